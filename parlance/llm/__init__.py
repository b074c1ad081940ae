"""Operations of a training-data pipeline over crawled documents, pages and embeddings.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its
queries where it is present.
"""
