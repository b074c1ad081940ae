"""Benchmark decontamination with a distributed positional inverted index.

``index`` cuts all training texts into words and stores, for the words that matter to the
test items, every posting (word, document row, position). Which words matter is decided by
counts over the whole corpus: of every window of the test items its two rarest words. Their
posting lists, shifted by the word's place in the item, are intersected: only where both
stand at the right distance can the window occur. The places that are left are compared word
by word, so phrases are exact; ``near`` reports windows whose two rarest words stand within a
few words of their right distance. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = " "  # no word: stands behind the last word of every document, so its posting tells the length


def words(text: Column) -> Column:
    """Words of a text with only A-Z lowered; none for a null text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def row_key(doc_id: Column, text: Column) -> Column:
    """One number for rows that are equal in id and text; such rows have equal results."""
    return F.xxhash64(doc_id, text)


def test_items(items: DataFrame, window: int = 10) -> DataFrame:
    """``item_id``, ``words`` and ``size`` (words of a window) for distinct items with words."""
    return (
        items.select("item_id", words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0).distinct()
        .withColumn("size", F.least(F.size("words"), F.lit(window)))
        .withColumn("item_key", F.xxhash64("item_id", "words"))
    )


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_key, window start, the two rarest words of the window with their places).

    A window with a word that the corpus lacks cannot occur and is left out. A window of a
    single word has that word twice.
    """
    places = items.select("item_key", "size", F.posexplode("words").alias("place", "term"))
    ranked = (
        places.join(small(counts), "term", "left")
        .groupBy("item_key", "size")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("all"))
    )
    starts = F.sequence(F.lit(0), F.size("all") - F.col("size"))
    by_rarity = F.array_sort(
        F.transform(F.slice("all", F.col("start") + 1, F.col("size")), lambda x: F.struct(x["n"].alias("n"), x["place"].alias("place"), x["term"].alias("term")))
    )
    return (
        ranked.select("item_key", "size", "all", F.explode(starts).alias("start"))
        .select("item_key", "start", by_rarity.alias("w"))
        .filter(F.col("w")[0]["n"] > 0)
        .select(
            "item_key", "start",
            F.col("w")[0]["term"].alias("first"), F.col("w")[0]["place"].alias("first_place"),
            F.coalesce(F.get("w", F.lit(1))["term"], F.col("w")[0]["term"]).alias("second"),
            F.coalesce(F.get("w", F.lit(1))["place"], F.col("w")[0]["place"]).alias("second_place"),
        )
    )


class Index:
    """Stored postings of the test items' rarest words over all of ``docs``."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = 10):
        self.docs = docs.select("doc_id", "text")
        self.items = staged(test_items(items, window))
        tokens = self.docs.select(F.explode(words(F.col("text"))).alias("term"))
        vocabulary = self.items.select(F.explode("words").alias("term")).distinct()
        counts = tokens.join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.anchors = staged(anchors(self.items, counts))
        terms = self.anchors.select(F.explode(F.array("first", "second")).alias("term")).distinct()
        terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
        placed = self.docs.select(
            "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"),
            F.posexplode(F.array_append(words(F.col("text")), F.lit(END))).alias("at", "term"),
        )
        self.postings = staged(placed.join(small(terms), "term"))

    def lengths(self) -> DataFrame:
        """One row for each row of the documents: ``doc_id``, ``row``, ``n_words``."""
        return self.postings.filter(F.col("term") == END).select("doc_id", "row", F.col("at").cast("bigint").alias("n_words"))

    def lists(self, which: str) -> DataFrame:
        """Postings of the windows' rarest (``first``) or next word, shifted to the item's start."""
        words_of = self.anchors.select(F.col(which).alias("term"), "item_key", F.col(f"{which}_place").alias("place")).distinct()
        return self.postings.select("term", "row", "at").join(small(words_of), "term").select(
            "item_key", "row", (F.col("at") - F.col("place")).alias("shift"), "place"
        ).distinct()

    def candidates(self) -> DataFrame:
        """``row``, ``item_key``, ``shift`` where both rarest words of a window stand right."""
        pairs = self.anchors.select("item_key", "first_place", "second_place").distinct()
        first = self.lists("first").withColumnRenamed("place", "first_place").join(small(pairs), ["item_key", "first_place"])
        second = self.lists("second").withColumnRenamed("place", "second_place")
        return first.join(second, ["row", "item_key", "shift", "second_place"], "left_semi").select("row", "item_key", "shift").distinct()

    def near(self, slop: int = 5) -> DataFrame:
        """``row``, ``item_key``, ``start``: windows whose two rarest words stand up to ``slop``
        words closer or wider than in the item."""
        by_window = self.anchors.select("item_key", "start", "first_place", "second_place")
        width = slop + 1
        first = self.lists("first").withColumnRenamed("place", "first_place").join(small(by_window), ["item_key", "first_place"])
        first = first.withColumn("cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("shift") / width) + d)))
        second = self.lists("second").select("item_key", "row", F.col("place").alias("second_place"), F.col("shift").alias("other"))
        second = second.withColumn("cell", F.floor(F.col("other") / width))
        return (
            first.join(second, ["row", "item_key", "second_place", "cell"])
            .filter(F.abs(F.col("shift") - F.col("other")) <= slop)
            .select("row", "item_key", "start").distinct()
        )

    def phrases(self) -> DataFrame:
        """``row``, ``item_id``, ``at``: every word of a document inside an exact occurrence."""
        found = staged(self.candidates().groupBy("row").agg(F.collect_list(F.struct("item_key", "shift")).alias("places")))
        texts = self.docs.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).select("row", "text")
        spread = (
            texts.join(found, "row")
            .select("row", words(F.col("text")).alias("doc"), F.explode("places").alias("p"))
            .select("row", "doc", "p.*")
            .join(small(self.items, 20_000), "item_key")
        )
        starts = F.sequence(F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("words") - F.col("size"), F.size("doc") - F.col("size") - F.col("shift")))
        same = lambda i: F.slice("doc", F.col("shift") + i + 1, F.col("size")) == F.slice("words", i + 1, F.col("size"))
        last = F.least(F.size("words"), F.size("doc") - F.col("shift")) - F.col("size")  # a window ends in the item and the document
        possible = last >= F.greatest(F.lit(0), -F.col("shift"))  # else the sequence of starts would run down
        hits = spread.select("*", F.when(possible, starts).alias("starts")).filter(F.col("starts").isNotNull()).select(
            "row", "item_id", F.explode(F.filter("starts", same)).alias("start"), "shift", "size"
        )
        return hits.select(
            "row", "item_id", F.explode(F.sequence(F.col("shift") + F.col("start"), F.col("shift") + F.col("start") + F.col("size") - 1)).alias("at")
        ).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted texts), contaminated.

    Null texts have no words; items without words match nothing; equal rows get equal
    results; rows that share an id but not the text are told apart; an empty table gives no
    rows and an empty benchmark no hits.
    """
    at = Index(docs, items, window)
    hits = staged(at.phrases())
    verdict = hits.groupBy("row").agg(
        F.count_distinct("at").alias("n_hit"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"),
    )
    return at.lengths().join(verdict, "row", "left").select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of a test item; all columns stay."""
    key = fresh(docs)
    bad = contamination(docs, items, window).filter("contaminated").select(F.col("row").alias(key)).distinct()
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == bad[key], "left_anti")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), sizes AS (SELECT DISTINCT k FROM windows
), spots AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), hits AS (
  SELECT s.doc_id, s.k, s.i, m.item_id FROM spots s JOIN windows m ON s.k = m.k AND s.phrase = m.phrase
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
