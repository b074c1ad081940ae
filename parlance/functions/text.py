"""Column expressions over message text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values, must equal the reference's for equal results -------------
STOP_WORDS = tuple(
    """
    the and for that you with this have are was but not all can your just its from they what when
    where will would there their about out get got into too very how why who him her his she himself
    herself them then than our ours were had has did does dont cant im ive id ill youre youve theyre
    weve isnt wasnt wont aint lol lmao yeah yep nah ok okay bro dude tho though like https http www
    com org net gg jpg jpeg png gif webp mp4 mov sticker video image images reply forwarded message
    messages
    """.split()
)
TOKEN_PATTERN = "[a-z]{3,}"
MENTION_PATTERN = "@([A-Za-z0-9_]+)"
URL_PATTERN = r"https?://[^\t\n\f\r ]+"
HOST_PATTERN = r"https?://([^/?#\t\n\f\r ]+)"
DOMAIN_ALIASES = {
    "youtube.com": ("youtu.be", "youtube.com", "www.youtube.com", "m.youtube.com"),
    "soundcloud.com": (
        "soundcloud.com",
        "www.soundcloud.com",
        "m.soundcloud.com",
        "on.soundcloud.com",
        "snd.sc",
        "api.soundcloud.com",
    ),
}
FACT_VERSIONS = {
    "fact_schema_version": "2",
    "tokenizer_version": "ascii-apostrophe-v1",
    "link_extractor_version": "http-host-v1",
    "mention_extractor_version": "ascii-handle-v1",
    "search_index_version": "lower-trigram-v1",
    "reaction_identity_version": "reaction-events-v2",
}
# ----------------------------------------------------------------------------

#: every character that counts as white space when words are split
SPACES = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_say(text: Column, *phrases: str) -> Column:
    """Whether one of the lower-case ``phrases`` can stand in the text for a pattern that ignores case.

    A few searches for plain bytes, so that long patterns need not be tried on texts without their words.
    """

    def said(folded: Column) -> Column:
        hit = F.contains(folded, F.lit(phrases[0]))
        for phrase in phrases[1:]:
            hit = hit | F.contains(folded, F.lit(phrase))
        return hit

    # what patterns take for i, k or s although lower case does not make one of it
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("\u212a"))
    return odd | let(F.lower(text), said)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def word_count(text: Column) -> Column:
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("int")


def char_count(text: Column) -> Column:
    return F.length(squeeze(F.coalesce(text, F.lit("")))).cast("int")


def tokens(text: Column) -> Column:
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'"), F.lit(""))
    return F.regexp_extract_all(plain, F.lit(TOKEN_PATTERN), F.lit(0))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_PATTERN), F.lit(0))


def hosts(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HOST_PATTERN), F.lit(1))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, HOST_PATTERN, 1)


def mentions(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MENTION_PATTERN), F.lit(1))
    return F.transform(found, lambda m: F.lower(m))


def canonical_domain(host: Column) -> Column:
    host = F.lower(host)
    out = None
    for domain, names in DOMAIN_ALIASES.items():
        out = (F if out is None else out).when(host.isin(*names), F.lit(domain))
    return out.otherwise(host)


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-cased text, in one linear pass.

    The look-ahead reads a piece, the dot moves on by one whole character.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))."), F.lit(1)))


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def normalise_word(word: str) -> str:
    """Letters a-z of a search word; fewer than three is an error."""
    letters = "".join(c for c in word.casefold() if "a" <= c <= "z")
    if len(letters) < 3:
        raise ValueError("Word must contain at least 3 letters")
    return letters


def name_key(name: Column) -> Column:
    """Key for comparing names: lower case, single blanks."""
    return F.lower(squeeze(F.coalesce(name, F.lit(""))))


def like_literal(q: str) -> str:
    """Pattern text for LIKE: % and _ stay wildcards, a backslash is plain text."""
    return "%" + q.replace("\\", "\\\\") + "%"
