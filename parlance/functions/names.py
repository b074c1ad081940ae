"""Column expressions for comparing and colouring names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# --- fixed values -----------------------------------------------------------
SATURATION, LIGHTNESS = 0.62, 0.54
# ----------------------------------------------------------------------------


def casefold(text: Column) -> Column:
    return F.lower(F.upper(text))


def fold(text: Column) -> Column:
    """Case-folded, single-spaced form used as a join key."""
    return squeeze(casefold(F.coalesce(text, F.lit(""))))


def name_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)))


def unquote(text: Column) -> Column:
    """Strips matching pairs of surrounding quotes, as often as they are nested.

    There are no more pairs than quotes in front.
    """
    rounds = F.greatest(F.lit(1), F.length(F.regexp_extract(text, "^[\\s\"'“‘]*", 0)))

    def strip(out: Column, _: Column) -> Column:
        paired = out.rlike("(?s)^(\".*\"|'.*'|“.*”|‘.*’)$") & (F.length(out) >= 2)
        return F.when(paired, F.trim(F.substring(out, F.lit(2), F.length(out) - 2))).otherwise(out)

    return F.aggregate(F.sequence(F.lit(1), rounds), F.trim(text), strip)


def stable_color(name: Column) -> Column:
    """A hex colour that depends on the name only: hash to hue, then HSL to RGB."""
    turn = F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    hue = turn * 6.0
    chroma = (1 - abs(2 * LIGHTNESS - 1)) * SATURATION
    second = F.lit(chroma) * (1 - F.abs(F.pmod(hue, F.lit(2.0)) - 1))
    base = LIGHTNESS - chroma / 2
    full, none = F.lit(chroma), F.lit(0.0)
    sector = F.floor(hue)

    def channel(*by_sector: Column) -> Column:
        value = F.when(sector == 0, by_sector[0])
        for k in range(1, 5):
            value = value.when(sector == k, by_sector[k])
        level = F.rint((value.otherwise(by_sector[5]) + base) * 255).cast("int")
        return F.lpad(F.hex(level), 2, "0")

    return F.concat(
        F.lit("#"),
        channel(full, second, none, none, second, full),
        channel(second, full, full, second, none, none),
        channel(none, none, second, full, full, second),
    )
