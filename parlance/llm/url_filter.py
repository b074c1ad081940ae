"""URL filters by a temporal list join.

Lists of addresses change: dated entries put a pattern on a list or take it off. They become
validity intervals, and every capture is judged by the entries that were active when it was
fetched - an as-of join on the patterns a capture can match: its host, each parent domain,
and each of these with every leading part of the path.

Time is cut into slots and an interval is spread over the slots it touches, so a capture
meets only intervals of its own slot, however often a pattern has come and gone. Slots have
the width of ``slot_days``; an interval that never ends is cut at the last capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh, small

DAY = 86_400


def host(url: Column) -> Column:
    """Host of an address in lower case, without user, port and closing stop; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"\.+$", "")), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", 1)


def patterns(url: Column) -> Column:
    """All patterns an address matches: domains from the host up, each alone and with leading path parts."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(path(url), "/"), lambda s: s != "")
    tails = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform(domains, lambda d: F.concat(F.array(d), F.transform(tails, lambda t: F.concat(d, t)))))
    return F.when(host(url).isNotNull(), F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, list, start, stop) from dated entries (pattern, list, ts, listed boolean); stop null: still active.

    Entries with a null in any of these are void. At one instant taking off wins over putting
    on; putting on what is on already, or off what is off, changes nothing.
    """
    dated = entries.dropna(subset=["pattern", "list", "ts", "listed"]).groupBy("pattern", "list", "ts").agg(F.min("listed").alias("listed"))
    line = W.partitionBy("pattern", "list").orderBy("ts")
    changes = dated.withColumn("was", F.lag("listed").over(line)).filter(F.col("was").isNull() | (F.col("was") != F.col("listed")))
    return changes.withColumn("stop", F.lead("ts").over(line)).filter("listed").select("pattern", "list", F.col("ts").alias("start"), "stop")


def evaluate(captures: DataFrame, entries: DataFrame, slot_days: int = 7) -> DataFrame:
    """All rows and columns of ``captures`` (url, fetched) with ``lists`` (sorted names of the lists
    that held a matching pattern when it was fetched), ``n_entries`` and ``blocked``.

    A null url or time, an address without a host and an empty list match nothing. An entry is
    active from its own instant until just before the one that takes it off. Repeated captures
    are judged one by one; columns named like the new ones are replaced.
    """
    kept = captures.drop("lists", "n_entries", "blocked")
    p = fresh(kept)
    slot = lambda ts: F.floor(F.unix_timestamp(ts.cast("timestamp")) / (slot_days * DAY))
    # one judgement per address and instant, so a hot address costs one
    asked = kept.select(F.col("url").alias("u"), F.col("fetched").alias("at")).dropna().distinct()
    newest = F.lit(asked.agg(slot(F.max("at"))).first()[0] or 0)  # one number: where intervals without an end stop
    ends = F.least(F.coalesce(slot(F.col("stop")), newest), newest)
    valid = intervals(entries).filter(slot(F.col("start")) <= newest).withColumn("slot", F.explode(F.sequence(slot(F.col("start")), ends)))
    met = (
        asked.select("u", "at", slot(F.col("at")).alias("slot"), F.explode(patterns(F.col("u"))).alias("pattern"))
        .join(small(valid), ["pattern", "slot"])
        .filter((F.col("start") <= F.col("at")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop"))))
        .groupBy("u", "at").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.count(F.lit(1)).alias("n_entries"))
        .withColumnsRenamed({"u": f"{p}u", "at": f"{p}at"})
    )
    return kept.join(met, (kept["url"] == met[f"{p}u"]) & (kept["fetched"] == met[f"{p}at"]), "left").select(
        *[kept[c] for c in kept.columns], F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), F.col("n_entries").isNotNull().alias("blocked"),
    )


# -- a dated list over the given tables -------------------------------------
START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def demo_captures(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Pages with the time of the event of the same number as the time they were fetched."""
    times = events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched"))
    return pages.select("page_id", "url").join(times, "page_id", "left")


def demo_entries(pages: DataFrame) -> DataFrame:
    """Entries for the domains (three labels) of the pages and their first path parts, on days read off a digest."""
    domain = F.regexp_extract("url", r"://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+\.[^./?#]+)/([^/?#]*)", 1)
    step = F.regexp_extract("url", r"://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+\.[^./?#]+)/([^/?#]*)", 2)
    names = pages.select(domain.alias("d"), step.alias("s")).filter("d != ''").distinct()
    names = names.select(F.col("d").alias("pattern")).unionByName(names.filter("s != ''").select(F.concat_ws("/", "d", "s").alias("pattern"))).distinct()
    byte = lambda i: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 2 * i + 1, 2), 16, 10).cast("int")
    day = lambda n: F.expr(START) + F.make_interval(days=n)
    dated = names.select("pattern", byte(0).alias("b0"), byte(1).alias("b1"), byte(2).alias("b2")).filter("b0 < 160").withColumn(
        "list", F.when(F.col("b0") < 64, "spam").when(F.col("b0") < 112, "malware").otherwise("adult")
    )
    on, off = F.col("b1") % 25, F.col("b1") % 25 + F.col("b2") % 9
    steps = F.array(
        F.struct(on.alias("day"), F.lit(True).alias("listed")),
        F.when(F.col("b2") < 200, F.struct(off.alias("day"), F.lit(False).alias("listed"))),
        F.when(F.col("b2") < 80, F.struct((off + 3).alias("day"), F.lit(True).alias("listed"))),
    )
    return dated.select("pattern", "list", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("e")).select(
        "pattern", "list", day(F.col("e.day")).alias("ts"), "e.listed"
    )


ORACLE = r"""
WITH hosts AS (
  SELECT page_id, url, regexp_extract(url, '://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+\.[^./?#]+)/([^/?#]*)', 1) AS d,
    regexp_extract(url, '://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+\.[^./?#]+)/([^/?#]*)', 2) AS s FROM pages
), names AS (
  SELECT d AS pattern FROM hosts WHERE d <> '' UNION SELECT d || '/' || s FROM hosts WHERE d <> '' AND s <> ''
), bytes AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 2))::INT AS b0, ('0x' || substr(md5(pattern), 3, 2))::INT AS b1, ('0x' || substr(md5(pattern), 5, 2))::INT AS b2 FROM names
), dated AS (
  SELECT pattern, CASE WHEN b0 < 64 THEN 'spam' WHEN b0 < 112 THEN 'malware' ELSE 'adult' END AS list, b1 % 25 AS day_on, b1 % 25 + b2 % 9 AS day_off, b2 FROM bytes WHERE b0 < 160
), entries AS (
  SELECT pattern, list, day_on AS day, true AS listed FROM dated
  UNION ALL SELECT pattern, list, day_off, false FROM dated WHERE b2 < 200
  UNION ALL SELECT pattern, list, day_off + 3, true FROM dated WHERE b2 < 80
), captures AS (
  SELECT h.page_id, h.url, e.ts, unnest(list_distinct([regexp_extract(h.url, '://([^/?#:]*)', 1), h.d, regexp_extract(h.url, '://([^/?#:]*)', 1) || '/' || h.s, h.d || '/' || h.s])) AS pattern
  FROM hosts h JOIN events e ON e.event_id = h.page_id
), latest AS (
  SELECT c.page_id, c.pattern, x.list, arg_max(x.listed, x.day * 2 + CASE WHEN x.listed THEN 0 ELSE 1 END) AS listed
  FROM captures c JOIN entries x ON c.pattern = x.pattern AND TIMESTAMP '2024-01-01' + to_days(x.day::INT) <= c.ts
  GROUP BY 1, 2, 3
), active AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM latest WHERE listed GROUP BY 1
)
SELECT p.page_id, p.url, coalesce(a.lists, '') AS lists, coalesce(a.n, 0)::BIGINT AS n_entries, a.n IS NOT NULL AS blocked
FROM pages p LEFT JOIN active a USING (page_id)
"""
