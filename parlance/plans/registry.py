"""Named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from ..model import Chat, Filters
from ..operators import (
    context, facts, history, links, overview, people, rankings, reactions, search, sessions, timelines, words,
)
from ..operators.scope import channel_dim, count_by, scope, shown_channel
from . import demo, oracle
from .oracle import DEFAULT, bucket, counted, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _flags(metric: str) -> dict:
    return {"counts": metric == "words", "conversations": metric == "conversations"}


def chat_query(run: Callable[[Chat], DataFrame], **flags) -> Query:
    return lambda spark, sf_dir: run(demo.demo_chat(spark, sf_dir, **flags))


def with_events(chat: Chat) -> Chat:
    """The chat with its reaction events, derived on the fly."""
    rows = chat.messages.join(channel_dim(chat).select("channel_id", "platform"), "channel_id")
    chat.reaction_events = reactions.reaction_events(rows, chat.platform_identities)
    return chat


def with_facts(chat: Chat) -> Chat:
    """The chat with content facts as tables of their own."""
    chat.tokens = facts.message_tokens(chat.messages)
    chat.links = facts.message_links(chat.messages)
    chat.mentions = facts.message_mentions(chat.messages)
    chat.trigrams = facts.message_trigrams(chat.messages)
    return chat


# -- scope ------------------------------------------------------------------
_SCOPE_COLUMNS = ["id", "person_id", "channel_name", "source_name", "platform"]
_SCOPE_SELECT = "SELECT id, person_id, channel_name, source_name, platform FROM scoped"
_NOT_SYSTEM = "NOT m.is_system AND m.id NOT IN ('10', '20', '400')"
_BOT = f"m.person_id NOT IN (SELECT id FROM people WHERE display_name IN ({oracle.BOTS}))"


def scope_query(name: str, filters: Filters, where: str, **kwargs) -> None:
    add(name, with_(_SCOPE_SELECT, where), chat_query(lambda c: scope(c, filters, **kwargs).select(*_SCOPE_COLUMNS)))


scope_query("scope_default", Filters(), DEFAULT)
scope_query(
    "scope_dates", Filters(date(2024, 1, 5), date(2024, 1, 12)),
    f"{DEFAULT} AND m.ts >= TIMESTAMP '2024-01-05' AND m.ts < TIMESTAMP '2024-01-13'",
)
scope_query("scope_people", Filters.parse(people="3, 7,42"), f"{DEFAULT} AND m.person_id IN (3, 7, 42)")
scope_query("scope_with_bots", Filters(include_bots=True), _NOT_SYSTEM)
scope_query("scope_theme", Filters(themes=(2,)), f"{DEFAULT} AND d.channel_name IN ('purchase', 'signup')")
scope_query("scope_unknown_theme", Filters(themes=(9,)), f"{DEFAULT} AND false")
scope_query(
    "scope_theme_by_names", Filters(themes=(1, 2)),
    f"{DEFAULT} AND (d.channel_name = 'click' OR (d.platform = 'facebook' AND d.channel_name = 'purchase'))",
    theme_match="names",
)
scope_query("scope_theme_stored", Filters(themes=(2, 3)), f"{DEFAULT} AND d.theme_id IN (2, 3)", theme_match="stored")
scope_query("scope_platform", Filters.parse(platforms="facebook, signal"), f"{DEFAULT} AND d.platform IN ('facebook', 'signal')")
scope_query("scope_with_system_and_excluded", Filters(), _BOT, system=True, excluded=True)

# -- time series ------------------------------------------------------------
_FULL = Filters(date(2024, 1, 5), date(2024, 1, 12), (), (2,), ("facebook", "signal"))
_FULL_SQL = (
    f"{DEFAULT} AND m.ts >= TIMESTAMP '2024-01-05' AND m.ts < TIMESTAMP '2024-01-13' "
    "AND d.channel_name IN ('purchase', 'signup') AND d.platform IN ('facebook', 'signal')"
)
for _metric in ("messages", "words", "conversations"):
    for _unit in ("day", "week", "month"):
        if _metric != "messages" and _unit == "week":
            continue
        add(
            f"messages_over_time_{_unit}_{_metric}",
            counted({"bucket": bucket(_unit)}, _metric),
            chat_query(lambda c, u=_unit, m=_metric: timelines.messages_over_time(c, granularity=u, metric=m), **_flags(_metric)),
        )
    _value, _cond = oracle.METRIC[_metric]
    add(
        f"platform_over_time_{_metric}",
        with_(
            f"SELECT g.bucket, g.platform, coalesce(k.n, 0) AS count FROM "
            f"(SELECT DISTINCT a.bucket, b.platform FROM k a, k b) g LEFT JOIN k ON k.bucket = g.bucket AND k.platform = g.platform",
            extra=f"k AS (SELECT {bucket('week')} AS bucket, platform, {_value} AS n FROM scoped WHERE {_cond} GROUP BY ALL)",
        ),
        chat_query(lambda c, m=_metric: timelines.platform_over_time(c, granularity="week", metric=m), **_flags(_metric)),
    )
    add(
        f"calendar_{_metric}", counted({"day": "CAST(ts AS DATE)"}, _metric),
        chat_query(lambda c, m=_metric: timelines.calendar(c, metric=m), **_flags(_metric)),
    )
    add(
        f"activity_heatmap_{_metric}",
        counted({"weekday": "CAST(EXTRACT(isodow FROM ts) AS BIGINT)", "hour": "CAST(EXTRACT(hour FROM ts) AS BIGINT)"}, _metric),
        chat_query(lambda c, m=_metric: timelines.activity_heatmap(c, metric=m), **_flags(_metric)),
    )
    add(
        f"messages_by_hour_{_metric}", counted({"hour": "CAST(EXTRACT(hour FROM ts) AS BIGINT)"}, _metric),
        chat_query(lambda c, m=_metric: timelines.messages_by_hour(c, metric=m), **_flags(_metric)),
    )
    add(
        f"messages_by_month_{_metric}", counted({"month": bucket("month")}, _metric),
        chat_query(lambda c, m=_metric: timelines.messages_by_month(c, metric=m), **_flags(_metric)),
    )
add(
    "messages_over_time_filtered", counted({"bucket": bucket("day")}, where=_FULL_SQL),
    chat_query(lambda c: timelines.messages_over_time(c, _FULL)),
)
add(
    "monthly_totals",
    counted({"month": bucket("month")}, "conversations"),
    chat_query(
        lambda c: timelines.monthly_totals(timelines.platform_over_time(c, metric="conversations")), conversations=True
    ),
)
_HEAT = (
    "heat AS (SELECT CAST(EXTRACT(isodow FROM ts) AS BIGINT) AS weekday, CAST(EXTRACT(hour FROM ts) AS BIGINT) AS hour, "
    "COUNT(DISTINCT conversation_id) AS n FROM scoped WHERE conversation_id IS NOT NULL GROUP BY ALL)"
)
add(
    "hourly_totals", with_("SELECT hour, CAST(SUM(n) AS BIGINT) AS message_count FROM heat GROUP BY hour", extra=_HEAT),
    chat_query(lambda c: timelines.hourly_totals(timelines.activity_heatmap(c, metric="conversations")), conversations=True),
)
add(
    "weekday_totals",
    with_(
        "SELECT w AS weekday, CAST(coalesce(SUM(n), 0) AS BIGINT) AS message_count FROM range(1, 8) r(w) "
        "LEFT JOIN heat ON weekday = w GROUP BY w", extra=_HEAT,
    ),
    chat_query(lambda c: timelines.weekday_totals(timelines.activity_heatmap(c, metric="conversations")), conversations=True),
)

# -- overview ---------------------------------------------------------------
for _metric in ("messages", "words", "conversations"):
    _value, _cond = oracle.METRIC[_metric]
    add(
        f"overview_total_{_metric}",
        with_(
            f"SELECT {_value} AS total_messages, MIN(ts) AS start_ts, MAX(ts) AS end_ts, CAST({_value} AS DOUBLE) / "
            f"greatest(date_diff('day', MIN(ts), MAX(ts)) + 1, 1) AS average_per_day FROM scoped WHERE {_cond}"
        ),
        chat_query(lambda c, m=_metric: overview.total_and_range(c, metric=m), **_flags(_metric)),
    )
    add(
        f"overview_people_{_metric}",
        with_(
            f"SELECT p.id, p.display_name, p.color, {_value} AS message_count FROM scoped s JOIN people p ON p.id = s.person_id "
            f"WHERE {_cond} GROUP BY ALL"
        ),
        chat_query(lambda c, m=_metric: overview.people_ranking(c, metric=m), **_flags(_metric)),
    )
    add(
        f"most_active_{_metric}",
        with_(
            " UNION ALL ".join(
                f"(SELECT '{u}' AS granularity, {bucket(u)} AS bucket, {_value} AS count FROM scoped WHERE {_cond} "
                "GROUP BY ALL ORDER BY count DESC, bucket LIMIT 1)"
                for u in ("year", "month", "day", "hour")
            )
        ),
        chat_query(lambda c, m=_metric: overview.most_active(c, metric=m), **_flags(_metric)),
    )


def _kind(name: str, cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


_PATH = "lower(regexp_replace(split_part(coalesce(attachment_preview, ''), '?', 1), '#.*$', ''))"
_ALL_EXT = "|".join(overview.EXTENSIONS.values())
add(
    "message_kinds",
    with_(
        "SELECT COUNT(*) AS total_messages, "
        + ", ".join(
            [
                _kind("with_text", "trim(coalesce(content, '')) <> ''"),
                _kind("with_links", r"regexp_matches(content, '(https?://|www\.)')"),
                *[
                    _kind(k, rf"attachment_count > 0 AND regexp_matches({_PATH}, '\.({e})$')")
                    for k, e in overview.EXTENSIONS.items()
                ],
                _kind("with_stickers", f"attachment_count > 0 AND {_PATH} LIKE '%sticker%'"),
                _kind(
                    "with_other_files",
                    rf"attachment_count > 0 AND NOT regexp_matches({_PATH}, '\.({_ALL_EXT})$') AND {_PATH} NOT LIKE '%sticker%'",
                ),
                _kind("edited_messages", "is_edited"),
            ]
        )
        + " FROM scoped"
    ),
    chat_query(overview.message_kinds, text=True),
)
add(
    "longest_gap",
    with_(
        "SELECT date_diff('second', prev_ts, ts) AS gap_seconds, prev_ts, ts FROM "
        "(SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM scoped) WHERE prev_ts IS NOT NULL "
        "ORDER BY gap_seconds DESC, prev_ts LIMIT 1"
    ),
    chat_query(overview.silent_gap),
)
_SESSION_CTE = (
    "ordered AS (SELECT id, ts, lag(ts) OVER (ORDER BY ts, id) AS prev FROM scoped), "
    "grouped AS (SELECT id, ts, SUM(CASE WHEN prev IS NULL OR date_diff('minute', prev, ts) > 15 THEN 1 ELSE 0 END) "
    "OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session_id FROM ordered), "
    "sess AS (SELECT CAST(session_id AS BIGINT) AS session_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, "
    "arg_min(id, ts) AS start_message_id FROM grouped GROUP BY session_id)"
)
add(
    "longest_session",
    with_(
        "SELECT date_diff('second', start_ts, end_ts) AS duration_seconds, start_message_id FROM sess "
        "ORDER BY duration_seconds DESC, start_ts LIMIT 1", extra=_SESSION_CTE,
    ),
    chat_query(overview.active_session),
)
add(
    "activity_sessions",
    with_(
        "SELECT session_id, start_ts, end_ts, start_message_id, date_diff('second', start_ts, end_ts) AS duration_seconds FROM sess",
        extra=_SESSION_CTE,
    ),
    chat_query(
        lambda c: sessions.with_start_message(sessions.activity_sessions(scope(c).select("id", "ts")), scope(c).select("id", "ts"))
    ),
)
add(
    "conversation_summary",
    with_(
        "SELECT COUNT(*) AS conversation_count, round(AVG(n), 9) AS avg_messages, MAX(n) AS longest_conversation FROM "
        "(SELECT conversation_id, COUNT(*) AS n FROM scoped WHERE conversation_id IS NOT NULL GROUP BY 1)"
    ),
    chat_query(
        lambda c: overview.conversation_summary(c).withColumn("avg_messages", F.round("avg_messages", 9)), conversations=True
    ),
)
add(
    "conversation_table",
    f"WITH {oracle._MESSAGES} SELECT conversation_id AS id, channel_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, "
    "COUNT(*) AS message_count, COUNT(DISTINCT person_id) AS participant_count "
    "FROM messages GROUP BY ALL",
    chat_query(lambda c: sessions.conversation_table(c.messages), conversations=True),
)
add(
    "message_conversations",
    f"WITH {oracle._MESSAGES} SELECT id, conversation_id FROM messages",
    chat_query(lambda c: c.messages.select("id", "conversation_id"), conversations=True),
)

# -- rankings ---------------------------------------------------------------
for _metric in ("messages", "words", "conversations"):
    _value, _cond = oracle.METRIC[_metric]
    add(
        f"top_people_{_metric}",
        with_(
            f"SELECT p.id, p.display_name, p.color, {_value} AS message_count FROM scoped s JOIN people p ON p.id = s.person_id "
            f"WHERE {_cond} GROUP BY ALL ORDER BY message_count DESC, display_name LIMIT 10"
        ),
        chat_query(lambda c, m=_metric: rankings.top_people(c, metric=m), **_flags(_metric)),
    )
    add(
        f"top_chats_{_metric}",
        with_(
            f"SELECT s.channel_id AS id, CASE WHEN s.channel_name = 'purchase' THEN 'Shopping' ELSE s.channel_name END AS name, "
            f"t.name AS theme_name, {_value} AS message_count FROM scoped s JOIN themes t ON t.id = s.theme_id "
            f"WHERE {_cond} GROUP BY ALL ORDER BY message_count DESC, name LIMIT 10"
        ),
        chat_query(lambda c, m=_metric: rankings.top_chats(c, metric=m), **_flags(_metric)),
    )
    add(
        f"top_themes_{_metric}",
        with_(
            f"SELECT CAST(0 AS INT) AS id, CASE WHEN channel_name IN ('click', 'error') THEN 'alerts' WHEN channel_name IN "
            f"('purchase', 'signup') THEN 'money' ELSE 'browsing' END AS name, {_value} AS message_count FROM scoped "
            f"WHERE {_cond} GROUP BY ALL"
        ),
        chat_query(lambda c, m=_metric: rankings.top_themes(c, metric=m), **_flags(_metric)),
    )
add(
    "most_mentioned",
    with_(
        "SELECT '@' || mention AS mention, COUNT(*) AS count FROM mentions GROUP BY 1 ORDER BY count DESC, mention LIMIT 200",
        extra=oracle.MENTION_CTE,
    ),
    chat_query(links.most_mentioned, text=True),
)
add(
    "reaction_authors",
    with_(
        "SELECT p.id, p.display_name, p.color, CAST(SUM(reaction_count) AS BIGINT) AS count FROM scoped s "
        "JOIN people p ON p.id = s.person_id GROUP BY ALL HAVING SUM(reaction_count) > 0 ORDER BY count DESC, display_name LIMIT 15"
    ),
    chat_query(reactions.reaction_authors),
)
add(
    "reactions_over_time",
    with_(
        f"SELECT {bucket('month')} AS bucket, CAST(SUM(coalesce(reaction_count, 0)) AS BIGINT) AS reaction_count, "
        "COUNT(*) AS message_count, CAST(SUM(CASE WHEN reaction_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS reacted_message_count, "
        "CAST(SUM(coalesce(reaction_count, 0)) AS DOUBLE) / COUNT(*) AS reactions_per_message FROM scoped GROUP BY 1"
    ),
    chat_query(reactions.reactions_over_time),
)
_EVENT_SCOPE = f"{oracle.REACTION_CTE}, ev AS (SELECT r.*, s.source_name FROM reaction_events r JOIN scoped s ON s.id = r.message_id)"
add(
    "reaction_events",
    with_("SELECT * FROM reaction_events", extra=oracle.REACTION_CTE),
    chat_query(lambda c: with_events(c).reaction_events.drop("emoji_id")),
)
add(
    "reaction_coverage",
    with_(
        "SELECT COUNT(*) AS total_reactions, COUNT(reactor_raw_id) AS identified_reactions, COUNT(reactor_person_id) AS "
        "resolved_reactions, CAST(COUNT(reactor_raw_id) AS DOUBLE) / COUNT(*) AS identity_coverage FROM ev", extra=_EVENT_SCOPE,
    ),
    chat_query(lambda c: reactions.reaction_coverage(with_events(c))),
)
add(
    "top_reactors",
    with_(
        "SELECT p.id, p.display_name, p.color, COUNT(*) AS count FROM ev JOIN people p ON p.id = ev.reactor_person_id "
        "GROUP BY ALL ORDER BY count DESC, display_name LIMIT 20", extra=_EVENT_SCOPE,
    ),
    chat_query(lambda c: reactions.top_reactors(with_events(c))),
)
_TOP_REACTED = (
    "SELECT s.id, s.ts, trim(coalesce(content, '')) AS content, attachment_preview, p.display_name AS person_name, "
    "p.color AS person_color, CASE WHEN channel_name = 'purchase' THEN 'Shopping' ELSE channel_name END AS channel_name, "
    "source_name, CAST(reaction_count AS BIGINT) AS reaction_count, reaction_summary, true AS has_more "
    "FROM scoped s JOIN people p ON p.id = s.person_id WHERE reaction_count > 0 ORDER BY reaction_count DESC, ts DESC, s.id DESC"
)
add("top_reacted_messages", with_(f"{_TOP_REACTED} LIMIT 6"), chat_query(reactions.top_reacted_messages, text=True))
add(
    "top_reacted_messages_page", with_(f"{_TOP_REACTED} LIMIT 25 OFFSET 25"),
    chat_query(lambda c: reactions.top_reacted_messages(c, limit=25, offset=25), text=True),
)
add(
    "emoji_usage",
    with_(
        "SELECT emoji AS name, COUNT(*) AS count, MIN(image_url) AS image_url, MIN(CASE WHEN image_url IS NOT NULL THEN "
        "source_name END) AS source_name FROM ev WHERE emoji <> 'unknown' GROUP BY 1 ORDER BY count DESC, name LIMIT 30",
        extra=_EVENT_SCOPE,
    ),
    chat_query(lambda c: reactions.emoji_usage(with_events(c))),
)
add(
    "emoji_usage_live",
    with_(
        "SELECT trim(x.name) AS name, CAST(SUM(x.n) AS BIGINT) AS count, MIN(x.image_url) AS image_url, "
        "MIN(CASE WHEN x.image_url IS NOT NULL THEN s.source_name END) AS source_name "
        "FROM listed l JOIN scoped s ON s.id = l.id "
        "WHERE trim(x.name) <> '' AND x.n > 0 AND (coalesce(s.reaction_details_json, '') = '' OR json_valid(s.reaction_details_json)) "
        "GROUP BY 1 ORDER BY count DESC, name LIMIT 30", extra=_EVENT_SCOPE,
    ),
    chat_query(reactions.emoji_usage_live),
)
_MEMBER = (
    f"ev AS (SELECT e.*, d.channel_name, d.source_name, d.platform FROM ({demo.MEMBER_EVENTS}) e JOIN channel_dim d USING (channel_id))"
)
for _col, _name in (("actor_person_id", "actor"), ("target_person_id", "target")):
    add(
        f"member_events_by_{_name}",
        with_(
            f"SELECT MIN(p.id) AS id, MIN(p.display_name) AS display_name, MIN(p.color) AS color, COUNT(*) AS count "
            f"FROM ev JOIN people p ON p.id = ev.{_col} WHERE kind = 'removed' AND (actor_person_id IN (1, 2, 3, 4) OR "
            "target_person_id IN (1, 2, 3, 4)) GROUP BY lower(trim(p.display_name)) ORDER BY count DESC, MIN(p.display_name) LIMIT 10",
            extra=_MEMBER,
        ),
        chat_query(
            lambda c, n=_name: getattr(rankings, f"member_events_by_{n}")(c, Filters(people=(1, 2, 3, 4)), "removed")
        ),
    )
add(
    "member_events_by_chat",
    with_(
        "SELECT channel_id AS id, CASE WHEN channel_name = 'purchase' THEN 'Shopping' ELSE channel_name END AS name, source_name, "
        "platform, COUNT(*) AS count FROM ev GROUP BY ALL ORDER BY count DESC, name LIMIT 10", extra=_MEMBER,
    ),
    chat_query(rankings.member_events_by_chat),
)

# -- facts ------------------------------------------------------------------
_BARE = f"WITH messages AS ({demo.MESSAGES_TEXT}) "
add(
    "message_word_counts",
    f"WITH {oracle._MESSAGES} SELECT id, word_count, char_count FROM messages",
    chat_query(lambda c: c.messages.select("id", "word_count", "char_count"), counts=True),
)
add(
    "message_tokens",
    _BARE + f"SELECT id AS message_id, CAST(i - 1 AS INT) AS token_index, token FROM (SELECT id, unnest({oracle.TOKENS}) AS token, "
    f"generate_subscripts({oracle.TOKENS}, 1) AS i FROM messages)",
    chat_query(lambda c: facts.message_tokens(c.messages), text=True),
)
_URLS = "regexp_extract_all(coalesce(content, ''), 'https?://[^\\s]+')"
add(
    "message_links",
    _BARE + f"SELECT id AS message_id, CAST(i - 1 AS INT) AS link_index, raw_url, raw_host, {oracle.domain('raw_host')} AS domain "
    "FROM (SELECT *, regexp_extract(raw_url, 'https?://([^/?#\\s]+)', 1) AS raw_host FROM "
    f"(SELECT id, unnest({_URLS}) AS raw_url, generate_subscripts({_URLS}, 1) AS i FROM messages)) WHERE raw_host <> ''",
    chat_query(lambda c: facts.message_links(c.messages), text=True),
)
_MENTIONS = "regexp_extract_all(coalesce(content, ''), '@([A-Za-z0-9_]+)', 1)"
add(
    "message_mentions",
    _BARE + f"SELECT id AS message_id, CAST(i - 1 AS INT) AS mention_index, lower(m) AS mention FROM "
    f"(SELECT id, unnest({_MENTIONS}) AS m, generate_subscripts({_MENTIONS}, 1) AS i FROM messages)",
    chat_query(lambda c: facts.message_mentions(c.messages), text=True),
)
add(
    "message_search_trigrams",
    _BARE + "SELECT DISTINCT id AS message_id, chars[i] || chars[i + 1] || chars[i + 2] AS gram FROM "
    "(SELECT id, chars, unnest(range(1, len(chars) - 1)) AS i FROM "
    "(SELECT id, string_split(lower(content), '') AS chars FROM messages WHERE length(content) >= 3))",
    chat_query(lambda c: facts.message_trigrams(c.messages), text=True),
)

# -- words ------------------------------------------------------------------
_TOP_WORDS = (
    f"SELECT token AS word, COUNT(*) AS count FROM tokens WHERE token NOT IN ({oracle.STOP}) GROUP BY 1 ORDER BY count DESC, word"
)
add("top_words", with_(f"{_TOP_WORDS} LIMIT 200", extra=oracle.TOKEN_CTE), chat_query(words.top_words, text=True))
add(
    "top_words_stored_facts", with_(f"{_TOP_WORDS} LIMIT 200", extra=oracle.TOKEN_CTE),
    chat_query(lambda c: words.top_words(with_facts(c)), text=True),
)
add(
    "all_words_containing",
    with_(
        f"SELECT token AS word, COUNT(*) AS count FROM tokens WHERE token NOT IN ({oracle.STOP}) AND token LIKE '%tion%' GROUP BY 1",
        extra=oracle.TOKEN_CTE,
    ),
    chat_query(lambda c: words.top_words(c, q=" Tion ", limit=None), text=True),
)
_WORD = "the"
add(
    "word_over_time",
    with_(
        f"SELECT {bucket('month')} AS month, COUNT(*) FILTER (WHERE token = '{_WORD}') AS count, COUNT(*) AS total_words, "
        f"round(COUNT(*) FILTER (WHERE token = '{_WORD}') / COUNT(*) * 100, 4) AS percent FROM tokens GROUP BY 1",
        extra=oracle.TOKEN_CTE,
    ),
    chat_query(lambda c: words.word_over_time(c, "T'he!"), text=True),
)
add(
    "word_people",
    with_(
        f"SELECT p.id, p.display_name, p.color, COUNT(*) AS count FROM tokens t JOIN people p ON p.id = t.person_id "
        f"WHERE token = '{_WORD}' GROUP BY ALL ORDER BY count DESC, display_name LIMIT 10", extra=oracle.TOKEN_CTE,
    ),
    chat_query(lambda c: words.word_people(c, _WORD), text=True),
)
add(
    "word_people_stored_facts",
    with_(
        f"SELECT p.id, p.display_name, p.color, COUNT(*) AS count FROM tokens t JOIN people p ON p.id = t.person_id "
        f"WHERE token = '{_WORD}' GROUP BY ALL ORDER BY count DESC, display_name LIMIT 10", extra=oracle.TOKEN_CTE,
    ),
    chat_query(lambda c: words.word_people(with_facts(c), _WORD), text=True),
)
add(
    "most_mentioned_stored_facts",
    with_(
        "SELECT '@' || mention AS mention, COUNT(*) AS count FROM mentions GROUP BY 1 ORDER BY count DESC, mention LIMIT 200",
        extra=oracle.MENTION_CTE,
    ),
    chat_query(lambda c: links.most_mentioned(with_facts(c)), text=True),
)
add(
    "word_chats",
    with_(
        "SELECT channel_id AS id, CASE WHEN channel_name = 'purchase' THEN 'Shopping' ELSE channel_name END AS name, source_name, "
        f"COUNT(*) AS count FROM tokens WHERE token = '{_WORD}' GROUP BY ALL ORDER BY count DESC, name LIMIT 10",
        extra=oracle.TOKEN_CTE,
    ),
    chat_query(lambda c: words.word_chats(c, _WORD), text=True),
)
_EXAMPLE = (
    "SELECT DISTINCT {s}.id AS message_id, {s}.ts, {s}.content, p.display_name AS person_name, p.color AS person_color, "
    "CASE WHEN channel_name = 'purchase' THEN 'Shopping' ELSE channel_name END AS channel_name, source_name FROM {s} "
    "JOIN people p ON p.id = {s}.person_id WHERE {cond} ORDER BY ts {way}, message_id {way} LIMIT {page}"
)
_KEEP_TOKENS = f"words AS (SELECT *, unnest({oracle.TOKENS}) AS token FROM scoped)"
add(
    "word_examples",
    with_(_EXAMPLE.format(s="words", cond=f"token = '{_WORD}'", way="DESC", page="6 OFFSET 6"), extra=_KEEP_TOKENS),
    chat_query(lambda c: words.word_examples(c, _WORD, limit=6, offset=6), text=True),
)
add(
    "word_first_message",
    with_(_EXAMPLE.format(s="words", cond=f"token = '{_WORD}'", way="ASC", page="1"), extra=_KEEP_TOKENS),
    chat_query(lambda c: words.word_first_message(with_facts(c), _WORD), text=True),
)

# -- links ------------------------------------------------------------------
add(
    "linked_domains",
    with_("SELECT domain, COUNT(*) AS count FROM links GROUP BY 1 ORDER BY count DESC, domain LIMIT 200", extra=oracle.LINK_CTE),
    chat_query(links.linked_domains, text=True),
)
add(
    "linked_domains_stored_facts",
    with_("SELECT domain, COUNT(*) AS count FROM links GROUP BY 1 ORDER BY count DESC, domain LIMIT 200", extra=oracle.LINK_CTE),
    chat_query(lambda c: links.linked_domains(with_facts(c)), text=True),
)
def _first_domain_examples(c: Chat) -> DataFrame:
    """Examples of the first domain in order, whichever the tables hold."""
    first = links.linked_domains(c, limit=None).agg(F.min("domain")).first()[0]
    return links.domain_examples(c, f" {first.upper()} ")


add(
    "domain_examples",
    with_(_EXAMPLE.format(s="links", cond="domain = (SELECT MIN(domain) FROM links)", way="DESC", page="6"), extra=oracle.LINK_CTE),
    chat_query(_first_domain_examples, text=True),
)
add(
    "links_by_author",
    with_(
        "SELECT p.id, p.display_name, p.color, COUNT(*) AS count FROM links l JOIN people p ON p.id = l.person_id GROUP BY ALL "
        "ORDER BY count DESC, display_name LIMIT 15", extra=oracle.LINK_CTE,
    ),
    chat_query(links.links_by_author, text=True),
)
_SHOWN_RE = r"""\bhttps?://[^\s<>"'']+"""
add(
    "message_shown_links",
    _BARE
    + f", found AS (SELECT id, content, [regexp_replace(u, '[)\\].,!?;:]+$', '') for u in regexp_extract_all(coalesce(content, ''), '{_SHOWN_RE}', 0, 'i')] AS urls FROM messages), "
    "kept AS (SELECT id, content, list_filter(urls, lambda u, i: length(u) >= 8 AND list_position(urls, u) = i)[1:2] AS links FROM found) "
    "SELECT id, to_json(links) AS links, CASE WHEN len(links) = 0 THEN coalesce(content, '') ELSE "
    "trim(regexp_replace(list_reduce(list_prepend(content, links), lambda a, u: replace(a, u, '')), '[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]{2,}', ' ', 'g')) END AS text "
    "FROM kept",
    chat_query(
        lambda c: links.message_links_view(c.messages).select("id", F.to_json("links").alias("links"), "text"), text=True
    ),
)
add(
    "attachment_kinds",
    _BARE + "SELECT id, CASE WHEN attachment_preview IS NULL THEN NULL WHEN regexp_matches(lower(attachment_preview), "
    "'\\.(png|jpe?g|gif|webp|bmp|svg)(\\?|#|$)') THEN 'image' WHEN regexp_matches(lower(attachment_preview), "
    "'\\.(mp4|mov|webm|m4v)(\\?|#|$)') THEN 'video' ELSE 'label' END AS kind FROM messages",
    chat_query(lambda c: c.messages.select("id", links.attachment_kind(F.col("attachment_preview")).alias("kind"))),
)

# -- search -----------------------------------------------------------------
_ALL_BUT_EXCLUDED = "m.id NOT IN ('10', '20', '400')"
_PAGE = (
    "SELECT s.id, ts, content, p.display_name AS person_name, p.color AS person_color, channel_name, source_name, platform "
    "FROM scoped s LEFT JOIN people p ON p.id = s.person_id WHERE {cond} ORDER BY ts DESC, s.id DESC LIMIT 20 OFFSET {offset}"
)
for _name, _q, _cond, _offset in (
    ("search_ascii", "The TH", "content ILIKE '%The TH%'", 0),
    ("search_wildcard", "th_n%sh", "content ILIKE '%th_n%sh%'", 20),
    ("search_short", "ZU", "content ILIKE '%ZU%'", 0),
    ("search_non_ascii", "üch", "content LIKE '%üch%'", 0),
    ("search_backslash", "a\\b", r"content ILIKE '%a\b%'", 0),
):
    add(
        _name, with_(_PAGE.format(cond=_cond, offset=_offset), _ALL_BUT_EXCLUDED),
        chat_query(lambda c, q=_q, o=_offset: search.search(c, q, offset=o), text=True),
    )
    add(
        f"{_name}_total", with_(f"SELECT COUNT(*) AS total FROM scoped WHERE {_cond}", _ALL_BUT_EXCLUDED),
        chat_query(lambda c, q=_q: search.search_total(c, q), text=True),
    )
add(
    "search_through_index", with_("SELECT id, ts FROM scoped WHERE content ILIKE '%tion the%'", _ALL_BUT_EXCLUDED),
    chat_query(lambda c: search.search_matches(with_facts(c), "tion THE").select("id", "ts"), text=True),
)
add(
    "messages_with_grams",
    _BARE + "SELECT id FROM messages WHERE length(content) >= 3 AND contains(lower(content), 'the') AND contains(lower(content), 'ion')",
    chat_query(lambda c: search.messages_with_grams(facts.message_trigrams(c.messages), ["ion", "the"]), text=True),
)

# -- people -----------------------------------------------------------------
_STATS = f"""
word_freq AS (SELECT person_id, token AS word, COUNT(*) AS n FROM tokens WHERE token NOT IN ({oracle.STOP}) GROUP BY ALL),
totals AS (SELECT person_id, CAST(SUM(n) AS BIGINT) AS total_words, COUNT(*) AS unique_words FROM word_freq GROUP BY 1),
entropy AS (
  SELECT f.person_id, round(-SUM((f.n * 1.0 / t.total_words) * log2(f.n * 1.0 / t.total_words)), 4) + 0.0 AS word_entropy
  FROM word_freq f JOIN totals t USING (person_id) GROUP BY 1
),
breadth AS (
  SELECT person_id, COUNT(*) AS message_count, COUNT(DISTINCT channel_id) AS channel_count,
    COUNT(DISTINCT theme_id) AS theme_count, COUNT(DISTINCT platform) AS platform_count FROM scoped GROUP BY 1
),
shares AS (
  SELECT person_id, channel_id, n / SUM(n) OVER (PARTITION BY person_id) AS share
  FROM (SELECT person_id, channel_id, COUNT(*) * 1.0 AS n FROM scoped GROUP BY 1, 2)
),
hhi AS (SELECT person_id, round(SUM(CAST(share AS DOUBLE) * CAST(share AS DOUBLE)), 4) AS channel_hhi FROM shares GROUP BY 1),
alone AS (
  SELECT person_id, COUNT(*) AS exclusive_word_count FROM word_freq a
  WHERE NOT EXISTS (SELECT 1 FROM word_freq b WHERE b.word = a.word AND b.person_id <> a.person_id) GROUP BY 1
)"""
_STATS_TEXT = f"{oracle.TOKEN_CTE},{_STATS}"


def _breadth(c: Chat) -> DataFrame:
    return people.breadth(scope(c)).withColumn("channel_hhi", F.round("channel_hhi", 4))


add(
    "person_breadth", with_("SELECT * FROM breadth JOIN hhi USING (person_id)", extra=_STATS_TEXT), chat_query(_breadth),
)
add(
    "person_vocabulary", with_("SELECT * FROM totals JOIN entropy USING (person_id)", extra=_STATS_TEXT),
    chat_query(
        lambda c: people.vocabulary(people.word_counts(c, scope(c))).withColumn(
            "word_entropy", F.round("word_entropy", 4) + 0.0
        ),
        text=True,
    ),
)
add(
    "person_exclusive_counts", with_("SELECT * FROM alone", extra=_STATS_TEXT),
    chat_query(
        lambda c: people.exclusive(people.words_said(c, scope(c))).groupBy("person_id").agg(
            F.count(F.lit(1)).alias("exclusive_word_count")
        ),
        text=True,
    ),
)
#: one walk over the words of everybody, word by word, in both directions
_MTLD = f"""
ranked AS (
  SELECT person_id, token, row_number() OVER (PARTITION BY person_id ORDER BY ts, id, i) AS p,
    COUNT(*) OVER (PARTITION BY person_id) AS n
  FROM (SELECT person_id, ts, id, unnest({oracle.TOKENS}) AS token, generate_subscripts({oracle.TOKENS}, 1) AS i FROM scoped)
  WHERE token NOT IN ({oracle.STOP})
),
listed AS (SELECT person_id, list(token ORDER BY p) AS f, list(token ORDER BY p DESC) AS b FROM ranked GROUP BY 1),
ways AS (SELECT person_id, f AS w FROM listed UNION ALL SELECT person_id, b AS w FROM listed),
walked AS (
  SELECT person_id, len(w) AS n,
    list_reduce([{{'t': CAST([] AS VARCHAR[]), 'c': 0, 'k': 0, 'w': ''}}] || [{{'t': CAST([] AS VARCHAR[]), 'c': 0, 'k': 0, 'w': x}} for x in w],
      lambda a, x: CASE
        WHEN (len(a.t) + (CASE WHEN list_contains(a.t, x.w) THEN 0 ELSE 1 END)) / (a.c + 1) <= 0.72
          THEN {{'t': CAST([] AS VARCHAR[]), 'c': 0, 'k': a.k + 1, 'w': ''}}
        ELSE {{'t': CASE WHEN list_contains(a.t, x.w) THEN a.t ELSE list_append(a.t, x.w) END, 'c': a.c + 1, 'k': a.k, 'w': ''}} END) AS s
  FROM ways
),
scored AS (
  SELECT person_id, n, s.k + CASE WHEN s.c > 0 THEN (1.0::DOUBLE - len(s.t)::DOUBLE / s.c) / (1.0::DOUBLE - 0.72::DOUBLE) ELSE 0 END AS factors FROM walked
),
mtld AS (
  SELECT person_id, round(SUM(CASE WHEN n = 1 THEN 1.0 WHEN factors = 0 THEN n ELSE n / factors END) / 2, 2) AS mtld FROM scored GROUP BY 1
)"""
add(
    "person_mtld", with_("SELECT * FROM mtld", extra=_MTLD.lstrip()),
    chat_query(
        lambda c: people.mtld(scope(c)).select("person_id", F.round("mtld", 2).alias("mtld")), text=True
    ),
)
_DIVERSITY = """SELECT b.person_id, b.message_count, coalesce(t.unique_words, 0) AS unique_words,
  coalesce(t.total_words, 0) AS total_words, coalesce(e.word_entropy, 0.0) AS word_entropy,
  coalesce(a.exclusive_word_count, 0) AS exclusive_word_count, b.channel_count, b.theme_count, b.platform_count, h.channel_hhi,
  coalesce(m.mtld, 0.0::DOUBLE) AS mtld
FROM breadth b LEFT JOIN mtld m USING (person_id) LEFT JOIN totals t USING (person_id) LEFT JOIN entropy e USING (person_id)
LEFT JOIN alone a USING (person_id) LEFT JOIN hhi h USING (person_id)"""
add(
    "person_stats_stored", with_(_DIVERSITY, "NOT m.is_system", extra=_STATS_TEXT + "," + _MTLD),
    chat_query(
        lambda c: people.person_stats(c).withColumn("mtld", F.round("mtld", 2))
        .withColumn("word_entropy", F.round("word_entropy", 4) + 0.0).withColumn("channel_hhi", F.round("channel_hhi", 4)),
        text=True,
    ),
)
add(
    "person_diversity_live",
    with_(
        f"SELECT p.id, p.display_name, p.color, CASE p.id WHEN 3 THEN 'https://example.org/3.png' ELSE '' END AS avatar, "
        f"d.* EXCLUDE (person_id), 'live' AS source FROM ({_DIVERSITY}) d JOIN people p ON p.id = d.person_id "
        "WHERE p.display_name IN ('User 3', 'User 5')",
        f"{DEFAULT} AND d.channel_name IN ('purchase', 'signup', 'view')", extra=_STATS_TEXT + "," + _MTLD,
    ),
    chat_query(lambda c: people.person_diversity(c, Filters(themes=(2, 3))), text=True),
)
add(
    "exclusive_words",
    with_(
        "SELECT word, false AS in_dictionary, false AS truncated FROM word_freq a WHERE person_id = 3 AND NOT EXISTS (SELECT 1 FROM word_freq b WHERE "
        "b.word = a.word AND b.person_id <> a.person_id)", extra=_STATS_TEXT,
    ),
    chat_query(lambda c: people.exclusive_words(c, 3), text=True),
)


def _exclusive_with_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    word_list = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")
    )
    return people.exclusive_words(demo.demo_chat(spark, sf_dir, text=True), 3, dictionary=word_list)


add(
    "exclusive_words_dictionary",
    with_(
        "SELECT word, word IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) AS in_dictionary, false AS truncated "
        "FROM word_freq a WHERE person_id = 3 AND NOT EXISTS (SELECT 1 FROM word_freq b WHERE "
        "b.word = a.word AND b.person_id <> a.person_id)", extra=_STATS_TEXT,
    ),
    _exclusive_with_dictionary,
)
add(
    "people_metadata",
    with_(
        "SELECT id, display_name AS name, color, CASE id WHEN 3 THEN 'https://example.org/3.png' ELSE '' END AS avatar, "
        "id IN (7, 42) AS is_bot FROM people WHERE id IN (3, 5, 7, 42)"
    ),
    chat_query(people.people_metadata),
)
add(
    "people_colors",
    "WITH p AS (SELECT DISTINCT concat('User ', CAST(user_id AS STRING)) AS name FROM events), "
    "h AS (SELECT name, CAST(concat('0x', substring(sha1(name), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE * 6.0 AS hue FROM p), "
    "c AS (SELECT name, CAST(floor(hue) AS INT) AS s, 0.5704 AS chroma, 0.5704 * (1 - abs((hue - 2 * floor(hue / 2)) - 1)) AS x FROM h), "
    "v AS (SELECT name, CASE WHEN s IN (0, 5) THEN chroma WHEN s IN (1, 4) THEN x ELSE 0 END AS r, "
    "CASE WHEN s IN (1, 2) THEN chroma WHEN s IN (0, 3) THEN x ELSE 0 END AS g, "
    "CASE WHEN s IN (3, 4) THEN chroma WHEN s IN (2, 5) THEN x ELSE 0 END AS b FROM c) "
    "SELECT name, '#' || printf('%02X', CAST(round((r + 0.2548) * 255) AS INT)) || printf('%02X', CAST(round((g + 0.2548) * 255) AS INT)) "
    "|| printf('%02X', CAST(round((b + 0.2548) * 255) AS INT)) AS color FROM v",
    chat_query(lambda c: c.people.select(F.col("display_name").alias("name"), nm.stable_color(F.col("display_name")).alias("color"))),
)

# -- history and context ----------------------------------------------------
_NICKS = f"""
changes AS ({demo.PERSON_CHANGES}),
nicks AS (SELECT DISTINCT person_id, source_id, json_extract_string(payload_json, '$.chatId') AS chat_id, new_name, ts FROM changes)"""


def _author(table: str) -> str:
    nick = (
        f"(SELECT n.new_name FROM nicks n WHERE n.source_id = {table}.source_id AND n.chat_id = {table}.chat_id "
        f"AND n.person_id = {table}.actor_id AND n.ts <= {table}.ts ORDER BY n.ts DESC, n.new_name DESC LIMIT 1)"
    )
    return f"CASE WHEN coalesce({nick}, '(cleared)') = '(cleared)' THEN {table}.actor_name ELSE {nick} || ' (' || {table}.actor_name || ')' END"


add(
    "nickname_history",
    with_(
        "SELECT a.source_id, a.platform, a.chat_id, a.person_id, 'User ' || CAST(a.person_id AS STRING) AS display_name, "
        f"a.previous_name, a.new_name, {_author('a')} AS author_name, a.ts FROM rows_ a",
        extra=_NICKS + ", rows_ AS (SELECT DISTINCT c.person_id, c.source_id, s.platform, json_extract_string(payload_json, '$.chatId') AS chat_id, "
        "json_extract_string(payload_json, '$.actor_name') AS actor_name, c.person_id AS actor_id, c.previous_name, c.new_name, c.ts "
        "FROM changes c JOIN sources s ON s.id = c.source_id)",
    ),
    chat_query(history.nickname_history),
)
_RENAMES = (
    f"renames AS (SELECT DISTINCT r.channel_id, d.platform, d.source_name, d.source_id, d.channel_name, d.platform_channel_id AS chat_id, "
    "previous_name, new_name, ts, json_extract_string(payload_json, '$.actor_name') AS actor_name, "
    "CAST(substring(json_extract_string(payload_json, '$.actor_raw_id'), 2) AS INT) AS actor_id "
    f"FROM ({demo.CHANNEL_CHANGES}) r JOIN channel_dim d USING (channel_id) WHERE trim(new_name) <> ''), "
    "kept AS (SELECT * FROM renames WHERE previous_name IS NULL OR previous_name <> new_name)"
)
_ADMITTED = (
    "channel_id IN (SELECT channel_id FROM kept WHERE previous_name IS NOT NULL) AND (platform <> 'signal' OR channel_id IN "
    "(SELECT m.channel_id FROM messages m JOIN people p ON p.id = m.person_id WHERE p.display_name IN "
    "('User 3', 'User 5', 'User 7', 'User 42') GROUP BY 1 HAVING COUNT(DISTINCT p.id) >= 2))"
)
add(
    "rename_history",
    with_(
        "SELECT k.channel_id AS id, k.platform, k.source_name, k.source_id, CASE WHEN k.channel_name = 'purchase' THEN 'Shopping' ELSE "
        f"k.channel_name END AS current_name, k.chat_id AS platform_channel_id, k.previous_name, k.new_name, {_author('k')} AS author_name, "
        f"k.ts FROM kept k WHERE {_ADMITTED}",
        extra=f"{_NICKS}, {_RENAMES}",
    ),
    chat_query(history.rename_history),
)
add(
    "nickname_groups",
    with_(
        "SELECT a.person_id AS id, 'User ' || CAST(a.person_id AS STRING) AS display_name, d.channel_id, CASE WHEN d.channel_name = 'purchase' "
        "THEN 'Shopping' ELSE d.channel_name END AS current_name, d.source_name, MIN(a.previous_name) AS previous_name, a.new_name, "
        f"{_author('a')} AS author_name, a.ts FROM rows_ a JOIN channel_dim d ON d.source_id = a.source_id AND d.platform_channel_id = a.chat_id "
        f"WHERE d.platform = 'facebook' AND d.channel_id IN (SELECT channel_id FROM kept WHERE {_ADMITTED}) GROUP BY ALL",
        extra=f"{_NICKS}, {_RENAMES}"
        + ", rows_ AS (SELECT DISTINCT c.person_id, c.source_id, json_extract_string(payload_json, '$.chatId') AS chat_id, "
        "json_extract_string(payload_json, '$.actor_name') AS actor_name, c.person_id AS actor_id, c.previous_name, c.new_name, c.ts FROM changes c)",
    ),
    chat_query(history.nickname_groups),
)
_NICK_AT = (
    "(SELECT n.new_name FROM changes n WHERE n.person_id = m.person_id AND n.source_id = d.source_id AND "
    "json_extract_string(n.payload_json, '$.chatId') = d.platform_channel_id AND n.ts <= m.ts ORDER BY n.ts DESC, n.id DESC LIMIT 1)"
)
_NAMED = (
    f"named AS (SELECT m.id, m.ts, m.channel_id, m.content, d.platform, d.source_name, p.display_name AS person_name_canonical, {_NICK_AT} AS nickname_at_time, "
    "p.color AS person_color FROM messages m JOIN channel_dim d USING (channel_id) LEFT JOIN people p ON p.id = m.person_id)"
)
add(
    "names_at_time",
    with_(
        "SELECT id, ts, channel_id, person_name_canonical, nickname_at_time, coalesce(CASE WHEN starts_with(lower(content), "
        "lower(person_name_canonical) || ' ') THEN person_name_canonical END, nickname_at_time, person_name_canonical) AS person_name FROM named",
        extra=f"{_NICKS}, {_NAMED}",
    ),
    chat_query(
        lambda c: context.names_at_time(c).select(
            "id", "ts", "channel_id", "person_name_canonical", "nickname_at_time", "person_name"
        ),
        text=True,
    ),
)
_CHANNEL_AT = (
    f"coalesce((SELECT n.new_name FROM ({demo.CHANNEL_CHANGES}) n WHERE n.channel_id = m.channel_id AND n.ts <= m.ts "
    "ORDER BY n.ts DESC, n.id DESC LIMIT 1), d.channel_name)"
)
add(
    "channel_names_at_time",
    with_(
        f"SELECT id, ts, channel_id, CASE WHEN source_name LIKE 'Facebook: %' AND name = 'purchase' THEN 'Shopping' ELSE name END AS channel_name "
        f"FROM (SELECT m.id, m.ts, m.channel_id, d.source_name, {_CHANNEL_AT} AS name FROM messages m JOIN channel_dim d USING (channel_id))"
    ),
    chat_query(context.channel_names_at_time),
)
add(
    "theme_metadata",
    with_(
        "SELECT t.id, t.name, CASE t.id WHEN 1 THEN '🚨' WHEN 2 THEN '💰' ELSE '' END AS emoji, COUNT(s.id) AS message_count "
        "FROM themes t LEFT JOIN scoped s ON s.theme_id = t.id GROUP BY ALL"
    ),
    chat_query(
        lambda c: people.theme_metadata(c).join(count_by(scope(c), [F.col("theme_id").alias("id")], "messages"), "id", "left")
        .select("id", "name", "emoji", F.coalesce("message_count", F.lit(0)).alias("message_count"))
    ),
)
add(
    "platform_metadata",
    with_("SELECT platform, COUNT(*) AS message_count FROM scoped GROUP BY platform"),
    chat_query(lambda c: people.platform_metadata(c).join(count_by(scope(c), ["platform"], "messages"), "platform")),
)
_TARGET = "400"
_RANKED = (
    "ranked AS (SELECT m.*, row_number() OVER (ORDER BY ts, id) AS rn FROM messages m WHERE channel_id = "
    f"(SELECT channel_id FROM messages WHERE id = '{_TARGET}')), "
    "win AS (SELECT r.* FROM ranked r WHERE rn BETWEEN (SELECT rn FROM ranked WHERE id = '{t}') - {k} AND (SELECT rn FROM ranked WHERE id = '{t}') + {k})"
)
_AVATARS = "CASE n.person_name_canonical WHEN 'User 3' THEN 'https://example.org/3.png' END AS avatar_url"
_WINDOW = (
    "w.id, w.ts, w.content, w.attachment_preview, w.attachment_count, w.reaction_count, w.reaction_summary, w.reaction_details_json, "
    "w.is_system, w.reply_to_id, n.person_name_canonical, n.nickname_at_time, "
    f"coalesce(n.nickname_at_time, n.person_name_canonical) AS person_name, '#888888' AS person_color, {_AVATARS}"
)
_WINDOW_OUT = [
    "id", "ts", "content", "attachment_preview", "attachment_count", "reaction_count", "reaction_summary", "reaction_details_json",
    "is_system", "reply_to_id", "person_name_canonical", "nickname_at_time", "person_name", "person_color", "avatar_url",
]
add(
    "message_window",
    with_(f"SELECT {_WINDOW} FROM win w JOIN named n USING (id)", extra=f"{_NICKS}, {_NAMED}, {_RANKED.format(t=_TARGET, k=10)}"),
    chat_query(lambda c: context.message_window(c, _TARGET, 10).select(*_WINDOW_OUT), text=True),
)
add(
    "message_windows_of_replies",
    with_(
        f"SELECT w.target_id, w.step, {_WINDOW} FROM wide w JOIN named n USING (id)",
        extra=f"{_NICKS}, {_NAMED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts, id) AS rn FROM messages), "
        "wide AS (SELECT t.id AS target_id, CAST(r.rn - t.rn AS INT) AS step, r.* FROM ranked t JOIN ranked r "
        "ON r.channel_id = t.channel_id AND r.rn BETWEEN t.rn - 5 AND t.rn + 5 "
        "WHERE t.id IN (SELECT reply_to_id FROM messages WHERE reply_to_id IS NOT NULL))",
    ),
    chat_query(
        lambda c: context.message_windows(c, c.messages.select(F.col("reply_to_id").alias("id")), 5).select("target_id", "step", *_WINDOW_OUT),
        text=True,
    ),
)
add(
    "message_window_info",
    with_(
        f"SELECT CASE WHEN d.source_name LIKE 'Facebook: %' AND {_CHANNEL_AT} = 'purchase' THEN 'Shopping' ELSE {_CHANNEL_AT} END AS channel_name, "
        "d.platform, d.source_name, (SELECT COUNT(*) FROM ranked) AS total_in_channel, (SELECT COUNT(*) FROM win) >= "
        f"(SELECT COUNT(*) FROM ranked) AS is_full FROM messages m JOIN channel_dim d USING (channel_id) WHERE m.id = '{_TARGET}'",
        extra=_RANKED.format(t=_TARGET, k=10),
    ),
    chat_query(lambda c: context.message_window_info(c, _TARGET, 10)),
)
add(
    "message_snippet",
    with_(
        "SELECT w.id, w.ts, w.content, w.attachment_count, w.reaction_summary, p.display_name AS person_name FROM win w "
        "LEFT JOIN people p ON p.id = w.person_id", extra=_RANKED.format(t=_TARGET, k=5),
    ),
    chat_query(
        lambda c: context.message_snippet(c, _TARGET, 5).select(
            "id", "ts", "content", "attachment_count", "reaction_summary", "person_name"
        ),
        text=True,
    ),
)
add(
    "messages_per_shown_chat",
    with_(
        "SELECT CASE WHEN channel_name = 'purchase' THEN 'Shopping' ELSE channel_name END AS name, COUNT(*) AS message_count "
        "FROM scoped GROUP BY 1"
    ),
    chat_query(
        lambda c: count_by(scope(c), [shown_channel(c, F.col("channel_name"), F.col("source_name")).alias("name")], "messages")
    ),
)

from . import registry_ingest  # noqa: E402,F401  (adds the queries over rendered exports)

__all__ = ["ORACLE", "QUERIES", "add", "chat_query", "tx"]
