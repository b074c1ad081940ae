"""Queries over exports: the test tables are written out as chat exports and read back.

Files hold at most 200 messages each, cut by message number, so rendering never
gathers more than that in one place. The SQL states what the readers must find.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config, Identity, PersonRule
from ..functions import text as tx
from ..operators import numbering
from ..operators.resolve import resolve_people, resolve_themes
from ..session import ensure_checkpoint_dir
from ..sources import archives, media, pages
from ..sources.discord import read_discord
from ..sources.facebook import read_facebook
from ..sources.files import export_files
from ..sources.seeds import Export, merge
from ..sources.signal import read_signal
from ..sources.signal_backup import read_signal_backup
from . import build, demo, oracle
from .registry import add

BLOCK = 200
_WS = oracle._SPACES[:-1]
_STRIPPED = f"regexp_replace(coalesce(content, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = demo.demo_chat(spark, sf_dir, text=True).messages
    n = F.col("id").cast("bigint")
    return m.withColumn("n", n).withColumn("block", F.floor(n / BLOCK).cast("bigint"))


def _files(rows: DataFrame, path: Column, box: Column, head: str, newest_first: bool = False) -> DataFrame:
    place = -F.col("n") if newest_first else F.col("n")
    whole = rows.select(path.alias("path"), F.struct(place.alias("n"), box.alias("box")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["box"]), "\n")
    return whole.groupBy("path").agg(body.alias("body")).select(
        "path", F.encode(F.concat(F.lit(f"<html>{head}<body>"), F.col("body"), F.lit("</body></html>")), "UTF-8").alias("content")
    )


# -- Discord -----------------------------------------------------------------
def discord_files(spark: SparkSession, sf_dir: str, threads: bool = False) -> DataFrame:
    """Exports of all messages; with ``threads`` replies are linked, and every tenth message continues the one before it."""
    m = _messages(spark, sf_dir)
    before = F.lag("n").over(W.partitionBy("channel_id", "block").orderBy("n"))
    m = m.withColumn("continues", F.lit(threads) & (F.col("n") % 10 == 1) & before.isNotNull())
    reply = F.when(F.lit(threads) & F.col("reply_to_id").isNotNull(), F.concat(
        F.lit('<div class="chatlog__reply"><a class="chatlog__reply-link" href="#'), F.col("reply_to_id"), F.lit('">r</a></div>'))).otherwise(F.lit(""))
    author = F.when(F.col("continues"), F.lit("")).otherwise(F.concat(
        F.lit('<span class="chatlog__author" data-user-id="u'), F.col("person_id").cast("string"), F.lit('">User '), F.col("person_id").cast("string"), F.lit("</span>")))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    snow = F.shiftleft(ms - F.lit(1420070400000), 22) + F.col("n")
    # 22 bits of an id are the number; where it needs more it runs into the milliseconds, and the time is told beside the id
    told = F.when(F.col("n") >= 1 << 22, F.concat(F.lit('" data-timestamp="'), ms.cast("string"))).otherwise(F.lit(""))
    text = F.when(F.col("n") % 30 == 2, F.concat(F.lit("They changed the channel name to \"Room "), (F.col("n") % 5).cast("string"), F.lit("\"")))
    text = F.coalesce(text, F.col("content"), F.lit(""))
    box = F.concat(
        F.lit('<div class="chatlog__message-container" data-message-id="'), snow.cast("string"), told, F.lit('">'),
        reply, author, F.lit('<div class="chatlog__content"><div>'), _escape(text), F.lit("</div></div>"),
        F.when(F.col("attachment_count") > 0, F.concat(F.lit('<div class="chatlog__attachment"><a href="'), F.col("attachment_preview"), F.lit('">f</a></div>'))).otherwise(F.lit("")),
        F.when(F.col("reaction_count") > 0, F.concat(
            F.lit('<div class="chatlog__reaction" title="t"><img class="chatlog__emoji" alt="👍" src="e.png"><span class="chatlog__reaction-count">'),
            F.col("reaction_count").cast("string"), F.lit("</span></div>"))).otherwise(F.lit("")),
        F.when(F.col("is_edited"), F.lit('<span class="chatlog__edited-timestamp">e</span>')).otherwise(F.lit("")),
        F.lit("</div>"),
    )
    path = F.concat(F.lit("file:/data/discord/9/"), (F.col("channel_id") * 1_000_000 + F.col("block")).cast("string"), F.lit(".html"))
    head = '<head><title>t</title></head><div class="preamble__entry">Guild</div><div class="preamble__entry">Text / chat</div>'
    return _files(m, path, box, head)


_SNOW = "CAST((epoch_us(ts) // 1000 - 1420070400000) * 4194304 + CAST(id AS BIGINT) AS BIGINT)"
_DISCORD_TEXT = (
    "CASE WHEN CAST(id AS BIGINT) % 30 = 2 THEN 'They changed the channel name to \"Room ' || CAST(CAST(id AS BIGINT) % 5 AS STRING) "
    f"|| '\"' ELSE {_STRIPPED} END"
)
_M = f"WITH messages AS ({demo.MESSAGES_TEXT}) "
add(
    "discord_messages",
    _M + f"SELECT CAST({_SNOW} AS STRING) AS id, 'Discord: Guild' AS source_name, CAST(channel_id * 1000000 + CAST(id AS BIGINT) // {BLOCK} AS STRING) "
    "AS channel_raw_id, 'chat' AS channel_name, 'u' || CAST(person_id AS STRING) AS person_raw_id, date_trunc('millisecond', ts) AS ts, "
    f"{_DISCORD_TEXT} AS content, attachment_count, CASE WHEN attachment_count > 0 THEN '9/' || split_part(attachment_preview, '?', 1) END AS "
    "attachment_preview, reaction_count, CASE WHEN reaction_count > 0 THEN '👍×' || CAST(reaction_count AS STRING) END AS reaction_summary, is_edited, false AS is_system FROM messages",
    lambda spark, sf: read_discord(discord_files(spark, sf)).messages.select(
        "id", "source_name", "channel_raw_id", "channel_name", "person_raw_id", "ts", "content", "attachment_count",
        "attachment_preview", "reaction_count", "reaction_summary", "is_edited", "is_system",
    ),
)
add(
    "discord_name_changes",
    _M + f"SELECT CAST(channel_id * 1000000 + CAST(id AS BIGINT) // {BLOCK} AS STRING) AS entity_raw_id, 'Room ' || CAST(CAST(id AS BIGINT) % 5 AS STRING) "
    "AS new_name, date_trunc('millisecond', ts) AS ts, 'channel-name-change' AS kind, 'User ' || CAST(person_id AS STRING) AS actor_name "
    "FROM messages WHERE CAST(id AS BIGINT) % 30 = 2",
    lambda spark, sf: read_discord(discord_files(spark, sf)).name_changes.select(
        "entity_raw_id", "new_name", "ts", "kind", F.get_json_object("payload_json", "$.actor_name").alias("actor_name")
    ),
)
add(
    "discord_people",
    "SELECT DISTINCT 'discord' AS platform, 'u' || CAST(user_id AS STRING) AS raw_id, 'User ' || CAST(user_id AS STRING) AS display_name FROM events",
    lambda spark, sf: read_discord(discord_files(spark, sf)).people.drop("ord"),
)
add(
    "discord_replies_and_continuations",
    _M + f", placed AS (SELECT *, CAST(id AS BIGINT) AS n, CAST(id AS BIGINT) // {BLOCK} AS block FROM messages), "
    "lagged AS (SELECT *, lag(n) OVER (PARTITION BY channel_id, block ORDER BY n) AS p FROM placed) "
    f"SELECT CAST({_SNOW} AS STRING) AS id, reply_to_id, 'u' || CAST(last_value(CASE WHEN n % 10 = 1 AND p IS NOT NULL THEN NULL ELSE person_id END IGNORE NULLS) "
    "OVER (PARTITION BY channel_id, block ORDER BY n ROWS UNBOUNDED PRECEDING) AS STRING) AS person_raw_id FROM lagged",
    lambda spark, sf: read_discord(discord_files(spark, sf, threads=True)).messages.select("id", "reply_to_id", "person_raw_id"),
)


# -- Facebook ----------------------------------------------------------------
_FB_EMOJI = 7  # messages whose number leaves this remainder by 50 are a bare emoji
_FB_NICK = 11  # ... a nickname, _FB_ADD ... a new member
_FB_ADD = 13


def facebook_files(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """Exports of all messages; ``plain`` ones have reaction lists and people who leave, but no bare emoji and nicknames."""
    m = _messages(spark, sf_dir)
    kind = F.col("n") % 50
    who = F.concat(F.lit("User "), F.col("person_id").cast("string"))
    text = (
        F.when((kind == _FB_ADD + 1) & F.lit(plain), F.concat(who, F.lit(" removed New "), (F.col("n") % 9).cast("string"), F.lit(" from the group.")))
        .when((kind == _FB_ADD + 2) & F.lit(plain), F.concat(who, F.lit(" left the group.")))
        .when((kind == _FB_EMOJI) & ~F.lit(plain), F.lit("🔥"))
        .when((kind == _FB_NICK) & ~F.lit(plain), F.concat(who, F.lit(" set their own nickname to Nick "), (F.col("n") % 3).cast("string"), F.lit(" of "), who, F.lit(".")))
        .when(kind == _FB_ADD, F.concat(who, F.lit(" added New "), (F.col("n") % 9).cast("string"), F.lit(" and Other to the group.")))
        .otherwise(_escape(F.coalesce(F.col("content"), F.lit(""))))
    )
    item = F.lit("<li>👍 User 1</li>")
    given = F.when(F.lit(plain) & (F.col("reaction_count") > 0), F.concat(F.lit('<ul class="_tqp">'), F.repeat(item, F.col("reaction_count")), F.lit("</ul>"))).otherwise(F.lit(""))
    box = F.concat(
        F.lit('<div class="pam _3-95 _2pi0 _2lej uiBoxWhite noborder"><div class="_2lek">'), who, F.lit('</div><div class="_2let"><div>'),
        text, F.lit("</div>"), given, F.lit("</div><div>"), F.date_format("ts", "dd MMM yyyy, HH:mm"), F.lit("</div></div>"),
    )
    chat = F.concat(F.lit("Chat_"), F.col("channel_id").cast("string"))
    # file names in order are newest first, as in real archives
    file = F.lpad((F.lit(99_999_999) - F.col("block")).cast("string"), 8, "0")
    path = F.concat(F.lit("file:/data/facebook/"), chat, F.lit("/message_"), file, F.lit(".html"))
    return _files(m, path, box, "<head></head>", newest_first=True)


_FB = f"""
WITH messages AS ({demo.MESSAGES_TEXT}),
said AS (
  SELECT channel_id, CAST(id AS BIGINT) AS n, 'User ' || CAST(person_id AS STRING) AS author, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute,
    CASE CAST(id AS BIGINT) % 50 WHEN {_FB_EMOJI} THEN '🔥'
      WHEN {_FB_NICK} THEN 'User ' || CAST(person_id AS STRING) || ' set their own nickname to Nick ' || CAST(CAST(id AS BIGINT) % 3 AS STRING) || ' of User ' || CAST(person_id AS STRING) || '.'
      WHEN {_FB_ADD} THEN 'User ' || CAST(person_id AS STRING) || ' added New ' || CAST(CAST(id AS BIGINT) % 9 AS STRING) || ' and Other to the group.'
      ELSE {oracle.SQUEEZED} END AS body
  FROM messages
),
cleaned AS (
  SELECT channel_id, n, author, minute, CASE WHEN body LIKE 'http%://%' THEN '' ELSE body END AS content,
    CASE WHEN body LIKE 'http%://%' THEN regexp_extract(body, 'https?://[^\\s]+') END AS attachment_preview,
    n % 50 IN ({_FB_NICK}, {_FB_ADD}) AS is_system
  FROM said
),
hashed AS (SELECT *, sha1(author || chr(31) || strftime(minute, '%Y-%m-%dT%H:%M:%S') || chr(31) || content) AS id FROM cleaned),
kept AS (
  SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, id ORDER BY n DESC) AS rank FROM hashed) WHERE rank = 1
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY channel_id, minute ORDER BY n) AS rn,
    row_number() OVER (PARTITION BY channel_id ORDER BY minute, n) AS place FROM kept
),
anchored AS (
  SELECT *, content = '🔥' AND place > 1 AS is_emoji,
    last_value(CASE WHEN content <> '🔥' OR place = 1 THEN place END IGNORE NULLS)
      OVER (PARTITION BY channel_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM placed
),
given AS (SELECT channel_id, anchor AS place, CAST(COUNT(*) AS INT) AS more FROM anchored WHERE is_emoji GROUP BY ALL)
"""
add(
    "facebook_messages",
    _FB + "SELECT a.id, 'Chat_' || CAST(a.channel_id AS STRING) AS channel_raw_id, a.author AS person_raw_id, minute + to_microseconds(rn - 1) AS ts, content, "
    "CAST(CASE WHEN attachment_preview IS NULL THEN 0 ELSE 1 END AS INT) AS attachment_count, attachment_preview, CAST(coalesce(more, 0) AS INT) AS reaction_count, "
    "'🔥×' || CAST(more AS STRING) AS reaction_summary, is_system OR is_emoji AS is_system FROM anchored a LEFT JOIN given USING (channel_id, place)",
    lambda spark, sf: read_facebook(facebook_files(spark, sf)).messages.select(
        "id", "channel_raw_id", "person_raw_id", "ts", "content", "attachment_count", "attachment_preview", "reaction_count",
        "reaction_summary", "is_system",
    ),
)
add(
    "facebook_member_events",
    _FB + "SELECT 'Chat_' || CAST(channel_id AS STRING) AS channel_raw_id, 'added' AS kind, author AS actor_raw_id, t AS target_raw_id, minute AS ts "
    f"FROM (SELECT *, unnest(['New ' || CAST(n % 9 AS STRING), 'Other']) AS t FROM cleaned WHERE n % 50 = {_FB_ADD})",
    lambda spark, sf: read_facebook(facebook_files(spark, sf)).member_events.select(
        "channel_raw_id", "kind", "actor_raw_id", "target_raw_id", "ts"
    ),
)
add(
    "facebook_reaction_lists",
    f"WITH messages AS ({demo.MESSAGES_TEXT}) SELECT 'Chat_' || CAST(channel_id AS STRING) AS channel_raw_id, date_trunc('minute', ts) AS minute, "
    "SUM(reaction_count)::BIGINT AS reactions, COUNT(DISTINCT reaction_count) AS counts FROM messages "
    "WHERE content IS NOT NULL AND content NOT LIKE 'http%' AND CAST(id AS BIGINT) % 50 NOT IN (13, 14, 15) GROUP BY ALL",
    lambda spark, sf: read_facebook(facebook_files(spark, sf, plain=True)).messages.filter("content <> '' AND NOT is_system").groupBy(
        "channel_raw_id", F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute")
    ).agg(F.sum("reaction_count").alias("reactions"), F.count_distinct("reaction_count").alias("counts")),
)
add(
    "facebook_members_gone",
    f"WITH messages AS ({demo.MESSAGES_TEXT}), m AS (SELECT *, CAST(id AS BIGINT) % 50 AS kind, 'User ' || CAST(person_id AS STRING) AS who FROM messages) "
    "SELECT 'Chat_' || CAST(channel_id AS STRING) AS channel_raw_id, CASE kind WHEN 14 THEN 'removed' ELSE 'left' END AS kind, who AS actor_raw_id, "
    "CASE kind WHEN 14 THEN 'New ' || CAST(CAST(id AS BIGINT) % 9 AS STRING) ELSE who END AS target_raw_id, date_trunc('minute', ts) AS ts FROM m WHERE kind IN (14, 15)",
    lambda spark, sf: read_facebook(facebook_files(spark, sf, plain=True)).member_events.filter("kind <> 'added'").select(
        "channel_raw_id", "kind", "actor_raw_id", "target_raw_id", "ts"
    ),
)
add(
    "facebook_nicknames",
    _FB + ", nicks AS (SELECT channel_id, n, author, minute, 'Nick ' || CAST(n % 3 AS STRING) || ' of ' || author AS nick FROM cleaned "
    f"WHERE n % 50 = {_FB_NICK}), chained AS (SELECT *, lag(nick) OVER (PARTITION BY channel_id, author ORDER BY minute, n DESC) AS prev FROM nicks) "
    "SELECT author AS entity_raw_id, prev AS previous_name, nick AS new_name, minute AS ts, 'Chat_' || CAST(channel_id AS STRING) AS chat_id, "
    "author AS actor_raw_id FROM chained WHERE prev IS NULL OR prev <> nick",
    lambda spark, sf: read_facebook(facebook_files(spark, sf)).name_changes.select(
        "entity_raw_id", "previous_name", "new_name", "ts", F.get_json_object("payload_json", "$.chatId").alias("chat_id"),
        F.get_json_object("payload_json", "$.actor_raw_id").alias("actor_raw_id"),
    ),
)


# -- Signal ------------------------------------------------------------------
def signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    stamp = F.date_format("ts", "MMM dd, yyyy HH:mm:ss")
    status = F.concat(
        F.lit('<div class="msg msg-status"><div class="status-text"><pre>User '), F.col("person_id").cast("string"),
        F.lit(" changed the group name to “Room "), (F.col("n") % 4).cast("string"), F.lit('”</pre></div><div class="footer-status"><span class="msg-data">'),
        stamp, F.lit("</span></div></div>"),
    )
    said = F.concat(
        F.lit('<div class="msg msg-incoming"><div class="membername">User '), F.col("person_id").cast("string"),
        F.lit("</div><div><pre>"), _escape(F.coalesce(F.col("content"), F.lit(""))), F.lit("</pre></div>"),
        F.when(F.col("attachment_count") > 0, F.lit('<img src="media/a.png">')).otherwise(F.lit("")),
        F.lit('<div class="footer"><span class="msg-data">'), stamp, F.lit("</span></div>"),
        F.when(F.col("reaction_count") > 0, F.concat(
            F.lit('<div class="msg-reactions"><div class="msg-reaction"><span class="msg-emoji">❤</span><span class="reaction-count">'),
            F.col("reaction_count").cast("string"), F.lit('</span><div class="msg-reaction-info">From: User 3</div></div></div>'))).otherwise(F.lit("")),
        F.lit("</div>"),
    )
    chat = F.concat(F.lit("Chat (_id"), (F.col("channel_id") * 1_000_000 + F.col("block")).cast("string"), F.lit(")"))
    path = F.concat(F.lit("file:/data/signal_decrypted/"), chat, F.lit("/chat.html"))
    return _files(m, path, F.when(F.col("n") % 25 == 3, status).otherwise(said), "<head><title>Chat</title></head>")


_SIGNAL = f"""
WITH messages AS ({demo.MESSAGES_TEXT}),
said AS (
  SELECT *, CAST(id AS BIGINT) AS n, CAST(channel_id * 1000000 + CAST(id AS BIGINT) // {BLOCK} AS STRING) AS chat, CAST(date_trunc('second', ts) AS TIMESTAMP) AS sec,
    {_STRIPPED} AS body FROM messages
),
placed AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY n) AS pos FROM said)
"""
add(
    "signal_messages",
    _SIGNAL + "SELECT sha1(chat || '|' || strftime(sec, '%Y-%m-%dT%H:%M:%S') || '|name:user ' || CAST(person_id AS STRING) || '|' || body || '|' || CAST(pos AS STRING) "
    "|| '|' || CASE WHEN attachment_count > 0 THEN 'Chat (_id' || chat || ')/media/a.png' ELSE '' END) AS id, chat AS channel_raw_id, 'Chat' AS channel_name, "
    "'name:user ' || CAST(person_id AS STRING) AS person_raw_id, sec AS ts, body AS content, attachment_count, reaction_count, CASE WHEN reaction_count > 0 THEN "
    "'❤×' || CAST(reaction_count AS STRING) END AS reaction_summary FROM placed WHERE n % 25 <> 3",
    lambda spark, sf: read_signal(signal_files(spark, sf)).messages.select(
        "id", "channel_raw_id", "channel_name", "person_raw_id", "ts", "content", "attachment_count", "reaction_count", "reaction_summary"
    ),
)
add(
    "signal_title_changes",
    _SIGNAL + ", titles AS (SELECT chat, sec, n, person_id, 'Room ' || CAST(n % 4 AS STRING) AS name FROM said WHERE n % 25 = 3), "
    "chained AS (SELECT *, lag(name) OVER (PARTITION BY chat ORDER BY sec, name, n) AS prev FROM titles) "
    "SELECT chat AS entity_raw_id, prev AS previous_name, name AS new_name, sec AS ts, 'name:user ' || CAST(person_id AS STRING) AS actor_raw_id FROM chained "
    "WHERE prev IS NULL OR prev <> name",
    lambda spark, sf: read_signal(signal_files(spark, sf)).name_changes.select(
        "entity_raw_id", "previous_name", "new_name", "ts", F.get_json_object("payload_json", "$.actor_raw_id").alias("actor_raw_id")
    ),
)
add(
    "signal_admitted_chats",
    _SIGNAL + "SELECT chat AS raw_id, 'Chat' AS name FROM placed WHERE n % 25 <> 3 AND person_id IN (3, 5, 7, 42) GROUP BY 1 HAVING COUNT(DISTINCT person_id) >= 2",
    lambda spark, sf: read_signal(signal_files(spark, sf), demo.DEMO_CONFIG).channels.select("raw_id", "name"),
)

def _merged(spark: SparkSession, sf_dir: str) -> Export:
    """Both platforms' exports; the Discord one is parsed once and merged twice, as if found in two places."""
    discord = read_discord(discord_files(spark, sf_dir))
    return merge([discord, read_signal(signal_files(spark, sf_dir)), discord])


add(
    "merged_channels",
    _SIGNAL + "SELECT 'Signal: signal_decrypted' AS source_name, chat AS raw_id, 'Chat' AS name FROM placed GROUP BY 2 "
    "UNION SELECT 'Discord: Guild', chat, 'chat' FROM placed",
    lambda spark, sf: _merged(spark, sf).channels,
)



# -- finding exports, building tables ------------------------------------------
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of exports of all messages, each platform its own way, and files beside them that are none."""
    m = _messages(spark, sf_dir).select(F.col("channel_id").cast("string").alias("c"), F.col("block").cast("string").alias("b")).distinct()
    root = F.lit("file:/data/")
    shapes = {
        "discord": [F.concat(root, F.lit("discord/9/"), "c", F.lit("/"), "b", F.lit(".html"))],
        "facebook": [
            F.concat(root, F.lit("facebook/Chat_"), "c", F.lit("/message_"), "b", F.lit(".html")),
            F.concat(root, F.lit("facebook/Chat_"), "c", F.lit("/old/message_"), "b", F.lit(".html")),
        ],
        "signal": [
            F.concat(root, F.lit("signal_decrypted/Chat "), "c", F.lit("/part"), "b", F.lit(".html")),
            F.concat(root, F.lit("signal_decrypted/Chat "), "c", F.lit("/media/"), "b", F.lit(".html")),
        ],
    }
    return m.select(F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), path.alias("path")) for p, paths in shapes.items() for path in paths])).alias("x")).select("x.*")


_BLOCKS = f"(SELECT DISTINCT CAST(channel_id AS STRING) AS c, CAST(CAST(id AS BIGINT) // {BLOCK} AS STRING) AS b FROM messages)"
add(
    "exports_found",
    _M + "SELECT 'discord' AS platform, c AS chat_dir, b || '.html' AS file, 'file:/data/discord/9/' || c || '/' || b || '.html' AS path "
    f"FROM {_BLOCKS} UNION ALL SELECT 'facebook', 'Chat_' || c, 'message_' || b || '.html', 'file:/data/facebook/Chat_' || c || '/message_' || b || '.html' FROM {_BLOCKS} "
    "UNION ALL SELECT 'signal', 'Chat ' || c, 'part' || min(b) || '.html', 'file:/data/signal_decrypted/Chat ' || c || '/part' || min(b) || '.html' "
    f"FROM {_BLOCKS} GROUP BY c",
    lambda spark, sf: export_files(_listed(spark, sf)),
)


def built_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a build from exports of all messages, as the opened build shows them."""
    out = f"{ensure_checkpoint_dir(spark)}/build-{uuid.uuid4().hex}"
    build.build_from(spark, lambda: merge([read_discord(discord_files(spark, sf_dir))]), out)
    c = build.open_build(spark, out)
    if c.tokens is None:
        raise build.BuildError("facts are not of the current version")
    tables = {
        "messages": c.messages, "people": c.people, "platform_identities": c.platform_identities, "sources": c.sources, "channels": c.channels,
        "channel_name_changes": c.channel_name_changes, "reaction_events": c.reaction_events, "places": c.places, "ordered": c.ordered,
        "person_stats": c.person_stats, "fact_version " + tx.FACT_VERSIONS["fact_schema_version"]: build.stored_versions(spark, out),
    }
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


_N = "(SELECT COUNT(*) FROM messages)"
add(
    "build_tables",
    _M + f"SELECT unnest(['messages', 'people', 'platform_identities', 'sources', 'channels', 'channel_name_changes', 'reaction_events', 'places', 'ordered', "
    f"'person_stats', 'fact_version {tx.FACT_VERSIONS['fact_schema_version']}']) AS name, "
    f"unnest([{_N}, (SELECT COUNT(DISTINCT user_id) FROM events), (SELECT COUNT(DISTINCT user_id) FROM events), 1, (SELECT COUNT(*) FROM {_BLOCKS}), "
    f"(SELECT COUNT(*) FROM messages WHERE CAST(id AS BIGINT) % 30 = 2), (SELECT SUM(reaction_count) FROM messages), {_N}, {_N}, "
    "(SELECT COUNT(DISTINCT user_id) FROM events), 1]::BIGINT[]) AS n",
    built_tables,
)


def backup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup with a group chat per channel, a recipient per person, and an item per message."""
    c = demo.demo_chat(spark, sf_dir, text=True)
    n = F.col("id").cast("bigint")
    text = F.when(n % 40 == 5, F.concat(F.lit("Ann named the group Room "), (n % 3).cast("string"))).otherwise(F.col("content"))
    reactions = F.when(F.col("reaction_count") > 0, F.transform(F.sequence(F.lit(1), F.col("reaction_count")), lambda i: F.struct(F.when(i % 2 == 0, "👍").otherwise("🎉").alias("emoji"))))
    item = F.struct(
        F.col("channel_id").cast("string").alias("chatId"), F.concat(F.lit("p"), "person_id").alias("authorId"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("dateSent"),
        F.struct(F.struct(text.alias("body")).alias("text"), reactions.alias("reactions")).alias("standardMessage"),
    )
    items = c.messages.select(F.to_json(F.struct(item.alias("chatItem"))).alias("value"))
    who = F.struct(F.concat(F.lit("p"), "id").alias("id"), F.struct(F.concat(F.lit("aci-"), "id").alias("aci"), F.col("display_name").alias("profileGivenName")).alias("contact"))
    people = c.people.select(F.to_json(F.struct(who.alias("recipient"))).alias("value"))
    title = F.struct(F.struct(F.struct(F.col("name").alias("title")).alias("title")).alias("snapshot"))
    group = F.struct(F.concat(F.lit("g"), "id").alias("id"), title.alias("group"))
    groups = c.channels.select(F.to_json(F.struct(group.alias("recipient"))).alias("value"))
    chat = F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("g"), "id").alias("recipientId"))
    chats = c.channels.select(F.to_json(F.struct(chat.alias("chat"))).alias("value"))
    return items.unionByName(people).unionByName(groups).unionByName(chats)


_BACKUP = _M + (
    ", said AS (SELECT *, date_trunc('millisecond', ts) AS ms, CASE WHEN CAST(id AS BIGINT) % 40 = 5 THEN 'Ann named the group Room ' || "
    "CAST(CAST(id AS BIGINT) % 3 AS STRING) ELSE coalesce(content, '') END AS body FROM messages), "
    "titled AS (SELECT channel_id, ms, 'Room ' || CAST(CAST(id AS BIGINT) % 3 AS STRING) AS name FROM said WHERE CAST(id AS BIGINT) % 40 = 5)"
)
add(
    "signal_backup_messages",
    _BACKUP + "SELECT CAST(s.channel_id AS STRING) AS channel_raw_id, (SELECT arg_max(name, ms) FROM titled t WHERE t.channel_id = s.channel_id) AS channel_name, "
    "'aci-' || CAST(person_id AS STRING) AS person_raw_id, ms AS ts, body AS content, reaction_count, CASE reaction_count WHEN 1 THEN '🎉×1' WHEN 2 THEN '🎉×1 👍×1' "
    "WHEN 3 THEN '🎉×2 👍×1' END AS reaction_summary, CAST(id AS BIGINT) % 40 = 5 AS is_system FROM said s",
    lambda spark, sf: read_signal_backup(backup_lines(spark, sf), "backup").messages.select(
        "channel_raw_id", "channel_name", "person_raw_id", "ts", "content", "reaction_count", "reaction_summary", "is_system"
    ),
)
add(
    "signal_backup_titles",
    _BACKUP + "SELECT CAST(channel_id AS STRING) AS entity_raw_id, prev AS previous_name, name AS new_name, ms AS ts FROM (SELECT *, lag(name) OVER (PARTITION BY channel_id ORDER BY ms, name) "
    "AS prev FROM titled) WHERE prev IS NULL OR prev <> name",
    lambda spark, sf: read_signal_backup(backup_lines(spark, sf), "backup").name_changes.select("entity_raw_id", "previous_name", "new_name", "ts"),
)

# -- pages, media, archives --------------------------------------------------
add(
    "page_previews",
    "SELECT url, replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&amp;', '&') AS title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS image, "
    "regexp_extract(url, '^https?://([^/?#]+)', 1) AS site_name, CAST(NULL AS VARCHAR) AS favicon FROM pages",
    lambda spark, sf: pages.page_previews(demo.tables(spark, sf)["pages"]),
)


def _media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demo.tables(spark, sf_dir)["documents"]
    path = F.concat(F.lit("file:/data/facebook/demo/photos/"), F.col("doc_id").cast("string"), F.lit(".JPG"))
    return d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = demo.demo_chat(spark, sf_dir).messages
    preview = (
        F.when(F.col("id").cast("bigint") % 3 == 0, F.concat(F.lit("messages/inbox/demo/photos/"), "id", F.lit(".JPG")))
        .when(F.col("id").cast("bigint") % 3 == 1, F.lit("https://example.org/a.png"))
        .otherwise(F.concat(F.lit("photos/"), "id", F.lit(".JPG")))
    )
    rows = m.select("id", F.lit("Facebook: demo").alias("source_name"), preview.alias("attachment_preview"))
    config = Config(blocked_filenames=frozenset({"6.jpg", "8.jpg"}))
    return media.resolve_attachments(rows, media.media_catalog(_media_files(spark, sf_dir)), config).select("id", "attachment_url")


add(
    "media_catalog",
    "SELECT 'facebook' AS platform, 'demo' AS source, 'photos/' || CAST(doc_id AS STRING) || '.JPG' AS path, CAST(doc_id AS STRING) || '.jpg' AS name, "
    "sha256(text) AS sha256 FROM documents",
    lambda spark, sf: media.media_catalog(_media_files(spark, sf)),
)
add(
    "attachment_urls",
    "SELECT CAST(e.event_id AS STRING) AS id, CASE WHEN e.event_id % 3 = 1 THEN 'https://example.org/a.png' WHEN d.doc_id IS NULL THEN NULL "
    "WHEN e.event_id IN (6, 8) THEN '/api/media-removed' ELSE '/api/media?platform=facebook&source=demo&path=photos%2F' || CAST(e.event_id AS STRING) || '.JPG' END "
    "AS attachment_url FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id",
    _attachments,
)


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/orders.parquet")
    people = F.concat_ws(", ", *[F.concat(F.lit("C "), ((F.col("o_custkey") + k * k) % 40).cast("string")) for k in range(4)])
    html = F.concat(F.lit("<html><head><title>G</title></head><body><div>Participants: "), people, F.lit(" and Zed</div></body></html>"))
    path = F.concat(F.lit("file:/in/chat"), F.col("o_orderkey").cast("string"), F.lit("/message_1.html"))
    config = Config(people=(PersonRule("A", identities=tuple(Identity("facebook", f"C {i}") for i in range(12))),))
    return archives.scan_archives(c.select(path.alias("path"), F.encode(html, "UTF-8").alias("content")), config, 2).filter("is_match").select(
        "chat_dir", F.array_join("matched", "|").alias("matched")
    )


add(
    "archive_matches",
    "WITH p AS (SELECT 'chat' || CAST(o_orderkey AS STRING) AS chat_dir, unnest([o_custkey % 40, (o_custkey + 1) % 40, (o_custkey + 4) % 40, (o_custkey + 9) % 40]) AS c, "
    "unnest([0, 1, 2, 3]) AS i FROM orders) SELECT chat_dir, string_agg('C ' || CAST(c AS STRING), '|' ORDER BY i) AS matched FROM p WHERE c < 12 GROUP BY 1 HAVING COUNT(*) >= 2",
    _archives,
)

# -- build steps -------------------------------------------------------------
_WHO = (
    ("signal", "'self'", "'You'"),
    ("signal", "'name:user ' || CAST(c_custkey % 60 AS STRING)", "'User ' || CAST(c_custkey % 60 AS STRING)"),
    ("discord", "'u' || CAST(c_custkey % 60 AS STRING)", "'Customer ' || CAST(c_custkey % 60 AS STRING)"),
    ("facebook", "'f' || CAST(c_custkey AS STRING)", "'  USER   ' || CAST(c_custkey % 60 AS STRING) || ' Smith'"),
    ("facebook", "'g' || CAST(c_custkey AS STRING)", "'Smith'"),
)
_IDENTITY_SQL = " UNION ".join(f"SELECT '{p}' AS platform, {r} AS raw_id, {n} AS display_name FROM customer" for p, r, n in _WHO)
_PERSON_CONFIG = Config(people=(
    PersonRule("User 3", "#112233", identities=(Identity("discord", "u3"),)),
    PersonRule("Five", "", identities=(Identity("signal", "User 5"),)),
    PersonRule("Smith Seven", identities=(Identity("discord", "u7"),)),
    PersonRule("Smith Eight", identities=(Identity("discord", "u8"),)),
))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return demo.sql_on(spark, _IDENTITY_SQL, customer=customer)


#: by tier: exact identity; alias or name of the same platform; unique name anywhere; word sets
_RESOLVED = f"""
WITH ids AS ({_IDENTITY_SQL}),
keyed AS (SELECT *, lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g'))) AS n FROM ids)
SELECT platform, raw_id, display_name,
  CASE WHEN platform = 'discord' AND raw_id = 'u3' THEN 'User 3' WHEN platform = 'discord' AND raw_id = 'u7' THEN 'Smith Seven'
    WHEN platform = 'discord' AND raw_id = 'u8' THEN 'Smith Eight'
    WHEN n IN ('user 3', 'user 3 smith') THEN 'User 3' WHEN n IN ('user 5', 'user 5 smith') THEN 'Five'
    ELSE display_name END AS canonical_name,
  CASE WHEN platform = 'discord' AND raw_id = 'u3' THEN '#112233' WHEN platform = 'discord' AND raw_id = 'u7' THEN 'Smith Seven'
    WHEN platform = 'discord' AND raw_id = 'u8' THEN 'Smith Eight'
    WHEN n IN ('user 3', 'user 3 smith') THEN '#112233' WHEN n IN ('user 5', 'user 5 smith') THEN 'Five' ELSE '' END AS color_hint
FROM keyed"""
add("resolve_people", _RESOLVED, lambda spark, sf: resolve_people(_identities(spark, sf), _PERSON_CONFIG))
add(
    "people_ids",
    f"WITH r AS ({_RESOLVED}), p AS (SELECT canonical_name, color_hint, MIN(platform || ' ' || raw_id) AS first FROM r GROUP BY ALL) "
    "SELECT row_number() OVER (ORDER BY first) AS id, canonical_name AS display_name FROM p",
    lambda spark, sf: build.people_tables(_identities(spark, sf), _PERSON_CONFIG)[0].select("id", "display_name"),
)


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return demo.sql_on(spark, _CHANNEL_SQL, part=part)


_CHANNEL_SQL = (
    "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Discord: demo' WHEN 1 THEN 'Facebook: demo_x' WHEN 2 THEN 'signal:  Demo' ELSE 'Discord: other' END AS source_name, "
    "concat(CASE p_partkey % 7 WHEN 0 THEN 'click' WHEN 1 THEN 'PURCHASE' WHEN 2 THEN 'sign' WHEN 3 THEN 'view' WHEN 4 THEN 'purchase_9' ELSE 'else' END, "
    "CASE WHEN p_partkey % 5 = 0 THEN ' x' ELSE '' END) AS channel_name, CAST(p_partkey AS STRING) AS raw_id FROM part"
)
_THEMED = f"""
WITH c AS ({_CHANNEL_SQL}), k AS (SELECT *, lower(channel_name) AS n FROM c)
SELECT source_name, channel_name, raw_id, CASE WHEN n = 'click' THEN 'alerts' WHEN n IN ('purchase', 'sign') THEN 'money' WHEN n = 'view' THEN 'browsing'
  WHEN source_name LIKE 'Facebook%' AND n LIKE 'purchase%' THEN 'money' WHEN source_name LIKE 'signal%' AND n LIKE 'sign%' THEN 'money'
  WHEN source_name LIKE 'signal%' AND n LIKE 'view%' THEN 'browsing' ELSE channel_name END AS theme FROM k"""
add("resolve_themes", _THEMED, lambda spark, sf: resolve_themes(_channels(spark, sf), demo.DEMO_CONFIG))
add(
    "channel_and_theme_ids",
    f"WITH t AS ({_THEMED}), ch AS (SELECT *, row_number() OVER (ORDER BY source_name, raw_id) AS id FROM t), "
    "th AS (SELECT theme, row_number() OVER (ORDER BY MIN(id)) AS theme_id FROM ch GROUP BY 1), "
    "so AS (SELECT source_name, row_number() OVER (ORDER BY source_name) AS source_id FROM (SELECT DISTINCT source_name FROM t)) "
    "SELECT ch.id, so.source_id, ch.raw_id AS platform_channel_id, ch.channel_name AS name, th.theme_id FROM ch JOIN th USING (theme) JOIN so USING (source_name)",
    lambda spark, sf: build.channel_tables(
        _channels(spark, sf).select(F.col("source_name").alias("name"), F.lower(F.split_part("source_name", F.lit(":"), F.lit(1))).alias("platform")).distinct(),
        _channels(spark, sf).select("source_name", "raw_id", F.col("channel_name").alias("name")), demo.DEMO_CONFIG,
    )[1],
)


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = demo.demo_chat(spark, sf_dir).messages.select("id", "ts", "person_id")
    even = F.col("id").cast("bigint") % 2 == 0
    later = m.filter(even).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    same = m.filter(~even).withColumn("person_id", F.lit(-1))
    every = m.withColumn("ord", F.lit(1)).unionByName(later.withColumn("ord", F.lit(0))).unionByName(same.withColumn("ord", F.lit(2)))
    # one message was exported over and over
    third = m.select(F.lit("1").alias("id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "person_id", F.lit(3).alias("ord"))
    return every.unionByName(third)


add(
    "dedupe_messages", "SELECT CAST(event_id AS STRING) AS id, ts, CAST(user_id AS INT) AS person_id FROM events",
    lambda spark, sf: build.dedupe_messages(_copies(spark, sf)).drop("ord"),
)
add(
    "numbered_in_time",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events",
    lambda spark, sf: numbering.numbered_in_time(demo.tables(spark, sf)["events"].select("event_id", "ts"), ["event_id"]).drop("ts"),
)


def _member_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.tables(spark, sf_dir)["events"].filter(F.col("event_id") % 5 == 4)
    person = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(
        F.lit("Facebook: demo").alias("source_name"), F.lit("facebook").alias("platform"), F.col("event_type").alias("channel_raw_id"),
        F.lit("added").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.lit("nobody")).otherwise(person).alias("actor_raw_id"),
        F.when(F.col("event_id") % 25 == 4, F.lit("gone")).otherwise(person).alias("target_raw_id"), "ts",
        F.col("event_id").cast("string").alias("payload_json"),
    )


def _member_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.demo_chat(spark, sf_dir)
    return build.member_event_table(_member_seeds(spark, sf_dir), c.sources, c.channels, c.platform_identities)


add(
    "member_event_table",
    "WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS id FROM events WHERE event_id % 5 = 4) "
    "SELECT id, CAST(3 AS INT) AS channel_id, CAST(2 AS INT) AS source_id, 'added' AS kind, CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(user_id AS INT) END AS "
    "actor_person_id, CAST(user_id AS INT) AS target_person_id, ts, CAST(event_id AS STRING) AS payload_json FROM e WHERE event_type = 'purchase' AND event_id % 25 <> 4",
    _member_table,
)


def _change_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.tables(spark, sf_dir)["events"].filter(F.col("event_id") % 5 == 1)
    person = F.col("event_id") % 2 == 0
    seeds = e.select(
        F.lit("Facebook: demo").alias("source_name"), F.lit("facebook").alias("platform"),
        F.when(person, "person").otherwise("channel").alias("entity_kind"),
        F.when(person, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.lit("purchase")).alias("entity_raw_id"),
        F.lit(None).cast("string").alias("previous_name"), F.col("event_type").alias("new_name"), "ts", F.lit("k").alias("kind"),
        F.col("props").alias("payload_json"),
    )
    c = demo.demo_chat(spark, sf_dir)
    persons, chats = build.name_change_tables(seeds, c.sources, c.channels, c.platform_identities)
    return persons.select("id", F.col("person_id").alias("entity_id"), "source_id", "new_name", "ts").unionByName(
        chats.select("id", (-F.col("channel_id")).alias("entity_id"), "source_id", "new_name", "ts")
    )


add(
    "name_change_tables",
    "SELECT row_number() OVER (ORDER BY ts, event_id) AS id, CAST(CASE WHEN event_id % 2 = 0 THEN user_id ELSE -3 END AS INT) AS entity_id, "
    "CAST(2 AS INT) AS source_id, event_type AS new_name, ts FROM events WHERE event_id % 5 = 1",
    _change_tables,
)
