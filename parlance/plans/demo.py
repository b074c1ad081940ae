"""A chat dataset seen through the star-schema test tables.

The view texts run unchanged in Spark and in other SQL engines, so the same text
feeds the operators and the SQL they are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Identity, PersonRule, ThemeRule
from ..functions import text as tx
from ..model import Chat
from ..operators.sessions import assign_conversations
from ..session import shares, use_utc

CHANNEL_OF_EVENT = (
    "CAST(CASE e.event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
    "WHEN 'signup' THEN 4 ELSE 5 END AS INT)"
)

_HEAD = f"""
SELECT CAST(e.event_id AS STRING) AS id, {CHANNEL_OF_EVENT} AS channel_id,
  CAST(e.user_id AS INT) AS person_id, e.ts AS ts"""

# documents are as many as events at scale, so both are partitioned by the key rather than one being copied around
_JOIN_HINT = "/*+ MERGE(d) */ "

_TAIL = """
  CASE WHEN e.event_id % 9 = 0 AND e.event_id > 0 THEN CAST(e.event_id - 1 AS STRING) END AS reply_to_id,
  CAST(CASE WHEN e.event_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS attachment_count,
  CASE WHEN e.event_id % 7 <> 0 THEN NULL WHEN e.event_id % 5 = 0 THEN 'media/a.JPG?x=1#f' WHEN e.event_id % 5 = 1 THEN 'media/b.gif'
       WHEN e.event_id % 5 = 2 THEN 'media/c.mp4' WHEN e.event_id % 5 = 3 THEN 'sticker' ELSE 'media/d.pdf' END AS attachment_preview,
  CAST(CAST(floor(e.value) AS BIGINT) % 4 AS INT) AS reaction_count,
  CASE e.event_id % 6 WHEN 1 THEN '👍×1 🔥×2' WHEN 3 THEN '😂×3' END AS reaction_summary,
  CASE e.event_id % 6
    WHEN 0 THEN concat('[{"name":"👍","count":2,"reactors":[{"platform":"discord","raw_id":"u', CAST(e.event_id % 5 AS STRING), '","display_name":"R"}]},{"name":"❤","count":5,"image_url":"img/h.png"}]')
    WHEN 2 THEN '[]' WHEN 3 THEN 'not json'
    WHEN 4 THEN '[{"name":" ","count":1,"code":"x","is_animated":true,"reactors":[{"raw_id":""},{"raw_id":"u3"}]},{"name":"🎉","count":2,"reactors":[{"raw_id":"u3"},{"raw_id":"u999999","display_name":"Guest"}]}]'
  END AS reaction_details_json,
  e.event_id % 11 = 0 AS is_edited, (e.event_type = 'signup' AND e.event_id % 13 = 0) AS is_system
FROM events e"""

MESSAGES_TEXT = (
    _HEAD.replace("SELECT ", "SELECT " + _JOIN_HINT, 1)
    + ",\n  NULLIF(concat_ws(' ', d.text, p.url), '') AS content,"
    + _TAIL
    + " LEFT JOIN documents d ON d.doc_id * 10 = e.event_id LEFT JOIN pages p ON p.page_id * 40 = e.event_id"
)
#: the same rows for queries that do not look at the text
MESSAGES_PLAIN = _HEAD + "," + _TAIL

CHANNELS = (
    "SELECT * FROM (VALUES (1,1,'click','click',1),(2,1,'error','error',1),(3,2,'purchase','purchase',2),"
    "(4,3,'signup','signup',2),(5,3,'view','view',3)) AS t(id,source_id,platform_channel_id,name,theme_id)"
)
SOURCES = (
    "SELECT * FROM (VALUES (1,'discord','Discord: demo'),(2,'facebook','Facebook: demo'),(3,'signal','Signal: demo'))"
    " AS t(id,platform,name)"
)
PEOPLE = (
    "SELECT DISTINCT CAST(user_id AS INT) AS id, concat('User ', CAST(user_id AS STRING)) AS display_name,"
    " '#888888' AS color FROM events"
)
THEMES = "SELECT * FROM (VALUES (1,'alerts'),(2,'money'),(3,'browsing')) AS t(id,name)"
IDENTITIES = (
    "SELECT s.platform, concat('u', CAST(p.id AS STRING)) AS platform_user_id, p.display_name AS platform_username,"
    f" p.id AS person_id FROM ({PEOPLE}) p JOIN ({SOURCES}) s ON s.id > 0"
)
_SOURCE_OF_EVENT = "CAST(CASE e.event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS INT)"
PERSON_CHANGES = f"""
SELECT CAST(e.event_id AS INT) AS id, CAST(e.user_id AS INT) AS person_id, {_SOURCE_OF_EVENT} AS source_id,
  'nickname-change' AS kind, CASE WHEN e.event_id % 40 = 1 THEN 'Old' END AS previous_name,
  CASE WHEN e.event_id % 60 = 21 THEN '(cleared)' ELSE concat('Nick ', CAST(e.event_id % 7 AS STRING)) END AS new_name,
  e.ts AS ts,
  concat('{{"chatId": "', e.event_type, '", "actor_name": "User ', CAST(e.user_id AS STRING), '", "actor_raw_id": "u',
         CAST(e.user_id AS STRING), '"}}') AS payload_json
FROM events e WHERE e.event_id % 20 = 1"""
CHANNEL_CHANGES = f"""
SELECT CAST(e.event_id AS INT) AS id, {CHANNEL_OF_EVENT} AS channel_id, {_SOURCE_OF_EVENT} AS source_id,
  'channel-title-change' AS kind,
  CASE WHEN e.event_id % 60 = 32 THEN concat('Room ', CAST(CAST(floor(e.value) AS BIGINT) % 3 AS STRING)) END AS previous_name,
  CASE WHEN e.event_id % 90 = 2 THEN ' ' ELSE concat('Room ', CAST(CAST(floor(e.value) AS BIGINT) % 5 AS STRING)) END AS new_name, e.ts AS ts,
  concat('{{"actor_name": "User ', CAST(e.user_id AS STRING), '", "actor_raw_id": "u', CAST(e.user_id AS STRING), '"}}') AS payload_json
FROM events e WHERE e.event_id % 30 = 2"""
MEMBER_EVENTS = f"""
SELECT CAST(e.event_id AS INT) AS id, {CHANNEL_OF_EVENT} AS channel_id, {_SOURCE_OF_EVENT} AS source_id,
  CASE e.event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'left' END AS kind,
  CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE CAST(CAST(floor(e.value) AS BIGINT) % 10 AS INT) END AS actor_person_id,
  CAST(e.user_id AS INT) AS target_person_id, e.ts AS ts
FROM events e WHERE e.event_id % 5 = 4"""

DEMO_CONFIG = Config(
    people=(
        PersonRule("User 3", "#112233", "https://example.org/3.png", identities=(Identity("discord", "u3"),)),
        PersonRule("User 5", "", identities=(Identity("signal", "u5"),)),
        PersonRule("User 7", is_bot=True, identities=(Identity("discord", "u7"),)),
        PersonRule("User 42", is_bot=True, identities=(Identity("discord", "u42"),)),
    ),
    themes=(
        ThemeRule("alerts", "🚨", (("Discord: demo", "click"), ("discord:  DEMO", "Error"))),
        ThemeRule("money", "💰", (("Facebook: demo", "purchase"), ("Signal: demo", "sign"))),
        ThemeRule("browsing", "", (("Signal: demo", "view"),)),
    ),
    excluded_message_ids=frozenset({"10", "20", "400"}),
    facebook_names={"purchase": "Shopping"},
)
#: without a display name for the Facebook folder and without bots or people limits
OPEN_CONFIG = Config(themes=DEMO_CONFIG.themes)

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    use_utc(spark)
    return {name: spark.read.schema(ddl).parquet(f"{sf_dir}/{name}.parquet") for name, ddl in SCHEMAS.items()}


def sql_on(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Runs a view text over the given frames under temporary names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql)


class DemoChat(Chat):
    """The dataset over one folder; a table is set up when a query first asks for it."""

    VIEWS = {
        "channels": CHANNELS, "sources": SOURCES, "people": PEOPLE, "themes": THEMES, "platform_identities": IDENTITIES,
        "person_name_changes": PERSON_CHANGES, "channel_name_changes": CHANNEL_CHANGES, "member_events": MEMBER_EVENTS,
    }

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config, text: bool, counts: bool, conversations: bool):
        self._tables = tables(spark, sf_dir)
        self.config = config
        if text or counts:
            messages = sql_on(spark, MESSAGES_TEXT, **self._dealt())
        else:
            messages = sql_on(spark, MESSAGES_PLAIN, **self._tables)
        if counts:
            messages = messages.withColumn("word_count", tx.word_count(F.col("content"))).withColumn(
                "char_count", tx.char_count(F.col("content"))
            )
        else:
            messages = messages.withColumn("word_count", F.lit(None).cast("int"))
        if not text and not counts:
            messages = messages.withColumn("content", F.lit(None).cast("string"))
        if conversations:
            messages = assign_conversations(messages)
        else:
            messages = messages.withColumn("conversation_id", F.lit(None).cast("int"))
        self.messages = messages

    def _dealt(self) -> dict[str, DataFrame]:
        """The tables, dealt out by the keys of the join with the texts: the more there is, the more tasks."""
        t = self._tables
        parts = shares(*t.values())
        return t | {
            "events": t["events"].repartition(parts, "event_id"),
            "documents": t["documents"].repartition(parts, F.col("doc_id") * 10),
        }

    def __getattribute__(self, name: str):
        views = DemoChat.VIEWS
        if name in views and name not in object.__getattribute__(self, "__dict__"):
            self.__dict__[name] = sql_on(self.messages.sparkSession, views[name], **self._tables)
        return object.__getattribute__(self, name)


def demo_chat(
    spark: SparkSession,
    sf_dir: str,
    *,
    text: bool = False,
    counts: bool = False,
    conversations: bool = False,
    config: Config = DEMO_CONFIG,
) -> Chat:
    """The dataset over one folder. Text, word counts and conversation ids only where a query needs them."""
    return DemoChat(spark, sf_dir, config, text, counts, conversations)
