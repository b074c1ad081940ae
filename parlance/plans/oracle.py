"""Building blocks of the plain SQL the operators are checked against.

Every statement is written independently of the operators: window functions over
the whole table, self joins, correlated look-ups - whatever states the meaning
most directly.
"""

from __future__ import annotations

from ..functions import text as tx
from . import demo

_SPACES = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQUEEZED = f"trim(regexp_replace(coalesce(content, ''), '{_SPACES}', ' ', 'g'))"
TOKENS = "regexp_extract_all(replace(lower(coalesce(content, '')), chr(39), ''), '[a-z]{3,}')"
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
BOTS = "'User 7', 'User 42'"
DEFAULT = (
    "NOT m.is_system AND m.id NOT IN ('10', '20', '400') "
    f"AND m.person_id NOT IN (SELECT id FROM people WHERE display_name IN ({BOTS}))"
)


def domain(host: str) -> str:
    yt = ", ".join(f"'{h}'" for h in tx.DOMAIN_ALIASES["youtube.com"])
    sc = ", ".join(f"'{h}'" for h in tx.DOMAIN_ALIASES["soundcloud.com"])
    return (
        f"CASE WHEN lower({host}) IN ({yt}) THEN 'youtube.com' "
        f"WHEN lower({host}) IN ({sc}) THEN 'soundcloud.com' ELSE lower({host}) END"
    )


_MESSAGES = f"""
raw_messages AS ({demo.MESSAGES_TEXT}),
sized AS (
  SELECT *, CAST(CASE WHEN {SQUEEZED} = '' THEN 0 ELSE len(string_split({SQUEEZED}, ' ')) END AS INT) AS word_count,
    CAST(length({SQUEEZED}) AS INT) AS char_count,
    lag(ts) OVER (PARTITION BY channel_id ORDER BY ts, id) AS prev_ts FROM raw_messages
),
runs AS (
  SELECT *, SUM(CASE WHEN prev_ts IS NULL OR ts - prev_ts > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY channel_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS seq FROM sized
),
run_sizes AS (SELECT channel_id, MAX(seq) AS n, MIN(ts) AS first_ts FROM runs GROUP BY channel_id),
run_offsets AS (
  SELECT channel_id, coalesce(SUM(n) OVER (ORDER BY first_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n
  FROM run_sizes
),
messages AS (
  SELECT r.* EXCLUDE (prev_ts, seq), CAST(r.seq + o.before_n AS BIGINT) AS conversation_id
  FROM runs r JOIN run_offsets o USING (channel_id)
)"""

_DIMS = f"""
channels AS ({demo.CHANNELS}), sources AS ({demo.SOURCES}), themes AS ({demo.THEMES}), people AS ({demo.PEOPLE}),
channel_dim AS (
  SELECT c.id AS channel_id, c.name AS channel_name, c.platform_channel_id, c.theme_id, c.source_id, s.platform,
    s.name AS source_name FROM channels c JOIN sources s ON s.id = c.source_id
)"""


def with_(body: str, where: str = DEFAULT, extra: str = "") -> str:
    """A statement over ``scoped``: messages of the scope with channel and source columns."""
    more = f",\n{extra}" if extra else ""
    return f"""WITH {_MESSAGES},{_DIMS},
scoped AS (
  SELECT m.*, d.channel_name, d.source_name, d.platform, d.theme_id, d.source_id
  FROM messages m JOIN channel_dim d USING (channel_id) WHERE {where}
){more}
{body}"""


TOKEN_CTE = f"tokens AS (SELECT * EXCLUDE (content), unnest({TOKENS}) AS token FROM scoped)"
LINK_CTE = (
    "links0 AS (SELECT *, unnest(regexp_extract_all(coalesce(content, ''), 'https?://([^/?#\\s]+)', 1)) AS host FROM scoped),\n"
    f"links AS (SELECT *, {domain('host')} AS domain FROM links0 WHERE host <> '')"
)
MENTION_CTE = (
    "mentions AS (SELECT lower(unnest(regexp_extract_all(coalesce(content, ''), '@([A-Za-z0-9_]+)', 1))) AS mention FROM scoped)"
)
METRIC = {
    "messages": ("COUNT(*)", "true"),
    "words": ("CAST(SUM(coalesce(word_count, 0)) AS BIGINT)", "true"),
    "conversations": ("COUNT(DISTINCT conversation_id)", "conversation_id IS NOT NULL"),
}


def counted(keys: dict[str, str], metric: str = "messages", name: str = "message_count", tail: str = "", where: str = DEFAULT) -> str:
    value, cond = METRIC[metric]
    cols = ", ".join(f"{sql} AS {alias}" for alias, sql in keys.items())
    return with_(f"SELECT {cols}, {value} AS {name} FROM scoped WHERE {cond} GROUP BY ALL {tail}", where)


def bucket(unit: str) -> str:
    return f"CAST(date_trunc('{unit}', ts) AS TIMESTAMP)"


#: reactions, one row per single reaction
REACTION_CTE = f"""
reacted AS (
  SELECT m.id, m.reaction_count, d.platform,
    CASE WHEN json_valid(m.reaction_details_json) AND json_type(m.reaction_details_json) = 'ARRAY'
      THEN [{{'name': json_extract_string(x, '$.name'), 'n': greatest(coalesce(TRY_CAST(json_extract_string(x, '$.count') AS BIGINT), 0), 0),
              'image_url': json_extract_string(x, '$.image_url'), 'code': json_extract_string(x, '$.code'),
              'animated': coalesce(json_extract_string(x, '$.is_animated') = 'true', false),
              'reactors': CAST(json_extract(x, '$.reactors[*]') AS JSON[])}}
            for x in CAST(json_extract(m.reaction_details_json, '$[*]') AS JSON[])]
      ELSE [{{'name': regexp_extract(s, '(\\S+)×(\\d+)', 1), 'n': CAST(regexp_extract(s, '(\\S+)×(\\d+)', 2) AS BIGINT),
              'image_url': CAST(NULL AS VARCHAR), 'code': CAST(NULL AS VARCHAR), 'animated': false, 'reactors': CAST([] AS JSON[])}}
            for s in regexp_extract_all(coalesce(m.reaction_summary, ''), '\\S+×\\d+')] END AS items
  FROM messages m JOIN channel_dim d USING (channel_id) WHERE m.reaction_count > 0
),
listed AS (SELECT id, platform, reaction_count, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM reacted),
clamped AS (
  SELECT id, platform, pos, x, reaction_count,
    least(coalesce(SUM(x.n) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), reaction_count) AS taken
  FROM listed
),
allotted AS (
  SELECT id, platform, pos, x, CAST(least(x.n, reaction_count - taken) AS BIGINT) AS n FROM clamped
  UNION ALL BY NAME
  SELECT r.id, r.platform, 1000000 AS pos, CAST(NULL AS STRUCT(name VARCHAR, n BIGINT, image_url VARCHAR, code VARCHAR, animated BOOLEAN, reactors JSON[])) AS x,
    CAST(r.reaction_count - coalesce((SELECT SUM(least(c.x.n, c.reaction_count - c.taken)) FROM clamped c WHERE c.id = r.id), 0) AS BIGINT) AS n
  FROM reacted r
),
one_by_one AS (SELECT id, platform, pos, x, n, unnest(range(n)) AS k FROM allotted WHERE n > 0),
placed AS (
  SELECT id, platform, x, k,
    list_filter(coalesce(x.reactors, [])[1:n], lambda r: trim(coalesce(json_extract_string(r, '$.raw_id'), '')) <> '') AS who,
    row_number() OVER (PARTITION BY id ORDER BY pos, k) - 1 AS reaction_index
  FROM one_by_one
),
identities AS ({demo.IDENTITIES}),
reaction_events AS (
  SELECT p.id AS message_id, CAST(p.reaction_index AS INT) AS reaction_index,
    coalesce(nullif(trim(p.x.name), ''), 'unknown') AS emoji,
    CASE WHEN p.k < len(p.who) THEN coalesce(nullif(json_extract_string(p.who[p.k + 1], '$.platform'), ''), p.platform) END AS reactor_platform,
    CASE WHEN p.k < len(p.who) THEN json_extract_string(p.who[p.k + 1], '$.raw_id') END AS reactor_raw_id,
    CASE WHEN p.k < len(p.who) THEN json_extract_string(p.who[p.k + 1], '$.display_name') END AS reactor_display_name,
    i.person_id AS reactor_person_id, p.x.image_url AS image_url, p.x.code AS code, coalesce(p.x.animated, false) AS is_animated
  FROM placed p LEFT JOIN identities i
    ON i.platform = coalesce(nullif(json_extract_string(p.who[p.k + 1], '$.platform'), ''), p.platform)
   AND i.platform_user_id = json_extract_string(p.who[p.k + 1], '$.raw_id') AND p.k < len(p.who)
)"""
