"""Edge cases the shared test tables do not hold."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance import Chat, Config, Filters, Identity, PersonRule, ThemeRule
from parlance.config import load_config, parse_moderation, parse_people, parse_themes
from parlance.functions import text as tx
from parlance.functions.names import stable_color, unquote
from parlance.model import int_list
from parlance.operators import diversity, facts, people
from parlance.operators.asof import as_of, change_leaves
from parlance.operators.history import actor_display_name
from parlance.operators.links import attachment_kind, domain_examples, is_url_only, shown_links, without_links
from parlance.operators.numbering import numbered, numbered_in_time
from parlance.operators.reactions import reaction_events, top_reacted_messages
from parlance.operators.resolve import resolve_people, resolve_themes
from parlance.operators.scope import scope
from parlance.operators.search import query_grams, search_matches
from parlance.operators.sessions import activity_sessions, assign_conversations, longest_gap, longest_session_span, with_start_message
from parlance.operators.words import word_examples

T0 = datetime(2024, 1, 1)


def messages(spark, rows):
    """rows of (id, channel, person, ts, content)"""
    df = spark.createDataFrame(rows, "id string, channel_id int, person_id int, ts timestamp_ntz, content string")
    return df.withColumn("is_system", F.lit(False)).withColumn("reaction_count", F.lit(0)).withColumn(
        "word_count", tx.word_count(F.col("content"))
    ).withColumn("conversation_id", F.lit(1))


def small_chat(spark, rows, config=Config(), **more):
    ids = sorted({r[2] for r in rows})
    return Chat(
        messages=messages(spark, rows),
        channels=spark.createDataFrame([(1, 1, "c", "c", 1), (2, 1, "d", "d", 1)], "id int, source_id int, platform_channel_id string, name string, theme_id int"),
        sources=spark.createDataFrame([(1, "discord", "Discord: s")], "id int, platform string, name string"),
        people=spark.createDataFrame([(i, f"P{i}", "#000000") for i in ids], "id int, display_name string, color string"),
        themes=spark.createDataFrame([(1, "t")], "id int, name string"),
        config=config, **more,
    )


# -- sessions ----------------------------------------------------------------
def test_conversation_gap_is_strict(spark):
    times = [T0, T0 + timedelta(minutes=30), T0 + timedelta(minutes=60, microseconds=1)]
    df = messages(spark, [(str(i), 1, 1, t, "x") for i, t in enumerate(times)]).drop("conversation_id")
    got = {r.id: r.conversation_id for r in assign_conversations(df).collect()}
    assert got == {"0": 1, "1": 1, "2": 2}


def test_conversations_equal_a_sequential_walk(spark):
    rng = random.Random(5)
    rows = [
        (str(i), rng.choice([1, 1, 1, 2, 3]), 1, T0 + timedelta(seconds=rng.randrange(4 * 86400), microseconds=rng.randrange(3)), "x")
        for i in range(1500)
    ]
    got = {r.id: r.conversation_id for r in assign_conversations(messages(spark, rows).drop("conversation_id")).collect()}
    per, last, number, want = {}, {}, 0, {}
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        per.setdefault(row[1], []).append(row)
    for channel, items in per.items():
        for row in items:
            if channel not in last or (row[3] - last[channel]).total_seconds() > 1800:
                number += 1
            last[channel] = row[3]
            want[row[0]] = number
    assert got == want


def test_sessions_count_minute_boundaries(spark):
    times = [T0 + timedelta(seconds=59), T0 + timedelta(minutes=15, seconds=1), T0 + timedelta(minutes=31)]
    df = messages(spark, [(str(i), 1, 1, t, "x") for i, t in enumerate(times)])
    got = sorted((r.start_message_id, r.duration_seconds) for r in with_start_message(activity_sessions(df), df).collect())
    assert got == [("0", 842), ("2", 0)]


@pytest.mark.parametrize("seed", range(4))
def test_gap_and_session_against_brute_force(spark, seed):
    """Sessions over midnight, days with one run, days without messages, equal instants."""
    rng = random.Random(seed)
    at, times = T0 - timedelta(minutes=seed * 30), []
    for _ in range(250):
        at += rng.choice([timedelta(0), timedelta(seconds=rng.randrange(90)), timedelta(minutes=rng.randrange(40)), timedelta(minutes=rng.randrange(200))])
        at += rng.choice([timedelta(0)] * 60 + [timedelta(days=2)])
        times.append(at)
    df = spark.createDataFrame([(f"m{i:03}", t) for i, t in enumerate(times)], "id string, ts timestamp_ntz")
    second = lambda t: int((t - T0) // timedelta(seconds=1))
    minute = lambda t: int((t - T0) // timedelta(minutes=1))
    gaps = [(second(b) - second(a), a, b) for a, b in zip(times, times[1:])]
    assert [tuple(r) for r in longest_gap(df).collect()] == [min(gaps, key=lambda g: (-g[0], g[1]))]
    runs = [[times[0], times[0]]]
    for a, b in zip(times, times[1:]):
        if minute(b) - minute(a) > 15:
            runs.append([b, b])
        runs[-1][1] = b
    best = min(runs, key=lambda r: (-(second(r[1]) - second(r[0])), r[0]))
    assert [tuple(r) for r in longest_session_span(df).collect()] == [(second(best[1]) - second(best[0]), best[0])]
    assert longest_session_span(df.limit(0)).count() == longest_gap(df.limit(0)).count() == longest_gap(df.limit(1)).count() == 0


def test_longest_gap_within_one_second(spark):
    def gap(*micros):
        df = messages(spark, [(str(i), 1, 1, T0 + timedelta(microseconds=m), "x") for i, m in enumerate(micros)])
        return [tuple(r) for r in longest_gap(df.select("ts")).collect()]

    assert gap(5) == []
    assert gap(900_000, 5, 7) == [(0, T0 + timedelta(microseconds=5), T0 + timedelta(microseconds=7))]
    assert gap(900_000, 2_100_000)[0][0] == 2


def test_numbering(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "k string")
    rows = numbered(df, ["k"]).collect()
    assert sorted(r.id for r in rows) == list(range(1, 301)) and all(int(r.k[1:]) + 1 == r.id for r in rows)


# -- text --------------------------------------------------------------------
def test_tokens_links_mentions(spark):
    df = messages(spark, [("m", 1, 1, T0, "Hello hello@example and @Daniel: https://youtu.be/demo")])
    assert [r.token for r in facts.message_tokens(df).orderBy("token_index").collect()] == [
        "hello", "hello", "example", "and", "daniel", "https", "youtu", "demo",
    ]
    assert [(r.raw_host, r.domain) for r in facts.message_links(df).collect()] == [("youtu.be", "youtube.com")]
    assert [r.mention for r in facts.message_mentions(df).orderBy("mention_index").collect()] == ["example", "daniel"]


def test_trigrams_are_whole_and_distinct(spark):
    rng = random.Random(1)
    texts = ["ab", "aaaa", "".join(rng.choice("ab ü😀\n") for _ in range(4000))]
    df = messages(spark, [(str(i), 1, 1, T0, t) for i, t in enumerate(texts)])
    got = {}
    for r in facts.message_trigrams(df).collect():
        got.setdefault(r.message_id, []).append(r.gram)
    want = {str(i): {t.lower()[k : k + 3] for k in range(len(t) - 2)} for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_word_counts_split_on_any_space(spark):
    df = messages(spark, [("a", 1, 1, T0, " one two\n\tthree  "), ("b", 1, 1, T0, " \n"), ("c", 1, 1, T0, None)])
    got = df.select("id", tx.word_count(F.col("content")), tx.char_count(F.col("content"))).collect()
    assert [tuple(r) for r in got] == [("a", 3, 13), ("b", 0, 0), ("c", 0, 0)]


def test_search_patterns(spark):
    rows = [("1", 1, 1, T0, "50% off"), ("2", 1, 1, T0, "50 and off"), ("3", 1, 1, T0, "a\\b"), ("4", 1, 1, T0, "ÜBER"), ("5", 1, 1, T0, "a_b")]
    plain = small_chat(spark, rows)
    indexed = small_chat(spark, rows, trigrams=facts.message_trigrams(messages(spark, rows)))

    def hits(chat, q):
        return sorted(r.id for r in search_matches(chat, q).collect())

    assert hits(plain, "50%OFF") == ["1", "2"]
    # the index takes wildcards literally, so it narrows them
    assert hits(indexed, "50%off") == []
    assert hits(indexed, "% o") == ["1"]
    assert hits(plain, "a\\b") == hits(indexed, "a\\b") == ["3"]
    assert hits(plain, "über") == [] and hits(plain, "ÜBER") == ["4"]
    assert hits(plain, "a_") == ["3", "5"] or hits(plain, "a_") == ["2", "3", "5"]
    assert query_grams("ABCab") == ["abc", "bca", "cab"]
    with pytest.raises(ValueError):
        search_matches(plain, "")


def test_shown_links(spark):
    text = "a https://youtu.be/x1?t=3, b https://www.youtube.com/watch?v=x1 c (https://e.org/p). d https://f.org/q"
    df = spark.createDataFrame([(text,), ("https://e.org/a https://e.org/a​",), ("http://",), (None,)], "c string")
    rows = df.select(
        shown_links(F.col("c")).alias("l"), is_url_only(F.col("c")).alias("u"), without_links(F.col("c"), shown_links(F.col("c"))).alias("t")
    ).collect()
    assert rows[0].l == ["https://youtu.be/x1?t=3", "https://e.org/p"] and not rows[0].u
    assert rows[0].t == "a , b https://www.youtube.com/watch?v=x1 c (). d https://f.org/q"
    assert rows[1].l == ["https://e.org/a", "https://e.org/a​"] or rows[1].u
    assert rows[2].l == [] and rows[3].l == [] and rows[3].t == ""


def test_attachment_kinds(spark):
    cases = {
        "x.JPG?y": "image", "a.webm#t": "video", "b.flac": "audio", "https://e.org/x": "link", "sticker": "label",
        "/api/media-removed": "image", "x.jpgz": "label",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "p string")
    got = {r.p: r.k for r in df.select("p", attachment_kind(F.col("p")).alias("k")).collect()}
    assert got == {**cases, None: None}


# -- people ------------------------------------------------------------------
def walk(words):
    if not words:
        return 0.0
    if len(words) == 1:
        return 1.0
    kinds, n, factors, ratio = set(), 0, 0.0, 1.0
    for w in words:
        kinds.add(w)
        n += 1
        ratio = len(kinds) / n
        if ratio <= 0.72:
            factors, kinds, n = factors + 1, set(), 0
    if n:
        factors += (1 - ratio) / (1 - 0.72)
    return len(words) / factors if factors else float(len(words))


@pytest.mark.parametrize("pieces", [1, 7])
def test_mtld_equals_a_sequential_walk(spark, pieces):
    rng = random.Random(3)
    vocabulary = ["w" + "".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    rows, said = [], {}
    for i in range(900):
        # one person writes most of everything
        person = rng.choice([1] * 8 + [2, 3])
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]
        rows.append((f"{i:04d}", 1, person, T0 + timedelta(minutes=i), " ".join(words)))
        said.setdefault(person, []).extend(words)
    rows.append(("x", 1, 4, T0, "single"))
    said[4] = ["single"]
    same = ["same"] * 50
    rows.append(("y", 1, 5, T0, " ".join(same)))
    said[5] = same
    different = ["".join(chr(97 + int(d)) for d in f"{k:05d}") for k in range(400)]
    for k in range(0, 400, 10):
        rows.append((f"z{k:03d}", 1, 6, T0 + timedelta(seconds=k), " ".join(different[k : k + 10])))
    said[6] = different
    got = {r.person_id: r.mtld for r in diversity.mtld(messages(spark, rows), pieces).collect()}
    want = {p: (walk(w) + walk(w[::-1])) / 2 for p, w in said.items()}
    assert got == pytest.approx(want)


def test_exclusive_words(spark):
    rows = [("1", 1, 1, T0, "alpha shared alpha"), ("2", 1, 2, T0, "beta shared beta Zebra")]
    chat = small_chat(spark, rows)
    words = spark.createDataFrame([("Zebra ",), ("be",), ("b3ta",)], "word string")
    got = people.exclusive_words(chat, 2, dictionary=words).collect()
    assert [tuple(r) for r in got] == [("beta", False, False), ("zebra", True, False)]
    assert [r.word for r in people.exclusive_words(chat, 2, Filters(people=(2,))).collect()] == ["beta", "shared", "zebra"]


# -- reactions ---------------------------------------------------------------
def events(spark, count, details=None, summary=None):
    df = spark.createDataFrame(
        [("m", "discord", count, summary, details)],
        "id string, platform string, reaction_count int, reaction_summary string, reaction_details_json string",
    )
    who = spark.createDataFrame([("discord", "u1", "U", 9)], "platform string, platform_user_id string, platform_username string, person_id int")
    rows = reaction_events(df, who).orderBy("reaction_index").collect()
    assert [r.reaction_index for r in rows] == list(range(len(rows)))
    return [(r.emoji, r.reactor_raw_id, r.reactor_person_id) for r in rows]


def test_reaction_clamp(spark):
    listed = json.dumps([
        {"name": "A", "count": 2, "reactors": [{"raw_id": " "}, {"raw_id": "u1"}, {"raw_id": "cut"}]},
        {"name": None, "count": "x"}, {"name": "B", "count": 5}, {"name": "C", "count": 1},
    ])
    assert events(spark, 4, listed) == [("A", "u1", 9), ("A", None, None), ("B", None, None), ("B", None, None)]
    assert events(spark, 3, json.dumps([{"name": "A", "count": 1}])) == [("A", None, None)] + [("unknown", None, None)] * 2
    assert events(spark, 2, "broken", "👍×1 x×9") == [("👍", None, None), ("x", None, None)]
    # a valid empty list does not fall back to the summary
    assert events(spark, 1, "[]", "👍×1") == [("unknown", None, None)]
    assert events(spark, 0, listed) == []
    assert events(spark, 2, json.dumps([{"name": "A", "count": 2, "reactors": [{"raw_id": "u1"}, {"raw_id": "zz"}]}])) == [
        ("A", "u1", 9), ("A", "zz", None),
    ]


@pytest.mark.parametrize("words", ["none restarts", "restarts are rare"])
def test_mtld_of_many_pieces_needs_few_rounds(spark, monkeypatch, words):
    """64 pieces of somebody who never restarts: one walk, six doublings, one walk with what they give."""
    rng = random.Random(5)
    letters = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(4)) + "q"
    rows, n = [], 0
    for i in range(640):
        text = []
        for _ in range(6):
            repeat = words != "none restarts" and n and rng.random() < 0.24
            text.append(letters(rng.randrange(n) if repeat else n))
            n += 1
        rows.append((f"m{i:04}", 1, 2**40, T0 + timedelta(minutes=i), " ".join(text)))
    walks, doublings = [], []
    both = diversity._both_ways
    monkeypatch.setattr(diversity, "_both_ways", lambda *a: walks.append(1) or both(*a))
    pin = diversity.pinned
    monkeypatch.setattr(diversity, "pinned", lambda df: doublings.append("span" in df.columns) or pin(df))
    df = spark.createDataFrame(rows, "id string, channel_id int, person_id long, ts timestamp_ntz, content string")
    got = diversity.mtld(df, 64).collect()
    tokens = [w for *_, text in rows for w in text.split()]
    assert [(r.person_id, round(r.mtld, 9)) for r in got] == [(2**40, round((walk(tokens) + walk(tokens[::-1])) / 2, 9))]
    if words == "none restarts":
        assert len(walks) <= 2 and sum(doublings) <= 2 * 7


# -- names -------------------------------------------------------------------
def test_as_of(spark):
    rng = random.Random(9)
    f = [(i, rng.choice("ab"), T0 + timedelta(hours=rng.randrange(200))) for i in range(300)] + [(999, None, T0)]
    c = [(rng.choice("ab"), T0 + timedelta(hours=rng.randrange(200)), rng.choice(["x", "y", None]), i) for i in range(25)]
    facts_df = spark.createDataFrame(f, "id int, k string, ts timestamp_ntz")
    changes = spark.createDataFrame(c, "k string, ts timestamp_ntz, v string, n int")
    got = {r.id: r.found for r in as_of(facts_df, changes, ["k"], "v", "found", tie="n").collect()}

    def want(k, ts):
        earlier = [x for x in c if x[0] == k and x[1] <= ts]
        return max(earlier, key=lambda x: (x[1], x[3]))[2] if earlier else None

    assert got == {i: want(k, ts) for i, k, ts in f}


def test_actor_names(spark):
    cases = [
        (("Al", "Alice", None), "Alice"),
        (("Al", "Alice", "Nick"), "Nick (Alice)"),
        (("Al", "Alice", "alice"), "alice"),
        (("Al", "Alice", "The (Alice) one"), "The (Alice) one"),
        (("Al", None, None), "Al"),
        (("You", None, None), "Owner"),
        (("Al", "You", None), "Owner"),
        (("Al", None, "Me (You)"), "Me (Owner)"),
        ((None, None, None), None),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a string, r string, n string")
    got = df.select("i", actor_display_name(F.col("a"), F.col("r"), F.col("n"), "Owner").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [want for _, want in cases]


def test_colors_and_quotes(spark):
    import hashlib

    def color(name):
        hue = int(hashlib.sha1(name.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF * 360
        c = (1 - abs(2 * 0.54 - 1)) * 0.62
        x = c * (1 - abs((hue / 60) % 2 - 1))
        rgb = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][min(int(hue // 60), 5)]
        return "#" + "".join(f"{round((v + 0.54 - c / 2) * 255):02X}" for v in rgb)

    names = [f"name {i}" for i in range(60)] + ["Ünï"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", stable_color(F.col("n")).alias("c")).collect()} == {n: color(n) for n in names}
    quoted = spark.createDataFrame([(' "“x”" ',), ("'",), ("“a'",), ("''",)], "q string")
    assert [r.u for r in quoted.select(unquote(F.col("q")).alias("u")).collect()] == ["x", "'", "“a'", ""]


CONFIG = Config(
    people=(
        PersonRule("Quince", "#0B4F6C", identities=(Identity("discord", "9001"), Identity("signal", "Quince Jam"))),
        PersonRule("Medlar", "#A23E48", identities=(Identity("facebook", "Old Medlar"),)),
        PersonRule("Rowan", identities=(Identity("facebook", "Rowan Ash-Hedge"),)),
        PersonRule("Plum Early", identities=(Identity("facebook", "Plum North"),)),
        PersonRule("Plum Late", "#102030", identities=(Identity("facebook", "Plum South"),)),
    ),
    themes=(
        ThemeRule("Main", channels=(("Discord: S", "general"), ("Facebook: Pals", "Pals"))),
        ThemeRule("Rand", channels=(("Discord: S", "Random"), ("Signal: x", "Random Talk"), ("Facebook: Pals", "Pal"))),
    ),
)


TIERS = {
    "the identity itself": (("discord", "9001", "anything"), "Quince"),
    "identity of the platform, in another case": (("facebook", "OLD   medlar", "anything"), "Medlar"),
    "alias of the platform": (("signal", "name:QUINCE jam", "anything"), "Quince"),
    "alias known from another platform": (("signal", "name:old medlar", "anything"), "Medlar"),
    "alias with some of an identity's words": (("signal", "name:rowan hedge", "anything"), "Rowan"),
    "name that is an identity of the platform": (("signal", "s5", "Quince  jam"), "Quince"),
    "name that is an identity elsewhere": (("discord", "d6", "Plum SOUTH"), "Plum Late"),
    "name of a person": (("discord", "d7", " plum   late"), "Plum Late"),
    "name with all of an identity's words and more": (("discord", "d8", "Plum North of the wall"), "Plum Early"),
    "name with a word two people have": (("discord", "d9", "Plum"), None),
    "name without words": (("discord", "d10", "???"), None),
    "nobody known": (("signal", "name:fig", "Fig"), None),
}


def test_person_tiers(spark):
    """Each way to find a person, alone."""
    hints = {p.name: p.hint for p in CONFIG.people}
    df = spark.createDataFrame([row for row, _ in TIERS.values()], "platform string, raw_id string, display_name string")
    got = {(r.platform, r.raw_id, r.display_name): (r.canonical_name, r.color_hint) for r in resolve_people(df, CONFIG).collect()}
    for tier, (row, person) in TIERS.items():
        assert got[row] == ((person, hints[person]) if person else (row[2], "")), tier


def test_theme_tiers(spark):
    cases = {
        ("Discord: S", "general"): "Main",
        ("discord:  s", "GENERAL"): "Main",
        ("Discord: other", "random"): "Rand",
        ("Signal: other", "general"): "Main",
        ("Facebook: Pals_x1", "Pals_x1"): "Facebook ambiguous",
        ("Signal: x2", "Random Talk more"): "Rand",
        ("Discord: S", "else"): "else",
    }
    df = spark.createDataFrame(list(cases), "source_name string, channel_name string")
    got = {(r.source_name, r.channel_name): r.theme for r in resolve_themes(df, CONFIG).collect()}
    cases[("Facebook: Pals_x1", "Pals_x1")] = "Pals_x1"  # both themes fit, so neither does
    assert got == cases


# -- configuration and parameters --------------------------------------------
def test_configuration_is_strict(tmp_path):
    with pytest.raises(ValueError, match="unknown keys"):
        parse_people({"people": [{"name": "A", "colour": "red"}]})
    with pytest.raises(ValueError, match="two people"):
        parse_people({"people": [{"name": n, "identities": [{"platform": "Discord", "id": 1}]} for n in "AB"]})
    with pytest.raises(ValueError, match="conflicting is_bot"):
        parse_people({"people": [{"name": "A", "is_bot": True}, {"name": " a "}]})
    with pytest.raises(ValueError, match="is required"):
        parse_people({"people": [{"name": "A", "identities": [{"platform": "x"}]}]})
    with pytest.raises(ValueError, match="two themes"):
        parse_themes({"themes": [{"name": n, "channels": [{"source": "s", "channel": "c"}]} for n in "AB"]})
    with pytest.raises(ValueError, match="SHA-256"):
        parse_moderation({"blocked_media": {"sha256": ["abc"]}})
    (tmp_path / "people.yaml").write_text("people:\n  - name: A\n    is_bot: true\n    identities:\n      - {platform: Signal, name: Al}\n")
    (tmp_path / "excluded_messages.yaml").write_text("- m1\n- ''\n")
    config = load_config(tmp_path)
    assert config.bot_names == ["A"] and config.people[0].identities == (Identity("signal", "Al"),)
    assert config.excluded_message_ids == {"m1"}


def test_parameters():
    assert int_list(" 1, 2,,3 ", "people") == (1, 2, 3)
    with pytest.raises(ValueError, match="Invalid people filter: 'x'"):
        int_list("1,x", "people")
    assert Filters.parse(themes="2", platforms="a, b") == Filters(themes=(2,), platforms=("a", "b"))
    with pytest.raises(ValueError):
        tx.normalise_word("a1b")
    assert date(2024, 1, 1) == Filters(start=date(2024, 1, 1)).start


def test_numbering_spreads_a_hot_day(spark):
    """All rows in one instant: every partition numbers its share, ties by the columns given."""
    at = datetime(2024, 1, 1, 12)
    df = spark.range(4000).select(F.lit(at).cast("timestamp_ntz").alias("ts"), F.col("id").alias("n"))
    got = numbered_in_time(df, ["n"])
    assert got.filter("id != n + 1").count() == 0 and got.schema["id"].dataType.simpleString() == "bigint"
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_as_of_where_changes_are_dense(spark):
    """One key, one day, more changes than a slot is meant for; equal instants count as before."""
    rng = random.Random(1)
    day = datetime(2024, 1, 1)
    at = lambda: day + timedelta(microseconds=rng.randrange(60_000_000))
    changes = sorted({at(): str(i) for i in range(300)}.items())
    facts = [(i, at()) for i in range(300)] + [(1000 + i, t) for i, (t, _) in enumerate(changes)]
    expected = {}
    for n, t in facts:
        before = [v for c, v in changes if c <= t]
        expected[n] = before[-1] if before else None
    f = spark.createDataFrame([("k", n, t) for n, t in facts], "k string, n long, ts timestamp_ntz")
    c = spark.createDataFrame([("k", t, v) for t, v in changes], "k string, ts timestamp_ntz, name string")
    assert {r.n: r.out for r in as_of(f, c, ["k"], "name", "out").collect()} == expected
    cut = as_of(f, c, ["k"], "name", "out", leaf=7)  # the same through many runs
    assert {r.n: r.out for r in cut.collect()} == expected
    leaves = change_leaves(c, ["k"], "name", leaf=7).collect()
    assert max(len(r["items"]) for r in leaves) <= 7 and sum(len(r["items"]) for r in leaves) == 300


def test_as_of_reads_facts_once_and_does_not_sort_them(spark, tmp_path):
    spark.range(2000).selectExpr("id", "id % 3 AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    changes = facts.filter("id % 50 = 0").select("k", "ts", F.col("id").cast("string").alias("v"))
    dated = as_of(facts, changes, ["k"], "v", "found")
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/facts") == 1 and "Sort" not in plan.split("BroadcastHashJoin")[0] and "Window" not in plan
    for r in dated.collect():
        before = [i for i in range(0, r.id + 1, 50) if i % 3 == r.k]
        assert r.found == (str(before[-1]) if before else None)


def test_as_of_without_changes_or_facts(spark):
    facts = spark.createDataFrame([(1, "a", T0)], "id int, k string, ts timestamp_ntz")
    changes = spark.createDataFrame([("a", T0, "x")], "k string, ts timestamp_ntz, v string")
    assert [r.found for r in as_of(facts, changes.limit(0), ["k"], "v", "found").collect()] == [None]
    assert [r.found for r in as_of(facts, changes, ["k"], "v", "found").collect()] == ["x"]
    assert as_of(facts.limit(0), changes, ["k"], "v", "found").count() == 0


def test_exclusive_words_are_not_cut(spark):
    """More words than any page, all of one person; a limit is a page that says so."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join("x" + a + b + c for a in letters for b in letters for c in letters[:16])
    chat = small_chat(spark, [("a", 1, 1, T0, many), ("b", 1, 2, T0, "hello")])
    rows = people.exclusive_words(chat, 1)
    assert rows.count() == 26 * 26 * 16 and rows.filter("truncated").count() == 0
    page = people.exclusive_words(chat, 1, limit=10).collect()
    assert len(page) == 10 and all(r.truncated for r in page)


def test_pages_are_cut_after_unknown_authors_are_left_out(spark):
    rows = [(f"m{i}", 1, 1 if i % 2 else 99, T0 + timedelta(minutes=i), "word https://a.org/x") for i in range(12)]
    chat = small_chat(spark, rows)
    chat.people = chat.people.filter("id = 1")
    chat.messages = chat.messages.withColumn("reaction_count", F.lit(1)).withColumn("reaction_summary", F.lit("x")).withColumn("attachment_preview", F.lit(None).cast("string"))
    assert [r.message_id for r in word_examples(chat, "word", limit=6).collect()] == ["m11", "m9", "m7", "m5", "m3", "m1"]
    assert domain_examples(chat, "a.org", limit=6).count() == 6
    top = top_reacted_messages(chat, limit=6).collect()
    assert len(top) == 6 and not any(r.has_more for r in top)


def test_reactions_without_a_reactor_are_dealt_out(spark):
    messages = spark.range(4_000).selectExpr(
        "cast(id as string) AS id", "'discord' AS platform", "1 AS reaction_count", "'👍×1' AS reaction_summary", "cast(null as string) AS reaction_details_json")
    who = spark.range(500).selectExpr("'discord' AS platform", "concat('u', id) AS platform_user_id", "id AS person_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in reaction_events(messages, who).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4_000 and max(sizes) < 2_000


# -- what a task holds -------------------------------------------------------
def test_words_are_counted_in_as_many_tasks_as_the_text_takes(spark, tmp_path, monkeypatch):
    from parlance import session

    df = spark.createDataFrame(
        [(f"m{i}", i % 3, f"word{chr(97 + i % 5)} again again the") for i in range(200)], "id string, person_id int, content string"
    )
    df.repartition(4).write.parquet(f"{tmp_path}/a b")
    rows = spark.read.parquet(f"{tmp_path}/a b")
    monkeypatch.setattr(session, "SHARE", 100, raising=False)
    counts = people.word_counts(small_chat(spark, [("1", 1, 1, T0, "x")]), rows)
    assert counts.rdd.getNumPartitions() > 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.person_id, r.word): r.n for r in counts.collect()}
    assert got[0, "again"] == 134 and sum(got.values()) == 600 and not any(w == "the" for _, w in got)


def test_pieces_hand_out_open_words_of_people_who_can_go_on_only(spark, monkeypatch):
    rows = [(f"m{i:03}", 1, i // 4, T0 + timedelta(minutes=i), f"one two three {'abcdefghij'[i % 10] * 4}") for i in range(80)]
    kept = []
    pin = diversity.pinned
    monkeypatch.setattr(diversity, "pinned", lambda df: kept.append(pin(df)) or kept[-1])
    got = {r.person_id: r.mtld for r in diversity.mtld(messages(spark, rows), 3).collect()}
    said = {p: [w for r in rows if r[2] == p for w in r[4].split()] for p in range(20)}
    assert got == pytest.approx({p: (walk(w) + walk(w[::-1])) / 2 for p, w in said.items()})
    walked = next(df for df in kept if "open_words" in df.columns)
    assert walked.filter("size(open_words) > 0").count() <= 2 * 2 * 3


def test_statistics_of_the_people_shown_equal_those_of_all(spark):
    rows = [("1", 1, 1, T0, "alpha shared alpha beta"), ("2", 1, 2, T0, "gamma shared gamma gamma"), ("3", 1, 3, T0, None)]
    chat = small_chat(spark, rows)
    shown = spark.createDataFrame([(2,), (3,)], "person_id int")
    every = {r.person_id: r for r in people.person_stats(chat, Filters()).collect()}
    some = {r.person_id: r for r in people.person_stats(chat, Filters(), shown).collect()}
    assert some == {p: every[p] for p in (2, 3)} and some[2].exclusive_word_count == 1


def test_messages_of_a_theme_are_not_dealt_out_by_channel(spark):
    chat = small_chat(spark, [("1", 1, 1, T0, "alpha"), ("2", 2, 2, T0, "beta")], Config(themes=(ThemeRule("T", "", (("Discord: s", "c"),)),)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that only a hint broadcasts
    try:
        rows = scope(chat, Filters(themes=(1,)))
        assert [r.id for r in rows.collect()] == ["1"]
        steps = rows._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in steps
