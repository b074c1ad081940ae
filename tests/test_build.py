"""From exports to tables and back through queries."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parlance import Config, Filters, Identity, PersonRule, ThemeRule
from parlance.operators import context, people, rankings, search, words
from parlance.plans import build as plan
from tests.test_sources import DISCORD, GARDEN, box, chat

CONFIG = Config(
    people=(
        PersonRule("Ines Example", "#123456", identities=(Identity("discord", "71"), Identity("signal", "Noor"))),
        PersonRule("Pavlik", identities=(Identity("discord", "72"), Identity("signal", "Pavel"))),
    ),
    themes=(ThemeRule("Talk", channels=(("Discord: Board games", "rules"), ("Facebook: Chat", "Chat"))),),
)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    pages = {
        "discord/club/8.html": DISCORD,
        "facebook/Chat_x/message_1.html": chat(
            box("Lena", "Lena added Pavel to the group.", "05 Jan 2020, 10:00"),
            box("Lena", "words words @pavel see https://youtu.be/abc", "05 Jan 2020, 10:40"),
        ),
        "signal_decrypted/Garden plot 9 (_id412)/x.html": GARDEN,
    }
    for name, text in pages.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def built(spark, data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    plan.build(spark, data, out, CONFIG)
    return out, plan.open_build(spark, out, CONFIG)


def test_dimensions(built):
    _, c = built
    assert [(r.id, r.platform, r.name) for r in c.sources.orderBy("id").collect()] == [
        (1, "discord", "Discord: Board games"), (2, "facebook", "Facebook: Chat_x"), (3, "signal", "Signal: signal_decrypted"),
    ]
    names = {r.display_name: (r.id, r.color) for r in c.people.collect()}
    assert names["Ines Example"] == (1, "#123456") and names["Pavlik"] == (2, "Pavlik")
    # Pavel of the Facebook chat is matched by the name configured for another platform
    assert set(names) == {"Ines Example", "Pavlik", "Lena", "You"} and names["Lena"][1].startswith("#")
    identities = {(r.platform, r.platform_user_id): r.person_id for r in c.platform_identities.collect()}
    assert identities[("signal", "name:noor")] == identities[("discord", "71")] == 1
    assert identities[("discord", "72")] == identities[("signal", "name:pavel")] == identities[("facebook", "Pavel")] == 2
    assert [(r.id, r.name) for r in c.themes.orderBy("id").collect()] == [(1, "Talk"), (2, "Garden plot 9")]
    channels = [(r.id, r.source_id, r.platform_channel_id, r.name, r.theme_id) for r in c.channels.orderBy("id").collect()]
    assert channels == [(1, 1, "8", "rules", 1), (2, 2, "Chat_x", "Chat_x", 1), (3, 3, "412", "Garden plot 9", 2)]


def test_messages_and_conversations(built):
    _, c = built
    assert c.messages.count() == 8
    assert {r.channel_id: r.n for r in c.messages.groupBy("channel_id").agg(F.count_distinct("conversation_id").alias("n")).collect()} == {
        1: 1, 2: 2, 3: 1,
    }
    table = [tuple(r)[1:] for r in c.conversations.orderBy("id").collect()]
    # channels are numbered by their first message
    assert [r[0] for r in table] == [2, 2, 3, 1]
    assert table[0][1:] == (datetime(2020, 1, 5, 10, 0), datetime(2020, 1, 5, 10, 0), 1, 1)
    assert [r[3:] for r in table] == [(1, 1), (1, 1), (2, 2), (4, 2)]
    assert c.messages.filter("lang is not null or sentiment is not null").count() == 0


def test_facts_and_stats(built):
    _, c = built
    assert c.tokens is not None
    assert {r.domain for r in c.links.collect()} == {"youtube.com"}
    assert {r.mention for r in c.mentions.collect()} == {"pavel"}
    assert c.reaction_events.count() == c.messages.agg(F.sum("reaction_count")).head()[0] == 6
    # Quinn reacted in the Signal chat but never wrote there, so they are identified but not a known person
    identified = c.reaction_events.filter("reactor_raw_id is not null").collect()
    assert [(r.reactor_raw_id, r.reactor_person_id) for r in identified] == [("name:quinn", None)]
    stats = {r.person_id: r for r in c.person_stats.collect()}
    lena = c.people.filter("display_name = 'Lena'").head().id
    # system messages are left out
    assert stats[lena].message_count == 1 and stats[lena].total_words == 6 and stats[lena].unique_words == 5
    events = c.member_events.collect()
    assert [(r.id, r.channel_id, r.kind, r.actor_person_id == lena, r.target_person_id) for r in events] == [(1, 2, "added", True, 2)]
    assert {r.new_name for r in c.channel_name_changes.collect()} == {"house rules", "Plot nine"}


def test_queries_on_the_build(built):
    _, c = built
    assert rankings.top_themes(c).head().name == "Talk"
    found = search.search_matches(c, "YOUTU.BE")
    assert found.count() == 1
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()  # months without hits are not read
    assert [r.word for r in words.top_words(c, Filters(platforms=("facebook",)), limit=1).collect()] == ["words"]
    shown = people.person_diversity(c)
    assert {r.source for r in shown.collect()} == {"materialized"}
    live = words.top_words(c, Filters(start=date(2020, 1, 5), end=date(2020, 1, 5)))
    plan_text = live._jdf.queryExecution().executedPlan().toString()
    assert "month_key" in plan_text and "PartitionFilters" in plan_text


def test_stored_and_live_facts_agree(built):
    _, c = built
    import copy

    live = copy.copy(c)
    live.tokens = live.links = live.mentions = live.trigrams = None
    for run in (lambda x: words.top_words(x, limit=None), lambda x: search.search_matches(x, "the beans").select("id")):
        assert sorted(map(tuple, run(c).collect())) == sorted(map(tuple, run(live).collect()))


def test_failed_build_keeps_the_current_one(spark, data, built, monkeypatch):
    import os

    out, _ = built
    before = plan.current_folder(spark, out)

    def broken(*args, **kwargs):
        raise RuntimeError("fact build failed")

    monkeypatch.setattr(plan.facts, "message_tokens", broken)
    with pytest.raises(RuntimeError, match="fact build failed"):
        plan.build(spark, data, out, CONFIG)
    assert plan.current_folder(spark, out) == before
    assert not os.path.exists(f"{before}/{plan.STAGED}")
    assert [n for n in os.listdir(out) if n.startswith("build_id=")] == [before.rsplit("/", 1)[1]]
    with pytest.raises(FileExistsError):
        plan.build(spark, data, out, CONFIG, overwrite=False)


def test_validation_notices_what_does_not_agree(spark, built):
    out, _ = built
    folder = plan.current_folder(spark, out)
    good = {"messages": 8, "reactions": 6, "longest": 40, "trigrams": 9, "reaction_events": 6}
    plan.validate(spark, folder, good, 8)
    for change, expected, said in (({}, 9, "expected 9 messages"), ({"trigrams": 0}, 8, "search facts"), ({"reaction_events": 5}, 8, "6 reaction events, found 5")):
        with pytest.raises(plan.BuildError, match=said):
            plan.validate(spark, folder, good | change, expected)


def test_counts_are_taken_while_writing(spark, data, tmp_path):
    """What is counted in passing is what the files hold."""
    export = plan.read_exports(spark, data, CONFIG, True)
    seen = plan.write_tables(export, str(tmp_path), CONFIG)
    stored = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("messages", "message_search_trigrams", "message_reaction_events")}
    assert seen["messages"] == stored["messages"].count() == 8
    assert seen["trigrams"] == stored["message_search_trigrams"].count() > 0
    assert seen["reaction_events"] == seen["reactions"] == stored["message_reaction_events"].count() == 6
    assert seen["longest"] == stored["messages"].agg(F.max(F.length("content"))).head()[0]


def test_windows_by_stored_places(built):
    """Neighbours found by number are those found by time, for one target and for all at once."""
    import copy

    _, c = built
    live = copy.copy(c)
    live.places = live.ordered = None
    ids = [r.id for r in c.messages.select("id").collect()]
    for target in ids[:4]:
        stored, scanned = (sorted(map(str, context.message_window(x, target, 2).collect())) for x in (c, live))
        assert stored == scanned and stored
    targets = c.messages.select("id").unionByName(c.messages.select("id")).unionByName(c.spark.createDataFrame([("none",), (None,)], "id string"))
    for x in (c, live):
        rows = context.message_windows(x, targets, 2).select("target_id", "step", "id").collect()
        assert {r.target_id: r.id for r in rows if r.step == 0} == {i: i for i in ids} and len(set(rows)) == len(rows)
        for target in ids[:3]:
            near = {r.id for r in rows if r.target_id == target}
            assert near == {r.id for r in context.window_rows(x, target, 2).collect()}
    with pytest.raises(LookupError):
        context.message_window(c, "none")
    looked = c.places.filter(F.col("id") == ids[0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id" in looked
    found = context.window_rows(c, ids[0], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in found  # other months are not read


def test_a_page_of_search_reads_the_newest_months_only(built):
    import copy

    _, c = built
    everything = copy.copy(c)
    everything.months = None
    months = sorted(r[0] for r in c.months.select("month_key").collect())
    assert len(months) > 1
    for q in ("the", "words", "e", "nowhere"):
        for limit, offset in ((1, 0), (2, 1), (50, 0)):
            page = search.search(c, q, limit=limit, offset=offset)
            assert page.collect() == search.search(everything, q, limit=limit, offset=offset).collect()
    newest = c.messages.filter(F.col("month_key") == months[-1]).filter("content is not null and not is_system").head().content
    plan_text = search.search(c, newest[:8], limit=1)._jdf.queryExecution().executedPlan().toString()
    assert f">= {months[-1]})" in plan_text  # no older month is read
    assert search.search(c, newest[:8], Filters(end=date(1999, 1, 1)), limit=1).count() == 0


def test_a_hot_key_takes_as_many_files_as_it_needs(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 4).selectExpr("cast(id AS string) AS message_id", "if(id % 10 < 7, 'hot', concat('t', id % 500)) AS token", "repeat(cast(id * 7919 AS string), 3) AS pad")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    try:
        plan._write(rows, f"{tmp_path}/t", "token")
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = spark.read.parquet(f"{tmp_path}/t").withColumn("file", F.input_file_name()).groupBy("token").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))
    found = {r.token: (r.files, r.n) for r in files.collect()}
    assert found["hot"][1] == 42_000 and found["hot"][0] >= 4  # splits follow the tasks that wrote the rows
    assert sum(n for _, n in found.values()) == 60_000
    # a key that shares the hot one's shuffle partition is spread with it, the others are not
    others = [f for t, (f, _) in found.items() if t != "hot"]
    assert max(others) <= found["hot"][0] and sum(f <= 2 for f in others) > len(others) / 2


def test_dedupe_keeps_the_earliest(spark):
    rows = [("a", datetime(2020, 1, 2), 1, "late"), ("a", datetime(2020, 1, 1), 3, "third"), ("a", datetime(2020, 1, 1), 2, "second"), ("b", datetime(2020, 1, 1), 1, "b")]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, ord int, content string")
    assert {r.id: r.content for r in plan.dedupe_messages(df).collect()} == {"a": "second", "b": "b"}


def test_dedupe_does_not_gather_the_copies_of_a_frequent_id(spark, monkeypatch):
    monkeypatch.setattr(plan, "OFTEN", 3, raising=False)
    at = lambda i: datetime(2020, 1, i)
    rows = [("a", at(i), i, f"a{i}") for i in range(9, 0, -1)] + [("b", at(2), 0, "late"), ("b", at(1), 1, "b"), ("c", at(1), 0, "c")]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, ord int, content string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that only a hint broadcasts
    try:
        left = plan.dedupe_messages(df)
        assert sorted((r.id, r.content) for r in left.collect()) == [("a", "a1"), ("b", "b"), ("c", "c")]
        steps = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in steps


def test_name_changes_are_looked_for_once(spark, data, tmp_path, monkeypatch):
    """Numbering reads them twice, and looking for them tries long patterns on all texts."""
    read, tables = [], plan.name_change_tables

    def kept(changes, *dims):
        read.extend(changes.inputFiles())
        return tables(changes, *dims)

    monkeypatch.setattr(plan, "name_change_tables", kept)
    plan.build(spark, data, str(tmp_path / "out"), CONFIG)
    assert read and all("/_staged/name_changes/" in file for file in read)
