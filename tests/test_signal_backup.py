import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from parlance.sources import signal_backup
from parlance.sources.signal_backup import read_signal_backup

ITEM = {"chatId": "10", "authorId": "2", "dateSent": "1602273050123"}
RECORDS = [
    {"account": {"givenName": "Me", "username": "me.01"}},
    {"recipient": {"id": "1", "self": {}}},
    {"recipient": {"id": "2", "contact": {"aci": "AAA", "e164": "+1", "profileGivenName": "Ann", "profileFamilyName": "Lee"}}},
    {"recipient": {"id": "3", "contact": {"pni": "PPP"}}},
    {"recipient": {"id": "9", "group": {"snapshot": {"title": {"title": "Old"}, "members": [{"userId": "AAA"}, {"userId": "ZZZ"}]}}}},
    {"chat": {"id": "10", "recipientId": "9"}},
    {"chat": {"id": "11", "recipientId": "2"}},
    {"chatItem": {**ITEM, "standardMessage": {
        "text": {"body": "héllo"}, "attachments": [{"pointer": {"contentType": "image/png"}}, {"fileName": "b.pdf"}],
        "reactions": [{"emoji": "👍"}, {"emoji": "❤"}, {"emoji": "❤"}]}}},
    {"chatItem": {**ITEM, "authorId": "1", "dateSent": "1602273060000", "stickerMessage": {}, "reactions": {"reactionList": [{}, {}]}}},
    {"chatItem": {**ITEM, "dateSent": "1602273070000", "updateMessage": {
        "groupChange": {"updates": [{"groupNameUpdate": {"newGroupName": "New"}}, {"groupIconUpdate": {}}, {"pollUpdate": {}}]}}}},
    {"chatItem": {**ITEM, "dateSent": "1602273080000", "updateMessage": {"profileChange": {"previousName": "Ann", "newName": "Annie"}}}},
    {"chatItem": {**ITEM, "authorId": "77", "dateSent": "1602273090000", "standardMessage": {"text": {"body": "Ann named the group \"Last\""}}}},
    {"chatItem": {**ITEM, "chatId": "11", "standardMessage": {"text": {"body": "private"}}}},
]


def write(tmp_path):
    path = tmp_path / "main.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS), encoding="utf-8")
    return str(path)


def test_backup(spark, tmp_path):
    export = read_signal_backup(spark.read.text(write(tmp_path)), "backup")
    rows = {r.ts: r for r in export.messages.collect()}
    assert len(rows) == 5
    first = rows[datetime(2020, 10, 9, 19, 50, 50, 123000)]
    assert (first.content, first.person_raw_id, first.person_name) == ("héllo", "AAA", "Ann Lee")
    assert (first.attachment_count, first.attachment_preview) == (2, "image/png")
    assert (first.reaction_count, first.reaction_summary) == (3, "❤×2 👍×1")
    packed = json.dumps(RECORDS[7]["chatItem"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert first.id == hashlib.sha1(packed.encode()).hexdigest()
    sticker = rows[datetime(2020, 10, 9, 19, 51)]
    assert (sticker.person_raw_id, sticker.attachment_preview, sticker.reaction_count) == ("me.01", "sticker", 2)
    assert rows[datetime(2020, 10, 9, 19, 51, 30)].is_system
    people = {r.raw_id: r.display_name for r in export.people.collect()}
    assert people == {"AAA": "Ann Lee", "ZZZ": "ZZZ", "me.01": "Me me.01", "77": "77"}
    assert [(r.raw_id, r.name) for r in export.channels.collect()] == [("10", "Last")]
    changes = sorted((r.ts, r.kind, r.previous_name or "", r.new_name) for r in export.name_changes.collect())
    assert [c[1:] for c in changes] == [
        ("channel-title-change", "", "(photo changed)"), ("channel-title-change", "(photo changed)", "(poll)"),
        ("channel-title-change", "(poll)", "New"), ("nickname-change", "Ann", "Annie"), ("channel-title-change", "New", "Last"),
    ]


def test_backup_filter(spark, tmp_path):
    lines = spark.read.text(write(tmp_path))
    assert read_signal_backup(lines, "b", {"aaa", "ME.01"}).messages.count() == 5
    assert read_signal_backup(lines, "b", {"aaa", "PPP"}).messages.count() == 0


def test_lines_are_parsed_once(spark, tmp_path, monkeypatch):
    """All later plans read stored columns of the kinds they need; no line is parsed again."""
    parses = []
    whole = signal_backup.stored_records
    monkeypatch.setattr(signal_backup, "stored_records", lambda lines: parses.append(1) or whole(lines))
    path = write(tmp_path)
    export = read_signal_backup(spark.read.text(path), "backup", {"aaa", "ME.01"})
    assert parses == [1]
    for df in (export.messages, export.channels, export.people, export.name_changes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert path not in plan and "Scan text" not in plan
    kinds = {r.kind: r.n for r in whole(spark.read.text(path)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"account": 1, "recipient": 4, "chat": 2, "chatItem": 6}


def test_of_several_accounts_the_first_counts(spark, tmp_path):
    lines = [json.dumps(r) for r in [RECORDS[0], {"account": {"givenName": "Other", "username": "other.02"}}, *RECORDS[1:]]] + ["", "no json", "{}"]
    (tmp_path / "two.jsonl").write_text("\n".join(lines), encoding="utf-8")
    export = read_signal_backup(spark.read.text(str(tmp_path / "two.jsonl")), "backup")
    assert {r.raw_id for r in export.people.collect()} == {"AAA", "ZZZ", "me.01", "77"}


def test_items_are_not_dealt_by_chat(spark):
    lines = [{"recipient": {"id": "g1", "group": {"snapshot": {"title": {"title": "T"}}}}}, {"chat": {"id": "1", "recipientId": "g1"}}]
    lines += [{"chatItem": {"chatId": "1", "authorId": "p", "dateSent": str(n), "standardMessage": {"text": {"body": "x"}}}} for n in range(5)]
    messages = read_signal_backup(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"), "b").messages
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert messages.count() == 5 and "SortMergeJoin" not in plan and "hashpartitioning(chat" not in plan
