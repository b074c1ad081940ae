"""What the readers of exports do with many files and many messages."""

import random
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from parlance.sources import discord, facebook, html, signal
from parlance.sources.html import parse_html

HEAD = '<div class="preamble__entry">Guild</div><div class="preamble__entry">Text / chat</div>'


def box(message_id: int, more: str = "") -> str:
    return (
        f'<div class="chatlog__message-container" data-message-id="{message_id}"{more}>'
        '<span class="chatlog__author" data-user-id="u1">Ann</span><div class="chatlog__content"><div>hello</div></div></div>'
    )


def test_many_short_files_make_one_frame():
    files = pd.DataFrame({"path": [f"file:/data/discord/9/{i}.html" for i in range(50)], "content": [f"{HEAD}{box(i + 1)}".encode() for i in range(50)]})
    frames = list(discord._parse(iter([files])))
    assert len(frames) == 1 and frames[0]["id"].tolist() == [str(i + 1) for i in range(50)]


def test_one_walk_finds_classes_in_document_order():
    page = parse_html('<div class="a b">1<p class="b">2</p></div><p class="a">3</p>')
    assert [n.tag for n in page.by_class()["a"]] == ["div", "p"] and [n.text() for n in page.by_class()["b"]] == ["1 2", "2"]


def test_a_told_time_counts_before_that_of_the_id(spark):
    number = 5_000_000  # more than the 22 bits that ids keep for it
    plain, spilt = ((1_000 << 22) + 7), ((1_000 << 22) + number)
    told = discord.EPOCH_MS + 1_000
    html = HEAD + box(plain) + box(spilt, f' data-timestamp="{told}"') + box(plain + 1, ' data-timestamp="soon"')
    files = spark.createDataFrame([("file:/data/discord/9/1.html", html.encode())], "path string, content binary")
    assert [r["ts"] for r in discord.read_discord(files).messages.orderBy("pos").collect()] == [datetime(2015, 1, 1, 0, 0, 1)] * 3


def tree(node) -> list:
    return [node.tag, list(node.attrs.items()), [c if isinstance(c, str) else tree(c) for c in node.children]]


def tokenized(text: str):
    builder = html._Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def test_plain_pages_are_cut_at_their_tags(monkeypatch):
    page = f"<!DOCTYPE html><html><head><title>a &amp; b</title></head><body>{HEAD}{box(7)}<ul><li>1<li>2</ul><p>x<div>y</p></body></html>"
    expected = tree(tokenized(page))
    monkeypatch.setattr(html._Builder, "feed", lambda self, text: 1 / 0)
    assert tree(parse_html(page)) == expected


def test_cutting_at_tags_gives_the_tree_of_the_tokenizer():
    pieces = (
        '<p> </p> <div class="a b"> </div> <li> </li> <ul> </ul> <br/> <br> <td> <tr> <table> </table> &amp; &lt <title> </title> <script> </script> '
        "<style> </style> <!--c--> <b < <i/> </i/> text>more <x-y> </> <A> </A> & <svg:x> <i y=2> <textarea> </textarea> <!doctype>"
    ).split() + ['<img src="x" alt="y&amp;z">', "<i x='1'>", '<a href="u?x=1>2">', '<d a="b"c="e">', '<A HREF="q" href="r">', "a & b", '<img alt="" />', "<!DOCTYPE html>"]
    pick = random.Random(5)
    for _ in range(5_000):
        page = "".join(pick.choices(pieces, k=pick.randint(1, 12)))
        assert tree(parse_html(page)) == tree(tokenized(page)), page


FB = '<div class="pam _3-95 _2pi0 _2lej uiBoxWhite noborder">'


def facebook_box(n: int, more: str = "") -> str:
    return f"{FB}<div>User {n}</div><div><div>{more}hello &amp; {n}</div><ul class='_tqp'></ul></div><div>12 Jan 2024, 10:{n % 60:02}</div></div>".replace("'", '"')


def signal_box(n: int, more: str = "") -> str:
    return (
        f'<div class="msg msg-incoming"><div class="membername">User {n}</div>{more}<pre>hi {n}</pre><div class="footer">'
        f'<span class="msg-data">Jan 05, 2024 10:00:{n % 60:02}</span></div></div>'
    )


def test_alike_boxes_are_parsed_once(monkeypatch):
    made, init = [], html.Node.__init__

    def counted(self, *args):
        made.append(1)
        init(self, *args)

    monkeypatch.setattr(html.Node, "__init__", counted)
    rows = list(facebook.parse_chat_file("a/b/c.html", "<html><body>" + "\n".join(map(facebook_box, range(500))) + "</body></html>"))
    assert [r[2:4] for r in rows] == [(f"User {n}", f"hello & {n}") for n in range(500)] and len(made) < 700
    made.clear()
    rows = list(signal.parse_chat("a/b/c.html", "<html><body>" + "\n".join(map(signal_box, range(500))) + "</body></html>"))
    assert [r[8] for r in rows if r[4] == "message"] == [f"hi {n}" for n in range(500)] and len(made) < 700


def test_cut_boxes_read_like_the_whole_page(monkeypatch):
    pieces = (
        "<p> </p> <div> </div> <span> </span> <ul> <li> </ul> <pre> </pre> <td> </table> <br> <img|src=\"media/a.png\"> <script> </script> <!--c--> "
        '<div|class="columnview"> <div|class="footer"> <div|class="msg-quote"> <div|class="membername"> <title> </title> x 3|reactions &lt; </body>'
    ).split(" ")
    pieces = [p.replace("|", " ") for p in pieces] + ['<div class="msg">', FB, '<ul class="_tqp"><li>👍 Ann</li></ul>']
    pick = random.Random(7)
    pages = []
    for _ in range(2_000):
        boxes = [pick.choice((facebook_box, signal_box))(n, "".join(pick.choices(pieces, k=pick.choice((0, 0, 1, 2))))) for n in range(3)]
        pages.append("".join(pick.choices(pieces, k=pick.choice((0, 0, 1)))).join(["", *boxes, ""]))

    def read():
        return [(list(facebook.parse_chat_file("a/b/c.html", p)), list(signal.parse_chat("a/b/c.html", p))) for p in pages]

    cut = read()
    monkeypatch.setattr(html, "_cut", lambda text, step: None)
    assert cut == read()


def test_notices_in_any_case_are_still_tried(spark):
    said = ["Ann ſet the emoji to x", "Ann created a POLL: x", "Ann changed your nIcKname to Bo.", "Ann set the nİcKname for Bo to Cy.", "Ann left the chat", "we left it", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select(
        "i", facebook.is_system_text(F.col("t")).alias("s"), facebook.may_say(F.col("t"), "nickname", "set the").alias("m"))
    found = rows.orderBy("i").collect()
    assert [r.s for r in found] == [True, True, True, True, True, False, False]
    assert [r.m for r in found] == [True, False, True, True, False, False, False]


def test_facebook_texts_are_shuffled_once(spark):
    boxes = "".join(facebook_box(n % 7, f"{n % 3}<i>{'🔥' * (n % 2)}</i>") for n in range(60))
    files = spark.createDataFrame([(f"file:/data/facebook/Chat_{c}/message_1.html", boxes.encode()) for c in "xy"], "path string, content binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    messages = facebook.read_facebook(files).messages
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = messages._jdf.queryExecution().explainString(mode)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 1 and sum("content#" in columns for columns in moved) == 1


def test_discord_notices_in_any_case_are_still_tried(spark):
    said = [
        "Ann changed the ſerver icon.", "x\nAnn UPDATED THE GROUP AVATAR", "Ann added the reaction x", "Ann added emoji y.", "Ann set the Group Emoji to z", "poll_question_text",
        "Ann created a poll: q", "Ann changed their nİcKname to Bo", "Ann CHANGED her nickname to Bo", "Ann changed the channel name: x", "Ann added a reaction", "the channel is open", "", None,
    ]
    text = F.col("t")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select(
        discord.may_say(text, *discord.NOTICE_WORDS).alias("n"), discord._matches(text, discord.PHOTO + discord.EMOJI + discord.POLL).alias("notice"),
        discord.may_say(text, *discord.RENAME_WORDS).alias("r"), discord._matches(text, discord.CHANNEL_RENAME + discord.NICKNAME).alias("rename"))
    found = rows.collect()
    assert [(r.n and r.notice, r.r and r.rename) for r in found] == [(r.notice, r.rename) for r in found]
    assert sum(bool(r.notice) for r in found) == 7 and sum(bool(r.rename) for r in found) >= 2 and not all(r.n for r in found)
