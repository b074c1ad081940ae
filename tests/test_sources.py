"""Readers on small hand-written exports."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from parlance import Config, Identity, PersonRule
from parlance.functions.names import unquote
from parlance.sources.archives import scan_archives
from parlance.sources.discord import read_discord, snowflake_ts
from parlance.sources.facebook import read_facebook
from parlance.sources.files import discover_exports, read_files
from parlance.sources.html import parse_html
from parlance.sources.media import media_catalog, resolve_attachments
from parlance.sources.pages import page_previews
from parlance.sources.signal import group_name_change, is_system_text, read_signal


def files(spark, *pairs):
    return spark.createDataFrame([(p, bytearray(t.encode("utf-8"))) for p, t in pairs], "path string, content binary")


def discord_page(guild, channel, *messages):
    """An export with the given message boxes; the place of a channel is the last entry of its preamble."""
    entries = "".join(f'<div class="preamble__entry">{e}</div>' for e in (guild, f"Text / {channel}"))
    return f'<html><body><div class="preamble">{entries}</div>{"".join(messages)}</body></html>'


def message(number, inner):
    return f'<div class="chatlog__message-container" data-message-id="{number}">{inner}</div>'


def by(user, name, kind="author"):
    return f'<span class="chatlog__{kind}" data-user-id="{user}">{name}</span>'


def said(text):
    return f'<div class="chatlog__markdown">{text}</div>'


#: 2024-03-01 18:00:00.250 and the three minutes after it, as ids
NIGHT = [((1709316000250 + minute * 60_000 - 1420070400000) << 22) + 9 for minute in range(4)]
DISCORD = discord_page(
    "Board games", "rules",
    message(NIGHT[0], by(71, "Ines") + said('who brings <b>dice</b>? <img class="chatlog__emoji" alt="🎲" src="d.svg">')
            + '<div class="chatlog__attachment"><div class="chatlog__attachment-generic-name"><a href="files/house%20rules.pdf">rules</a></div></div>'
            + '<div class="chatlog__attachment"><a href="https://cdn.example/map.png">map</a></div>'),
    message(NIGHT[1], by(72, "Otto") + f'<div class="chatlog__reply" data-message-id="{NIGHT[0]}"></div>' + said("me")
            + '<div class="chatlog__reactions"><div class="chatlog__reaction" title="tada">🎉<span class="chatlog__reaction-count">five</span></div>'
            + '<div class="chatlog__reaction"><img class="chatlog__emoji" alt="dice5" src="files/d5.gif"><span class="chatlog__reaction-count">4</span></div></div>'),
    message(NIGHT[2], said("and snacks") + '<span class="chatlog__edited-timestamp">(edited)</span>'),
    message(NIGHT[3], by(71, "Ines", "system-notification-author")
            + '<span class="chatlog__system-notification-content">Ines changed the channel name to "house rules"</span>'),
)


def test_discord_messages(spark):
    export = read_discord(files(spark, ("file:/in/discord/club/8.html", DISCORD)))
    rows = {int(r.id): r for r in export.messages.collect()}
    assert sorted(rows) == NIGHT
    asked, answer, more, rename = (rows[n] for n in NIGHT)
    assert asked.content == "who brings\ndice\n?\n🎲" and asked.ts == datetime(2024, 3, 1, 18, 0, 0, 250_000)
    assert (asked.source_name, asked.channel_raw_id, asked.channel_name) == ("Discord: Board games", "8", "rules")
    assert (asked.attachment_count, asked.attachment_preview, asked.reaction_count) == (2, "club/files/house rules.pdf", 0)
    assert answer.reply_to_id == str(NIGHT[0]) and not answer.is_edited
    # in page order; a count that is no number is one
    assert (answer.reaction_count, answer.reaction_summary) == (5, "tada×1 dice5×4")
    details = {d["name"]: d for d in json.loads(answer.reaction_details_json)}
    assert details["dice5"]["image_url"] == "club/files/d5.gif" and details["dice5"]["code"] is None and details["tada"]["code"] == "tada"
    # a message without an author continues the one before
    assert (more.person_raw_id, more.is_edited, more.is_system) == ("72", True, False)
    assert rename.is_system and rename.person_raw_id == "71"
    change = export.name_changes.collect()
    assert [(c.kind, c.new_name) for c in change] == [("channel-name-change", "house rules")]
    assert json.loads(change[0].payload_json) == {"actor_name": "Ines", "actor_raw_id": "71"}
    assert {(r.raw_id, r.display_name) for r in export.people.collect()} == {("71", "Ines"), ("72", "Otto")}


def test_discord_survives_bad_markup(spark):
    page = discord_page("G", "c", message(NIGHT[0], by(1, "A") + said("<p>" * 5_000 + "deep") + '<div class="chatlog__attachment"><a href="http://[x">f</a></div>'))
    row = read_discord(files(spark, ("file:/in/discord/g/1.html", page))).messages.collect()[0]
    assert row.content == "deep" and (row.attachment_count, row.attachment_preview) == (1, None)


def test_snowflake(spark):
    # the id of the very first millisecond, and one with its lower 22 bits set
    low = (1 << 22) - 1
    row = spark.range(1).select(snowflake_ts(F.lit("0")).alias("a"), snowflake_ts(F.lit(str((86_400_000 << 22) + low))).alias("b")).head()
    assert (row.a, row.b) == (datetime(2015, 1, 1), datetime(2015, 1, 2))


def box(author, body, when, extra=""):
    return (
        '<div class="pam _3-95 _2pi0 _2lej uiBoxWhite noborder">'
        f'<div class="_3-96 _2pio _2lek _2lel">{author}</div><div class="_3-96 _2let"><div>{body}</div>{extra}</div>'
        f'<div class="_3-94 _2lem">{when}</div></div>'
    )


def chat(*boxes):
    return "<html><body>" + "".join(boxes) + "</body></html>"


def fb(spark, *boxes):
    return read_facebook(files(spark, ("file:/data/facebook/Chat_x/message_1.html", chat(*boxes))))


def test_facebook_authors_under_nicknames(spark):
    export = fb(
        spark,
        box("Mira", "Mira set the nickname for Tomas to Cook.", "14 Feb 2021, 20:15"),
        box("Cook", "soup is ready", "14 Feb 2021, 20:31"),
        box("Cook", "Cook set the nickname for Mira to Guest.", "14 Feb 2021, 20:32"),
        box("Guest", "smells good", "14 Feb 2021, 20:40"),
        box("Tomas", "own name again", "14 Feb 2021, 21:00"),
        box("Guest", "Guest cleared the nickname for Cook.", "14 Feb 2021, 21:05"),
        box("Iva", "late", "14 Feb 2021, 21:30"),
    )
    authors = {r.content: r.person_raw_id for r in export.messages.filter("not is_system").collect()}
    assert authors == {"soup is ready": "Tomas", "smells good": "Mira", "own name again": "Tomas", "late": "Iva"}
    assert {r.raw_id for r in export.people.collect()} == {"Mira", "Tomas", "Iva"}
    changes = sorted((r.ts, r.entity_raw_id, r.previous_name, r.new_name, json.loads(r.payload_json)["actor_raw_id"]) for r in export.name_changes.collect())
    assert [c[1:] for c in changes] == [
        ("Tomas", None, "Cook", "Mira"), ("Mira", None, "Guest", "Tomas"), ("Tomas", "Cook", "(cleared)", "Mira"),
    ]


def test_facebook_cleared_nicknames_and_renames(spark):
    export = fb(
        spark,
        box("A", "A cleared the nickname for B.", "01 Jan 2020, 10:00"),
        box("A", "A set the nickname for B to Bee.", "01 Jan 2020, 10:01"),
        box("A", "A changed the nickname for B to Bee.", "01 Jan 2020, 10:02"),
        box("A", "A cleared the nickname for B.", "01 Jan 2020, 10:03"),
        box("A", "A named the group Fun!", "01 Jan 2020, 10:04"),
        box("A", "A named the group Fun.", "01 Jan 2020, 10:05"),
        box("A", "A changed the group name to Less fun.", "01 Jan 2020, 10:06"),
    )
    rows = sorted((r.ts, r.entity_kind, r.previous_name, r.new_name) for r in export.name_changes.collect())
    assert [r[1:] for r in rows] == [
        ("person", None, "Bee"), ("person", "Bee", "(cleared)"), ("channel", None, "Fun"), ("channel", "Fun", "Less fun"),
    ]
    assert all(r.is_system for r in export.messages.collect())


def test_facebook_member_events(spark):
    export = fb(
        spark,
        box("Ann", "Ann added Bob, Cid and Dee to the group.", "01 Jan 2020, 10:00"),
        box("Zed", "Ann removed Bob from the chat", "01 Jan 2020, 10:01"),
        box("Cid", "Cid left the group.", "01 Jan 2020, 10:02"),
        box("Zed", "Who left the conversation.", "01 Jan 2020, 10:03"),
    )
    rows = sorted((str(r.ts), r.kind, r.actor_raw_id, r.target_raw_id) for r in export.member_events.collect())
    assert [r[1:] for r in rows] == [
        ("added", "Ann", "Bob"), ("added", "Ann", "Cid"), ("added", "Ann", "Dee"), ("removed", "Ann", "Bob"),
        ("left", "Cid", "Cid"), ("left", "Zed", "Who"),
    ]


def test_facebook_emoji_messages_fold_into_reactions(spark):
    # newest first, all within the same two minutes
    export = fb(
        spark,
        box("C", "🔥", "01 Jan 2020, 10:01"),
        box("B", "👍", "01 Jan 2020, 10:01"),
        box("A", "text", "01 Jan 2020, 10:00", '<ul class="_tqp"><li>👍 Zoe</li><li>😂Yan</li></ul>'),
        box("B", "❤️", "01 Jan 2020, 09:59"),
        box("A", "😮", "01 Jan 2020, 09:58"),
    )
    rows = {r.content: r for r in export.messages.collect()}
    assert (rows["text"].reaction_count, rows["text"].reaction_summary) == (4, "👍×2 😂×1 🔥×1")
    assert rows["👍"].is_system and rows["🔥"].is_system and not rows["text"].is_system
    # a leading emoji message is an ordinary one
    assert not rows["😮"].is_system and rows["😮"].reaction_summary == "❤️×1" and rows["❤️"].is_system
    assert rows["👍"].ts == datetime(2020, 1, 1, 10, 1) and rows["🔥"].ts == datetime(2020, 1, 1, 10, 1, 0, 1)


def test_facebook_bodies(spark):
    clip = "messages/inbox/Chat_x/audio/memo7.mp4"
    memo = f'<audio src="{clip}"><a href="{clip}"><div>Click for audio:</div></a></audio>'
    export = fb(
        spark,
        box("A", memo, "12 Jun 2019, 09:57"),
        box("B", "B sent a link. https://x.org/a", "12 Jun 2019, 09:58"),
        box("B", "https://x.org/b https://x.org/b", "12 Jun 2019, 09:59"),
        box("B", "look at this https://x.org/c", "12 Jun 2019, 10:00"),
        box("B", 'see <a href="https://x.org/d">https://x.org/d</a>', "12 Jun 2019, 10:01"),
        box("C", "One or more media attachments were removed", "12 Jun 2019, 10:02"),
        box("D", "cafÃ©", "12 Jun 2019, 10:03"),
        box("D", "cafÃ©", "12 Jun 2019, 10:03"),
        box("D", "no time", "yesterday"),
    )
    rows = {r.ts.strftime("%H:%M"): (r.content, r.attachment_count, r.attachment_preview) for r in export.messages.collect()}
    assert rows == {
        "09:57": ("", 1, clip),
        "09:58": ("", 1, "https://x.org/a"),
        "09:59": ("", 1, "https://x.org/b"),
        "10:00": ("look at this https://x.org/c", 0, None),
        "10:01": ("see https://x.org/d", 1, "https://x.org/d"),
        "10:02": ("", 0, None),
        "10:03": ("café", 0, None),
    }
    assert export.messages.count() == 7


def signal_page(title, members, *boxes):
    side = f'<div class="groupdetails"><span class="columnview"><span class="column-right-align">Members:</span><span class="column-left-align">{members}</span></span></div>'
    return f'<html><head><title>{title}</title></head><body><div class="thread-subtitle"><label>{side}</label></div>{"".join(boxes)}</body></html>'


def note(kind, when, inner, foot="footer", after=""):
    return f'<div class="msg msg-{kind}">{inner}<div class="{foot}"><span class="msg-data">{when}</span></div>{after}</div>'


GARDEN = signal_page(
    "Garden plot 9", "Noor <i>(admin)</i>, Pavel, Quinn, You",
    note("date-change", "May 03, 2022 07:00:00", "<p>Tuesday</p>"),
    note("incoming", "May 03, 2022 07:05:09", '<div class="membername">Pavel</div><div><pre>frost tonight</pre></div><div><img src="media/t1.jpg"></div><div><img src="media/t2.jpg"></div>',
         after='<div class="msg-reactions"><div class="msg-reaction"><span class="msg-emoji">🥶</span><div class="msg-reaction-info">From: Quinn\nSent: May 03</div></div></div>'),
    note("outgoing", "May 03, 2022 07:30", '<div class="msg-quote"><a class="quote-link" href="#m-1"><pre>frost tonight</pre></a></div><div><pre>covering\nthe beans</pre></div>'),
    note("status", "May 03, 2022 08:00:00", '<div class="status-text"><pre>Noor changed the group name to "Plot nine"</pre></div>', "footer-status"),
    note("incoming", "sometime", '<div class="membername">Quinn</div><div><pre>no time stamp</pre></div>'),
)


def test_signal_chat(spark):
    export = read_signal(files(spark, ("file:/in/signal_decrypted/Garden plot 9 (_id412)/x.html", GARDEN)))
    rows = {r.content: r for r in export.messages.collect()}
    assert set(rows) == {"frost tonight", "covering\nthe beans"}
    frost, beans = rows["frost tonight"], rows["covering\nthe beans"]
    assert (frost.person_raw_id, frost.ts) == ("name:pavel", datetime(2022, 5, 3, 7, 5, 9))
    assert (frost.attachment_count, frost.attachment_preview) == (2, "Garden plot 9 (_id412)/media/t1.jpg")
    assert (frost.reaction_count, frost.reaction_summary, frost.reply_to_id) == (1, "🥶×1", None)
    assert [p["display_name"] for p in json.loads(frost.reaction_details_json)[0]["reactors"]] == ["Quinn"]
    assert (beans.person_raw_id, beans.reply_to_id, beans.attachment_count, beans.ts) == ("self", "m-1", 0, datetime(2022, 5, 3, 7, 30))
    change = export.name_changes.collect()
    assert [(c.entity_raw_id, c.new_name, json.loads(c.payload_json)["actor_raw_id"]) for c in change] == [("412", "Plot nine", "name:noor")]
    assert [tuple(r) for r in export.channels.collect()] == [("Signal: signal_decrypted", "412", "Garden plot 9")]


def test_signal_needs_two_configured_people(spark):
    config = Config(people=tuple(PersonRule(n, identities=(Identity("signal", f"+{i}"),)) for i, n in enumerate(("Noor", "Pavel", "Quinn"))))
    said = note("incoming", "May 03, 2022 09:00:00", '<div class="membername">Zora</div><div><pre>hi</pre></div>')
    pages = files(
        spark,
        ("file:/in/signal_decrypted/Three (_id3)/x.html", signal_page("Three", "Quinn, Zora, Noor", said)),
        ("file:/in/signal_decrypted/One (_id1)/x.html", signal_page("One", "Zora, Pavel", said)),
        ("file:/in/signal_decrypted/None (_id0)/x.html", signal_page("None", "Zora", said)),
    )
    export = read_signal(pages, config)
    assert [r.raw_id for r in export.channels.collect()] == ["3"]
    assert {r.channel_raw_id for r in export.messages.collect()} == {"3"}


def test_signal_texts(spark):
    texts = [
        ("Ann named the group “Friends”.", ("Ann", "Friends"), True),
        ("You changed the group avatar. Bo renamed the group to New One!", ("Bo", "New One"), True),
        ("missed voice call", None, True),
        ("we named the cat", None, False),
        ("", None, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "i int, t string")
    got = df.select("i", group_name_change(F.col("t")).alias("g"), is_system_text(F.col("t")).alias("s")).orderBy("i").collect()
    for row, (text, change, system) in zip(got, texts):
        assert (tuple(row.g) if row.g else None) == change, text
        assert row.s == system, text


def test_page_fields(spark):
    rows = [
        ("https://a.org/x/y", "<title> Plain </title>"),
        (
            "https://b.org/p/",
            '<meta property="og:title" content=" "><meta name="twitter:title" content="T"><meta name="description" content="D">'
            '<meta property="og:image" content="/i.png"><meta property="og:site_name" content="B"><link rel="shortcut icon" href="f.ico">',
        ),
    ]
    got = {r.url: tuple(r)[1:] for r in page_previews(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["https://a.org/x/y"] == ("Plain", None, None, "a.org", None)
    assert got["https://b.org/p/"] == ("T", "D", "https://b.org/i.png", "B", "https://b.org/p/f.ico")


def test_page_fields_of_bad_pages(spark):
    """Whatever a page holds, it gives a row."""
    rows = [
        ("http://[x", "<title>t</title><meta property=og:image content=a.png>"),
        ("https://c.org/", '<meta property="og:image" content="http://[y"><title>u</title>'),
        ("https://d.org/", "<li>" * 100_000 + "<title>deep</title>"),
        ("https://e.org/", "<b>" * 100_000 + "</i>" * 1_000 + "<p>" * 1_000 + "<title>bold</title>"),
        (None, None),
    ]
    got = {r.url: tuple(r)[1:] for r in page_previews(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["http://[x"] == ("t", None, None, None, None) and got["https://c.org/"] == ("u", None, None, "c.org", None)
    assert got["https://d.org/"][0] == "deep" and got["https://e.org/"][0] == "bold" and len(got) == 5


def test_tags_that_end_others():
    page = parse_html("<ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e</div>f<table><tr><td>g<td>h<tr><td>i</table>")
    outer = page.one("ul")
    assert [n.tag for n in outer.elements()] == ["li", "li"] and outer.elements()[1].text() == "c"
    assert page.one("p").text() == "d" and [r.text() for r in page.all("tr")] == ["g h", "i"]


def test_quotes_nested_nine_deep(spark):
    text = "“" * 9 + "name" + "”" * 9
    row = spark.createDataFrame([(text, "'\"x\"'", "plain", "")], "a string, b string, c string, d string").select(*[unquote(F.col(c)).alias(c) for c in "abcd"]).head()
    assert tuple(row) == ("name", "x", "plain", "")


def test_archives(spark):
    config = Config(people=(PersonRule("A", identities=(Identity("facebook", "Ann"), Identity("facebook", "Bob"), Identity("facebook", "Cid"))),))

    def head(text):
        return f"<html><head><title>Group</title></head><body><div>{text}</div></body></html>"

    found = scan_archives(
        files(
            spark,
            ("/in/one/message_1.html", head("nothing")),
            ("/in/one/message_2.html", head("Participants: Ann, Bob, Zoe and Cid")),
            ("/in/two/message_1.html", head("Participants: Ann and Bob")),
            ("/in/three/message_1.html", head("nothing")),
        ),
        config,
    )
    rows = {r.chat_dir: r for r in found.collect()}
    assert rows["one"].matched == ["Ann", "Bob", "Cid"] and rows["one"].is_match
    assert rows["one"].participants == ["Ann", "Bob", "Zoe", "Cid"]
    assert not rows["two"].is_match and rows["two"].readable and not rows["three"].readable


def test_discovery_and_media(spark, tmp_path):
    root = tmp_path / "data"
    for name in (
        "discord/1/5.html", "discord/1/assets/a b.png", "discord-media/c.png", "facebook/Chat_x/message_1.html",
        "facebook/Chat_x/photos/P.jpg", "facebook/Chat_x/deep/message_9.html", "signal_decrypted/G (_id7)/b.html",
        "signal_decrypted/G (_id7)/a.html", "signal_decrypted/G (_id7)/media/S.JPG",
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    found = [(r.platform, r.chat_dir, r.file) for r in discover_exports(spark, str(root)).collect()]
    assert found == [
        ("discord", "1", "5.html"), ("facebook", "Chat_x", "message_1.html"), ("signal", "G (_id7)", "a.html"),
    ]
    catalog = media_catalog(read_files(spark, str(root)))
    messages = spark.createDataFrame(
        [
            (1, "Facebook: Chat_x", "messages/inbox/Chat_x/photos/P.jpg"),
            (2, "Facebook: Chat_x", "photos/missing.jpg"),
            (3, "Signal: signal_decrypted", "G (_id7)/media/S.JPG"),
            (4, "Signal: signal_decrypted", "G (_id7)/elsewhere/s.jpg"),
            (5, "Discord: Guild", "1/assets/a b.png"),
            (6, "Discord: Guild", "file:///old/discord-media/c.png"),
            (7, "Discord: Guild", "https://cdn.org/x.png"),
            (8, "Discord: Guild", None),
        ],
        "n int, source_name string, attachment_preview string",
    )
    urls = {r.n: r.attachment_url for r in resolve_attachments(messages, catalog).collect()}
    assert urls == {
        1: "/api/media?platform=facebook&source=Chat_x&path=photos%2FP.jpg",
        2: None,
        3: "/api/media?platform=signal&source=G+%28_id7%29&path=media%2FS.JPG",
        4: "/api/media?platform=signal&source=G+%28_id7%29&path=media%2FS.JPG",
        5: "/api/media?platform=discord&source=Guild&path=1%2Fassets%2Fa+b.png",
        6: "/api/media?platform=discord&source=Guild&path=c.png",
        7: "https://cdn.org/x.png",
        8: None,
    }
    config = Config(blocked_filenames=frozenset({"p.jpg"}))
    urls = {r.n: r.attachment_url for r in resolve_attachments(messages, catalog, config).collect()}
    assert urls[1] == "/api/media-removed" and urls[3] != "/api/media-removed"
