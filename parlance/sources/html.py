"""A small forgiving HTML tree on top of the standard library's tokenizer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser
from itertools import islice
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset({"script", "style", "template"})
# what HTML closes without an end tag
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"),
}
HOLDERS = frozenset("ul ol dl select table".split())


NONE: frozenset[str] = frozenset()
CUT = "cutbox"
T = TypeVar("T")
ROWS = 2_000  # rows handed on together, whatever files they come from


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "kinds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.kinds: frozenset[str] = _kinds(attrs["class"]) if attrs.get("class") else NONE

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator["Node"]:
        """Descendants in document order, without the node itself."""
        left = [c for c in reversed(self.children) if c.__class__ is Node]
        while left:
            node = left.pop()
            yield node
            if node.children:
                left.extend([c for c in reversed(node.children) if c.__class__ is Node])

    def by_class(self) -> dict[str, list["Node"]]:
        """Descendants by each of their classes, in document order: one walk for many questions."""
        return by_class(self.walk())

    def ancestors(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def strings(self) -> Iterator[str]:
        left = self.children[::-1]
        while left:
            child = left.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in SILENT:
                left.extend(child.children[::-1])

    def text(self, joiner: str = " ") -> str:
        parts = (s.strip() for s in self.strings())
        return joiner.join(p for p in parts if p)

    def all(self, *steps: str, among: "Iterable[Node] | None" = None) -> list["Node"]:
        """Descendants matching the last step, each earlier step being some ancestor.

        A step is ``tag``, ``.class``, ``tag.class.class`` or either with ``[attr]``.
        With ``among``, some descendants in document order, only those are looked at.
        """
        wanted = _step(steps[-1])
        return [n for n in (self.walk() if among is None else among) if _matches(n, wanted) and (len(steps) == 1 or _inside(n, steps[:-1], self))]

    def one(self, *steps: str, among: "Iterable[Node] | None" = None) -> "Node | None":
        wanted = _step(steps[-1])
        return next((n for n in (self.walk() if among is None else among) if _matches(n, wanted) and (len(steps) == 1 or _inside(n, steps[:-1], self))), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


def by_class(nodes: Iterable[Node]) -> dict[str, list[Node]]:
    found: dict[str, list[Node]] = {}
    for node in nodes:
        for kind in node.kinds:
            if kind in found:
                found[kind].append(node)
            else:
                found[kind] = [node]
    return found


@lru_cache(maxsize=1024)
def _kinds(classes: str) -> frozenset[str]:
    return frozenset(classes.split())


@lru_cache(maxsize=1024)
def _step(step: str) -> tuple[str, frozenset[str], str]:
    """(tag, classes, attribute) a step asks for, empty where it does not."""
    step, _, attr = step.removesuffix("]").partition("[")
    tag, *classes = step.split(".")
    return tag, frozenset(classes), attr


def _matches(node: Node, step: tuple[str, frozenset[str], str]) -> bool:
    tag, classes, attr = step
    return (not tag or node.tag == tag) and classes <= node.kinds and (not attr or bool(node.attrs.get(attr)))


def _inside(node: Node, steps: tuple[str, ...], top: Node) -> bool:
    above = node.ancestors()
    for step in reversed(steps):
        wanted = _step(step)
        for parent in above:
            if parent is top:
                return False
            if _matches(parent, wanted):
                break
        else:
            return False
    return True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not asked for, so lines are not counted."""
        return j

    def _close(self, place: int) -> None:
        for node in self.open[place:]:
            self.count[node.tag] -= 1
        del self.open[place:]

    def _close_implied(self, tag: str) -> None:
        """Ends what the start of ``tag`` ends: an open paragraph, the list item or cell before."""
        if tag in BLOCKS and self.count["p"]:
            place = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in ("p", "td", "th", "table")), 0)
            if place and self.open[place].tag == "p":
                self._close(place)
        ended, place = CLOSED_BY.get(tag, ()), 0
        if any(self.count[t] for t in ended):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in HOLDERS:
                    break
                if self.open[i].tag in ended:
                    place = i
            if place:
                self._close(place)

    def handle_starttag(self, tag, attrs):
        known: dict[str, str] = {}
        for name, value in attrs:
            known[name] = value or ""
        self._close_implied(tag)
        node = Node(tag, known, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        place = len(self.open) - 1
        while self.open[place].tag != tag:
            place -= 1
        self._close(place)

    def handle_data(self, data):
        self.open[-1].children.append(data)


# What the tokenizer reads one way only, whatever its version: names, values in double quotes
# without references, text without a stray "<".
_ATTR = r'[ \t\r\n\f]+([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:="([^"&<>]*)")?'
_ATTRS = re.compile(_ATTR)
_TAG = re.compile(rf"(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTR})*)[ \t\r\n\f]*(/?)")
_DOCTYPE = re.compile(r"![dD][oO][cC][tT][yY][pP][eE][ a-zA-Z]*")
_RAW = frozenset({"script", "style"})  # their text is taken as it is
_OTHER = frozenset("xmp iframe noembed noframes noscript plaintext".split())
_TEXT_ONLY = _RAW | {"title", "textarea"}


@lru_cache(maxsize=8192)
def _tag(inside: str) -> tuple[bool, str, dict[str, str], bool] | None:
    """(is an end, name, attributes, ends itself) of a plain tag, None for any other."""
    hit = _TAG.fullmatch(inside)
    if hit is None:
        return None
    name, listed = hit[2].lower(), hit[3]
    if name in _OTHER or (hit[1] and (listed or hit[6])) or (hit[6] and name in _TEXT_ONLY):
        return None
    return bool(hit[1]), name, {n.lower(): v for n, v in _ATTRS.findall(listed)} if listed else {}, bool(hit[6])


def _parse_plain(text: str) -> Node | None:
    """The tree of a page of plain tags and text, None where there is anything else."""
    builder = _Builder()
    pieces = text.split("<")
    top = builder.root
    if pieces[0]:
        top.children.append(unescape(pieces[0]) if "&" in pieces[0] else pieces[0])
    stack, count = builder.open, builder.count
    only = ""
    for piece in pieces[1:]:
        inside, mark, data = piece.partition(">")
        tag = _tag(inside) if mark else None
        if tag is None:
            if not (mark and not only and _DOCTYPE.fullmatch(inside)):
                return None
            if data:
                stack[-1].children.append(unescape(data) if "&" in data else data)
            continue
        is_end, name, attrs, whole = tag
        if only and not (is_end and name == only):
            return None
        only = ""
        if is_end:
            if stack[-1].tag == name:
                stack.pop()
                count[name] -= 1
            else:
                builder.handle_endtag(name)
        else:
            if name in CLOSED_BY or (name in BLOCKS and count["p"]):
                builder._close_implied(name)
            node = Node(name, attrs, stack[-1])
            stack[-1].children.append(node)
            if name not in VOID and not whole:
                stack.append(node)
                count[name] += 1
            if name in _TEXT_ONLY:
                only = name
        if data:
            stack[-1].children.append(unescape(data) if "&" in data and only not in _RAW else data)
    return None if only else top


def parse_html(text: str) -> Node:
    """The tree of a page. Plain pages are cut at their tags; all others go through the tokenizer, with the same tree."""
    plain = _parse_plain(text)
    if plain is not None:
        return plain
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


@lru_cache(maxsize=8192)
def _turn(inside: str) -> int | None:
    """How many elements deeper a plain tag leads, None for other tags and for those whose text is no markup."""
    tag = _tag(inside)
    if tag is None or tag[1] in _TEXT_ONLY:
        return None
    return -1 if tag[0] else 0 if tag[3] or tag[1] in VOID else 1


@lru_cache(maxsize=8192)
def _opens(inside: str, step: str) -> bool:
    tag = _tag(inside)
    return tag is not None and not (tag[0] or tag[3] or tag[1] in VOID) and _matches(Node(tag[1], tag[2], None), _step(step))


_LONGEST = 1_000  # a box of more tags is parsed with its page
_PLACES = [str(place) for place in range(_LONGEST)]


def _box_tree(tags: tuple[str, ...]) -> Node | None:
    """The tree of a box from its tags, the number of the tag before it standing for a text.

    None unless the last tag alone ends the box, and no tag ends what stands outside.
    """
    builder = _Builder()
    for place, inside in enumerate(tags):
        if place and len(builder.open) == 1:
            return None
        is_end, name, attrs, whole = _tag(inside)
        if is_end and not builder.count[name]:
            return None
        if is_end:
            builder.handle_endtag(name)
        elif whole:
            builder.handle_startendtag(name, list(attrs.items()))
        else:
            builder.handle_starttag(name, list(attrs.items()))
        if len(builder.open) > 1:
            builder.open[-1].children.append(_PLACES[place])
    found = builder.root.children
    return found[0] if len(builder.open) == 1 and len(found) == 1 else None


@lru_cache(maxsize=1024)
def _outline_of(tags: tuple[str, ...], step: str, outline: Callable, inside: frozenset[str]):
    box = _box_tree(tags)
    if box is None or box.all(step) or any(node.kinds & inside for node in box.walk()):
        return None
    return outline(box)


def _cut(text: str, step: str) -> tuple[Node, list[tuple[tuple[str, ...], list[str]]]] | None:
    """A plain page with ``CUT`` for each box, and the tags of each box with the text after each. None if it is not that plain."""
    pieces = text.split("<")
    rest, boxes, depth = [pieces[0]], [], 0
    tags: list[str] = []
    texts: list[str] = []
    for piece in pieces[1:]:
        inside, mark, data = piece.partition(">")
        if depth:
            turn = _turn(inside) if mark else None
            if turn is None:
                return None
            tags.append(inside)
            depth += turn
            if len(tags) > _LONGEST:
                return None
            if depth:
                texts.append(unescape(data) if "&" in data else data)
            else:
                boxes.append((tuple(tags), texts))
                rest.append(f"{CUT}/>{data}")
        elif mark and _opens(inside, step):
            if len(rest) > 1 and _turn(rest[-1].partition(">")[0]) is None:
                return None  # a tag that is not plain, or text that is no markup
            tags, texts, depth = [inside], [unescape(data) if "&" in data else data], 1
        else:
            rest.append(piece)
    page = None if depth else _parse_plain("<".join(rest))
    if page is None or any(node.tag == "p" or node.tag in CLOSED_BY for node in page.walk()):
        return None  # what a box would end, or stand in
    return page, boxes


def outlined(
    text: str, step: str, outline: Callable[[Node], T], inside: frozenset[str] = NONE, outside: frozenset[str] = NONE
) -> tuple[Node, list[tuple[T, Callable[[list[str]], Iterable[str]]]]]:
    """A page, and of each element matching ``step`` its outline with a function that gives the texts of lists in it.

    Boxes of a page repeat few sequences of tags. On a plain page each sequence is parsed and outlined once, with
    places instead of texts, and the page is given without its boxes. Any other page is parsed whole: so are pages
    with boxes inside boxes, with the classes ``inside`` in a box, or with ``outside`` around one.
    """
    cut = _cut(text, step)
    around = {} if cut is None or not outside else {id(n.parent): n for n in cut[0].walk() if n.tag == CUT}
    if cut is not None and not any(parent.kinds & outside for node in around.values() for parent in node.ancestors()):
        found = []
        for tags, texts in cut[1]:
            known = _outline_of(tags, step, outline, inside)
            if known is None:
                break
            found.append((known, partial(map, dict(zip(_PLACES, texts)).__getitem__)))
        else:
            return cut[0], found
    page = parse_html(text)
    return page, [(outline(box), iter) for box in page.all(step)]


def arrow_schema(schema: str) -> pa.Schema:
    """Types of a DDL text for ``in_batches``; asked for on the driver."""
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in DataType.fromDDL(schema)])


def in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Like ``in_frames``, without the way through pandas."""
    rows = iter(rows)
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*held), schema)], schema=schema)


def in_frames(rows: Iterable[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows as frames of up to ``ROWS``: many short files make few frames, a long one several."""
    columns, held = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
