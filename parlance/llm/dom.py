"""A forgiving HTML tokenizer that yields a tree as flat lists, and features of its nodes.

Nodes are numbered in page order, so a subtree is a range of numbers; nothing recurses, and
any input gives a tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|x-label|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# tags by what HTML says of them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = frozenset("template svg select object canvas video audio".split())  # of RAW: what follows one without an end tag is text
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPE = frozenset("table td th caption button body html".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = frozenset("ul ol dl table select menu".split())

# kinds of tags and of words in class, id, role: features of a node and of its ancestors
TAG_KINDS = [
    {"article", "main"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"div", "section"}, {"nav", "menu"},
    {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "input", "button", "label", "fieldset"}, {"a"}, {"table", "tr", "td", "th", "tbody"},
    INLINE - {"a", "label"}, {"blockquote", "pre", "figure", "figcaption"}, {"html", "body", "head"}, RAW,
]
WORD_KINDS = [
    set("article content post entry story articlebody body text main hentry page blog prose".split()),
    set("nav navigation navbar menu breadcrumb breadcrumbs tabs pagination pager toc".split()),
    set("header masthead banner topbar logo top".split()),
    set("footer copyright bottom legal colophon contentinfo".split()),
    set("sidebar side aside widget rail related recommended recommend popular trending more tags complementary teaser".split()),
    set("ad ads advert advertisement advertorial sponsor sponsored promo promotion promoted adsense banner".split()),
    set("comment comments reply replies respond discussion disqus feedback review reviews".split()),
    set("notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup subscription paywall message disclaimer".split()),
    set("share sharing social search login form toolbar tools print meta byline author".split()),
]
_TAG_BITS = {tag: 1 << i for i in range(len(TAG_KINDS) - 1, -1, -1) for tag in TAG_KINDS[i]}
_WORD_BITS: dict[str, int] = {}
for _i, _words in enumerate(WORD_KINDS):
    for _w in _words:
        _WORD_BITS[_w] = _WORD_BITS.get(_w, 0) | 1 << (len(TAG_KINDS) + _i)
BITS = len(TAG_KINDS) + len(WORD_KINDS)


@dataclass
class Page:
    """Nodes in page order, and the texts between tags with the node they stand in."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # (node, nodes begun before it, text)


def pairs_of(source: str, tag: str) -> dict[int, int]:
    """Where each element of a tag that has an end tag starts, and the place behind its end."""
    out, begun = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*>?", source, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            out[begun.pop()] = m.end()
    return out


def parse(source: str | None) -> Page:
    page, stack, opened = Page(), [0], Counter()
    page.tag.append("html")
    for values, first in ((page.parent, -1), (page.depth, 0), (page.end, 0), (page.bits, _TAG_BITS["html"]), (page.above, 0), (page.label, "")):
        values.append(first)
    source, ends = source or "", {}

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            opened[page.tag[node]] -= 1
            page.end[node] = len(page.tag)

    def text(raw: str) -> None:
        if raw:
            page.texts.append((stack[-1], len(page.tag), html.unescape(raw)))

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if opened[tag] > 0:
                i = len(stack) - 1
                while page.tag[stack[i]] != tag:
                    i -= 1
                close(i)
            elif tag == "p" or tag == "br":
                page.texts.append((stack[-1], len(page.tag), "\n"))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "html":
            continue
        if tag in ENDS_P and opened["p"] > 0:
            i = len(stack) - 1
            while i > 0 and page.tag[stack[i]] != "p" and page.tag[stack[i]] not in SCOPE:
                i -= 1
            if page.tag[stack[i]] == "p":
                close(i)
        if tag in SIBLINGS:
            ended, i, found = SIBLINGS[tag], len(stack) - 1, 0
            if any(opened[t] > 0 for t in ended):
                while i > 0 and page.tag[stack[i]] not in LISTS:
                    if page.tag[stack[i]] in ended:
                        found = i
                    i -= 1
                if found:
                    close(found)
        node, bits, label = len(page.tag), _TAG_BITS.get(tag, 0), ""
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name == "x-label":
                    label = value
                elif name != "hidden":
                    for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                        bits |= _WORD_BITS.get(w, 0)
        up = stack[-1]
        page.tag.append(tag)
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1)
        page.end.append(node + 1)
        page.bits.append(bits)
        page.above.append(page.above[up] | page.bits[up])
        page.label.append(label or page.label[up])
        if tag == "br":
            page.texts.append((up, len(page.tag), "\n"))
        if tag in VOID or m[0].endswith("/>") and tag not in ENDS_P:
            continue
        if tag in NESTED:
            if tag not in ends:
                ends[tag] = pairs_of(source, tag)
            at = ends[tag].get(m.start(), at)
            continue
        if tag in RAW:  # nothing in it is text of the page
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else n
            continue
        stack.append(node)
        opened[tag] += 1
    close(0)
    page.end[0] = len(page.tag)
    return page


def features(pages: list[Page]) -> np.ndarray:
    """One row a node: kinds of tag and attribute words, those of ancestors, and the numbers:
    text, links, density, place, depth, children and siblings."""
    base = np.cumsum([0] + [len(p.tag) for p in pages])
    total = int(base[-1])
    own, link, marks, words = (np.zeros(total + 1) for _ in range(4))
    first = np.zeros(total, np.int64)
    parent, end, depth = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total)
    bits, above = np.zeros(total, np.int64), np.zeros(total, np.int64)
    a_bit = _TAG_BITS["a"]
    for i, p in enumerate(pages):
        lo, hi = base[i], base[i + 1]
        parent[lo:hi] = np.array(p.parent) + lo
        parent[lo] = lo
        end[lo:hi] = np.array(p.end) + lo
        depth[lo:hi] = p.depth
        bits[lo:hi], above[lo:hi], first[lo:hi] = p.bits, p.above, lo
        for node, _, t in p.texts:
            size = len(t) - t.count(" ") - t.count("\n")
            if size:
                k = lo + node
                own[k] += size
                marks[k] += t.count(".") + t.count(",")
                words[k] += t.count(" ") + 1
                if (p.bits[node] | p.above[node]) & a_bit:
                    link[k] += size
    at = np.arange(total)
    sums = {name: np.concatenate(([0.0], np.cumsum(v[:-1]))) for name, v in (("own", own), ("link", link), ("marks", marks), ("words", words))}
    sub = {name: s[end] - s[at] for name, s in sums.items()}
    ps = np.concatenate(([0.0], np.cumsum((bits & _TAG_BITS["p"]) != 0)))
    inline = np.concatenate(([0.0], np.cumsum((bits & _TAG_BITS["b"]) != 0)))
    size = end - at
    blocks = np.maximum(1, size - (inline[end] - inline[at]))
    whole = np.maximum(1.0, sub["own"][first])
    kids = np.bincount(parent[at != first], minlength=total).astype(float)
    kid_text = np.bincount(parent[at != first], weights=sub["own"][at != first], minlength=total)
    n_nodes = (end[first] - first).astype(float)
    numbers = np.stack([
        np.log1p(sub["own"]), sub["own"] / whole, sub["link"] / np.maximum(1.0, sub["own"]), sub["own"] / blocks, np.log1p(own[:total]), depth,
        np.log1p(kids), (at - first) / n_nodes, (end - first) / n_nodes, sub["marks"] / np.maximum(1.0, sub["words"]), np.log1p(sub["words"]),
        np.log1p(ps[end] - ps[at]), np.log1p(kids[parent]), sub["own"] / np.maximum(1.0, kid_text[parent] / np.maximum(1.0, kids[parent])),
        sub["own"] / np.maximum(1.0, sub["own"][parent]), np.log1p(size), (sums["own"][at] - sums["own"][first]) / whole,
    ], axis=1)
    flags = [((values[:, None] >> np.arange(BITS)) & 1).astype(float) for values in (bits, above)]
    return np.concatenate([numbers, *flags], axis=1)
