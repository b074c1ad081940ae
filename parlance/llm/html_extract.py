"""Main text of web pages by gradient-boosted trees over the nodes of their DOM.

Each element gets features (text, links, density, place, depth, siblings, words in class, id
and role, kinds of its ancestors) and a probability of being main content. Decoding is
hierarchical: along any path from the root a page is first outside the content, then inside,
then possibly inside something left out of it, and never back. The best such choice for the
whole tree is found bottom up, so a descendant cannot contradict its ancestors.

No page comes with labels. The trees are trained on a bounded sample of the pages themselves
(``most_pages``, by hash of the address): nodes are labelled by what tags and attribute words
mean in HTML, and the sample's texts are set again in generated layouts (content in plain
containers, menus, banners, side columns, forms, notices, comments) whose labels are known.
All pages are then extracted, whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .boosting import Boosted
from .shared import fresh

SPACE = re.compile(r"\s+")
DROPPED_TAGS = frozenset("nav menu footer aside form header dialog button input select textarea figcaption".split())
NOT_CONTENT = sum(1 << (len(dom.TAG_KINDS) + i) for i in (1, 3, 4, 5, 6, 7))
CONTENT_TAGS = frozenset(("article", "main"))


def seed_labels(page: dom.Page) -> list[int]:
    """1 inside an article or main element, except what tags or attribute words set apart.

    Generated pages carry their labels."""
    labels = []
    state: list[int] = []  # 0 outside, 1 inside, 2 left out
    for node, tag in enumerate(page.tag):
        if page.label[node]:
            labels.append(int(page.label[node] == "in"))
            state.append(labels[-1])
            continue
        before = state[page.parent[node]] if node else 0
        if before == 0 and tag in CONTENT_TAGS:
            before = 1
        elif before == 1 and (tag in DROPPED_TAGS or page.bits[node] & NOT_CONTENT):
            before = 2
        state.append(before)
        labels.append(int(before == 1))
    return labels


# -- decoding ---------------------------------------------------------------
def blocks_of(page: dom.Page, log_odds: np.ndarray) -> list[str]:
    """The text blocks of the best consistent choice of nodes.

    A node counts with the logarithm of its own text, so containers without text hardly vote.
    """
    n = len(page.tag)
    own = np.zeros(n)
    for node, _, t in page.texts:
        own[node] += len(t) - t.count(" ") - t.count("\n")
    weight = 0.05 + np.log1p(own)
    yes = (-np.logaddexp(0, -log_odds) * weight).tolist()
    no = (-np.logaddexp(0, log_odds) * weight).tolist()
    # best score of each subtree if its root is outside, inside or left out; children come after parents
    inside, outside, left_out = yes[:], no[:], no[:]
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        inside[up] += max(inside[node], left_out[node])
        outside[up] += max(inside[node], outside[node])
        left_out[up] += left_out[node]
    state = [1 if inside[0] > outside[0] else 0]
    for node in range(1, n):
        up = state[page.parent[node]]
        if up == 0:
            state.append(1 if inside[node] > outside[node] else 0)
        elif up == 1:
            state.append(1 if inside[node] >= left_out[node] else 2)
        else:
            state.append(2)
    # a block ends where an element that is not inline begins or ends
    breaks = sorted({k for node in range(1, n) if page.tag[node] not in dom.INLINE for k in (node, page.end[node])})
    out, parts, at = [], [], 0
    seen = -1
    for node, begun, t in page.texts:
        # position of a text: behind ``begun`` nodes, and inside ``node``; leaving an element moves it past its end
        block = node
        while block and page.tag[block] in dom.INLINE:
            block = page.parent[block]
        while at < len(breaks) and breaks[at] < begun:
            at += 1
        key = (block, at)
        if key != seen and parts:
            out.append("".join(parts))
            parts = []
        seen = key
        parts.append(t if state[node] == 1 else " ")
    out.append("".join(parts))
    return [b for b in (SPACE.sub(" ", b).strip() for b in out) if b]


# -- training ---------------------------------------------------------------
def _texts(page: dom.Page, labels: list[int]) -> tuple[list[str], list[str]]:
    good, bad = [], []
    for node, _, t in page.texts:
        t = SPACE.sub(" ", t).strip()
        if t:
            (good if labels[node] else bad).append(t)
    return good, bad


LAYOUT_WORDS = {
    "in": ["content", "post-content", "entry-content", "article-body", "story", "main", "post", "page-content", "", "", "text", "col-8", "wrap"],
    "nav": ["menu", "navbar", "nav main-nav", "breadcrumbs", "", "top-menu", "pagination"],
    "header": ["header", "site-header", "masthead", "banner", "", "top-bar"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "", "legal"],
    "side": ["sidebar", "widget", "related-posts", "right-rail", "aside", "trending", "recommended"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad", "adsense"],
    "comments": ["comments", "comment-list", "discussion", "replies", "disqus_thread", "respond"],
    "notice": ["cookie-notice", "notice", "newsletter-signup", "alert", "consent", "popup", "subscribe-box"],
    "share": ["share", "social-links", "toolbar", "tags"],
}
LAYOUT_TAGS = {
    "in": ["article", "div", "div", "main", "section", "td"], "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div", "p"],
    "side": ["aside", "div", "section"], "ad": ["div", "aside", "p", "section"], "comments": ["section", "div", "ol"], "notice": ["div", "section", "p"], "share": ["div", "ul"],
}


def layout(rng: random.Random, good: list[str], bad: list[str]) -> str:
    """A page made of the given texts, with its labels in ``x-label``."""
    pick = lambda texts, n: [rng.choice(texts) for _ in range(n)]
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def box(kind: str, inner: str, label: str = "out") -> str:
        tag = rng.choice(LAYOUT_TAGS[kind])
        word = rng.choice(LAYOUT_WORDS[kind])
        mark = f' {rng.choice(["class", "class", "id"])}="{word}"' if word else ""
        return f'<{tag}{mark} x-label="{label}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{esc(t[:20])}</a></li>' for i, t in enumerate(pick(bad, n))) + "</ul>"

    def para(t: str) -> str:
        form = rng.random()
        if form < 0.75:
            return f"<p>{esc(t)}</p>"
        if form < 0.8:
            return f"<blockquote><p>{esc(t)}</p></blockquote>"
        if form < 0.85:
            return f"<ul><li>{esc(t)}</li><li>{esc(rng.choice(good)[:60])}</li></ul>"
        if form < 0.9:
            return f"<div>{esc(t)}</div>"
        return f'<p>{esc(t[: len(t) // 2])}<a href="/x">{esc(t[len(t) // 2 : len(t) // 2 + 12])}</a> <em>{esc(t[len(t) // 2 + 12 :])}</em></p>'

    some = rng.sample(good, min(len(good), rng.randint(1, 8)))
    body = [para(t) for t in some]
    if rng.random() < 0.7:
        body.insert(0, f"<h1>{esc(rng.choice(good)[:70])}</h1>")
    for kind, chance in (("ad", 0.4), ("share", 0.3), ("notice", 0.2), ("side", 0.2), ("comments", 0.2)):
        if rng.random() < chance:
            inner = links(3) if kind == "share" else "".join(f"<p>{esc(t)}</p>" for t in pick(good if kind == "comments" else bad, rng.randint(1, 3)))
            place = len(body) if kind == "comments" else rng.randint(0, len(body))
            body.insert(place, box(kind, inner))
    main = box("in", "".join(body), "in")
    before = [box("header", f"<h2>{esc(rng.choice(bad)[:40])}</h2>") if rng.random() < 0.6 else "", box("nav", links(rng.randint(3, 8)))]
    after = [box("footer", f"&copy; {esc(rng.choice(bad))}")]
    if rng.random() < 0.5:
        (before if rng.random() < 0.4 else after).append(box("side", links(4) + "".join(f"<p>{esc(t)}</p>" for t in pick(bad, 2))))
    if rng.random() < 0.5:
        (before if rng.random() < 0.5 else after).insert(0, box("ad", esc(rng.choice(bad))))
    if rng.random() < 0.4:
        (before if rng.random() < 0.5 else after).insert(0, box("notice", f"<p>{esc(rng.choice(bad))}</p><button>{esc(rng.choice(bad)[:10])}</button>"))
    if rng.random() < 0.4:
        after.insert(0, box("comments", "".join(f"<div><p>{esc(t)}</p></div>" for t in pick(good + bad, rng.randint(1, 4)))))
    if rng.random() < 0.3:
        after.insert(0, f'<form x-label="out"><label>{esc(rng.choice(bad)[:20])}</label><input><p>{esc(rng.choice(bad))}</p></form>')
    inner = "".join(before) + main + "".join(after)
    for _ in range(rng.randint(0, 2)):
        inner = f'<div{rng.choice(["", " class=wrapper", " id=page"])}>{inner}</div>'
    return f"<html><body>{inner}</body></html>"


class Extractor:
    """The trained trees, and the text of a page under them."""

    def __init__(self, model: Boosted):
        self.model = model

    def texts(self, sources: list[str | None]) -> list[list[str]]:
        pages = [dom.parse(s) for s in sources]
        if not pages:
            return []
        odds = self.model.score(dom.features(pages))
        cut = np.cumsum([len(p.tag) for p in pages])[:-1]
        return [blocks_of(p, o) for p, o in zip(pages, np.split(odds, cut))]


def fit(pages: DataFrame, most_pages: int = 160, layouts: int = 4, seed: int = 5) -> Extractor:
    """Trains on at most ``most_pages`` pages and ``layouts`` generated ones for each of them.

    Pages are chosen by a hash of their address and text, one for each of ``most_pages``
    slots. Without pages the layouts are filled with placeholder words.
    """
    hashed = pages.filter(F.length("html") > 0).select("html", F.xxhash64("url", F.length("html")).alias("h"))
    slots = hashed.groupBy(F.pmod("h", F.lit(most_pages)).alias("slot")).agg(F.min("h").alias("h"))
    sample = hashed.join(F.broadcast(slots.select("h")), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    rng = random.Random(seed)
    parsed = [dom.parse(r["html"]) for r in sample]
    labels = [seed_labels(p) for p in parsed]
    used = [(p, y) for p, y in zip(parsed, labels) if any(y)]
    filler = [" ".join(["word"] * n) + "." for n in (5, 20, 60)]
    goods, bads = [], []
    for p, y in zip(parsed, labels):
        good, bad = _texts(p, y)
        goods.extend(good)
        bads.extend(bad)
    goods, bads = goods or filler, bads or filler
    for _ in range(max(len(sample), 40) * layouts):
        page = dom.parse(layout(rng, goods, bads))
        used.append((page, seed_labels(page)))
    x = dom.features([p for p, _ in used])
    y = np.concatenate([np.array(y, float) for _, y in used])
    return Extractor(Boosted().fit(x, y))


def extract(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """All rows and columns of ``pages`` with ``text`` and ``blocks`` (array of strings).

    Only ``html`` is read. Null and empty pages, and pages without main content, have an empty
    text; any markup, however broken or deep, gives a row. Columns named text or blocks are
    replaced.
    """
    kept = pages.drop("text", "blocks")
    name = fresh(kept)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sources, out = list(batch), []
            for at in range(0, len(sources), 200):
                out.extend(extractor.texts(sources[at : at + 200]))
            yield pd.Series(out, dtype=object)

    return kept.withColumn(name, found("html")).select(
        *kept.columns, F.array_join(name, "\n\n").alias("text"), F.col(name).alias("blocks")
    )
