"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import (
    centroids, chain_dedup, collocations, components, decontaminate, dom, embedding_dedup, golay, html_extract, language_id, license_scan, line_dedup, mixing, simhash, suffix_dedup, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, x_doc string, score double, taken long, spans string, row long"


def text_of(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null text, empty text, spaces only, a long text, a copy, a near copy, a repeated row, an id used twice."""
    base = text_of(1)
    texts = [
        (1, base), (2, base), (3, base.replace(base.split()[60], "changed")), (4, None), (5, ""), (6, " \n\t "), (7, text_of(7, 30_000)),
        (8, text_of(8)), (8, text_of(8)), (9, text_of(9)), (9, text_of(10)), (None, text_of(11)), (None, None), (12, "été 123"), (13, "123 456"),
    ]
    rows = [(d, t, "en" if i % 3 else "fr", f"s{i % 2}" if i % 5 else None, len(t or ""), "x", 0.5, 7, "s", 3) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    assert rows == mixing.mix(odd).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}


def test_mixing_inclusion_is_unequal_and_met(spark):
    """600 sources with the same 24 sizes: how often each size is taken comes near its inclusion."""
    sizes = [1, 2, 3, 5, 6, 9, 11, 14, 18, 22, 27, 33] * 2
    rows = [(1000 * s + i, " ".join(["w"] * n), f"s{s:03}") for s in range(600) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    seen = {}
    for r in got:
        seen.setdefault((r["copies"], round(r["target"] / r["source_size"], 6), r["size"]), []).append((r["inclusion"], r["sampled"]))
    assert len({k[1] for k in seen}) == 3
    for (copies, times, size), marks in seen.items():
        assert len({p for p, _ in marks}) == 1 and len(marks) == 400
        assert abs(sum(taken for _, taken in marks) / 400 - marks[0][0]) < 0.12, (times, size)
    for key in {k[:2] for k in seen}:
        by_size = [seen[(*key, n)][0][0] for n in sorted(set(sizes))]
        assert by_size == sorted(by_size) and by_size[-1] > 2 * by_size[0]
        words = sum(2 * n * p for n, p in zip(sorted(set(sizes)), by_size))
        assert abs(words - (key[1] - key[0]) * sum(sizes)) < 1e-3  # inclusions fill the quota
    # the quotient of the odds decides, not the random number alone
    other = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed="b").collect()
    assert {(r["doc_id"], r["sampled"]) for r in other} != {(r["doc_id"], r["sampled"]) for r in got}


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    rows = got.collect()
    assert all(abs(r["t"] - r["target"]) <= 20 for r in rows)
    assert abs(sum(r["target"] for r in rows) - sum(r["size"] for r in rows)) < 1e-3


def test_language(odd, none):
    got = language_id.identify(odd, language_id.fit(odd)).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    assert all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6, 13))
    assert language_id.fit(none) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(none, {}).count() == 0


def test_golay_neighbours_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500, dtype=np.uint32)
    flips = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 23, (500, 2))], np.uint32)
    one, two = golay.nearby(words), golay.nearby(words ^ flips)
    assert all(set(one[:, i]) & set(two[:, i]) for i in range(500))


def test_simhash_links_every_pair_within_four_bits(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(200)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), 4)) for p in prints[:100]]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = components.components(simhash.fingerprint_links(spark.createDataFrame([(p, [p]) for p in signed], "node long, fps array<bigint>"))).collect()
    label = {r["node"]: r["component"] for r in links}
    assert all(label[signed[i]] == label[signed[200 + i]] for i in range(100))
    assert not any(p in label for p in signed[100:200])


def test_simhash_groups(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and simhash.simhash_groups(none).count() == 0
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    label = {d: c for (d, _), c in by.items() if d in (1, 2, 4, 5, 6, 7)}
    assert label[1] == label[2] == 1 and label[4] == label[5] == label[6] == 4 and label[7] == 7
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 5 not in ids and 8 in ids


def test_a_copy_does_not_take_another_text_with_its_id_along(spark):
    rows = [(1, text_of(1)), (2, text_of(1)), (2, text_of(2)), (3, text_of(3))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2], rows[3]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60, 1)] + [(100, 101), (5, 5), (7, 6), (7, 6)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup(spark, odd, none):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and suffix_dedup.remove_repeats(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["removed"] == [] and by[2]["kept"] == b"" and by[4]["n_bytes"] == 0 and by[7]["removed"] == []
    assert all(r["removed"] == [] for r in rows if r["doc_id"] == 8)  # a repeated row is the same document
    # a run of one byte repeats itself one byte further on; long texts are parsed in parts
    runs = spark.createDataFrame([(1, "a" * 250), (2, "b" * 99), (3, "b" * 100)], "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["removed"]] for r in suffix_dedup.remove_repeats(runs).collect()}
    assert got == {1: [(1, 250)], 2: [], 3: []}


def test_suffix_dedup_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 1 << 10)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcd", k=5000)) for _ in range(3)]
    texts.append(texts[0][700:2900] + "x" + texts[1][100:350] + texts[2][4000:])
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone[at : at + 100] = [True] * 100
            seen.add(t[at : at + 100])
        expected[i] = sum(gone)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(suffix_dedup.parse(data, np.cumsum([len(t) for t in texts]), 100, 32)[0])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: sum(x["stop"] - x["start"] for x in r["removed"]) for r in got} == expected


def test_decontaminate(spark, odd, none):
    words = text_of(8).split()
    items = spark.createDataFrame([(1, " ".join(words[20:32])), (2, "the missing words"), (3, None), (4, ""), (5, "123 456"), (5, "123 456"), (None, " ".join(words[:2]))], "item_id long, text string")
    rows = decontaminate.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["n_hit"] == 14 and by[8]["items"] == ["", "1"] and by[13]["items"] == ["5"] and by[13]["n_hit"] == 2
    assert not by[7]["contaminated"] and by[4]["n_words"] == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, items.limit(0)).collect())
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_fragments_of_a_longer_item(spark):
    words = text_of(22, 20).split()
    others = words[:8] + words[10:]
    docs = [(1, " ".join(words[8:10])), (2, " ".join(words[1:10])), (3, " ".join(words)), *((i, " ".join(others)) for i in range(4, 8))]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: 0, 2: 0, 3: 20, 4: 10, 5: 10, 6: 10, 7: 10}  # words 11 to 20 are a window


def test_decontaminate_near(spark):
    words = text_of(20, 40).split()
    docs = spark.createDataFrame([(1, " ".join(words[:25] + ["inserted"] + words[25:])), (2, text_of(21))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[20:32]))], "item_id long, text string")
    index = decontaminate.Index(docs, items)
    assert index.phrases().count() == 0 and index.near(2).select("row").distinct().count() == 1


def test_chain(odd, none):
    rows = chain_dedup.passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} >= {(2, 1), (3, 1)} and not [r for r in rows if r["doc_id"] in (7, 8, 9, None)]
    assert chain_dedup.passages(none).count() == 0 and chain_dedup.cut_passages(none).count() == 0
    cut = chain_dedup.cut_passages(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    by = {r["doc_id"]: r for r in cut.collect()}
    assert by[1]["text"] == text_of(1) and by[2]["text"] == "" and by[2]["n_chars"] == 0 and by[4]["text"] is None


def exact_words(texts, size=50):
    """Per text the words inside windows of ``size`` that an earlier text has."""
    seen, need = set(), {}
    for doc, text in texts:
        words = text.split()
        grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        need[doc] = {w for i, g in enumerate(grams) if g in seen for w in range(i, i + size)}
        seen.update(grams)
    return need


def found_words(spark, texts):
    found = {doc: set() for doc, _ in texts}
    for r in chain_dedup.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found[r["doc_id"]] |= set(range(r["start_word"], r["stop_word"]))
    return found


def test_passages_of_lines_that_stand_alone_elsewhere(spark):
    texts = []
    for case in range(30):  # two lines, each alone before and between the documents that have both
        a, b, at = text_of(1000 + case, 27), text_of(2000 + case, 27), case * 10
        around = [text_of(10_000 + 10 * case + i, 30) for i in range(6)]
        texts += [(at, f"{around[0]} {a}"), (at + 1, f"{b} {around[1]}"), (at + 2, f"{around[2]} {a} {b} {around[2]}")]
        texts += [(at + 3, f"{around[3]} {a}"), (at + 4, f"{b} {around[4]}"), (at + 5, f"{around[5]} {a} {b} x")]
    need, found = exact_words(texts), found_words(spark, texts)
    assert sum(map(bool, need.values())) == 30 and not [d for d in need if not need[d] <= found[d]]


def test_passages_whose_lines_stand_before_them_in_the_same_document(spark):
    texts = []
    for case in range(30):
        a, b = text_of(3000 + case, 27), text_of(4000 + case, 27)
        around = [text_of(20_000 + 10 * case + i, 30) for i in range(4)]
        texts += [(2 * case, f"{a} {around[0]} {b} {around[1]} {a} {b} {around[2]}"), (2 * case + 1, f"{around[3]} {a} {b} x")]
    need, found = exact_words(texts), found_words(spark, texts)
    assert sum(map(bool, need.values())) == 30 and not [d for d in need if not need[d] <= found[d]]


def changed_copies(cases: int, pieces: bool):
    """Passages of 100 words and copies of them with every twelfth word replaced; with ``pieces`` quarters of the passage also stand before and between."""
    texts = []
    for case in range(cases):
        words, at = text_of(50_000 + case, 100).split(), 20 * case
        copy = [f"new{case}x{i}" if i % 12 == case % 12 else w for i, w in enumerate(words)]
        around = [text_of(60_000 + 30 * case + i, 30) for i in range(20)]
        for i, shift in enumerate((0, 10)):
            for quarter in range(4):
                piece = " ".join(words[25 * quarter : 25 * quarter + 25]) if pieces else ""
                texts.append((at + shift + quarter, f"{around[8 * i + quarter]} {piece} {around[8 * i + quarter + 4]}"))
        texts.append((at + 8, f"{around[16]} {' '.join(words)} {around[17]}"))
        texts.append((at + 18, f"{around[18]} {' '.join(copy)} {around[19]}"))
    return texts


def test_changed_copies_of_passages_whose_pieces_stand_elsewhere(spark):
    alone, among = (found_words(spark, changed_copies(30, pieces)) for pieces in (False, True))
    found = [sum(len(words[20 * case + 18] & set(range(30, 130))) >= 50 for case in range(30)) for words in (alone, among)]
    assert found[0] == found[1] >= 25


def test_documents_with_two_seeds_in_common_meet_in_blocks(spark, monkeypatch):
    texts = changed_copies(6, True)
    whole = found_words(spark, texts)
    monkeypatch.setattr(chain_dedup, "BLOCK", 2)
    assert found_words(spark, texts) == whole and any(whole.values())


def test_agreement_of_many_rows_is_that_of_each():
    pick = np.random.default_rng(3)
    for _ in range(300):
        a, b = (pick.integers(0, 2, pick.integers(0, 30)) for _ in range(2))
        n = min(len(a), len(b))
        same = np.append((a[:n] == b[:n]).astype(np.int8), np.full(40 - n, -1, np.int8))
        length, matches, ended = chain_dedup.agreeing_rows(same[None])
        assert ended[0] and (length[0], matches[0]) == chain_dedup.agreeing(a, b)


def test_chains_prefer_the_ascending_matches():
    a, b = np.array([0, 6, 12, 18, 24, 30]), np.array([100, 106, 3, 118, 124, 130])
    best = chain_dedup.chains(a, b)[0]
    assert best.tolist() == [0, 1, 3, 4, 5]
    assert [c.tolist() for c in chain_dedup.chains(np.array([0, 200]), np.array([0, 200]))] == [[0], [1]]


def test_alignment_counts_common_words():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint32)
    assert chain_dedup.edit_matches(a, a) == 8 and chain_dedup.edit_matches(a, a[[0, 1, 3, 4, 5, 6, 7]]) == 7 and chain_dedup.edit_matches(a, a[:0]) == 0


def test_html(spark, none):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "<li>" * 20_000 + "x", "t"), (4, "u", "<div " * 2_000 + "<p>y", "t"),
         (5, "u", "<html><body><nav><a href=/a>menu</a></nav><article><h1>Title &amp; more</h1><p>First<br>part  of\nit.</p><p>Second " + "word, " * 40 + "end.</p>"
          "<div class=comments><p>I like it</p></div></article><footer>&copy; me</footer></body></html>", "t")],
        "page_id long, url string, html string, text string",
    )
    got = {r["page_id"]: r for r in html_extract.extract(pages, html_extract.fit(pages)).collect()}
    assert len(got) == 5 and got[1]["text"] == got[2]["text"] == ""
    assert got[5]["blocks"][:2] == ["Title & more", "First part of it."] and len(got[5]["blocks"]) == 3
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


def test_embedded_elements_without_an_end_tag_hide_nothing_else():
    words = lambda source: " ".join(" ".join(t[2] for t in dom.parse(source).texts).split())
    for tag in ("object", "video", "audio", "canvas", "select", "svg", "template"):
        assert words(f"<p>one</p><{tag} a=b><p>two</p>") == "one two"
        assert words(f"<p>one</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>two</p>") == "one two"
    assert words("<p>one</p><script>x <p>two</p>") == "one"


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (4, None, "x"), (5, [], "x"), (6, [float("inf"), 1.0], "x"), (7, [0.0, 1.0], "x"), (8, [1.0], "x")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()
    assert len(got) == len(rows)
    assert {r["n_links"] for r in got if r["vec_id"] in (1, 2, None)} == {3}
    assert {r["component_id"] for r in got if r["vec_id"] in (1, 2, None)} == {1}
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] in (4, 5, 6, 7, 8))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_large_buckets_are_compared_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.ones(16) + rng.standard_normal((60, 16)) * 0.02
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = embedding_dedup.near_duplicates(df, block=8).collect()
    assert {r["n_links"] for r in rows} == {59} and {r["component_id"] for r in rows} == {0}


def test_licenses(odd, none):
    got = license_scan.scan(odd)
    assert got.count() == odd.count() and license_scan.scan(none).count() == 0
    assert all(r["licenses"] == [] for r in got.collect())
    assert license_scan.apply_rules(["A", "B", "A", "C"], [(("A", "B"), "one"), (("A",), "two")]) == (["one", "two"], ["C"])


def test_known_sentences_are_found(spark):
    text = "// Redistributions of source code must retain the above copyright notice,\tthis list of conditions and the following disclaimer.\n** Licensed under CC  BY-NC 4.0!\n" + text_of(3)
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["sentence_ids"] == ["BSDSource", "CC-BY-NC-4"] and row["licenses"] == ["CC-BY-NC-4.0"] and row["left_over"] == ["BSDSource"]


WRAPPED = {
    "BSD-3-Clause": """
/*
 * Copyright (c) 2020, Somebody. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 *
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
 * AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
 * ARE DISCLAIMED. IN NO EVENT SHALL
 */""",
    "MIT": """
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in
# all copies or substantial portions of the Software.""",
    "GPL-2.0-or-later": """
// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation; either version 2 of the License, or
// (at your option) any later version.
""",
    "GPL-3.0-or-later": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
}


def test_wrapped_licences_are_found(spark):
    rows = [(i, text_of(i) + "\n" + text + "\n" + text_of(9)) for i, text in enumerate(WRAPPED.values())]
    rows.append((9, "Redistributions of source code must retain the above copyright notice,\n\nthis list of conditions and the following disclaimer."))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(len(WRAPPED))] == [[name] for name in WRAPPED]
    assert got[9]["sentence_ids"] == [] and all(got[i]["left_over"] == [] for i in range(len(WRAPPED)))


def test_urls(spark):
    at = lambda d: f"2024-01-{d:02d} 12:00:00"
    entries = spark.createDataFrame(
        [("b.com", "spam", at(2), True), ("b.com", "spam", at(5), False), ("b.com", "spam", at(20), True), ("a.b.com/x", "bad", at(1), True),
         ("b.com", "spam", at(20), True), ("c.com", "spam", at(3), True), ("c.com", "spam", at(3), False), (None, "spam", at(1), True)],
        "pattern string, list string, ts string, listed boolean",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    rows = [("http://a.B.com/y", at(1)), ("http://a.b.com/y", at(2)), ("http://a.b.com/y", at(4)), ("http://a.b.com/y", at(5)), ("http://user@a.b.com:80/x/z?q#f", at(25)),
            ("https://c.com", at(4)), (None, at(4)), ("http://b.com", None), ("no address", at(4)), ("http://b.com", at(21)), ("http://b.com", at(21))]
    captures = spark.createDataFrame([(i, u, t, "mine") for i, (u, t) in enumerate(rows)], "n long, url string, fetched string, lists string").withColumn("fetched", F.to_timestamp_ntz("fetched"))
    got = {r["n"]: r["lists"] for r in url_filter.evaluate(captures, entries).collect()}
    assert got == {0: [], 1: ["spam"], 2: ["spam"], 3: [], 4: ["bad", "spam"], 5: [], 6: [], 7: [], 8: [], 9: ["spam"], 10: ["spam"]}
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in url_filter.evaluate(captures, entries.limit(0)).collect())


# -- collocations ------------------------------------------------------------
def brute_collocations(rows, least, top):
    from collections import Counter, defaultdict

    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3, 4):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in many.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_texts(seed, n=1500):
    rng = random.Random(seed)
    words = [w + x for w in ("zug", "ß", "The", "new", "york", "a\x1c", "b\u2028", "日本") for x in ("", "é", "1")]
    texts = []
    for _ in range(n):
        said = [rng.choice(words[: 1 + int(len(words) * rng.random() ** 2)]) for _ in range(rng.randrange(40))]
        texts.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r"]) for w in said), rng.choice(["en", "en", "en", "de", None, ""])))
    return texts


@pytest.mark.parametrize("most", [1 << 22, 4])
def test_collocations_against_brute_force(spark, most, monkeypatch):
    """Once as it is, once with every tile cut into ranges of cells and merged in small buffers."""
    rows = some_texts(1) + [(None, "en"), ("", None), (" \t\n", "fr"), ("one", "xx")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n long, rank string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=30, top=40, most=most).collect())
    assert got == brute_collocations(rows, 30, 40) and len(got) > 60
    assert collocations.collocations(df.limit(0)).count() == 0


def test_tiles_address_every_pair():
    rng = np.random.default_rng(2)
    codes = np.concatenate([rng.integers(-1, 40, 3000), rng.integers(-1, 60_000, 3000), rng.integers(0, 1 << 40, 100)])
    at, tiles, cells = collocations.cells_of(codes)
    for tile in np.unique(tiles):
        mine = tiles == tile
        left, right = collocations.pairs_of(int(tile), cells[mine])
        assert (left == codes[at[mine]]).all() and (right == codes[at[mine] + 1]).all()
        found, n = collocations.counted(int(tile), cells[mine])
        assert (found == np.unique(cells[mine])).all() and n.sum() == mine.sum()
    assert sorted(at) == [i for i in range(len(codes) - 1) if codes[i] >= 0 and codes[i + 1] >= 0]
    for numbers in ([], [-1], [-1, 5, 254, 255, 1 << 40], list(range(70_000))):
        assert collocations.unpack(collocations.pack(np.array(numbers, np.int64))).tolist() == numbers


# -- centroids ---------------------------------------------------------------
def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if mine:
                    centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((str(i), j, d, sum(e for e, c in near if c == j), sum(e for e, _ in near)) for (i, _), (d, j) in zip(kept, near))


@pytest.mark.parametrize(("n", "k", "spread"), [(150, 16, 1.0), (60, 16, 0.01), (9, 16, 1.0), (40, 1, 1.0), (120, 5, 300.0)])
def test_clusters_against_brute_force(spark, n, k, spread):
    """Few vectors, one centroid, ties of close vectors, repeated rows and ids, unusable ones, clashing columns."""
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(64) * spread).tolist()) for i in range(n)]
    rows += rows[:3] + [(900 + i, v) for i, (_, v) in enumerate(rows[:4])] + [(None, rows[0][1])]
    bad = [(800, None), (801, []), (802, [1.0] * 63), (803, [None] + [1.0] * 63), (804, [float("nan")] * 64), (805, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], "vec_id long, embedding array<double>, n int, cluster string").repartition(3)
    got = centroids.cluster(df, k=k).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got) == brute_clusters(rows, k, 3)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).count() == 0 and centroids.cluster(none.limit(0)).columns[:2] == ["vec_id", "cluster"]


# -- lines -------------------------------------------------------------------
def brute_lines(rows):
    top = 1 << 63
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), top), top if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (top if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(spark, odd):
    rng = random.Random(4)
    lines = ["", " ", "short", "Exactly 10", "exactly 10\r", "\u00a0padded with other space", "日本語日本語日本語日", "日本語日本語日本語", "a line\u2028of two", "x" * 400]
    rows = [(i % 70, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows += [(500 + i, "A very common line") for i in range(300)] + [(None, "A very common line"), (None, None), (3, None), (499, "A very common line\n" * 2000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, text string, keep string, place int").repartition(7)
    done = line_dedup.dedup_lines(df)
    assert {"keep", "place"} <= set(done.columns)
    got = done.select("doc_id", "n_lines", "n_dropped", line_dedup.apply_keep().alias("left")).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.left) for r in got) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(odd).count() == odd.count()


def test_a_line_over_many_partitions(spark):
    """One line makes up most of the corpus; it is spread over partitions, and only its first document keeps it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("id AS doc_id", "concat('the very common line\nown line number ', id) AS text")
        done = line_dedup.dedup_lines(df).groupBy("n_dropped").count().collect()
        lines = line_dedup.hashed_lines(df.selectExpr("doc_id AS doc", "0L AS tag", "text"), 10)
        ranged = lines.repartitionByRange("h1", "h2", "doc", "tag", "place").withColumn("p", F.spark_partition_id())
        hot = ranged.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts")).orderBy(F.desc("n")).head()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, done)) == [(0, 1), (1, 3999)]
    assert hot.n == 4000 and hot.parts > 1
