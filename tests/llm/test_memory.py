"""Operators that must not hold more than they need."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from parlance.llm import chain_dedup, collocations, simhash


def test_words_of_a_chunk_are_not_held_as_objects(monkeypatch):
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = " ".join(f"word{i % 97}" for i in range(1_000))
    batches = (pd.DataFrame({"lang": ["en"] * 10, "text": [text] * 10}) for _ in range(40))
    tracemalloc.start()
    out = pd.concat(collocations.encoded(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(np.sum(n)) for n in out["counts"]) == 400_000
    assert peak < 12 << 20


def test_buckets_of_one_component_give_no_pairs(spark):
    one = [(i, [i, 7, 9], 1, 100) for i in range(1, 4)]  # three texts of one component, another of a second, a third much shorter
    rows = [*one, (4, [4, 7, 9], 4, 90), (5, [5, 7, 9], 5, 10)]
    fps = spark.createDataFrame(rows, "node bigint, fps array<bigint>, component bigint, n bigint")

    def links(df):
        return {tuple(sorted(r)) for r in simhash.fingerprint_links(df, 40, 3, direct=True, apart=0.8).collect()}

    assert links(fps.filter("component = 1")) == set()
    found = links(fps)
    assert found and all(4 in pair and 5 not in pair for pair in found)


def test_a_sketch_bounds_what_sets_have_in_common(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 100, 700):
        pool = rng.integers(-(1 << 63), (1 << 63) - 1, 2 * n + 1, dtype=np.int64)
        for shared in {0, n // 2, n}:
            a, b = pool[:n], np.concatenate((pool[:shared], pool[n : 2 * n - shared]))
            size = np.array([n])
            most = simhash.at_most(size, size, simhash.sketch(a)[None], simhash.sketch(b)[None])
            assert shared <= most[0] <= n and (n != 100 or most[0] < shared + 30)
    near, far = (rng.integers(0, 1 << 62, 100, dtype=np.int64) for _ in range(2))
    half = np.concatenate((near[:90], far[:10]))
    rows = [(i, [i, 7, 9], i, 100, simhash.sketch(g).tolist()) for i, g in enumerate((near, far, half), 1)]
    fps = spark.createDataFrame(rows, "node bigint, fps array<bigint>, component bigint, n bigint, sketch array<bigint>")
    found = {tuple(sorted(r)) for r in simhash.fingerprint_links(fps, 40, 3, direct=True, apart=0.8).collect()}
    assert found <= {(1, 3)}  # all three are near in bits, the second has nothing like the others' shingles


def test_links_that_span_too_little_are_not_sorted():
    tag = 1 << chain_dedup.TAG
    doc, other = np.array([5, 5, 5, 6, 6, 5], np.int64), np.array([1, 1, 2, 1, 1, 1], np.int64)
    place, to = np.array([10, 30, 40, 9, 3, tag + 90], np.int64), np.array([0, 20, 0, 7, 1, 0], np.int64)
    assert sorted(chain_dedup.far_apart(doc, place, other, to, 7)) == [0, 1]  # 6 words between documents 6 and 1, one link with 2 and of the other tag
    assert sorted(chain_dedup.far_apart(doc, place, other, to, 6)) == [0, 1, 3, 4]
    assert sorted(chain_dedup.far_apart(doc, place, other, to, 0)) == [0, 1, 2, 3, 4, 5]


def test_alignment_has_fewest_edits_and_then_most_matches():
    def plain(a, b):
        best = {(i, 0): (i, 0) for i in range(len(a) + 1)} | {(0, j): (j, 0) for j in range(len(b) + 1)}
        for i, v in enumerate(a, 1):
            for j, w in enumerate(b, 1):
                cost, match = best[i - 1, j - 1]
                steps = [(cost + (v != w), match - (v == w))]
                steps += [(best[at][0] + 1, best[at][1]) for at in ((i - 1, j), (i, j - 1))]
                best[i, j] = min(steps)
        return -best[len(a), len(b)][1]

    rng = np.random.default_rng(8)
    for _ in range(500):
        a, b = (rng.integers(0, 5, rng.integers(0, 9)).astype(np.uint32) for _ in range(2))
        assert chain_dedup.edit_matches(a, b) == plain(a.tolist(), b.tolist())
