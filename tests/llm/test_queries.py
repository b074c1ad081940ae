"""Queries of the llm subpackage on the smallest tables: against their SQL where there is one, else against brute force."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from parlance.llm import license_scan
from parlance.llm.queries import ORACLE, QUERIES
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, sf, name):
    state, rows, _, _, note = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert state == "ok" and rows, note


def test_op1(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, sf).collect()}
    assert sorted(got) == [d for d, *_ in docs]
    known = {license_scan.normal_text(s): i for s, i in license_scan.SENTENCES.items() if len(license_scan.parts_of(s)) == 1}
    for doc_id, text, _ in docs:
        ids = [known[n] for n in map(license_scan.normal_text, re.split(r"(?<=[.!?;:])\s+|[\r\n]+", text)) if n in known]
        assert got[doc_id]["licenses"] == ",".join(license_scan.apply_rules(ids, license_scan.RULES)[0])
    assert any(r["licenses"] for r in got.values())


def test_op2(spark, sf, docs):
    seen, expected = set(), {}
    for doc_id, text, _ in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            part = data[at : at + 100]
            if part in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        expected[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()}
    assert got == expected


def test_op4_on_held_out_documents(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, sf).collect()}
    held = [(d, lang) for d, _, lang in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == {d for d, _ in held}
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op5(spark, sf, docs):
    prints = []
    for _, text, _ in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    ids = [d for d, *_ in docs]
    expected = {ids[i]: (f"{prints[i]:016x}", ids[c]) for i, c in enumerate(components(len(ids), pairs))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == expected


def test_op6_articles(spark, sf, con):
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_html_extract"](spark, sf).collect()}
    rows = con.execute("SELECT page_id, html FROM pages").fetchall()
    right = 0
    for page_id, source in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        right += got[page_id] == "\n\n".join(b for b in blocks if b)
    assert right >= 0.98 * len(rows)


def test_op8(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    vectors = [list(map(float, (c + rng.standard_normal(64) * s))) for c in centres for s in (0.0, 0.05, 0.1, 0.15, 0.2, 0.25)] + [None, [0.0] * 64, [float("nan")] * 64]
    vectors += vectors[:3]
    rows = [(i, v) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in QUERIES["op8_embedding_dedup"](spark, str(tmp_path)).collect()}
    usable = [i for i, v in rows if v is not None and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[i] for i in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    true, found = close.sum(1), np.array([got[i]["n_links"] for i in usable])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() > 0
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(rows)) if i not in usable)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op9_finds_every_exact_passage_of_over_50_words(spark, sf, docs):
    seen, need = set(), {}
    for doc_id, text, _ in docs:
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 51]) for i in range(len(words) - 50)]
        need[doc_id] = {w for i, g in enumerate(grams) if g in seen for w in range(i, i + 51)}
        seen.update(grams)
    found = {d: set() for d in need}
    for r in QUERIES["op9_chain_dedup"](spark, sf).collect():
        assert r["other_id"] < r["doc_id"] and r["matches"] >= 0.8 * (r["stop_word"] - r["start_word"])
        found[r["doc_id"]] |= set(range(r["start_word"], r["stop_word"]))
    assert any(need.values()) and all(need[d] <= found[d] for d in need)
