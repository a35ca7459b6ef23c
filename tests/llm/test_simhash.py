import random

import numpy as np
import pytest
import xxhash
from brute import components

from leadtime.llm import simhash


def slow_fingerprint(t):
    import re
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_follows_its_definition():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choices(["Ab", "é", " ", "\t", "\x0b", " ", "x", "\n", "İ", "ß", "\x1c"], k=rng.randrange(30)))
        assert simhash.fingerprint(t) == slow_fingerprint(t), repr(t)
    assert simhash.fingerprint(None) == simhash.fingerprint("  ") == 0
    assert simhash.fingerprint("Two words") == slow_fingerprint("two words")


def test_walk_finds_exactly_the_close_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    v = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (8, 2))]))
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2 and v[i] >> np.uint64(42) == v[j] >> np.uint64(42)}
    got = {(int(i), int(j)) for a, b in simhash._walk(v, v, True, 22, 2) for i, j in zip(a, b)}
    assert got == want
    half = len(v) // 2
    got = {(int(i), int(j) + half) for a, b in simhash._walk(v[:half], v[half:], False, 22, 2) for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in want if i < half <= j}


@pytest.mark.parametrize("cell", [20_000, 40])
def test_groups_of_a_dense_cloud(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    v = [int(centre[k % 3]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, k % 5).tolist())) for k in range(400)]
    v += v[:50]
    rows = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(v)], "doc_id long, fingerprint long")
    root = components(set(v), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for k, x in enumerate(v):
        low.setdefault(root[x], k)
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(rows).collect()}
    assert got == {k: low[root[x]] for k, x in enumerate(v)}


def test_query_equals_brute_force(spark, sf):
    from leadtime.llm.catalog import QUERIES
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op6_simhash_dedup"](spark, sf).collect()
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    root = components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for i in sorted(prints):
        low.setdefault(root[prints[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", low[root[p]]) for i, p in prints.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.simhash_groups(odd_docs.withColumnRenamed("lang", "component_id")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == 10 and len(by_id[5]) == 2
    assert {by_id[k][0].component_id for k in (1, 2, 3)} == {1} and by_id[1][0].fingerprint == "0" * 16
    assert by_id[8][0].component_id == 5
    assert simhash.simhash_groups(no_docs).count() == 0


def test_one_of_each_group(spark, odd_docs):
    got = simhash.one_of_each_group(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "5", "6", "7", "None"]
