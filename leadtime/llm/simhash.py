"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64 bits, a bit set if over half of a text's word-shingle hashes have it set.  Two
fingerprints link if they differ in few bits.

Join: equal fingerprints are one entry.  With ``d`` bits of budget, two linked entries agree in at
least one of ``d + 1`` blocks of bits, so each entry enters ``d + 1`` tries, one with each block turned
to the front, and rows with one front block meet in one task (a hash partition).  There the task
walks pairs of trie nodes from the root of each front block downwards, bit by bit: a node is a range
of the sorted fingerprints, the differing bits of a pair add up on the way, and a pair over the
budget is dropped with everything below it.  A task returns only a spanning forest of the links it
meets, so no component's pairs are listed; components then join over all tasks.

A front block with more than ``CELL`` entries (a group of near copies) is dealt in chunks; every pair
of chunks is a cell of its own, so no task holds the whole block and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import append_columns, components

SHINGLE_WORDS = 3
MAX_BITS = 2
CELL = 20_000        # entries of one front block in one cell
FRONTIER = 1 << 18   # node pairs walked at once


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Words split at ASCII white space, A-Z lowered; XXH64 (seed 42) of each shingle of ``words`` words,
    repeats included; fewer words: one shingle of all.  No word, or null: 0."""
    tokens = (text or "").encode("utf-8").lower().split()  # of bytes both are ASCII only
    if not tokens:
        return 0
    parts = [tokens[i:] for i in range(words)] if len(tokens) > words else [[x] for x in tokens]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(b" ".join(p), 42) for p in zip(*parts, strict=False)], ">u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = SHINGLE_WORDS,
                     keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a 64-bit fingerprint (long, the same bits).  No shuffle."""
    def make():
        def work(texts):
            return [[f - (1 << 64) if (f := fingerprint(t, words)) >> 63 else f for t in texts]]
        return work
    return append_columns(docs, [text], [(out, T.LongType())], make, keep)


def _walk(a: np.ndarray, b: np.ndarray, same: bool, prefix: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted ``a`` and ``b``) that agree in the first ``prefix`` bits and differ in at most
    ``budget`` bits of all; if ``same``, each pair of different entries once."""
    if not len(a) or not len(b):
        return
    shift = np.uint64(64 - prefix)
    front_a, front_b = a >> shift, b >> shift
    lo_a = np.flatnonzero(np.concatenate([[True], front_a[1:] != front_a[:-1]]))
    hi_a = np.append(lo_a[1:], len(a))
    lo_b = np.searchsorted(front_b, front_a[lo_a], "left")
    hi_b = np.searchsorted(front_b, front_a[lo_a], "right")
    some = (hi_b > lo_b) & ((hi_a - lo_a > 1) if same else True)
    stack = [(prefix, lo_a[some], hi_a[some], lo_b[some], hi_b[some], np.zeros(int(some.sum()), np.int8))]
    while stack:
        depth, la, ha, lb, hb, d = stack.pop()
        if len(la) > FRONTIER:  # deeper first, in parts, so that few pairs of nodes wait at a time
            cut = len(la) // 2
            stack.append((depth, la[cut:], ha[cut:], lb[cut:], hb[cut:], d[cut:]))
            stack.append((depth, la[:cut], ha[:cut], lb[:cut], hb[:cut], d[:cut]))
            continue
        # Pairs of small nodes are compared entry by entry: cheaper than a walk to the leaves.
        small = (ha - la) * (hb - lb) <= 8
        if small.any():
            na, nb = (ha - la)[small], (hb - lb)[small]
            n = na * nb
            begin = np.cumsum(n) - n
            k = np.arange(int(n.sum())) - np.repeat(begin, n)
            width = np.repeat(nb, n)
            i = np.repeat(la[small], n) + k // width
            j = np.repeat(lb[small], n) + k % width
            ok = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            la, ha, lb, hb, d = (x[~small] for x in (la, ha, lb, hb, d))
        if not len(la) or depth == 64:
            continue
        bit = np.uint64(63 - depth)
        ma, mb = _middle(a, la, ha, bit), _middle(b, lb, hb, bit)
        own = (la == lb) & (ha == hb) if same else np.zeros(len(la), bool)
        cases = ((la, ma, lb, mb, d, None), (ma, ha, mb, hb, d, None), (la, ma, mb, hb, d + 1, None), (ma, ha, lb, mb, d + 1, ~own))
        parts = []
        for x0, x1, y0, y1, e, also in cases:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if also is not None:  # the two mixed pairs of a node with itself are one
                ok &= also
            if same:
                ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 < 2))
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*parts, strict=True))))


def _middle(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the entries with ``bit`` set begin in each range (entries of a range agree above it)."""
    one = np.uint64(1)
    target = ((v[lo] >> bit) | one) << bit
    return np.clip(np.searchsorted(v, target, "left"), lo, hi)


class _Forest:
    """Disjoint sets over positions of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        # Whole rounds of hooking larger roots below smaller ones; every round settles some links.
        while len(i):
            i, j = self._roots(i), self._roots(j)
            apart = i != j
            i, j = i[apart], j[apart]
            if len(i):
                high, low = np.maximum(i, j), np.minimum(i, j)
                np.minimum.at(self.up, high, low)
                i, j = high, low

    def _roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            p = self.up[i]
            pp = self.up[p]
            if (p == pp).all():
                return p
            self.up[i] = pp
            i = pp

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(len(self.up))
        r = self._roots(i)
        below = r != i
        return i[below], r[below]


def _links(batches: Iterator[pa.RecordBatch], blocks: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by (trie, front block, cell): spanning links within each cell.

    ``x`` is the fingerprint, ``trie`` the rotation, ``i`` and ``j`` the two chunks of the cell and ``c`` the
    row's own chunk.  Whole cells are gathered to about ``CELL`` rows, so memory holds few of them.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(x, trie, i, j, c) -> Iterator[pa.RecordBatch]:
        for t in np.unique(trie):
            for ci, cj in {(p, q) for p, q in zip(i[trie == t].tolist(), j[trie == t].tolist(), strict=True)}:
                at = (trie == t) & (i == ci) & (j == cj)
                turned = _rotate(x[at].view(np.uint64), sum(blocks[:t]))
                if ci == cj:
                    one = other = np.unique(turned)
                else:
                    one, other = np.unique(turned[c[at] == ci]), np.unique(turned[c[at] == cj])
                both = one if ci == cj else np.concatenate([one, other])
                forest = _Forest(len(both))
                for p, q in _walk(one, other, ci == cj, blocks[t], budget):
                    forest.link(p, q if ci == cj else q + len(one))
                p, q = forest.edges()
                if len(p):
                    back = _rotate(both, 64 - sum(blocks[:t])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(back[p]), pa.array(back[q])], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(k).to_numpy() for k in range(6)))
        if sum(len(h[0]) for h in held) < CELL:
            continue
        x, trie, front, i, j, c = (np.concatenate(z) for z in zip(*held, strict=True))
        border = np.flatnonzero((trie[1:] != trie[:-1]) | (front[1:] != front[:-1])
                                | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        held = [(x, trie, front, i, j, c)]
        if len(border):  # the last cell may go on in the next batch
            at = int(border[-1]) + 1
            yield from solve(x[:at], trie[:at], i[:at], j[:at], c[:at])
            held = [tuple(z[at:] for z in held[0])]
    if held:
        x, trie, front, i, j, c = (np.concatenate(z) for z in zip(*held, strict=True))
        yield from solve(x, trie, i, j, c)


def _rotate(v: np.ndarray, k: int) -> np.ndarray:
    k %= 64
    return v if not k else (v << np.uint64(k)) | (v >> np.uint64(64 - k))


def trie_links(entries: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``entries.x`` that differ in at most ``bits`` bits.

    Two entries are connected by the result if and only if a chain of links joins them.
    """
    k = bits + 1
    blocks = [64 // k + (t < 64 % k) for t in range(k)]
    front = [F.shiftrightunsigned("x", 64 - sum(blocks[:t + 1])).bitwiseAND(F.lit((1 << blocks[t]) - 1))
             for t in range(k)]
    dealt = entries.select("x", F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), f.alias("front"))
                                                    for t, f in enumerate(front)])).alias("e")).select("x", "e.*")
    large = (dealt.groupBy("trie", "front").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
             .withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int")).drop("n"))
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = (dealt.join(large, ["trie", "front"], "left").withColumn("c", chunk)
             .withColumn("o", F.explode(others))
             .select("x", "trie", "front", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c"))
    placed = cells.repartition("trie", "front", "i", "j").sortWithinPartitions("trie", "front", "i", "j")

    def run(batches):
        return _links(batches, blocks, bits)
    return placed.mapInArrow(run, "a long, b long")


def simhash_components(rows: DataFrame, fingerprint: str = "fingerprint", doc_id: str = "doc_id",
                       bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (already computed; read several times) with ``component_id``, the smallest id reachable by links.

    Null ids never give a component its name: a component of null ids only has a null one.
    """
    entries = cut_lineage(rows.groupBy(F.col(fingerprint).alias("x")).agg(F.min(doc_id).alias("low")), "entries")
    found = components(trie_links(entries.select("x"), bits))
    lowest = (found.join(entries, found["node"] == entries["x"]).groupBy("root").agg(F.min("low").alias("component_id")))
    named = found.join(lowest, "root").select(F.col("node").alias("x"), "component_id")
    # Written, so that the last join reads two plain tables and a frequent fingerprint can be split.
    of = cut_lineage(entries.join(named, "x", "left").select("x", F.coalesce("component_id", "low").alias("component_id")),
                     "groups")
    return rows.join(of, rows[fingerprint] == of["x"], "left").drop("x")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                   bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.  An empty table gives no rows."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(with_fingerprint(src, "text", "fingerprint", words, ["doc_id"]), "fingerprints")
    return simhash_components(prints, bits=bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                      bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, one of them if it repeats.

    Rows with a null doc_id cannot be named, so they take no part and all stay.
    """
    groups = simhash_groups(docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, bits)
    keep = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept id")).agg(F.count("*").alias("kept rows"))
    found = docs.join(keep, F.col(doc_id) == F.col("`kept id`"), "left")
    once = found.where(F.col("`kept rows`") == 1)
    repeated = found.where(F.col("`kept rows`") > 1).dropDuplicates([doc_id])
    unnamed = docs.where(F.col(doc_id).isNull())
    return once.select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(unnamed)
