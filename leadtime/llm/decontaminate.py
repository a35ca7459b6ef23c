"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit check.

Texts and benchmark items are sequences of words (runs of letters and digits, lower case; an
ideograph is a word).  The Chakraborty-Goldenberg-Koucky walk embeds a sequence: at step j it copies
the symbol under the pointer and moves the pointer on if random bit r_j(symbol) is set.  Walks over
sequences at small edit distance meet again after an edit, so few copied symbols differ.

* Windows of a document start at every ``stride``-th word and reach as far as the longest walk; an
  item is embedded from each start in its first half, so some window meets some start exactly.
* Bit sampling: each repetition hashes a few sampled steps of one of several walks.
* Anchors make the search complete, whatever the length of an item and the others of its block: an item that
  may differ by k edits is cut into k + 1 pieces, one of which every match holds unchanged.  The first
  ``ANCHOR`` words of each piece are looked up at every word of a document.
* Candidates (document place, item) are checked exactly: the least edit distance of the whole item
  to any stretch of the document's words near that place.  A leak has 1 - edits / words >= 0.8.

The benchmark is read in blocks of ``BLOCK_ITEMS``; each block's index is broadcast (bounded by block and
item length) and documents pass once a block.  No row is shuffled.

Defined results: null or empty texts hold no leak; items under ``MIN_WORDS`` words say too little to
be found and are skipped; repeated rows and repeated items are each reported; per (row, item) the
closest stretch counts, the first among equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

SIMILARITY = 0.8
MIN_WORDS = 5
BLOCK_ITEMS = 2000
BLOCK_WORDS = 200_000
STRIDE = 4
WALKS = 3
STEPS = 24
SAMPLED = 7          # steps per repetition
ANCHOR = 4           # words of a piece that are looked up
SPANS = ((14, 3), (24, 2))  # (steps a repetition samples from, repetitions), for each walk
SEED = 20
SLICE_CHARS = 1_500_000  # small enough for the processor's caches
_FILTER_BITS = 22
_tables: dict[str, np.ndarray] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and 0 outside words, 1 in a word, 2 a word by itself."""
    if "lower" not in _tables:
        n = 0x32000
        lower = np.arange(n, dtype=np.uint32)
        kind = np.zeros(n, np.uint8)
        for c in range(0x20000):
            s = chr(c)
            if s.isalnum():
                kind[c] = 1
                if len(low := s.lower()) == 1:
                    lower[c] = ord(low)
        for a, b in ((0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, n)):
            kind[a:b] = 2
        _tables["kind"], _tables["lower"] = kind, lower
    return _tables["lower"], _tables["kind"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts in order: hash, text number, start and end in code points of its text."""
    lower, kinds = _code_tables()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "replace"), "<u4") for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    if not sizes.sum():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    c = np.concatenate(codes)
    c = np.where(c < len(kinds), c, 0)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    kind = kinds[c]
    inside = kind > 0
    at = np.flatnonzero(inside)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (kind[at[1:]] == 2) | (kind[at[:-1]] == 2)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    first = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    powers = _powers()
    value = _mix(lower[c[at]].astype(np.uint64) + np.uint64(1)) * powers[place % len(powers)]
    h = _mix(np.add.reduceat(value, first))
    o = owner[at[first]]
    last = np.append(first[1:], len(at)) - 1
    return h, o, at[first] - begin[o], at[last] + 1 - begin[o]


def _powers() -> np.ndarray:
    if "powers" not in _tables:
        p, out = 1, []
        for _ in range(256):
            out.append(p)
            p = p * 0x5851F42D4C957F2D % (1 << 64)
        _tables["powers"] = np.array(out, np.uint64)
    return _tables["powers"]


class Plan:
    """The random choices: a multiplier for each walk and step, and the sampled steps of each repetition."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(1 << 62, 1 << 63, (WALKS, STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = []  # (walk, set of steps)
        for w in range(WALKS):
            for span, times in SPANS:
                for _ in range(times):
                    self.samples.append((w, frozenset(rng.choice(span, SAMPLED, replace=False).tolist())))
        self.salts = rng.integers(1, 1 << 63, len(self.samples), dtype=np.uint64)

    def keys(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Per repetition: a key for each start, and, given ``ends``, whether all its samples lie before them."""
        for w in range(WALKS):
            at = starts.copy()
            reps = [(r, s) for r, (v, s) in enumerate(self.samples) if v == w]
            keys = {r: np.full(len(starts), self.salts[r], np.uint64) for r, _ in reps}
            valid = {r: np.ones(len(starts), bool) for r, _ in reps} if ends is not None else {}
            for j in range(1 + max(max(s) for _, s in reps)):
                x = symbols[at]
                for r, s in reps:
                    if j in s:
                        k = keys[r]
                        k ^= x
                        k *= np.uint64(0xD6E8FEB86659FD93)
                        k ^= k >> np.uint64(32)
                        if ends is not None:
                            valid[r] &= at < ends
                at += ((x * self.moves[w, j]) >> np.uint64(63)).astype(at.dtype)
            for r, _ in reps:
                yield keys[r], valid.get(r)


PAD = np.zeros(STEPS + 1, np.uint64)


def most_edits(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * sizes + 1e-9).astype(np.int64)


def runs(symbols: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Per length, ascending: a key for the run of so many symbols from each place on.  Good until the next."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(ANCHOR, np.uint64)])
    k = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    for j in range(max(lengths, default=0)):
        k ^= padded[j:j + n]
        k *= np.uint64(0xD6E8FEB86659FD93)
        k ^= k >> np.uint64(32)
        if j + 1 in lengths:
            yield j + 1, k


class Index:
    """Keys of a block of items: walks from each start in an item's first half, and the anchors of its pieces
    for matches of ``similarity``."""

    def __init__(self, items: list[np.ndarray], plan: Plan, stride: int, similarity: float = SIMILARITY):
        self.items, self.plan, self.stride, self.similarity = items, plan, stride, similarity
        sizes = np.array([len(x) for x in items], np.int64)
        begin = np.cumsum(sizes) - sizes
        symbols = np.concatenate([*items, PAD])
        shifts = [max(min(n, stride), n // 2) for n in sizes]
        item = np.repeat(np.arange(len(items)), shifts)
        shift = np.concatenate([np.arange(s) for s in shifts])
        keys, payload = [], []
        for k, ok in plan.keys(symbols, begin[item] + shift, (begin + sizes)[item]):
            keys.append(k[ok])
            payload.append((item << 32 | shift)[ok])
        pieces = np.minimum(most_edits(sizes, similarity) + 1, sizes)
        item = np.repeat(np.arange(len(items)), pieces)
        j = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        shift = j * sizes[item] // pieces[item]
        length = np.minimum((j + 1) * sizes[item] // pieces[item] - shift, ANCHOR)
        self.lengths = np.unique(length).tolist()
        for m, k in runs(symbols, self.lengths):
            own = length == m
            keys.append(k[(begin[item] + shift)[own]])
            payload.append((item << 32 | shift)[own])
        keys, payload = np.concatenate(keys), np.concatenate(payload)
        order = np.argsort(keys, kind="stable")
        self.keys, self.payload = keys[order], payload[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.sizes = sizes
        # Which words an item has, as a filter that may say yes too often.
        self.salt = _mix(np.arange(1, len(items) + 1, dtype=np.uint64))
        self.has = np.zeros(1 << _FILTER_BITS, bool)
        self.has[self._slot(np.concatenate(items), np.repeat(np.arange(len(items)), sizes))] = True

    def _slot(self, symbols: np.ndarray, item: np.ndarray) -> np.ndarray:
        return ((symbols ^ self.salt[item]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def plausible(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether ``symbols[lo:hi]`` has ``least`` places with words of the item, as every match must."""
        out = np.zeros(len(lo), bool)
        for a in range(0, len(lo), 20_000):
            l, n, k = lo[a:a + 20_000], (hi - lo)[a:a + 20_000], item[a:a + 20_000]
            begin = np.cumsum(n) - n
            at = np.repeat(l - begin, n) + np.arange(int(n.sum()))
            inside = np.cumsum(np.append(0, self.has[self._slot(symbols[at], np.repeat(k, n))]))
            out[a:a + 20_000] = inside[begin + n] - inside[begin] >= least[a:a + 20_000]
        return out

    def candidates(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (word the item would begin at, item, text), once each."""
        n = len(symbols)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.zeros(0, np.int64)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        starts = np.flatnonzero(place % self.stride == 0)
        padded = np.concatenate([symbols, PAD])
        found = []

        def look_up(k: np.ndarray, starts: np.ndarray | None, length: int = 1) -> None:
            hit = np.flatnonzero(self.filter[k >> np.uint64(64 - _FILTER_BITS)])
            key = k[hit]
            low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            many = high - low
            hit, low, many = hit[many > 0], low[many > 0], many[many > 0]
            start = hit if starts is None else starts[hit]
            inside = owner[np.minimum(start + length, n) - 1] == owner[start]
            start, low, many = start[inside], low[inside], many[inside]
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            p = self.payload[at]
            start = np.repeat(start, many)
            found.append(np.stack([start - (p & 0xFFFFFFFF), p >> 32, owner[start]], 1))

        for k, _ in self.plan.keys(padded, starts):
            look_up(k, starts)
        for length, k in runs(symbols, self.lengths):
            look_up(k, None, length)
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def closest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``region``: (edits, start, end); of equals the first end,
    then the last start."""
    m = len(region)
    step = np.arange(m + 1)
    cost = np.zeros(m + 1, np.int64)
    start = step.copy()
    for k, w in enumerate(item, 1):
        # Diagonal, else from above; then along the row.  Start columns travel in the low bits, so that
        # among equal costs the later start (the shorter stretch) wins.
        code = cost * (m + 1) + (m - start)
        diagonal = np.concatenate([[np.iinfo(np.int64).max // 2], code[:-1] + (region != w) * (m + 1)])
        new = np.minimum(diagonal, code + (m + 1))
        new[0] = k * (m + 1) + m
        new = np.minimum.accumulate(new - step * (m + 1)) + step * (m + 1)
        cost, start = new // (m + 1), m - new % (m + 1)
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def leaks_in(texts: list[str | None], index: Index, similarity: float = SIMILARITY) -> list[list[tuple[int, int, float, int, int]]]:
    """Per text the leaks (item, edits, similarity, start, end); code points, end exclusive.  All are found if
    ``similarity`` is not below that of the index."""
    h, owner, begin, end = words(texts)
    out: list[list] = [[] for _ in texts]
    best: dict[tuple[int, int], tuple] = {}
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = index.candidates(h, owner)
    if not len(found):
        return out
    at, item, d = found[:, 0], found[:, 1], found[:, 2]
    n = index.sizes[item]
    most = most_edits(n, similarity)
    lo = np.maximum(bounds[d], at - 2 * most - 1)
    hi = np.minimum(bounds[d + 1], at + n + 2 * most + 1)
    # Where a match of this candidate can lie.
    least, last = np.maximum(bounds[d], at - most), np.minimum(bounds[d + 1], at + n + most)
    ok = np.flatnonzero(hi - lo >= n - most)
    ok = ok[index.plausible(h, lo[ok], hi[ok], item[ok], (n - most)[ok])]
    for d, k, lo, hi, least, last, most in zip(*(x[ok].tolist() for x in (d, item, lo, hi, least, last, most)), strict=True):
        # A region that an earlier candidate of the same item covered need not be looked at again.
        done = seen.setdefault((d, k), [])
        if any(x <= least and last <= y for x, y in done):
            continue
        done.append((lo, hi))
        edits, s, e = closest(index.items[k], h[lo:hi])
        if edits <= most and e > s:
            row = (edits, int(begin[lo + s]), int(end[lo + e - 1]))
            if (d, k) not in best or row < best[d, k]:
                best[d, k] = row
    for (d, k), (edits, s, e) in sorted(best.items()):
        out[d].append((k, edits, 1 - edits / len(index.items[k]), s, e))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Bounded blocks of (item ids, word hashes)."""
    ids, items, total = [], [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        h = words([row["t"]])[0]
        if len(h) < MIN_WORDS:
            continue
        ids.append(row["i"])
        items.append(h)
        total += len(h)
        if len(ids) >= BLOCK_ITEMS or total >= BLOCK_WORDS:
            yield ids, items
            ids, items, total = [], [], 0
    if ids:
        yield ids, items


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id",
               item_text: str = "text", similarity: float = SIMILARITY, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the benchmark items each text holds (item_id, edits, similarity, start, end)."""
    kind = benchmark.schema[item_id].dataType
    leak = T.StructType([T.StructField("item_id", kind), T.StructField("edits", T.LongType()),
                         T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    kept = [c for c in (keep if keep is not None else docs.columns) if c != out]
    df = docs
    parts = []
    for b, (ids, items) in enumerate(_blocks(benchmark, item_id, item_text)):
        stride = max(1, min(STRIDE, min(map(len, items)) // 4))
        shipped = docs.sparkSession.sparkContext.broadcast((ids, Index(items, Plan(), stride, similarity)))

        def make(shipped=shipped):
            ids, index = shipped.value
            return lambda texts: [[[{"item_id": ids[k], "edits": e, "similarity": s, "start": x, "end": y}
                                    for k, e, s, x, y in row] for row in leaks_in(texts, index, similarity)]]
        parts.append(f"{out}: block {b}")
        df = append_columns(df, [text], [(parts[-1], T.ArrayType(leak))], make, most=SLICE_CHARS)
    none = F.array().cast(T.ArrayType(leak))
    all_parts = F.concat(*[F.col(f"`{p}`") for p in parts]) if parts else none
    return df.select(*[F.col(f"`{c}`") for c in kept], all_parts.alias(out))


def leak_rows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, edits, similarity, start, end."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_leaks(src, benchmark, keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    found = find_leaks(docs, benchmark, text, "benchmark leaks of the text")
    return found.where(F.size("benchmark leaks of the text") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
