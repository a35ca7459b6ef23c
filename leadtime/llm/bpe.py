"""Byte-level BPE by corpus-level merge replay.

A task splits its texts into words, numbers the distinct ones and lays the new ones out as one
token array with links between neighbours.  An inverted index from merge rank (the token that an
adjacent pair makes) to positions holds every mergeable pair.  Ranks are taken in order from a heap;
one rank merges all its positions at once and renews the index only for the two neighbours of each
merge.  Words keep their ids for later texts, up to a bound on memory that never changes results.

Any two neighbours whose bytes together are a vocabulary entry may merge, the lowest rank first and
the leftmost first among equals.  Null texts count as empty; the empty text has no ids.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

# Distinct words kept between slices of one worker; beyond it the table starts anew.
WORDS_KEPT = 250_000
SLICE_BYTES = 4_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeReplay:
    """Encoder for one vocabulary and word pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.concatenate([np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]])
        self.pair_made = np.concatenate([np.array(made, np.int64)[order], [-1]])
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, r in ranks.items():
            lengths[r] = len(token)
        self.token_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.token_len = lengths
        self.known = lengths > 0
        flat = bytearray(int(lengths.sum()))
        for token, r in ranks.items():
            flat[self.token_at[r]:self.token_at[r] + len(token)] = token
        self.token_bytes = np.frombuffer(bytes(flat), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of tokens makes, or -1."""
        key = left << 32 | right
        i = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[i] == key, self.pair_made[i], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` in order, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        ends = np.cumsum(sizes)
        tok = self.bytes_ids[data]
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        last, first = ends[sizes > 0] - 1, (ends - sizes)[sizes > 0]
        nxt[last] = -1
        prv[first] = -1
        alive = np.ones(n, bool)
        makes = np.full(n, -1, np.int64)  # the rank that a position makes with its right neighbour
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            right = nxt[at]
            rank = np.where(right >= 0, self._made(tok[at], tok[right]), -1)
            makes[at] = rank
            some = rank >= 0
            at, rank = at[some], rank[some]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for a, b, r in zip(bounds[:-1], bounds[1:], rank[bounds[:-1]].tolist(), strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[makes[at] == r]
            if not len(at):
                continue
            at = np.sort(at)
            right = nxt[at]
            if len(at) > 1:
                touching = np.concatenate([[False], right[:-1] == at[1:]])
                if touching.any():  # of a chain of overlapping pairs the 1st, 3rd, ... merge
                    begin = np.flatnonzero(~touching)
                    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                    late, at = at[place % 2 == 1], at[place % 2 == 0]
                    right = nxt[at]
                else:
                    late = at[:0]
            else:
                late = at
            after = nxt[right]
            tok[at] = r
            nxt[at] = after
            alive[right] = False
            makes[right] = -1
            inner = after >= 0
            prv[after[inner]] = at[inner]
            left = prv[at]
            touched = np.concatenate([at, left[left >= 0]])
            if len(late):
                touched = np.concatenate([touched, late])
            if len(touched) > 1:
                touched = np.unique(touched)
            enter(touched[alive[touched]])
        starts = np.concatenate([[0], np.cumsum(alive)])
        return tok[alive].astype(np.uint32), starts[ends] - starts[ends - sizes]

    def _learn(self, words: list[str]) -> None:
        ids, lens = self.replay([w.encode("utf-8") for w in words])
        self.at = np.concatenate([self.at, len(self.ids) + np.concatenate([[0], np.cumsum(lens)])[:-1].astype(np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        self.len = np.concatenate([self.len, lens])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (uint32)."""
        if len(self.number) > WORDS_KEPT:
            self._forget()
        number = _Numbers(self.number)
        known = len(self.number)
        words = [np.fromiter(map(number.__getitem__, self.split(t)), np.int64) if t else None for t in texts]
        self.number = number
        if len(number) > known:
            fresh = list(number)[known:]
            self._learn(fresh)
        return [np.zeros(0, np.uint32) if w is None else gather(self.ids, self.at[w], self.len[w]) for w in words]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (int(ids.max()) < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


class _Numbers(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces ``flat[at : at + len]`` one after another."""
    total = int(lens.sum())
    begin = np.cumsum(lens) - lens
    return flat[np.repeat(at - begin, lens) + np.arange(total)]


_coders: dict[tuple[int, str], MergeReplay] = {}


def coder(data: bytes, pattern: str) -> MergeReplay:
    """One encoder per worker process, vocabulary and pattern."""
    key = (hash(data), pattern)
    if key not in _coders:
        _coders[key] = MergeReplay(read_ranks(data), pattern)
    return _coders[key]


def _shipped(df: DataFrame, path: str):
    """The rank file's bytes (about 1 MB, a fixed size) as a broadcast variable."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each text as packed little-endian unsigned 32-bit numbers.

    No special tokens.  Null text: empty ids.  No shuffle.
    """
    ranks = _shipped(docs, path)

    def make():
        c = coder(ranks.value, pattern)
        return lambda texts: [[x.astype("<u4").tobytes() for x in c.encode(texts)]]
    return append_columns(docs, [text], [(ids, T.BinaryType())], make, keep, SLICE_BYTES)


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded",
               keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``out``: the bytes that packed ``ids`` stand for; null ids give null."""
    ranks = _shipped(rows, path)

    def make():
        c = coder(ranks.value, pattern)
        return lambda packed: [[None if p is None else c.decode(np.frombuffer(p, "<u4")) for p in packed]]
    return append_columns(rows, [ids], [(out, T.BinaryType())], make, keep, SLICE_BYTES)


def bpe_digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the packed ids and of the decoded bytes."""
    encoded = bpe_encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, pattern,
                         keep=["doc_id"])
    decoded = bpe_decode(encoded, path, pattern)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def checked_ids(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and ids as an array; a text whose ids do not decode to it fails the task."""
    ranks = _shipped(docs, path)

    def make():
        c = coder(ranks.value, pattern)

        def work(texts):
            ids = c.encode(texts)
            for t, x in zip(texts, ids, strict=True):
                if c.decode(x) != (t or "").encode("utf-8"):
                    raise ValueError("ids do not decode to their text")
            return [ids]
        return work
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = append_columns(src, ["text"], [("ids", T.ArrayType(T.IntegerType()))], make, ["doc_id"], SLICE_BYTES)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
