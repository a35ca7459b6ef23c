"""Extremely randomised trees as a Spark ML estimator.

Every split draws one threshold a feature, uniform between the least and the greatest value of the node's rows,
and takes the feature whose threshold separates the labels best (least squares); every row takes part in
every tree.  Draws are hashes of (seed, tree, node, feature) and labels are summed in whole steps of
``LABEL_STEP``, so sums are exact in any order: a seed gives the same trees on any partitioning.

One pass over the rows finds the features of at most ``MAX_CODES`` values, and those of them that another one
determines in every row (the month tells the quarter and the sine of the month).  The rows are then written once: a code for
each feature that no other one determines, the values of the remaining features, the label.  A record holds a few dozen
rows, ``BLOCK_BYTES`` at most: Spark handles far fewer records than rows, and Parquet and Arrow batches, which count
records and not bytes, stay small.

Upper nodes grow level by level: one aggregate gives the ranges of all open nodes (of coded features which codes
occur), a second one the row counts and label sums left of the drawn thresholds (of coded features from a count a code),
which are also those of the children; a child that may not be split is a leaf at once.  Tasks send a few rows a node,
whatever their rows, and at most ``CELLS`` codes and values of open nodes are counted at a time.  A node of
``LOCAL_ROWS`` rows or less is grown to its leaves by one task, so rows are shuffled once a tree at most and no task
holds more than that many; in a large table it goes on level by level if at most ``LAST_LEVELS`` are left, as a
pass over a row costs less than its shuffle.  The trees are held by the driver and sent to the tasks, as Spark's own forests are: ``maxDepth`` and
``minInstancesPerNode`` bound them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import cut_lineage

LABEL_STEP = 1.0 / 1024      # labels are rounded to it
BLOCK_BYTES = 1 << 11        # of a record of coded rows
GROUP_BYTES = 1 << 24        # of a Parquet row group of them
CHUNK_ROWS = 1 << 14         # rows that a pass works on at a time
MAX_CODES = 1024             # values of a coded feature
MAX_PAIRED = 64              # coded features among which dependent ones are looked for
LOCAL_ROWS = 5_000
LAST_LEVELS = 4
FEW_ROWS = 2_000_000         # rows times trees that are always finished by node
CELLS = 1_000_000            # codes and values of open nodes counted at a time
TREES_AT_ONCE = 20
DEEPEST = 60                 # splits from the root to a leaf: a node's number, a bit a split, fits 64 bits
NODE_SCHEMA = "tree int, node long, feature int, threshold double, value double, n long, gain double"


def uniform(seed: int, tree, node, feature, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the arguments (integers or arrays of them)."""
    with np.errstate(over="ignore"):
        x = np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        for part in (tree, node, feature):
            x = (x ^ np.asarray(part, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass(frozen=True)
class Settings:
    seed: int
    n_features: int
    tried: int               # features tried a node
    max_depth: int
    min_leaf: int
    min_split: int = 2

    def may_split(self, n, depth):
        return (n >= max(2, self.min_split, 2 * self.min_leaf)) & (depth <= self.max_depth)


def thresholds(s: Settings, tree: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(nodes x features) drawn thresholds, NaN for features not tried: the constant ones, and all but ``tried`` of the
    others in an order drawn for the node."""
    f = np.arange(s.n_features)
    u = uniform(s.seed, tree[:, None], node[:, None], f, 1)
    t = lo + u * (hi - lo)
    t = np.where(t >= hi, lo, t)
    varies = hi > lo
    order = np.where(varies, uniform(s.seed, tree[:, None], node[:, None], f, 2), 2.0)
    nth = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
    return np.where(varies & (nth < s.tried), t, np.nan)


def best_split(s: Settings, t: np.ndarray, n: np.ndarray, total: np.ndarray, n_left: np.ndarray, left: np.ndarray):
    """Feature (-1: none is valid) and gain of each node; ties go to the first feature."""
    n_right, right = n[:, None] - n_left, total[:, None] - left
    valid = ~np.isnan(t) & (n_left >= s.min_leaf) & (n_right >= s.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, left * left / n_left + right * right / n_right, -np.inf)
    best = score.argmax(axis=1)
    top = score[np.arange(len(best)), best]
    ok = np.isfinite(top)
    gain = np.where(ok, (top - total * total / n) * LABEL_STEP**2, 0.0)
    return np.where(ok, best, -1), gain


def grow(s: Settings, tree: int, root: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The nodes below and at ``root`` (its number in the tree) over rows x and labels y in steps."""
    out, stack = [], [(root, np.arange(len(y)))]
    one = np.array([tree])
    while stack:
        node, at = stack.pop()
        xs, ys = x[at], y[at]
        n, total = len(at), ys.sum()
        feature, gain, t = -1, 0.0, None
        if s.may_split(n, node.bit_length()) and ys.min() < ys.max():
            t = thresholds(s, one, np.array([node]), xs.min(0)[None], xs.max(0)[None])
            lower = xs <= t
            best, gains = best_split(s, t, np.array([n]), np.array([total]), lower.sum(0)[None], (lower * ys[:, None]).sum(0)[None])
            feature, gain = int(best[0]), float(gains[0])
        cut = float(t[0, feature]) if feature >= 0 else 0.0
        out.append((tree, node, feature, cut, float(total) / n * LABEL_STEP, n, gain))
        if feature >= 0:
            low = lower[:, feature]
            stack += [(2 * node + 1, at[~low]), (2 * node, at[low])]
    return out


@dataclass
class Tree:
    """Arrays over the nodes of one tree, root first; ``feature`` -1 marks a leaf or an open node."""

    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Position of the leaf or open node of each row of ``x`` (rows x features, in either order of memory)."""
        n, width = x.shape
        by_column = x.T.flags.c_contiguous
        flat = (x.T if by_column else np.ascontiguousarray(x)).reshape(-1)
        row = np.arange(n) if by_column else np.arange(n) * width
        inner = self.feature >= 0
        own = np.arange(len(inner))
        feature = np.where(inner, self.feature, 0) * (n if by_column else 1)
        child = np.column_stack([np.where(inner, self.right, own), np.where(inner, self.left, own)]).reshape(-1)
        at = np.zeros(n, np.int64)
        depth = int(self.node[-1]).bit_length() - 1
        # A node that is not split is its own child, so all rows move together while most of them do.
        for _ in range(min(depth, 10)):
            at = child[2 * at + (flat[feature[at] + row] <= self.threshold[at])]
        moving = np.flatnonzero(inner[at]) if depth > 10 else own[:0]
        while len(moving):
            i = at[moving]
            i = child[2 * i + (flat[feature[i] + row[moving]] <= self.threshold[i])]
            at[moving] = i
            moving = moving[inner[i]]
        return at


def build_trees(nodes: pd.DataFrame) -> list[Tree]:
    """Trees of a table of nodes (``NODE_SCHEMA``), in the order of their numbers."""
    out = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
        ids = t["node"].to_numpy()
        feature = t["feature"].to_numpy()
        inner = feature >= 0
        left = np.where(inner, np.searchsorted(ids, np.where(inner, 2 * ids, 0)), 0)
        right = np.where(inner, np.searchsorted(ids, np.where(inner, 2 * ids + 1, 0)), 0)
        out.append(Tree(ids, feature, t["threshold"].to_numpy(), left, right, t["value"].to_numpy()))
    return out


@dataclass
class Layout:
    """How rows are written: a code column for each feature of ``bases``, a value column for each of ``raw``."""

    width: int
    bases: list[int]
    raw: list[int]
    base_of: np.ndarray           # of each feature the position in ``bases`` of the one that determines it; -1 for ``raw``
    values: dict[int, np.ndarray]  # of each other feature its value at each code of its base

    @property
    def sizes(self) -> list[int]:
        return [len(self.values[f]) for f in self.bases]

    @property
    def names(self) -> list[str]:
        """Columns of a coded row: codes (whole numbers of two bytes), values, the label."""
        return [*(f"c{j}" for j in range(len(self.bases))), *(f"r{j}" for j in range(len(self.raw))), "y"]

    @property
    def record(self) -> np.dtype:
        """The rows of a record, column by column."""
        rows = max(1, BLOCK_BYTES // (2 * len(self.bases) + 8 * len(self.raw) + 8))
        return np.dtype([("c", "<i2", (len(self.bases), rows)), ("r", "<f8", (len(self.raw), rows)), ("y", "<f8", (rows,))])

    def records(self, codes: np.ndarray, raws: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows as records, and the number of rows of each; the last one may have fewer, and zeros behind them."""
        rows = self.record["y"].shape[0]
        count = -(-len(y) // rows)
        out = np.zeros(count, self.record)
        for name, part in (("c", codes), ("r", raws), ("y", y[None])):
            padded = np.zeros((len(part), count * rows), part.dtype)
            padded[:, :len(y)] = part
            out[name] = padded.reshape(len(part), count, rows).transpose(1, 0, 2).reshape(out[name].shape)
        return out, np.minimum(rows, len(y) - rows * np.arange(count))

    def matrix(self, codes: list[np.ndarray], raws: list[np.ndarray]) -> np.ndarray:
        """The features (rows x features) of coded rows."""
        return np.column_stack([raws[self.raw.index(f)] if j < 0 else self.values[f][codes[j]] for f, j in enumerate(self.base_of)])


def _features(b: pa.RecordBatch) -> np.ndarray:
    """Rows x features of a batch (features array, label)."""
    return _matrix(b.column(0))


def _matrix(features: pa.Array) -> np.ndarray:
    """Rows x features; rows of different or no features are an error, as is a null or NaN."""
    sizes = np.unique(features.value_lengths().to_numpy(zero_copy_only=False))
    if features.null_count or len(sizes) != 1:
        raise ValueError("rows of different numbers of features")
    x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), int(sizes[0]))
    if np.isnan(x).any():
        raise ValueError("null or NaN in a feature")
    return x


class _Seen:
    """Values of the features in the rows of a task, in the order in which they came, and which feature determines which."""

    def __init__(self, width: int):
        self.width = width
        self.known = {f: np.empty(0) for f in range(width)}                  # sorted values
        self.number = {f: np.empty(0, np.int64) for f in range(width)}       # their codes
        self.maps: dict[tuple[int, int], np.ndarray] | None = None           # (f, h): code of f at each code of h, -1 not seen

    def _codes(self, f: int, column: np.ndarray) -> np.ndarray | None:
        known = self.known[f]
        new = np.ones(len(column), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, column), len(known) - 1)
            new = known[at] != column
        if new.any():
            fresh = np.unique(column[new])
            if len(known) + len(fresh) > MAX_CODES:
                return None
            number = np.concatenate([self.number[f], len(known) + np.arange(len(fresh))])
            known = np.concatenate([known, fresh])
            order = np.argsort(known)
            self.known[f], self.number[f] = known[order], number[order]
            at = np.searchsorted(self.known[f], column)
        return self.number[f][at]

    def add(self, x: np.ndarray) -> None:
        codes = {}
        for f in list(self.known):
            got = self._codes(f, np.ascontiguousarray(x[:, f]))
            if got is None:
                del self.known[f], self.number[f]
            else:
                codes[f] = got
        if self.maps is None:
            paired = codes if len(codes) <= MAX_PAIRED else ()
            self.maps = {(f, h): np.full(MAX_CODES, -1) for f in paired for h in paired if f != h}
            self._check({f: c[:200] for f, c in codes.items()})
        self._check(codes)

    def _check(self, codes: dict[int, np.ndarray]) -> None:
        for (f, h), m in list(self.maps.items()):
            if f in codes and h in codes:
                got = m[codes[h]]
                new = got < 0
                if new.any():
                    m[codes[h][new]] = codes[f][new]
                    got = m[codes[h]]
                if (got == codes[f]).all():
                    continue
            del self.maps[f, h]

    def rows(self) -> Iterator[tuple]:
        """(kind, f, h, a, b): 1 the values a of f; 2 f has too many; 3 h determines f; 4 with the value b at a."""
        of = {f: v[np.argsort(self.number[f])] for f, v in self.known.items()}
        for f in range(self.width):
            if f in of:
                yield from ((1, f, 0, v, 0.0) for v in of[f].tolist())
            else:
                yield (2, f, 0, 0.0, 0.0)
        for (f, h), m in (self.maps or {}).items():
            if (len(of[f]), f) <= (len(of[h]), f if h < f else -1):
                yield (3, f, h, 0.0, 0.0)
                yield from ((4, f, h, a, b) for a, b in zip(of[h].tolist(), of[f][m[:len(of[h])]].tolist(), strict=True))


def study(rows: DataFrame) -> tuple[Layout, int]:
    """The layout of ``rows`` (x array, y, maybe more), and their number.  No rows, rows without a label or of different numbers of
    features are an error."""
    names = ["kind", "f", "h", "a", "b", "n", "bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, bad = None, 0, 0
        for b in batches:
            if b.num_rows:
                x = _features(b)
                seen = seen or _Seen(x.shape[1])
                if x.shape[1] != seen.width:
                    raise ValueError("rows of different numbers of features")
                for i in range(0, len(x), CHUNK_ROWS):
                    seen.add(x[i:i + CHUNK_ROWS])
                n, bad = n + len(x), bad + b.column(1).null_count
        if seen:
            found = [(0, seen.width, 0, 0.0, 0.0), *seen.rows()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            counts = [pa.array([v, *[0] * (len(found) - 1)], pa.int64()) for v in (n, bad)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)), *counts], names)

    got = rows.mapInArrow(run, "kind int, f int, h int, a double, b double, n long, bad long").groupBy(*names[:5]).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("tasks")).toArrow().to_pandas()
    totals = got[got["kind"] == 0]
    if not len(totals) or totals["bad"].sum():
        raise ValueError("no rows, or rows without a label")
    if len(totals) > 1:
        raise ValueError("rows of different numbers of features")
    width, n_rows, tasks = (int(totals[c].iloc[0]) for c in ("f", "n", "tasks"))
    own = {int(f): np.sort(v.to_numpy()) for f, v in got[got["kind"] == 1].groupby("f")["a"]}
    many = {int(f) for f in got[got["kind"] == 2]["f"]} | {f for f, v in own.items() if len(v) > MAX_CODES}
    maps = {(int(f), int(h)): t for (f, h), t in got[got["kind"] == 4].groupby(["f", "h"])}
    everywhere = {(int(r.f), int(r.h)) for r in got[(got["kind"] == 3) & (got["tasks"] == tasks)].itertuples()}
    coded = sorted((f for f in own if f not in many), key=lambda f: (-len(own[f]), f))
    bases, base_of, values = [], np.full(width, -1), {}
    for f in coded:
        told = [h for h in bases if (f, h) in everywhere and len(maps[f, h]) == len(own[h])]
        if told:
            base_of[f], values[f] = bases.index(told[0]), maps[f, told[0]].sort_values("a")["b"].to_numpy()
        else:
            base_of[f], values[f] = len(bases), own[f]
            bases.append(f)
    return Layout(width, bases, [f for f in range(width) if base_of[f] < 0], base_of, values), n_rows


def coded_rows(rows: DataFrame, lay: Layout) -> DataFrame:
    """``rows`` (x array, y, maybe a part) as a written table of records of ``lay`` (n, rows, maybe the part of all of them)."""
    parted = "part" in rows.columns
    names = ["n", "rows", *["part"] * parted]
    full = lay.record["y"].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[int, tuple[np.ndarray, ...]] = {}

        def batch(part: int, *columns: np.ndarray) -> pa.RecordBatch:
            found, n = lay.records(*columns)
            raw = pa.array(found.view(f"V{lay.record.itemsize}").tolist(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), raw, *[pa.array(np.full(len(n), part, np.int32))] * parted], names)

        for b in batches:
            if not b.num_rows:
                continue
            x = _features(b)
            codes, raws = np.empty((len(lay.bases), len(x)), np.int16), np.ascontiguousarray(x[:, lay.raw].T)
            for j, f in enumerate(lay.bases):
                known = lay.values[f]
                at = np.minimum(np.searchsorted(known, x[:, f]), len(known) - 1)
                if (known[at] != x[:, f]).any():
                    raise ValueError("the rows changed between two passes")
                codes[j] = at
            y = np.rint(b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) / LABEL_STEP)
            of = b.column(2).to_numpy(zero_copy_only=False) if parted else np.zeros(len(x), np.int32)
            for part in np.unique(of).tolist():
                own = of == part
                held = (codes[:, own], raws[:, own], y[own])
                if part in rest:
                    held = tuple(np.concatenate(v, axis=-1) for v in zip(rest[part], held, strict=True))
                whole = len(held[2]) // full * full
                if whole:
                    yield batch(part, *(v[..., :whole] for v in held))
                rest[part] = tuple(v[..., whole:] for v in held)
        for part, held in rest.items():
            if len(held[2]):
                yield batch(part, *held)

    return cut_lineage(rows.mapInArrow(run, "n int, rows binary" + ", part int" * parted), "rows", **{"parquet.block.size": str(GROUP_BYTES)})


@dataclass
class CodedRows:
    """A written table of coded rows, in parts if they were given, for any number of fits."""

    data: DataFrame
    layout: Layout
    n: dict[int, int]        # rows of each part; part 0 where there are none

    def without(self, part: int | None) -> tuple[DataFrame, int]:
        """The rows of the other parts and their number; all for None."""
        own = self.data if part is None or "part" not in self.data.columns else self.data.where(F.col("part") != part)
        return own.select("n", "rows"), sum(n for p, n in self.n.items() if p != part)


def _chunks(batches: Iterator[pa.RecordBatch], lay: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes of bases x rows, values of raw features x rows, labels in steps) of some ``CHUNK_ROWS`` rows of records."""
    nb, full = len(lay.bases), lay.record["y"].shape[0]
    most = max(1, CHUNK_ROWS // full)
    for whole in batches:
        for i in range(0, whole.num_rows, most):
            b = whole.slice(i, most)
            n, raw = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            found = np.frombuffer(raw.buffers()[2], lay.record, b.num_rows, int(first))
            codes = np.zeros((max(nb, 1), b.num_rows, full), np.int64)
            codes[:nb] = found["c"].transpose(1, 0, 2)
            raws, y = found["r"].transpose(1, 0, 2), found["y"]
            if (n < full).any():
                there = np.arange(full) < n[:, None]
                yield codes[:, there], raws[:, there], y[there]
            else:
                yield codes.reshape(max(nb, 1), -1), raws.reshape(len(lay.raw), -1), y.reshape(-1)


class _Router:
    """A tree over coded rows: of each node a table of the codes that go left, or a value to compare with."""

    def __init__(self, tree: Tree, lay: Layout):
        inner, own = tree.feature >= 0, np.arange(len(tree.node))
        base = np.where(inner, lay.base_of[tree.feature], -1)
        sizes = np.array([*lay.sizes, 0])
        most = int(sizes.max())
        self.raw = inner & (base < 0)
        self.any_raw = bool(self.raw.any())
        place = {f: j for j, f in enumerate(lay.raw)}
        self.column = np.where(self.raw, [place.get(int(f), 0) for f in tree.feature], 0)
        self.threshold = tree.threshold
        self.base = np.maximum(base, 0)
        taken = np.where(base >= 0, sizes[base], 0)
        self.first = np.where(base >= 0, max(most, 1) + np.cumsum(taken) - taken, 0)   # leaves share a table at 0
        self.left = np.ones(max(most, 1) + int(taken.sum()), np.int8)
        for f in np.unique(tree.feature[base >= 0]).tolist():
            at = np.flatnonzero((base >= 0) & (tree.feature == f))
            to = self.first[at][:, None] + np.arange(len(lay.values[f]))
            self.left[to] = lay.values[f][None, :] <= tree.threshold[at][:, None]
        # A node that is not split is its own child, so all rows move together.
        self.child = np.column_stack([np.where(inner, tree.right, own), np.where(inner, tree.left, own)]).reshape(-1)
        self.inner, self.depth = inner, int(tree.node[-1]).bit_length() - 1

    def _step(self, at: np.ndarray, codes: np.ndarray, raws: np.ndarray, row: np.ndarray, n: int, base: np.ndarray) -> np.ndarray:
        left = self.left.take(self.first.take(at) + codes.take(base.take(at) + row))
        if self.any_raw:
            by_value = np.flatnonzero(self.raw.take(at))
            i = at[by_value]
            left[by_value] = raws.take(self.column.take(i) * n + row[by_value]) <= self.threshold.take(i)
        return self.child.take(2 * at + left)

    def place(self, codes: np.ndarray, raws: np.ndarray) -> np.ndarray:
        """Position of the leaf or open node of each row."""
        n = codes.shape[1]
        row, at, codes, raws, base = np.arange(n), np.zeros(n, np.int64), codes.reshape(-1), raws.reshape(-1), self.base * n
        for _ in range(min(self.depth, 8)):
            at = self._step(at, codes, raws, row, n, base)
        moving = np.flatnonzero(self.inner[at]) if self.depth > 8 else row[:0]
        while len(moving):
            at[moving] = self._step(at[moving], codes, raws, moving, n, base)
            moving = moving[self.inner[at[moving]]]
        return at


def _by_node(at: np.ndarray, index: np.ndarray):
    """Rows of open nodes, sorted by node: (rows, first row of each node, open nodes in order).  ``at``: positions in the
    tree; ``index``: the open node at each position, -1 for others."""
    is_open = index[at] >= 0
    rows = None if is_open.all() else np.flatnonzero(is_open)
    at = at if rows is None else at[rows]
    if not len(at):
        return at, at, at
    order = np.argsort(at.astype(np.uint16) if len(index) < 1 << 16 else at, kind="stable")
    nodes = at[order]
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    return order if rows is None else rows[order], first, index[nodes[first]]


class _Forest:
    """Trees while they grow, on the driver."""

    def __init__(self, s: Settings, trees: list[int], layout: Layout):
        self.s, self.trees, self.layout = s, trees, layout
        self.nodes: dict[int, dict[int, tuple]] = {t: {1: (-1, 0.0, 0.0, 0, 0.0)} for t in trees}

    def routers(self, wanted: list[tuple[int, int]]) -> list[tuple[int, _Router, np.ndarray, np.ndarray]]:
        """For each tree of the open nodes ``wanted``: its number, its router, the number of each of its positions and the
        position in ``wanted`` of each (-1 for others)."""
        trees = sorted({t for t, _ in wanted})
        rows = [(t, i, *v) for t in trees for i, v in self.nodes[t].items()]
        built = build_trees(pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "value", "n", "gain"]))
        return [(t, _Router(tree, self.layout), tree.node, of) for t, tree, of in zip(trees, built, _open_index(built, trees, wanted), strict=True)]


def _open_index(trees: list[Tree], numbers: list[int], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each tree the position in ``wanted`` of each of its nodes, -1 for others."""
    place = {k: i for i, k in enumerate(wanted)}
    return [np.array([place.get((t, int(n)), -1) for n in tree.node], np.int64) for t, tree in zip(numbers, trees, strict=True)]


def _level(data: DataFrame, s: Settings, forest: _Forest, wanted: list[tuple[int, int]]) -> None:
    """Splits the open nodes ``wanted`` (tree, node), in the order of their trees; what is not split is a leaf."""
    sc, lay = data.sparkSession.sparkContext, forest.layout
    k, f, nr = len(wanted), s.n_features, len(lay.raw)
    start = np.concatenate([[0], np.cumsum(lay.sizes)]).astype(np.int64)   # of each base among the bits of a node
    words = -(-int(start[-1]) // 64)
    cells = words + nr + 1                                  # of a node: words of bits, raw features, the label
    shared = sc.broadcast(forest.routers(wanted))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = [np.zeros(k * c, bool) for c in lay.sizes]
        lo, hi, n, total = np.full((nr + 1, k), np.inf), np.full((nr + 1, k), -np.inf), np.zeros(k), np.zeros(k)
        for codes, raws, y in _chunks(batches, lay):
            for _, router, _, of in shared.value:
                at = router.place(codes, raws)
                rows, first, nodes = _by_node(at, of)
                if not len(rows):
                    continue
                size = np.diff(np.append(first, len(rows)))
                open_at = np.repeat(nodes, size)
                for j, c in enumerate(lay.sizes):
                    there[j][open_at * c + codes[j].take(rows)] = True
                for j, column in enumerate((*raws, y)):
                    v = column.take(rows)
                    lo[j, nodes] = np.minimum(lo[j, nodes], np.minimum.reduceat(v, first))
                    hi[j, nodes] = np.maximum(hi[j, nodes], np.maximum.reduceat(v, first))
                n[nodes] += size
                total[nodes] += np.add.reduceat(v, first)
        at = np.flatnonzero(n > 0)
        bits = np.zeros((len(at), 64 * words), bool)
        for j, c in enumerate(lay.sizes):
            bits[:, start[j]:start[j + 1]] = there[j].reshape(k, c)[at]
        packed = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<i8")
        out = [((at[:, None] * cells + np.arange(words)).ravel(), packed, np.zeros((4, len(packed)))),
               ((at[:, None] * cells + np.arange(words, cells)).ravel(), np.zeros(len(at) * (nr + 1), np.int64),
                np.array([v.T[at].ravel() for v in (lo, hi, np.tile(n, (nr + 1, 1)), np.tile(total, (nr + 1, 1)))]))]
        for cell, word, numbers in out:
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(word), *(pa.array(v) for v in numbers)],
                                             ["cell", "word", "lo", "hi", "n", "total"])

    got = data.mapInArrow(ranges, "cell long, word long, lo double, hi double, n double, total double").groupBy("cell").agg(
        F.bit_or("word").alias("word"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    cell, word, *numbers = (got.column(c).to_numpy() for c in ("cell", "word", "lo", "hi", "n", "total"))
    bits = np.zeros(k * cells, np.int64)
    bits[cell] = word
    table = np.zeros((4, k * cells))
    table[:, cell] = numbers
    table = table.reshape(4, k, cells)
    there = np.unpackbits(np.ascontiguousarray(bits.reshape(k, cells)[:, :words]).view(np.uint8), axis=1, bitorder="little").astype(bool)
    n, total = table[2, :, -1], table[3, :, -1]
    lo, hi = np.zeros((k, f)), np.zeros((k, f))
    for j, own in enumerate(lay.raw):
        lo[:, own], hi[:, own] = table[0, :, words + j], table[1, :, words + j]
    for own, values in lay.values.items():
        j = lay.base_of[own]
        found = there[:, start[j]:start[j + 1]]
        lo[:, own], hi[:, own] = np.where(found, values, np.inf).min(axis=1), np.where(found, values, -np.inf).max(axis=1)
    tree, node = (np.array(v) for v in zip(*wanted, strict=True))
    t = thresholds(s, tree, node, lo, hi)
    depth = np.array([int(i).bit_length() for i in node])
    ripe = s.may_split(n, depth) & (table[0, :, -1] < table[1, :, -1])
    t[~ripe] = np.nan
    drawn = sc.broadcast(t)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = drawn.value
        tried = ~np.isnan(t)
        counts = [(np.zeros(k * c), np.zeros(k * c)) for c in lay.sizes]
        n_left, left = np.zeros((f, k)), np.zeros((f, k))
        ripe = tried.any(axis=1)
        for codes, raws, y in _chunks(batches, lay):
            for _, router, _, of in shared.value:
                of = np.where((of >= 0) & ripe[of], of, -1)
                if (of < 0).all():
                    continue
                rows, first, nodes = _by_node(router.place(codes, raws), of)
                if not len(rows):
                    continue
                size, ys = np.diff(np.append(first, len(rows))), y.take(rows)
                open_at = np.repeat(nodes, size)
                least, most = int(nodes.min()), int(nodes.max()) + 1
                for (c, (rows_at, sum_at)), code in zip(zip(lay.sizes, counts, strict=True), codes, strict=False):
                    if (most - least) * c <= 4 * len(rows):
                        cell = (open_at - least) * c + code.take(rows)
                        part = slice(least * c, most * c)
                        rows_at[part] += np.bincount(cell, minlength=(most - least) * c)
                        sum_at[part] += np.bincount(cell, ys, (most - least) * c)
                    else:
                        cell = open_at * c + code.take(rows)
                        np.add.at(rows_at, cell, 1.0)
                        np.add.at(sum_at, cell, ys)
                for own, column in zip(lay.raw, raws, strict=True):
                    if tried[nodes, own].any():
                        lower = column.take(rows) <= np.repeat(t[nodes, own], size)
                        n_left[own, nodes] += np.add.reduceat(lower, first, dtype=np.int64)
                        left[own, nodes] += np.add.reduceat(lower * ys, first)
        for own, values in lay.values.items():
            rows_at, sum_at = (v.reshape(k, -1) for v in counts[lay.base_of[own]])
            lower = (values <= t[:, own][:, None]).astype(np.float64)
            n_left[own], left[own] = np.einsum("kc,kc->k", rows_at, lower), np.einsum("kc,kc->k", sum_at, lower)
        n_left, left = n_left.T.ravel(), left.T.ravel()
        cell = np.flatnonzero(n_left)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n_left[cell]), pa.array(left[cell])], ["cell", "n", "total"])

    n_left, left = np.zeros(k * f), np.zeros(k * f)
    if not np.isnan(t).all():
        got = data.mapInArrow(splits, "cell long, n double, total double").groupBy("cell").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        cell = got.column("cell").to_numpy()
        n_left[cell], left[cell] = got.column("n").to_numpy(), got.column("total").to_numpy()
    n_left, left = n_left.reshape(k, -1), left.reshape(k, -1)
    feature, gain = best_split(s, t, n, total, n_left, left)
    for i, (a, b) in enumerate(wanted):
        own = int(feature[i])
        cut = float(t[i, own]) if own >= 0 else 0.0
        forest.nodes[a][b] = (own, cut, float(total[i]) / max(n[i], 1) * LABEL_STEP, int(n[i]), float(gain[i]))
        if own >= 0:
            for child, rows, labels in ((2 * b, n_left[i, own], left[i, own]), (2 * b + 1, n[i] - n_left[i, own], total[i] - left[i, own])):
                forest.nodes[a][child] = (-1, 0.0, float(labels) / max(rows, 1) * LABEL_STEP, int(rows), 0.0)
    shared.unpersist()
    drawn.unpersist()


def _finish(data: DataFrame, s: Settings, forest: _Forest, small: list[tuple[int, int]]) -> None:
    """Grows the nodes ``small``, each in one task."""
    lay = forest.layout
    shared = data.sparkSession.sparkContext.broadcast(forest.routers(small))
    columns = lay.names
    types = ", ".join(f"{c} {'short' if c[0] == 'c' else 'double'}" for c in columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, raws, y in _chunks(batches, lay):
            for number, router, node, of in shared.value:
                at = router.place(codes, raws)
                rows = np.flatnonzero(of[at] >= 0)
                if len(rows):
                    own = [*(c[rows].astype(np.int16) for c in codes[:len(lay.bases)]), *(v[rows] for v in raws), y[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), pa.array(node[at[rows]]),
                                                      *(pa.array(v) for v in own)], ["tree", "node", *columns])

    def finish(rows: pa.Table) -> pa.Table:
        own = [rows.column(c).to_numpy() for c in columns]
        nb = len(lay.bases)
        got = grow(s, rows.column("tree")[0].as_py(), rows.column("node")[0].as_py(), lay.matrix(own[:nb], own[nb:-1]), own[-1])
        types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), types, strict=True)],
                                    ["tree", "node", "feature", "threshold", "value", "n", "gain"])

    grown = (data.mapInArrow(deal, f"tree int, node long, {types}").groupBy("tree", "node")
             .applyInArrow(finish, NODE_SCHEMA).toArrow().to_pylist())
    for r in grown:
        forest.nodes[r["tree"]][r["node"]] = (r["feature"], r["threshold"], r["value"], r["n"], r["gain"])
    shared.unpersist()


def grow_forest(data: DataFrame, s: Settings, trees: list[int], n_rows: int, layout: Layout) -> list[tuple]:
    """Nodes (as ``NODE_SCHEMA``) of some trees over ``data`` (coded rows)."""
    forest = _Forest(s, trees, layout)
    few = n_rows * len(trees) <= FEW_ROWS

    def is_small(node: int, n: int) -> bool:
        return n <= LOCAL_ROWS and (few or s.max_depth + 1 - node.bit_length() > LAST_LEVELS)

    open_nodes, small = [((t, 1), n_rows) for t in trees], []
    while open_nodes:
        small += [k for k, n in open_nodes if is_small(k[1], n)]
        big = [k for k, n in open_nodes if not is_small(k[1], n)]
        step = max(1, CELLS // (sum(layout.sizes) + s.n_features + 1))
        for i in range(0, len(big), step):
            _level(data, s, forest, big[i:i + step])
        children = [(t, c) for t, b in big if forest.nodes[t][b][0] >= 0 for c in (2 * b, 2 * b + 1)]
        open_nodes = [((t, c), n) for t, c in children if s.may_split(n := forest.nodes[t][c][3], c.bit_length())]
    if small:
        _finish(data, s, forest, small)
    return [(t, i, *v) for t in trees for i, v in forest.nodes[t].items()]


def features_tried(strategy: str, n: int) -> int:
    """Number of features a node tries: all, sqrt, log2, onethird, a share such as 0.5, or a count."""
    named = {"all": n, "auto": n, "sqrt": math.isqrt(n), "log2": int(math.log2(max(n, 2))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return max(1, named[strategy])
    return max(1, min(n, int(strategy))) if strategy.isdigit() else max(1, min(n, int(float(strategy) * n)))


class _ExtraTreesParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most splits from the root to a leaf", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    minInstancesToSplit = Param(Params._dummy(), "minInstancesToSplit", "least rows of a node that is split", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features tried a node", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=100, maxDepth=DEEPEST, minInstancesPerNode=1, minInstancesToSplit=2, featureSubsetStrategy="all", seed=42)


class ExtraTreesRegressor(Estimator, _ExtraTreesParams, DefaultParamsWritable, DefaultParamsReadable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100,
                 maxDepth=DEEPEST, minInstancesPerNode=1, minInstancesToSplit=2, featureSubsetStrategy="all", seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def code(self, dataset: DataFrame, part: str | None = None) -> CodedRows:
        """The rows of ``dataset`` as fits read them; ``part``: a column of whole numbers that tells folds apart.

        Rows with a null label or feature are an error.  An empty table is an error, as for other learners.
        """
        own = [] if part is None else [F.col(part).cast("int").alias("part")]
        rows = dataset.select(_as_array(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), *own)
        layout, n = study(rows.select("x", "y"))
        data = coded_rows(rows, layout)
        return CodedRows(data, layout, {0: n} if part is None else {r["part"]: r["n"] for r in data.groupBy("part").agg(F.sum("n").alias("n")).collect()})

    def fit_coded(self, coded: CodedRows, without: int | None = None) -> ExtraTreesModel:
        """``fit`` on the rows of ``coded`` but those of the part ``without``."""
        data, n = coded.without(without)
        if not n:
            raise ValueError("no rows")
        width = coded.layout.width
        s = Settings(self.getSeed(), width, features_tried(self.getOrDefault("featureSubsetStrategy"), width),
                     min(self.getOrDefault("maxDepth"), DEEPEST), self.getOrDefault("minInstancesPerNode"),
                     self.getOrDefault("minInstancesToSplit"))
        nodes, trees = [], self.getOrDefault("numTrees")
        for first in range(0, trees, TREES_AT_ONCE):
            nodes += grow_forest(data, s, list(range(first, min(trees, first + TREES_AT_ONCE))), n, coded.layout)
        table = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "value", "n", "gain"])
        return self._copyValues(ExtraTreesModel(table, width))

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        return self.fit_coded(self.code(dataset))


def _as_array(df: DataFrame, column: str) -> Column:
    """A column of vectors or arrays as arrays."""
    return F.col(column) if isinstance(df.schema[column].dataType, ArrayType) else vector_to_array(F.col(column))


class ArrayAssembler(Transformer, HasInputCols, HasOutputCol, DefaultParamsWritable, DefaultParamsReadable):
    """Numbers side by side as one array: a ``VectorAssembler`` for learners that read arrays and refuse nulls and NaN."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.array(*[F.col(f"`{c}`").cast("double") for c in self.getInputCols()]))


class ExtraTreesModel(Model, _ExtraTreesParams, MLWritable, MLReadable):
    """``nodes``: a pandas table, one row a node (tree, node, feature, threshold, value, n, gain)."""

    def __init__(self, nodes: pd.DataFrame | None = None, num_features: int = 0):
        super().__init__()
        self.nodes, self.num_features = nodes, num_features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = dataset.sparkSession.sparkContext.broadcast(build_trees(self.nodes))
        n = self.num_features

        def predict(features: pa.Array) -> pa.Array:
            x = _matrix(features) if len(features) else np.empty((0, n))
            total = np.zeros(len(x))
            for tree in trees.value:
                total += tree.value[tree.place(x)]
            return pa.array(total / max(len(trees.value), 1))

        return dataset.withColumn(self.getPredictionCol(), F.arrow_udf(predict, DoubleType())(_as_array(dataset, self.getFeaturesCol())))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each tree's total gain by feature, averaged over trees with a split."""
        inner = self.nodes[self.nodes["feature"] >= 0]
        out = np.zeros(self.num_features)
        for _, t in inner.groupby("tree"):
            if t["gain"].sum() > 0:
                out += np.bincount(t["feature"], t["gain"], self.num_features) / t["gain"].sum()
        return Vectors.dense(out / out.sum() if out.sum() > 0 else out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ExtraTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"num_features": self.model.num_features})
        spark.createDataFrame(self.model.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ExtraTreesModel:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/nodes").toPandas(), meta["num_features"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
