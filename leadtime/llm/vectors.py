"""Near-duplicate vectors: cross-polytope hashing with multiprobe buckets and exact cosines.

A hash is the nearest signed axis after three rounds of random signs and a fast Hadamard transform; a
table's code joins ``HASHES`` of them.  Every distinct vector enters its own bucket of each of
``TABLES`` tables and asks in the ``PROBES - 1`` next likely buckets (by how little its coordinates fall
short of the largest), and each pair that meets is verified by its cosine in double precision.  At
cosine 0.93 in 64 dimensions a pair meets with probability 0.998, more above.

Equal vectors of one label are one class with a count, so copies make no pairs.  A task holds one
bucket; pairs are compared in blocks and leave it only as link counts per class and a spanning forest
of links.  A pair that meets in several buckets counts in the first alone (both codes are recomputed
to tell).  A bucket with more than ``CELL`` rows is dealt in chunks and every pair of chunks is a cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components
from .simhash import _Forest

COSINE = 0.93
TABLES = 4
HASHES = 2
PROBES = 6
CELL = 2000
SEED = 5


def _signs(dim: int, table: int, which: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, which]).choice([-1.0, 1.0], (3, dim))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a Hadamard transform (unscaled); the width is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def codes(vectors: np.ndarray, table: int) -> np.ndarray:
    """n x PROBES codes of one table, a vector's own bucket first.  Each row depends on that row alone."""
    n, width = len(vectors), 1 << max(1, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :vectors.shape[1]] = vectors
    top = min(4, width)
    axes, gaps = [], []
    for which in range(HASHES):
        y = rotate(x, _signs(width, table, which))
        order = np.argsort(-np.abs(y), 1, kind="stable")[:, :top]
        v = np.take_along_axis(y, order, 1)
        axes.append(np.where(v > 0, order, order + width).astype(np.int64))
        gaps.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
    combos = list(itertools.product(range(top), repeat=HASHES))
    cost = np.stack([sum(gaps[i][:, m] for i, m in enumerate(c)) for c in combos], 1)
    code = np.stack([sum(axes[i][:, m] * (2 * width) ** i for i, m in enumerate(c)) for c in combos], 1)
    cost[:, 0] = -1.0
    best = np.argsort(cost, 1, kind="stable")[:, :PROBES]
    return np.take_along_axis(code, best, 1)


def _scaled(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    return v / np.abs(v).max(1, keepdims=True)


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    c = batch.column(i)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, count, label, dim, vector) to a row for each bucket it enters (role 0) or asks in (role 1)."""
    for b in batches:
        dims = b.column(3).to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            x = _scaled(_column(part, 4))
            for t in range(TABLES):
                c = codes(x, t)
                for p in range(c.shape[1]):
                    n = len(c)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), part.column(3), part.column(4),
                         pa.array(np.full(n, t, np.int32)), pa.array(c[:, p]), pa.array(np.full(n, int(p > 0), np.int32))],
                        ["cls", "n", "label", "dim", "vec", "t", "code", "role"])


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Cells in order (columns cls, n, vec, t, role, c, i, j, cell, dim): link counts (a, null, n) and links (a, b, null)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(h.num_rows for h in held) < CELL:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cell = whole.column(8).to_numpy()
        border = np.flatnonzero(cell[1:] != cell[:-1])
        held = [whole]
        if len(border):
            at = int(border[-1]) + 1
            yield from _cells(whole.slice(0, at), cosine)
            held = [whole.slice(at)]
    if held:
        yield from _cells(pa.Table.from_batches(held).combine_chunks().to_batches()[0], cosine)


def _cells(rows: pa.RecordBatch, cosine: float) -> Iterator[pa.RecordBatch]:
    cls, n, t, role, chunk, ci, cj, cell, dim = (rows.column(k).to_numpy() for k in (0, 1, 3, 4, 5, 6, 7, 8, 9))
    border = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    bounds = np.concatenate([[0], border, [len(cell)]])
    has_own = np.add.reduceat(role == 0, bounds[:-1]) if len(cell) else np.zeros(0)
    left, right, counts = [], [], {}
    for a, e in zip(bounds[:-1][(np.diff(bounds) > 1) & (has_own > 0)].tolist(), bounds[1:][(np.diff(bounds) > 1) & (has_own > 0)].tolist(), strict=True):
        # Cells of other widths or chunks may share a cell number only by a hash collision; split those.
        for key in sorted({(d, u, i, j) for d, u, i, j in zip(dim[a:e].tolist(), t[a:e].tolist(), ci[a:e].tolist(), cj[a:e].tolist(), strict=True)}):
            at = a + np.flatnonzero((dim[a:e] == key[0]) & (t[a:e] == key[1]) & (ci[a:e] == key[2]) & (cj[a:e] == key[3]))
            v = _scaled(_column(rows.take(pa.array(at)), 2))
            unit = v / np.sqrt((v * v).sum(1, keepdims=True))
            own = np.flatnonzero((role[at] == 0))
            other = np.arange(len(at))
            near = np.flatnonzero
            p, q = [], []
            for s in range(0, len(own), 1024):
                o = own[s:s + 1024]
                sim = unit[o] @ unit.T
                # Rounding may not lose a pair at the border: look again at pairs just below it.
                x, y = np.nonzero(sim >= cosine - 1e-9)
                x = o[x]
                exact = (unit[x] * unit[y]).sum(1) >= cosine
                x, y = x[exact], y[exact]
                c_x, c_y = chunk[at[x]], chunk[at[y]]
                ok = (role[at[y]] == 1) | (x < y)
                ok &= cls[at[x]] != cls[at[y]]
                if key[2] != key[3]:  # a cell of two chunks compares only across them
                    ok &= c_x != c_y
                p.append(x[ok])
                q.append(y[ok])
            p, q = np.concatenate(p) if p else other[:0], np.concatenate(q) if q else other[:0]
            if not len(p):
                continue
            keep = _first_meeting(v, p, q, role[at][q], cls[at], key[1])
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            total = np.zeros(len(at), np.int64)
            np.add.at(total, p, n[at[q]])
            np.add.at(total, q, n[at[p]])
            for k in near(total):
                counts[int(cls[at[k]])] = counts.get(int(cls[at[k]]), 0) + int(total[k])
            names, place = np.unique(cls[at], return_inverse=True)
            forest = _Forest(len(names))
            forest.link(place[p], place[q])
            i, j = forest.edges()
            left.append(names[i])
            right.append(names[j])
    a = np.concatenate([*left, np.array(list(counts), np.int64)]) if left else np.zeros(0, np.int64)
    if len(a):
        links = int(sum(map(len, left)))
        b = pa.array([*np.concatenate(right).tolist(), *[None] * len(counts)], pa.int64())
        m = pa.array([*[None] * links, *counts.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, m], ["a", "b", "n"])


def _first_meeting(v: np.ndarray, p: np.ndarray, q: np.ndarray, role_q: np.ndarray, cls: np.ndarray, table: int) -> np.ndarray:
    """Which pairs (p in its own bucket of ``table``, q there by ``role_q``) have not met before."""
    some, place = np.unique(np.concatenate([p, q]), return_inverse=True)
    i, j = place[:len(p)], place[len(p):]
    keep = np.ones(len(p), bool)
    for t in range(table + 1):
        c = codes(v[some], t)
        for s in range(0, len(p), 1 << 16):
            z = slice(s, s + (1 << 16))
            a, b = c[i[z]], c[j[z]]
            if t < table:
                keep[z] &= ~((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1))
            else:  # each asks in the other's bucket: the smaller class's bucket counts
                both = (role_q[z] == 1) & (b[:, :1] == a[:, 1:]).any(1)
                keep[z] &= ~(both & (cls[p[z]] > cls[q[z]]))
    return keep


def comparable(vec: str = "embedding", label: str = "label"):
    """True for vectors that may link: a label, components, all finite, not all zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0),
                      F.lit(False))


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
                 cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Links: equal labels and cosine at least ``cosine``.  Null labels, null, empty or zero vectors and
    those with null or non-finite parts link with nothing; so do vectors of different length.
    Repeated rows are vectors of their own and link with each other.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    ok = comparable("vec", "label")
    digest = [F.xxhash64("label", "vec").alias("d1"), F.xxhash64(F.lit(17), "vec", "label").alias("d2")]
    good = rows.where(ok).select("vec_id", "label", "vec", F.size("vec").alias("dim"), *digest)
    classes = cut_lineage(good.groupBy("d1", "d2", "label", "dim", "vec")
                          .agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
                          .withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    kind = classes.schema["vec"].dataType.simpleString()
    label_kind = classes.schema["label"].dataType.simpleString()
    dealt = classes.select("cls", "n", "label", "dim", "vec").mapInArrow(
        _deal, f"cls long, n long, label {label_kind}, dim int, vec {kind}, t int, code long, role int")
    bucket = ["label", "dim", "t", "code"]
    large = (dealt.groupBy(bucket).agg(F.count("*").alias("m")).where(F.col("m") > CELL)
             .withColumn("chunks", F.ceil(F.col("m") / CELL).cast("int")).drop("m"))
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = (dealt.join(large, bucket, "left").withColumn("c", chunk).withColumn("o", F.explode(others))
             .withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")})
             .withColumn("cell", F.xxhash64(*bucket, "i", "j")))
    placed = (cells.repartition("cell").sortWithinPartitions("cell")
              .select("cls", "n", "vec", "t", "role", "c", "i", "j", "cell", "dim"))
    found = cut_lineage(placed.mapInArrow(lambda b: _verify(b, cosine), "a long, b long, n long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    named = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "root")
    known = (classes.select("cls", "d1", "d2", "low", "n").join(links, "cls", "left").join(named, "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "d1", "d2").join(known, ["d1", "d2"])
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
