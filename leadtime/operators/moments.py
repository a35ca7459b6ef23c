"""Blocked cross-product matrices of many columns in one pass, with null masks.

A task turns each Arrow batch into a matrix X of values less a shift per column (nulls as zero) and a matrix M of
ones where a value is there.  For two blocks of columns, M'M counts the rows that have both values, X'M and
M'X sum either value over those rows, (X X)'M and M'(X X) their squares and X'X their products.  A
task adds up its batches in matrices of block size and sends one row a column pair, whatever the number of
rows; Spark adds the tasks' rows.  No input row is multiplied.  Shifting by the column mean keeps the sums
small, so that differences of them are accurate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128      # columns of one block
# A pair's variance below this share of its sum of squares about the column mean is rounding: constant.
ROUNDING = 1e-13
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def column_shifts(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Mean of each column (0 where it has none), one row to the driver."""
    names = {c: f"m{i}" for i, c in enumerate(cols)}
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(n) for c, n in names.items()]).first()
    return {c: float(row[n]) if row[n] is not None and math.isfinite(row[n]) else 0.0 for c, n in names.items()}


def to_matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns ``first`` to ``first + n`` as doubles, nulls as NaN."""
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)]).astype(np.float64, copy=False)


def pair_moments(df: DataFrame, pairs: list[tuple[str, str]], shifts: dict[str, float] | None = None) -> DataFrame:
    """(row, col, n, sx, sy, sxx, syy, sxy) for each column pair over the rows that have both values; sums are of
    values less their column's shift (by default its mean).  A pair without such a row has n 0."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    place = {c: i for i, c in enumerate(cols)}
    shifts = shifts if shifts is not None else column_shifts(df, cols)
    shift = np.array([shifts[c] for c in cols])
    # Column pairs by pair of blocks.
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in pairs:
        i, j = place[a], place[b]
        cells.setdefault((i // BLOCK, j // BLOCK), []).append((i, j))
    n_cols = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {cell: np.zeros((6, min(BLOCK, n_cols - cell[0] * BLOCK), min(BLOCK, n_cols - cell[1] * BLOCK))) for cell in cells}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch, 0, n_cols) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m, xx = there.astype(np.float64), x * x
            for (p, q), s in sums.items():
                a, b = slice(p * BLOCK, (p + 1) * BLOCK), slice(q * BLOCK, (q + 1) * BLOCK)
                s[0] += m[:, a].T @ m[:, b]
                s[1] += x[:, a].T @ m[:, b]
                s[2] += m[:, a].T @ x[:, b]
                s[3] += xx[:, a].T @ m[:, b]
                s[4] += m[:, a].T @ xx[:, b]
                s[5] += x[:, a].T @ x[:, b]
        for cell, s in sums.items():
            i, j = np.array(cells[cell]).T
            got = s[:, i - cell[0] * BLOCK, j - cell[1] * BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(got[0].astype(np.int64)),
                                              *[pa.array(v) for v in got[1:]]], ["i", "j", *SUMS])

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)]) \
              .mapInArrow(run, "i int, j int, n long, " + ", ".join(f"{s} double" for s in SUMS[1:]))
    names = F.array(*[F.lit(c) for c in cols])
    return (parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
            .select(F.get(names, F.col("i")).alias("row"), F.get(names, F.col("j")).alias("col"), *SUMS))


def correlation() -> Column:
    """Pearson's r from the sums of ``pair_moments``; null if either side is constant over the common rows."""
    n = F.col("n").cast("double")
    vx, vy = (F.col(q) - F.col(s) * F.col(s) / n for q, s in (("sxx", "sx"), ("syy", "sy")))
    varies = (F.col("n") > 1) & (vx > ROUNDING * F.col("sxx")) & (vy > ROUNDING * F.col("syy"))
    return F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
