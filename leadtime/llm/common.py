"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import cut_lineage

# Text handed to one vectorised step; longer batches are cut at row borders.  A single longer
# text still goes through whole.
SLICE_CHARS = 4_000_000


def append_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, DataType]],
                   make: Callable[[], Callable[..., list]], keep: list[str] | None = None,
                   most: int = SLICE_CHARS) -> DataFrame:
    """``df`` (or its columns ``keep``) with new columns computed per slice of rows.

    ``make()`` runs once per task and returns a function that takes one Python list per input
    column (nulls are None) and returns one list per new field.  No shuffle; rows and their other
    columns pass through untouched, repeated rows and nulls included.  A column of ``df`` that
    has the name of a new field is replaced by it.
    """
    new = {n for n, _ in fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c not in new]
    position = {c: i for i, c in enumerate(df.columns)}
    need = [c for c in dict.fromkeys([*kept, *inputs])]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(need)])
    at = [need.index(c) for c in inputs]
    n_kept = len(kept)
    schema = StructType([StructField(f"c{i}", df.schema[position[c]].dataType, True) for i, c in enumerate(kept)]
                        + [StructField(f"n{i}", t, True) for i, (_, t) in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        work = make()
        out_types = [f.type for f in to_arrow_schema(schema)][n_kept:]
        names = [f.name for f in schema.fields]
        for whole in batches:
            for b in slices(whole, at, most):
                cols = work(*[b.column(i).to_pylist() for i in at])
                arrays = [b.column(i) for i in range(n_kept)]
                arrays += [pa.array(c, type=t) for c, t in zip(cols, out_types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
                      *[F.col(f"n{i}").alias(n) for i, (n, _) in enumerate(fields)])


def slices(batch: pa.RecordBatch, at: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` whose string columns ``at`` hold about ``most`` bytes at most."""
    size = sum((batch.column(i).nbytes for i in at), 0)
    if size <= most or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), at, most)
    yield from slices(batch.slice(half), at, most)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    ``edges`` has two columns of one ordered type; self links and null ends are ignored, and only
    nodes with a link appear.  Alternating star contractions: every round links each node to the
    smallest neighbour it knows, so long chains halve.  Rounds are grouped aggregates with
    map-side combining and joins that adaptive execution may split, so a hub with a third of all
    links is no single task; each round is written to the shared folder, so a lost executor
    costs one round.  Raises if the graph has not settled after ``max_rounds``.
    """
    a, b = edges.columns[:2]
    cur = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where((F.col(a) != F.col(b))).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # u > v everywhere.  Large star: neighbours above a node go to the smallest it knows.
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # Small star: neighbours below a node, and the node, go to the smallest below it.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = cut_lineage(large.join(least, "u")
                          .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                    F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                          .select("e.*").where("u != v").distinct(), "links")
        now = cur.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d"),
                      F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and tuple(now) == before and now["n"] == now["d"]:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
