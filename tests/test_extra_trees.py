import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from leadtime.plans import extra_trees as X
from leadtime.plans import models as M

FEATURES = ["a", "b", "c", "d"]


def table(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(0, 3, n).round(2), rng.integers(0, 2, n), np.full(n, 4)]).astype(float)
    y = np.rint(20 * x[:, 0] - 7 * x[:, 1] + 30 * x[:, 2] * (x[:, 0] > 5) + rng.normal(0, 4, n))
    return x, y


def slow_tree(x, y, seed, tree, tried, min_leaf, min_split, max_depth, node=1):
    """{node: (feature, threshold, value, rows)}, by the definition, one node at a time."""
    def u(feature, salt):
        return float(X.uniform(seed, np.array([tree]), np.array([node]), np.array([feature]), salt)[0])
    n, out = len(y), {node: (-1, 0.0, float(np.sum(y)) / len(y), len(y))}
    if n < 2 or n < min_split or n < 2 * min_leaf or len(bin(node)) - 2 > max_depth or len(set(y.tolist())) == 1:
        return out
    varying = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()]
    chosen = sorted(varying, key=lambda f: (u(f, 2), f))[:tried]
    best = None
    for f in sorted(chosen):
        lo, hi = x[:, f].min(), x[:, f].max()
        t = lo + u(f, 1) * (hi - lo)
        t = lo if t >= hi else t
        left = x[:, f] <= t
        if min(left.sum(), (~left).sum()) < min_leaf:
            continue
        score = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()
        if best is None or score > best[0]:
            best = (score, f, t, left)
    if best:
        _, f, t, left = best
        out[node] = (f, float(t), out[node][2], n)
        for child, side in ((2 * node, left), (2 * node + 1, ~left)):
            out |= slow_tree(x[side], y[side], seed, tree, tried, min_leaf, min_split, max_depth, child)
    return out


def fit(spark, x, y, parts, **settings):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double").repartition(parts)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), X.ExtraTreesRegressor(**settings)]
    return Pipeline(stages=stages).fit(df), df


def nodes_of(model, tree):
    t = model.stages[-1].nodes
    return {r.node: (r.feature, r.threshold, r.value, r.n) for r in t[t.tree == tree].itertuples()}


@pytest.mark.parametrize("local", [5_000, 60])
def test_trees_equal_the_plain_grower(spark, monkeypatch, local):
    monkeypatch.setattr(X, "LOCAL_ROWS", local)
    x, y = table(500)
    model, _ = fit(spark, x, y, 3, numTrees=3, minInstancesPerNode=4, minInstancesToSplit=11, maxDepth=9, featureSubsetStrategy="0.5", seed=9)
    for tree in range(3):
        want = slow_tree(x, y, 9, tree, 2, 4, 11, 9)
        got = nodes_of(model, tree)
        assert set(got) == set(want) and len(got) > 20
        for k, (f, t, value, n) in want.items():
            assert got[k][0] == f and got[k][3] == n and got[k][1] == t and got[k][2] == pytest.approx(value)


def test_any_partitioning_gives_the_same_trees(spark, monkeypatch):
    x, y = table(700, 6)
    tables = []
    for parts, local in ((1, 5_000), (6, 100), (4, 1)):
        monkeypatch.setattr(X, "LOCAL_ROWS", local)
        model, _ = fit(spark, x, y, parts, numTrees=2, minInstancesPerNode=5)
        tables.append(model.stages[-1].nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    assert tables[0].equals(tables[1]) and tables[0].equals(tables[2])


def test_predictions_importance_save_and_load(spark, tmp_path):
    x, y = table(800, 7)
    model, df = fit(spark, x, y, 4, numTrees=8, minInstancesPerNode=5)
    out = model.transform(df)
    assert out.columns == [*FEATURES, "label", "features", "prediction"]
    rows = out.select(*FEATURES, "prediction").collect()
    trees = [slow_tree(x, y, 42, t, 4, 5, 2, 60) for t in range(8)]

    def one(tree, r):
        node = 1
        while tree[node][0] >= 0:
            node = 2 * node + (r[tree[node][0]] > tree[node][1])
        return tree[node][2]
    for r in rows[:60]:
        assert r["prediction"] == pytest.approx(np.mean([one(t, r) for t in trees]))
    imp = model.stages[-1].featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and imp[0] == imp.max() and imp[3] == 0
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(df).select(*FEATURES, "prediction").collect()
    assert sorted(again) == sorted(rows)


def test_bad_tables_are_errors(spark):
    x, y = table(10)
    with pytest.raises(ValueError):
        fit(spark, x[:0], y[:0], 1)


def test_constant_label_is_one_leaf(spark):
    x, _ = table(50)
    model, df = fit(spark, x, np.full(50, 3.0), 2, numTrees=2)
    assert len(model.stages[-1].nodes) == 2
    assert {r.prediction for r in model.transform(df).select("prediction").collect()} == {3.0}


def test_large_tables_go_on_level_by_level_to_the_same_trees(spark, monkeypatch):
    x, y = table(900, 8)
    calls, level = [], X._level
    monkeypatch.setattr(X, "_level", lambda *a: calls.append(len(a[3])) or level(*a))
    for name, value in (("FEW_ROWS", 0), ("LOCAL_ROWS", 200), ("BLOCK_BYTES", 700), ("CHUNK_ROWS", 50)):
        monkeypatch.setattr(X, name, value)
    model, _ = fit(spark, x, y, 3, numTrees=2, minInstancesPerNode=3, maxDepth=4)
    assert len(calls) == 4      # no pass for the leaves of the last level
    for tree in range(2):
        want = slow_tree(x, y, 42, tree, 4, 3, 2, 4)
        got = nodes_of(model, tree)
        assert set(got) == set(want)
        assert all(got[k][:2] == v[:2] and got[k][2] == pytest.approx(v[2]) and got[k][3] == v[3] for k, v in want.items())


def test_rows_without_a_label_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0)], "a double, label double")
    with pytest.raises(ValueError):
        X.ExtraTreesRegressor().fit(VectorAssembler(inputCols=["a"], outputCol="features").transform(df))


@pytest.mark.parametrize("most", [1024, 60])
def test_rows_are_written_as_codes_and_plain_numbers(spark, monkeypatch, most):
    """a Parquet batch or an Arrow batch of blocks of a megabyte each held the rows of a whole task."""
    for name, value in (("FEW_ROWS", 0), ("LOCAL_ROWS", 40), ("CHUNK_ROWS", 90), ("MAX_CODES", most), ("CELLS", 12_000)):
        monkeypatch.setattr(X, name, value)
    written, write = [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda *a, **b: written.append(write(*a, **b)) or written[-1])
    x, y = table(600, 11)
    model, _ = fit(spark, x, y, 4, numTrees=2, minInstancesPerNode=3, maxDepth=5, seed=4)
    # b has more than 60 values; d is constant, so any other feature determines it
    row_bytes = 14 if most > 60 else 20
    assert len(written) == 1 and written[0].columns == ["n", "rows"]
    records = written[0].collect()
    assert sum(r["n"] for r in records) == 600
    assert {len(r["rows"]) for r in records} == {X.BLOCK_BYTES // row_bytes * row_bytes} and X.BLOCK_BYTES <= 4096
    for tree in range(2):
        slow = slow_tree(x, y, 4, tree, 4, 3, 2, 5)
        got = nodes_of(model, tree)
        assert set(got) == set(slow) and len(got) > 20
        assert all(got[k][:2] == v[:2] and got[k][2] == pytest.approx(v[2]) and got[k][3] == v[3] for k, v in slow.items())


def test_a_feature_is_dependent_only_if_it_is_so_in_all_rows(spark):
    """Third feature: told by the first within each partition, but not over both.  Fourth: told by the first everywhere."""
    rows = [([float(a), float(i), float(a % 2 if part else a % 3), float(a * a), float("-inf") if a else 0.0], 1.0) for part in (0, 1)
            for i in range(30) for a in range(6)]
    df = spark.createDataFrame(rows, "x array<double>, y double").coalesce(1)
    half = [spark.createDataFrame(rows[:180], df.schema).coalesce(1), spark.createDataFrame(rows[180:], df.schema).coalesce(1)]
    for source in (df, half[0].union(half[1])):
        lay, n = X.study(source)
        assert n == 360 and lay.raw == [] and set(lay.bases) == {0, 1, 2}
        assert lay.base_of[3] == lay.base_of[4] == lay.base_of[0] == lay.bases.index(0)
        assert lay.values[3].tolist() == [0, 1, 4, 9, 16, 25] and lay.values[4].tolist() == [0.0, *[float("-inf")] * 5]
        parts = source.withColumn("part", F.when(F.col("x")[0] > 3, 2).otherwise(1))
        got = X.coded_rows(parts, lay)
        assert {r["part"]: r["n"] for r in got.groupBy("part").agg(F.sum("n").alias("n")).collect()} == {1: 240, 2: 120}
        codes = []
        for b in got.select("n", "rows").toArrow().to_batches():
            for c, raws, y in X._chunks(iter([b]), lay):
                assert raws.shape == (0, len(y)) and set(y) == {1024.0}
                codes += c[[lay.bases.index(f) for f in range(3)]].T.tolist()
        assert sorted(codes) == sorted([int(v) for v in x[:3]] for x, _ in rows)


def test_folds_share_one_coded_table_and_have_the_trees_of_separate_fits(spark, monkeypatch):
    """rows were written anew in a form of their own for every fold and draw."""
    x, y = table(300, 13)
    rows = [(i, *map(float, r), float(v), i % 3 + 1) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    folded = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label double, fold int").repartition(4)
    spec = M.ModelSpec("x", "xrf", {"numTrees": 2, "minInstancesPerNode": 4})
    calls, study = [], X.study
    monkeypatch.setattr(X, "study", lambda *a: calls.append(1) or study(*a))
    fit = M.fold_fits(M.build_estimator(spec, FEATURES), folded)
    shared = {f: fit(f) for f in (1, 2, 3, None)}
    assert len(calls) == 1
    for fold, model in shared.items():
        alone = M.build_estimator(spec, FEATURES).fit(folded if fold is None else folded.where(F.col("fold") != fold))
        tables = [m.stages[-1].nodes.sort_values(["tree", "node"]).reset_index(drop=True) for m in (model, alone)]
        assert tables[0].equals(tables[1]) and len(tables[0]) > 20
    _, per_fold = M.cross_validate(folded, FEATURES, "id", [spec], k=3)
    assert {r["fold"]: r["n"] for r in per_fold.collect()} == {1: 100, 2: 100, 3: 100}
