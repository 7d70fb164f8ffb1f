import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from hearthstat.operators import forest, ml
from hearthstat.operators.scale import literal_table, stage

NAMES = ["a", "b", "c"]


def made(spark, n, seed, noise=0.3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n), np.round(rng.normal(size=n), 3), rng.integers(0, 40, n)], axis=1).astype(float)
    y = x[:, 0] * 2 + np.sin(x[:, 1] * 2) * 3 + (x[:, 2] > 25) + noise * rng.normal(size=n)
    rows = [(i, *map(float, v), float(t), int(t > 6)) for i, (v, t) in enumerate(zip(x, y))]
    return literal_table(spark, rows, "id int, a double, b double, c double, t double, risk int")


def binned(spark, n=500, seed=1):
    df = made(spark, n, seed)
    cuts = forest.cut_points(df, NAMES)
    rows = df.select("id", F.col("t").alias("_y"), F.array(*NAMES).alias("x"))
    return cuts, stage(forest.coded(rows, "x", cuts, ["id", "_y"]).repartition(3, "id"))


def values(result):
    return {tuple(r["_cell"]): r["value"] for r in result[0].collect()}


def test_whole_forest_takes_few_jobs(spark):
    """400 trees to depth 30 with leaves of two rows; jobs once followed the number of nodes."""
    df, sc = made(spark, 4000, 3, noise=3.0), spark.sparkContext
    sc.setJobGroup("whole-forest", "whole forest")
    try:
        got, importance = ml.fit_regression(df, df, NAMES, "t", ["id"], models=["random_forest"])
        assert got.count() == 4000
        jobs = len(sc.statusTracker().getJobIdsForGroup("whole-forest"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    assert sum(r.importance for r in importance.collect()) == pytest.approx(1.0)
    assert ml.regression_metrics(got).first().r2 > 0.7


def plain_tree(cells, n, s, depth, least):
    """Leaf value per cell by trying every split of every node; the sum of gains."""
    out, total = np.full(len(cells), s.sum() / n.sum()), 0.0
    best = (1e-9, None, None)
    for f in range(cells.shape[1]):
        for b in range(31):
            left = cells[:, f] <= b
            if min(n[left].sum(), n[~left].sum()) >= least:
                gain = s[left].sum() ** 2 / n[left].sum() + s[~left].sum() ** 2 / n[~left].sum() - s.sum() ** 2 / n.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    if depth and best[1] is not None:
        total += best[0]
        left = cells[:, best[1]] <= best[2]
        for side in (left, ~left):
            out[side], more = plain_tree(cells[side], n[side], s[side], depth - 1, least)
            total += more
    return out, total


@pytest.mark.parametrize("depth, least", [(30, 2), (3, 1), (0, 1), (30, 9)])
def test_tree_by_brute_force(depth, least):
    rng = np.random.default_rng(depth + least)
    cells = np.unique(rng.integers(0, [4, 12, 30], (150, 3)), axis=0).astype(np.uint8)
    n = rng.integers(1, 5, len(cells)).astype(float)
    s = n * rng.normal(100, 5, len(cells))
    want, total = plain_tree(cells, n, s, depth, least)
    got, gains = forest._grow(cells, n, s, cells, depth, least, 3, 32, rng)
    assert np.allclose(got, want) and gains.sum() == pytest.approx(total)


def test_equal_labels_make_one_leaf():
    cells = np.arange(20, dtype=np.uint8).reshape(-1, 1)
    n = np.arange(1.0, 21.0)
    got, gains = forest._grow(cells, n, n * 0.1, cells, 30, 1, 1, 32, np.random.default_rng(0))
    assert np.allclose(got, 0.1) and not gains.any()


def test_large_nodes_split_by_all_tasks_give_the_same_trees(spark):
    cuts, rows = binned(spark, 200)
    options = {"numTrees": 3, "maxDepth": 30, "minInstancesPerNode": 2, "seed": 7}
    whole = forest.fit(rows, rows, cuts, 3, **options)
    for limits in ({"node_cells": 60}, {"held": 1}):
        other = forest.fit(rows, rows, cuts, 3, **options, **limits)
        a, b = values(whole), values(other)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
        assert other[1] == pytest.approx(whole[1])


def test_depth_holds_where_large_nodes_are_split_first(spark):
    cuts, rows = binned(spark)
    for depth in (0, 2):
        options = {"numTrees": 3, "maxDepth": depth, "minInstancesPerNode": 1, "seed": 7}
        a, b = (values(forest.fit(rows, rows, cuts, 3, **options, node_cells=k)) for k in (10**6, 100))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_blocks_of_trees_count_every_tree(spark):
    cuts, rows = binned(spark)
    options = {"numTrees": 60, "maxDepth": 4, "minInstancesPerNode": 2, "seed": 7}
    a, b = values(forest.fit(rows, rows, cuts, 3, **options)), values(forest.fit(rows, rows, cuts, 3, **options, block=20 * 1000))
    assert a.keys() == b.keys() and np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.98
    assert np.mean(list(a.values())) == pytest.approx(np.mean(list(b.values())), abs=0.1)


def test_bootstrap_draws_every_row_once_on_average(spark):
    _, rows = binned(spark, 2000)
    pieces = rows.select("_cell", "_y").mapInArrow(forest._bag(range(0, 50), 1, 10**6), forest.PIECE).collect()
    drawn = np.bincount([p.tree for p in pieces], [np.frombuffer(p.n, np.int32).sum() for p in pieces])
    assert len(drawn) == 50 and len(set(drawn)) > 10 and abs(drawn.mean() - 2000) < 5 * np.sqrt(2000 / 50)


def test_forest_is_as_good_as_the_library(spark):
    train, test = made(spark, 1500, 11), made(spark, 700, 12)
    options = {"numTrees": 40, "maxDepth": 12, "minInstancesPerNode": 2, "seed": 5}
    got, importance = ml.fit_regression(train, test, NAMES, "t", ["id"], models=["random_forest"], forest=options)
    assemble = VectorAssembler(inputCols=NAMES, outputCol="_x")
    model = RandomForestRegressor(featureSubsetStrategy="all", labelCol="t", featuresCol="_x", **options).fit(assemble.transform(train))
    want = model.transform(assemble.transform(test)).select("id", "prediction", "t").orderBy("id").toArrow().to_pydict()
    mine = got.orderBy("id").toArrow().to_pydict()["predicted_target"]
    t, w, g = np.array(want["t"]), np.array(want["prediction"]), np.array(mine)
    assert np.sqrt(((t - g) ** 2).mean()) < 1.15 * np.sqrt(((t - w) ** 2).mean())
    assert np.corrcoef(g, w)[0, 1] > 0.99
    by_name = {r.feature: r.importance for r in importance.collect()}
    assert np.allclose([by_name[f] for f in NAMES], model.featureImportances.toArray(), atol=0.03)


@pytest.mark.parametrize("options", [{}, {"maxBins": 32}])
def test_boosting_on_equal_bins_equals_boosting_on_rows(spark, options):
    cuts, rows = binned(spark, 800)
    boost = {"maxIter": 5, "stepSize": 0.1, "maxDepth": 3, "seed": 42}
    model, x = ml._boosted(GBTRegressor(**boost, **options), rows, boost | options, False)
    one_by_one = rows.select("_y", x)
    want = GBTRegressor(**boost, labelCol="_y", featuresCol="_x").fit(one_by_one)
    a, b = (np.array([r.prediction for r in m.transform(rows.select("id", "_y", x)).orderBy("id").collect()]) for m in (model, want))
    assert np.allclose(a, b) and np.allclose(model.featureImportances.toArray(), want.featureImportances.toArray())


def test_classes_follow_their_shares(spark):
    train, test = made(spark, 1200, 21), made(spark, 500, 22)
    got, importance = ml.fit_classification(train, test, NAMES, "risk", ["id"], models=["random_forest", "gradient_boosting"],
                                            forest={"numTrees": 30, "maxDepth": 30, "minInstancesPerNode": 2, "seed": 1}, boost={"maxIter": 5, "seed": 1})
    for r in got.collect():
        assert 0 <= r.predicted_probability <= 1 and r.predicted_class == int(r.predicted_probability > 0.5)
    assert all(r.roc_auc > 0.9 for r in ml.classification_metrics(got).collect())
    sums = importance.groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert len(sums) == 2 and all(r.s == pytest.approx(1.0) for r in sums)


def test_cuts_keep_few_values_apart_and_spend_what_frequent_values_leave(spark):
    rows = [(float(i % 32), float(0 if i % 10 else i), float(i), 7.0) for i in range(3200)]
    df = literal_table(spark, rows, "few double, frequent double, all double, one double")
    few, frequent, every, one = forest.cut_points(df, ["few", "frequent", "all", "one"])
    assert [int(np.searchsorted(few, v, side="left")) for v in range(32)] == list(range(32))
    assert len(frequent) == 31 and len(every) == 31
    assert np.allclose(np.diff(np.searchsorted(np.arange(3200), every, side="right")), 100, atol=1)
    assert len(set(np.searchsorted(one, [7.0], side="left"))) == 1


def test_labels_must_be_numbers(spark):
    cuts, rows = binned(spark, 50)
    with pytest.raises(Exception, match="labels must be finite"):
        forest.fit(rows.withColumn("_y", F.lit(None).cast("double")), rows, cuts, 3, numTrees=2)
