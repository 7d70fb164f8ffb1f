"""The forms used for large or skewed groups give the same results as the plain ones."""

import datetime
import glob
import os
import re
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthstat.operators import ordered, quality, ranking, reshape, standardize
from hearthstat.operators import profile as pf
from hearthstat.operators import scale
from hearthstat.operators.scale import join_rows, join_small, literal_table


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds two thirds of the rows; values repeat; some are missing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 7}"
        value = None if i % 41 == 0 else float(rng.integers(0, 400)) / 4 if i % 5 else 50.0
        rows.append((i, group, value))
    return rows, literal_table(spark, rows, "id int, g string, v double")


@pytest.mark.parametrize("bins, few", [(2, 0), (7, 3), (1024, 4096)])
def test_quantiles(spark, skewed, bins, few):
    rows, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["g"]: r for r in ordered.quantiles(df, ["g"], "v", probs, bins, few).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(part["v"].quantile(p), abs=1e-9)


def test_quantiles_of_constant_and_empty_groups(spark):
    df = literal_table(spark, [("a", 2.0), ("a", 2.0), ("b", None), ("c", 7.0)], "g string, v double")
    for few in (0, 100):
        got = {r.g: r.m for r in ordered.quantiles(df, ["g"], "v", {"m": 0.5}, few=few).collect()}
        assert got == {"a": 2.0, "c": 7.0}
    assert ordered.quantiles(df.where("v is null"), ["g"], "v", {"m": 0.5}).count() == 0
    assert [tuple(r) for r in ordered.quantiles(df, [], "v", {"m": 0.5}).collect()] == [(2.0,)]


def test_quantiles_of_far_spread_values(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400), rng.integers(0, 3, 200), 1e9 + rng.random(400) * 1e-6, [5e-324, -5e-324]])
    df = literal_table(spark, [(None if i % 3 else "a", float(v)) for i, v in enumerate(values)], "g string, v double")
    probs = {f"p{i}": i / 40 for i in range(41)}
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for bins, few in ((1024, 5), (3, 1)):
        assert sorted(map(repr, ordered.quantiles(df, ["g"], "v", probs, bins, few).collect())) == sorted(map(repr, want))


def test_a_pass_looks_into_wanted_ranges_only(spark):
    df = spark.range(200_000).selectExpr("'hot' AS g", "pow(1.0001, id) AS v")
    got = ordered.quantiles(df, ["g"], "v", {"m": 0.5}, bins=16, few=100)
    assert got.first().m == df.agg(F.percentile("v", 0.5)).first()[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all("_before#" in w.split(" ASC")[0] for w in windows)  # within one range of at most ``few`` values, never a group
    few = got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [g#")
    assert few == 1 and "Sort [" not in plan


@pytest.mark.parametrize("limit", [0, 10**6])
def test_dense_ranks(spark, skewed, limit):
    rows, df = skewed
    got = {r.id: (r.rank_asc, r.rank_desc) for r in ranking.dense_ranks(df, ["g"], "v", group_rows=limit).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).dropna()
    up, down = pdf.groupby("g")["v"].rank("dense"), pdf.groupby("g")["v"].rank("dense", ascending=False)
    assert got == {i: (int(a), int(b)) for i, a, b in zip(pdf.id, up, down)}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_totals_below(spark, limit):
    rows = [("x", float(v), v % 3 + 1) for v in range(200)] + [("y", 5.0, 2)]
    df = literal_table(spark, rows, "g string, v double, n int")
    got = {(r.g, r.v): r.below for r in ordered.totals_below(df, ["g"], "v", {"below": F.col("n")}, limit).collect()}
    seen = 0
    for g, v, n in rows[:200]:
        assert got[g, v] == seen
        seen += n
    assert got["y", 5.0] == 0


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("max_rows", [1, 3, 1000])
def test_join_small_bounds(spark, skewed, how, max_rows):
    _, df = skewed
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("g <> 'g3'")
    want = {(r.id, r.n) for r in df.join(small, "g", how).collect()}
    got = {(r.id, r.n) for r in join_small(df, small, ["g"], how, max_rows).collect()}
    assert got == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_rows_keeps_every_row(spark, skewed, how):
    _, df = skewed
    other = df.select("g", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).distinct().where("g <> 'g2'")
    want = sorted((r.id, r.k or 0) for r in df.join(other, "g", how).collect())
    assert sorted((r.id, r.k or 0) for r in join_rows(df, other, ["g"], how).collect()) == want


def test_a_wide_small_table_is_not_broadcast(spark, skewed):
    _, df = skewed
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("wide", F.repeat(F.lit("x"), 1000))
    joined = join_small(df, small, ["g"], max_bytes=2000)
    assert joined.count() == df.count() and "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()


ODD = {"double": [1.0, 1.0, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, None, 2.5], "string": ["b", "a", "", None, "é", "B", "10", "9", "a"],
       "date": [None, *[datetime.date(2020, 1, d) for d in (5, 1, 5, 9, 2, 3, 4, 7)]], "decimal(20,4)": [None, *[Decimal(x) for x in "1.5 -2 7 7 0 3.25 1.5 9".split()]]}


@pytest.mark.parametrize("kind", list(ODD))
def test_both_ways_agree_on_odd_values(spark, kind):
    rows = [("x", v) for v in ODD[kind]] + [("y", v) for v in ODD[kind][:3]] + [(None, ODD[kind][1])]
    df = literal_table(spark, rows, f"g string, v {kind}")
    small, large = ([repr(r) for r in ranking.dense_ranks(df, ["g"], "v", group_rows=n).collect()] for n in (10**6, 0))
    assert sorted(small) == sorted(large) and small
    if kind in ("double", "decimal(20,4)"):
        probs = {f"p{i}": i / 8 for i in range(9)}
        one = df.where("v is not null").groupBy("g").agg(*[F.percentile(F.col("v").cast("double") + 0.0, p).alias(n) for n, p in probs.items()])
        two = ordered.quantiles(df, ["g"], "v", probs, bins=4, few=1)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_a_group_that_grows_is_dealt_over_more_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for n in (1_000, 100_000):
            df = spark.range(n).selectExpr("'hot' AS g", "id % 50000 + id / 1e7 AS v")
            placed = ordered.positions(df, ["g"], ["v"], {"before": F.lit(1)}).withColumn("part", F.spark_partition_id())
            assert placed.agg(F.max("before"), F.countDistinct("before")).first() == (n - 1, n)
            stretch = spark.read.parquet(sorted(glob.glob(scale.stage_root(spark).removeprefix("file:") + "/*"), key=os.path.getmtime)[-1])
            assert stretch.groupBy("_part").count().agg(F.max("count")).first()[0] < 3 * n / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_group_finds_its_statistics(spark):
    df = literal_table(spark, [(None, 1.0), (None, 3.0), (1, 5.0)], "y int, v double")
    got = scale.attach(df, ["y"], m=F.avg("v")).collect()
    assert sorted((r.v, r.m) for r in got) == [(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)]


def test_stages_lie_in_the_shared_folder_and_can_be_cleared(spark):
    assert scale.stage_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = scale.stage(spark.range(5).toDF("a"))
    assert kept.count() == 5 and kept.inputFiles()[0].startswith(scale.stage_root(spark))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_scan_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id % 4 AS year", "cast(id AS double) AS a", "cast(id * 2 AS double) AS b").write.parquet(path)
    df = spark.read.parquet(path)
    frames = [pf.missingness(df, ["year"], ["a", "b"]), pf.correlation_matrix(df, ["year"], ["a", "b"]),
              quality.missing_profile(df, ["a", "b"]), quality.numeric_profile(df, ["a", "b"]),
              pf.stable_comparison(df, ["year"], F.col("a") > 3, ["a", "b"]), reshape.to_long(df, ["year"], ["a", "b"])]
    for frame in frames:
        assert plan(frame).count("FileScan parquet") == 1


def test_group_statistics_need_no_window_and_no_shuffle_of_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 4 AS year", "cast(id AS double) AS a").write.parquet(path)
    text = plan(standardize.zscores(spark.read.parquet(path), ["year"], ["a"]))
    assert "Window" not in text and "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_top_n_limits_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 4 AS year", "cast(id AS double) AS a").write.parquet(path)
    df = spark.read.parquet(path)
    text = plan(ranking.top_n(df, ["year"], [F.desc("a"), F.asc("id")], 3))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert ranking.top_and_bottom(df, ["year"], "a", ["id"], 3).count() == 24
