"""Tables stored by key, one-scan profiles and the lineage of metrics."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.operators import checks, colocate, metrics, profile
from hearthstat.operators.metrics import Metric
from hearthstat.operators.scale import literal_table, stage
from hearthstat.plans import households, tracts, validation


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_of_stored_tables_needs_no_exchange(spark, no_broadcast):
    keys = ["year", "area"]
    spine = literal_table(spark, [(y, a) for y in (1, 2, 3) for a in range(50)] + [(None, 7)], "year int, area long")
    parts = {f"star_{i}": literal_table(spark, [(y, a, float(a * i + y)) for y in (1, 2, 3) for a in range(0, 50, i + 1)], f"year int, area long, v{i} double")
             for i in range(13)}
    colocate.save(spine, "star_spine", keys, 4)
    for name, df in parts.items():
        colocate.save(df, name, keys, 4)
    try:
        assert colocate.buckets_of(spark, "star_spine") == (4, keys)
        out = colocate.star(spark, "star_spine", {name: [f"v{i}"] for i, name in enumerate(parts)}, keys)
        text = plan(out)
        assert "Exchange" not in text and text.count("SortMergeJoin") == 13
        rows = {(r.year, r.area): r for r in out.collect()}
        assert len(rows) == 151 and rows[None, 7].v3 is None
        assert all(rows[y, a][f"v{i}"] == (float(a * i + y) if a % (i + 1) == 0 else None) for y in (1, 2, 3) for a in range(50) for i in range(13))
        colocate.save(parts["star_1"], "star_odd", keys, 3)
        with pytest.raises(ValueError, match="star_odd"):
            colocate.star(spark, "star_spine", {"star_odd": ["v1"]}, keys)
        with pytest.raises(ValueError, match="star_spine"):
            colocate.star(spark, "star_spine", {}, ["area"])
    finally:
        colocate.drop(spark, ["star_spine", "star_odd", *parts])
    assert not spark.catalog.tableExists("star_spine")


def test_the_wide_fact_of_stored_tables_is_shuffled_for_its_dimension_only(spark, no_broadcast):
    key = [(2019, "t1"), (2019, "t2"), (2023, "t1")]
    tables = {"b19013": literal_table(spark, [(*k, 5.0, 1) for k in key], "year int, tract_geoid string, median_household_income double, has_x int"),
              "b25003": literal_table(spark, [(*key[0], 3.0)], "year int, tract_geoid string, occupied_units double"),
              "b25070": literal_table(spark, [(*key[0], 3.0)], "year int, tract_geoid string, renter_hh_rent_burden_base double"),
              "dp04": literal_table(spark, [(*key[0], 3.0)], "year int, tract_geoid string, housing_units_total double")}
    tables |= {c: literal_table(spark, [(*key[1], 2.0)], f"year int, tract_geoid string, {c}_c01_001e double") for c in tracts.METRIC_GROUPS
               if c not in tables and c != "b03002"}
    tables["b03002"] = literal_table(spark, [(*key[2], 9.0, 1.0, 2.0, 3.0, 4.0)], "year int, tract_geoid string, " + ", ".join(f"{c} double" for c in tracts.RACE_COLUMNS))
    stored = tracts.store_typed({"spine": literal_table(spark, key, "year int, tract_geoid string"), **tables}, "stored_test", 3)
    try:
        spine = stored.pop("spine")
        fact = tracts.tract_profile({"bridge_tract_year": spine, "dim_tract": literal_table(spark, [("t1", "a"), ("t2", "b")], "tract_geoid string, name string")}, stored)
        assert len(re.findall(r"Exchange hashpartitioning", plan(fact))) == 2  # the fact and the dimension, by tract
        rows = {(r.year, r.tract_geoid): r for r in fact.collect()}
        assert rows[2019, "t1"].has_core_housing_metrics == 1 and rows[2019, "t2"].s1101_metrics_json == '{"s1101_c01_001e":2.0}'
        assert fact.columns[:4] == ["year", "tract_geoid", "year_label", "acs_dataset"]
    finally:
        colocate.drop(spark, [f"stored_test_{c}" for c in ["spine", *tables]])


# Profiles

HOUSEHOLDS = ("year int, analysis_weight double, person_count int, np int, adult_count int, noc int, hincp_adj_real double, annual_threshold double, "
              "student_heavy_flag int, has_any_student int, has_any_likely_college_student int, reference_person_student_flag int, "
              "has_any_employed_person int, hh_comp_key string, below_flag int")


def test_both_profiles_come_from_one_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2019, 2021)), float(rng.random()) if i % 9 else None, int(rng.integers(1, 6)) if i % 5 else None, 2, int(rng.integers(1, 4)), int(rng.integers(0, 3)),
             float(rng.integers(0, 40) * 1000) if i % 11 else None, 30000.0, int(i % 3 == 0) if i % 10 else None, *[int(v) for v in rng.integers(0, 2, 4)],
             f"k{i % 4}" if i % 6 else None, int(rng.integers(0, 2)) if i % 8 else None) for i in range(600)]
    literal_table(spark, rows, HOUSEHOLDS).write.parquet(f"{tmp_path}/households")
    households = spark.read.parquet(f"{tmp_path}/households")
    seen = []
    monkeypatch.setattr(profile, "stage", lambda df: seen.append(df) or stage(df))
    out = profile.survey_profiles(households)
    reads = [df for df in seen if f"{tmp_path}/households" in str(df.inputFiles())]
    assert len(reads) == 1 and reads[0]._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert all(f"{tmp_path}/households" not in str(df.inputFiles()) for df in out.values())  # the rest reads the cube

    for name, keep in (("complete", lambda r: True), ("nonstudent", lambda r: not r[8])):
        got = {(r.year, r.metric_group, r.metric_name): (r.metric_value, r.pct_of_households) for r in out[name].collect()}
        for year in (2019, 2020):
            pop = [r for r in rows if r[0] == year and r[-1] == 1 and keep(r)]
            w = [r[1] for r in pop]
            total = sum(x for x in w if x is not None)
            assert got[year, "overall", "weighted_households"][0] == pytest.approx(total, abs=1e-4)
            assert got[year, "overall", "unweighted_records"][0] == len(pop)
            assert got[year, "income", "median_real_income_unweighted"][0] == pytest.approx(np.median([r[6] for r in pop if r[6] is not None]))
            assert got[year, "income", "weighted_avg_real_income"][0] == pytest.approx(sum((x or 0) * (r[6] or 0) for x, r in zip(w, pop)) / total, abs=1e-2)
            share = sum(x for x, r in zip(w, pop) if x is not None and r[9] == 1)
            assert got[year, "student_labor", "share_has_any_student"] == pytest.approx((share, 100 * share / total), abs=1e-3)
            part = sum(x for x, r in zip(w, pop) if x is not None and r[13] == "k1")
            assert got[year, "composition_hh_comp_key", "k1"][0] == pytest.approx(part, abs=1e-3)
    totals = {(r.year, r.source_variant): r.below_households for r in out["county_totals"].collect()}
    assert totals == {(r.year, r.source_variant): r.below_households for r in profile.county_totals(households).collect()}


# Lineage


def test_names_in_an_expression():
    read = metrics.referenced("case when year >= 2021 then round(100.0D * `odd name` / a_1, 2) when b is not null and c like 'x d''e' then coalesce(a_1, 1e5) end")
    assert read == ["year", "odd name", "a_1", "b", "c"]


def test_declared_sources_of_the_library_are_what_is_read():
    every = [*tracts.V2_METRICS, *[m for table in tracts.CORE_TABLES.values() for m in table]]
    assert {n: found for n, found in metrics.wrong_sources(every).items() if found != (["year"], [])} == {}
    wrong = [Metric("a", "g", "x + y", ("x",)), Metric("b", "g", "x", ("x", "z")), Metric("c", "g", "x", ("x",))]
    assert metrics.wrong_sources(wrong) == {"a": (["y"], []), "b": ([], ["z"])}


def test_lineage_closes_over_derived_metrics(spark):
    specs = [Metric("c", "g", "a - b", ("a", "b")), Metric("a", "g", "x + y", ("x", "y")), Metric("b", "g", "a * z", ("a", "z")), Metric("x", "g", "x * 2", ("x",))]
    assert [[s.name for s in layer] for layer in metrics.in_order(specs)] == [["x"], ["a"], ["b"], ["c"]]
    reach = {(r.metric, r.column_name): (r.steps, r.direct) for r in metrics.closed_lineage(spark, specs).collect()}
    assert reach[("c", "z")] == (2, False) and reach[("c", "x")] == (4, False) and reach[("b", "z")] == (1, True) and len(reach) == 9
    assert metrics.affected(specs, "z") == ["b", "c"]
    with pytest.raises(ValueError, match="read each other"):
        metrics.in_order([Metric("p", "g", "q + 1", ("q",)), Metric("q", "g", "p + 1", ("p",))])
    with pytest.raises(ValueError, match="repeat"):
        metrics.in_order([specs[0], specs[0]])
    df = literal_table(spark, [(1, 2.0, 3.0, 4.0)], "id int, x double, y double, z double")
    chain = [s for s in specs if s.name != "x"]
    assert tuple(metrics.project_all(df, chain, ["id"]).first()) == (1, 5.0, 20.0, -15.0)


# Checks


def scans(df, path):
    return sum(path in str(f) for f in df.inputFiles())


@pytest.fixture
def staged(monkeypatch):
    """Frames that are written, in order."""
    seen = []
    monkeypatch.setattr(checks, "stage", lambda df: seen.append(df) or stage(df))
    return seen


def test_many_checks_are_one_scan(spark, tmp_path, staged):
    rows = [(2019, "a", 1.0), (2019, "a", None), (2019, None, 3.0), (2020, " ", -4.0), (None, "b", 5.0), (2020, "c", 0.0)]
    literal_table(spark, rows, "year int, k string, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    asked = checks.Checks(df).rows("all", nulls=F.count_if(F.col("v").isNull()), top=F.max("v")).rows("years", ["year"], total=F.sum("v"))
    asked.groups("keys", ["k", "year"]).groups("upper", {"letter": F.upper("k")})
    found = asked.run()
    assert len(staged) == 1 and staged[0]._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [tuple(r) for r in found["all"].collect()] == [(6, 1, 5.0)]
    assert {tuple(r) for r in found["years"].collect()} == {(2019, 3, 4.0), (2020, 2, -4.0), (None, 1, 5.0)}
    assert {tuple(r) for r in found["keys"].collect()} == {("a", 2019, 2), (None, 2019, 1), (" ", 2020, 1), ("b", None, 1), ("c", 2020, 1)}
    assert {r.letter for r in found["upper"].collect()} == {"A", None, " ", "B", "C"}
    assert tuple(checks.excess(found["keys"]).first()) == (1, 1)
    empty = checks.Checks(df.where("false")).rows("all", nulls=F.count_if(F.col("v").isNull()), top=F.max("v")).groups("keys", ["k"]).run()
    assert [tuple(r) for r in empty["all"].collect()] == [(0, 0, None)] and empty["keys"].count() == 0
    with pytest.raises(ValueError, match="two things"):
        checks.Checks(df).groups("a", ["k"]).groups("b", {"k": F.upper("k")})
    with pytest.raises(ValueError, match="already"):
        checks.Checks(df).groups("a", ["k"]).groups("a", ["v"])


def test_suites_read_each_table_once(spark, tmp_path, staged):
    key = [(y, f"1701900{i:04d}") for y in (2019, 2021) for i in range(5)]
    for name, rows in {"one": [*key, key[0]], "two": key[:3]}.items():
        literal_table(spark, [(str(y), t, "x") for y, t in rows], "year string, tract_geoid string, v string").write.parquet(f"{tmp_path}/{name}")
    tables = {f"stg_acs_2019_{c}_raw": spark.read.parquet(f"{tmp_path}/{n}") for c, n in (("b19013", "one"), ("b25003", "two"))}
    suite = validation.layer_suite(spark, "stg", tables, literal_table(spark, key, "year int, tract_geoid string"))
    for name in ("one", "two"):
        assert sum(scans(df, f"{tmp_path}/{name}") > 0 for df in staged) == 1
        assert all(not scans(df, f"{tmp_path}/{name}") for df in suite.values())
    rows = {r.source: r for r in suite["table_counts"].collect()}
    assert (rows["b19013"].row_count, rows["b19013"].distinct_keys, rows["b19013"].duplicate_groups, rows["b19013"].duplicate_rows) == (11, 5, 5, 6)
    assert {(r.table_name[-10:-4], r.year, r.missing_from_source) for r in suite["bridge_coverage"].collect()} == {
        ("b19013", 2019, 0), ("b19013", 2021, 0), ("b25003", 2019, 2)}


def test_household_checks_read_the_final_table_once(spark, tmp_path, staged):
    ddl = ("year int, analysis_weight double, hincp_adj_real double, hh_comp_key string, annual_threshold double, below_flag int, student_heavy_flag int")
    rows = [(2019, 2.0, 5.0, "other", 10.0, 1, 0), (2019, 3.0, None, "other", 11.0, 0, 1), (2021, 1.0, 7.0, "x", None, 1, 1), (2021, 4.0, 7.0, "x", 5.0, None, None)]
    literal_table(spark, rows, ddl).write.parquet(f"{tmp_path}/final")
    final = spark.read.parquet(f"{tmp_path}/final")
    table = literal_table(spark, [(2019, "other", 10.0), (2021, "x", 5.0)], "year int, hh_comp_key string, annual_threshold double")
    found = households.validation_checks(final, *households.thresholds(spark)[:1], table)
    assert len(staged) == 1 and staged[0]._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert all(not scans(df, f"{tmp_path}/final") for df in found.values())
    assert {tuple(r) for r in found["01_calibrated_threshold_match"].collect()} == {(2019, 2, 1), (2021, 2, 1)}
    assert {tuple(r) for r in found["04_balance_check"].collect()} == {(2019, 5.0, 2.0, 3.0, 0.0), (2021, 5.0, 1.0, 0.0, 4.0)}
    assert {tuple(r) for r in found["06_nonstudent_filter_impact"].collect()} == {(2019, 2.0, 2.0, 0.0, 0.0), (2021, 1.0, 0.0, 1.0, 100.0)}
    assert {(r.year, r.null_hincp_adj_real, r.null_annual_threshold) for r in found["03_final_table_null_check"].collect()} == {(2019, 1, 0), (2021, 0, 1)}
