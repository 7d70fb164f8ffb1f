"""Whole analyses on small synthetic inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.operators.scale import literal_table
from hearthstat.plans import analysis, geography, households, tracts, validation
from hearthstat.sources.io import PERIODS, dim_year

TRACTS = {2019: 8, 2021: 10, 2022: 10, 2023: 10}


def raw_table(spark, code, year, columns, seed):
    rng = np.random.default_rng([seed, year])
    rows = [("Geography", "Geographic Area Name", *["label"] * len(columns)), ("0100000US", "Nation", *["9"] * len(columns))]
    sep = "," if year <= 2021 else ";"
    for i in range(TRACTS[year] + 1):
        county = "019" if i < TRACTS[year] else "031"
        start = 1 if year == 2019 else 3  # two tracts disappear, four are new
        number = f"{start + i}.01"
        values = [str(round(float(v), 1)) for v in rng.uniform(1, 30, len(columns))]
        if i == 3:
            values = ["-"] * len(columns)
        rows.append((f"1400000US17{county}{(start + i) * 100 + 1:06d}",
                     f"Census Tract {number}{sep} Some County{sep} Some State", *values))
    return literal_table(spark, rows, ", ".join(f"`{c}` string" for c in ["GEO_ID", "NAME", *columns]))


@pytest.fixture(scope="module")
def acs(spark):
    needed = {code: set() for code in tracts.METRIC_GROUPS}
    for metric in [*tracts.V2_METRICS, *[m for t in tracts.CORE_TABLES.values() for m in t]]:
        for c in metric.sources:
            needed[c.split("_")[0]].add(c)
    needed["b03002"] |= set(tracts.RACE_COLUMNS)
    needed["s2401"] |= {"s2401_c01_001e", "s2401_c01_001m"}
    needed["dp04"] -= {"dp04_0010e"}
    raws, staged = {}, {}
    for n, code in enumerate(tracts.METRIC_GROUPS):
        for year in PERIODS:
            columns = [c.upper() for c in sorted(needed[code])]
            if code == "s2301" and year == 2023:
                columns.append("S2301_C09_001E")  # a column only one period has
            raws[code, year] = raw_table(spark, code, year, columns, n)
            staged[code, year] = tracts.stage_table(raws[code, year], code, year, "family", "DT", "17", "019")
    tables = {code: tracts.typed_table([staged[code, y] for y in PERIODS], code).cache() for code in tracts.METRIC_GROUPS}
    audit = tracts.audit_rows({y: raws["b19013", y] for y in PERIODS}, "17", "019")
    dims = {k: v.cache() for k, v in tracts.build_dimensions(audit).items()}
    return {"staged": staged, "tables": tables, "dims": dims}


@pytest.fixture(scope="module")
def profile_v2(spark, acs):
    first = tracts.tract_profile(acs["dims"], acs["tables"])
    return tracts.tract_profile_v2(first, acs["tables"]).cache()


def test_dimensions(acs):
    dim = {r.tract_geoid: r for r in acs["dims"]["dim_tract"].collect()}
    assert len(dim) == 12 and sum(r.is_stable_all_4_years for r in dim.values()) == 6
    row = dim["17019000301"]
    assert (row.tract_name_canonical, row.tract_number, row.county_name, row.year_count) == ("Census Tract 3.01", "3.01", "Some County", 4)
    assert acs["dims"]["bridge_tract_year"].count() == sum(TRACTS.values())
    assert acs["dims"]["name_conflicts"].select("tract_geoid").distinct().count() == 10


def test_typed_tables_follow_drift(acs):
    assert "s2301_c09_001e" not in acs["tables"]["s2301"].columns
    dp04 = acs["tables"]["dp04"]
    assert dict(dp04.dtypes)["other_vacant_units"] == "double" and dp04.where("other_vacant_units is not null").count() == 0


def test_long_fact(acs):
    long = tracts.metric_long(acs["tables"]).cache()
    checks = tracts.metric_long_checks(long, acs["dims"]["bridge_tract_year"])
    assert checks["duplicates"].first().duplicate_groups == 0
    assert {(r.missing_from_reference, r.missing_from_source) for r in checks["bridge"].collect()} == {(0, 0)}
    assert {r.metric_kind for r in checks["dictionary"].collect()} == {"derived"}
    assert long.where("metric_value is null").count() == 0


def test_wide_fact(acs, profile_v2):
    rows = {(r.year, r.tract_geoid): r for r in profile_v2.collect()}
    assert len(rows) == sum(TRACTS.values())
    bad = rows[2021, "17019000601"]  # every measure was '-'
    assert bad.median_household_income is None and bad.pct_rent_burden_30_plus is None
    assert bad.pct_hh_income_under_25k == 0.0 and bad.pct_some_college_or_associate is None
    assert (bad.has_core_housing_metrics, bad.has_batch2_metrics, bad.has_batch3_metrics) == (0, 1, 1)
    assert '"median_household_income":null' in bad.b19013_metrics_json
    s = {(r.year, r.tract_geoid): r for r in acs["tables"]["s1101"].collect()}
    for key, r in rows.items():
        later = key[0] >= 2021
        assert r.pct_one_person_households == (s[key].s1101_c01_013e if later else s[key].s1101_c01_012e)
        assert r.pct_households_with_65_plus == (s[key].s1101_c01_012e if later else None)
    audit = {(r.year, r.check_name): r.max_abs_diff for r in tracts.profile_v2_checks(profile_v2)["audit"].collect()}
    assert all(audit[y, "family_and_nonfamily"] < 0.02 and audit[y, "high_school_parts"] < 0.01 for y in PERIODS)


def test_missing_source_stops(acs, profile_v2):
    tables = dict(acs["tables"], s1601=acs["tables"]["s1601"].drop("s1601_c02_003e"))
    with pytest.raises(ValueError, match="s1601_c02_003e"):
        tracts.tract_profile_v2(profile_v2, tables)


def test_validation_suites(spark, acs, profile_v2):
    bridge = acs["dims"]["bridge_tract_year"]
    named = {f"stg_acs_{y}_{c}_raw": acs["staged"][c, y] for c in ("b19013", "b25003") for y in PERIODS}
    suite = validation.layer_suite(spark, "stg", named, bridge)
    summary = {r.metric: r.value for r in suite["run_summary"].collect()}
    assert summary["expected_table_count"] == 52 and summary["discovered_table_count"] == 8
    assert summary["missing_table_count"] == 44 and summary["tables_with_bridge_mismatch"] == 0
    assert suite["batch_coverage"].where("all_present").count() == 0
    facts = validation.fact_suite(tracts.metric_long(acs["tables"]), profile_v2, bridge)
    assert facts["long_batch_coverage"].where("all_present").count() == 12
    assert facts["profile_keys"].first().duplicate_groups == 0


def micro(spark):
    rng = np.random.default_rng(9)
    housing, persons = [], []
    for year, areas in households.AREAS.items():
        for i in range(60):
            area = int(rng.choice([*areas, 5000]))
            income = None if i % 11 == 0 else float(rng.integers(-1000, 90000))
            n = int(rng.integers(0, 5))
            housing.append((year, f"h{i}", 17 if i % 13 else 18, area, int(rng.integers(1, 200)), n, income, None, 1010000, 1, 1,
                            int(rng.integers(0, 3)), n, 0))
            for k in range(n):
                persons.append((year, f"h{i}", k, 17 if i % 13 else 18, area, int(rng.integers(1, 90)), 20 if k == 0 else 25,
                                int(rng.integers(1, 4)), int(rng.choice([14, 15, 16])), 20, int(rng.integers(1, 7))))
    return (
        literal_table(spark, housing, "year int, serialno string, state int, puma int, wgtp int, np int, hincp double, fincp double, "
                                      "adjinc int, hht int, hht2 int, noc int, npf int, fparc int"),
        literal_table(spark, persons, "year int, serialno string, sporder int, state int, puma int, agep int, relshipp int, sch int, "
                                      "schg int, schl int, esr int"))


def test_households(spark):
    housing, persons = micro(spark)
    raw, calibrated = households.thresholds(spark)
    final = households.household_final(households.household_profile(persons, housing), calibrated).cache()
    assert {r.year for r in final.select("year").distinct().collect()} == {2019, 2021, 2022, 2023}
    assert final.where("puma = 5000 or state <> 17 or hincp is null or np = 0").count() == 0
    part = final.where("puma = 1902 and year = 2022").first()
    assert part.analysis_weight == pytest.approx(part.wgtp * 0.218974)
    out = households.profiles(final)
    totals = {(r.year, r.source_variant): r for r in out["county_totals"].collect()}
    for year in PERIODS:
        a, b = totals[year, "complete_calibrated"], totals[year, "nonstudent_calibrated"]
        assert 0 <= b.below_households <= a.below_households <= a.county_total_households
    assert out["complete_profile"].where("metric_group <> 'composition_hh_comp_key'").count() == 13 * 4
    shares = out["complete_profile"].where("metric_group = 'composition_hh_comp_key'").groupBy("year").agg(
        F.sum("pct_of_households").alias("s")).collect()
    assert all(r.s == pytest.approx(100, abs=0.001) for r in shares)
    checks = households.validation_checks(final, raw, calibrated)
    assert {r.threshold_mismatch_rows for r in checks["01_calibrated_threshold_match"].collect()} == {0}
    assert all(abs(r.balance_check) < 1e-6 for r in checks["04_balance_check"].collect())
    pack = households.validation_pack(final, raw, calibrated)
    assert pack.select("validation_name").distinct().count() == 6


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    names = [n for n, _, _ in tracts.METRIC_SHEET]
    rows = []
    for year in PERIODS:
        for i in range(30):
            if year == 2019 and i >= 26:
                continue
            level = (i % 3) * 12.0
            values = [None if (i + j) % 29 == 0 else float(level + 5 + rng.normal(0, 1) + j) for j in range(len(names))]
            rows.append((year, f"17019{i:06d}", int(i < 26), f"Tract {i}", float(100 + 10 * i), *values))
    ddl = "year int, tract_geoid string, is_stable_all_4_years int, tract_name_canonical string, occupied_units double, "
    return literal_table(spark, rows, ddl + ", ".join(f"{n} double" for n in names)).cache()


def test_eda(panel):
    out = analysis.eda(panel, ["poverty_rate", "median_household_income", "pct_age_18_24"])
    assert out["summary"].count() == 12 and out["correlation"].count() == 9 and out["outliers"].count() == 3
    ranks = out["rankings"].groupBy("year", "metric", "rank_group").count().collect()
    assert all(r["count"] == 10 for r in ranks)
    assert out["zscores"].agg(F.abs(F.avg("z_poverty_rate"))).first()[0] < 1e-9


def test_panel_change(panel):
    out = analysis.panel_change(panel, ["poverty_rate", "median_household_income"])
    assert out["changes"].count() == 26 * 4 * 2 and out["wide"].count() == 52
    assert {r.metric_label for r in out["changes"].select("metric_label").distinct().collect()} == {
        "Poverty rate", "Median household income"}
    assert out["movers"].count() == 4 * 2 * 2 * 10


def test_clusters(panel):
    out = analysis.clusters(panel, ["poverty_rate", "median_household_income"], ks=[2, 3], restarts=2)
    assert {r.selected_k for r in out["selected_k"].collect()} == {3}
    assert out["assignments"].where("aligned_cluster_id is null").count() == 0
    summary = out["transition_summary"].collect()
    assert [r.entities_compared for r in summary] == [26] * 3
    assert all(r.entities_compared == r.stayed_same_count + r.changed_count for r in summary)
    assert out["profiles"].groupBy("year").agg(F.sum("entity_count").alias("n")).where("n not in (26, 30)").count() == 0


def test_allocation_to_models(spark, panel):
    totals = literal_table(spark, [(y, 1000.0 + y) for y in PERIODS], "year int, control_total double")
    out = analysis.allocation(panel, totals)
    assert all(r.sum_diff_abs < 1e-9 for r in out["validation"].collect())
    assert out["components"].select("metric").distinct().count() == 11
    geo = literal_table(spark, [("17019000001", "Some — Mixed", "Mixed", "Some"), ("17019000002", None, "Mixed", None)],
                        "tract_geoid string, display_area_label string, area_type string, primary_place string")
    final = analysis.final_outputs(out["estimates"], geo)
    assert final["flat"].count() == panel.count() and final["flat"].where("display_area_label is null").count() == 0
    assert final["top_bottom"].count() == 4 * 2 * 2 * 15
    assert final["group_summary"].where("group_name = 'area_type'").count() == 4
    small = {"forest": {"numTrees": 10, "minInstancesPerNode": 2, "maxDepth": 5, "seed": 42},
             "boost": {"maxIter": 5, "stepSize": 0.1, "maxDepth": 2, "seed": 42}}
    ml = analysis.ml_layer(out["estimates"], features=["poverty_rate", "median_household_income", "pct_age_18_24"], **small)
    assert ml["regression_metrics"].count() == 3 and ml["classification_metrics"].count() == 3
    # An area without the student proxy has no estimate, so it is no training or test row.
    known = {r.year: r["count"] for r in out["estimates"].where("estimated_rate_proxy_pct is not null").groupBy("year").count().collect()}
    assert ml["regression_predictions"].count() == 3 * known[2023]
    assert {(r.split, r.row_count) for r in ml["split_summary"].collect()} == {
        ("train", known[2019] + known[2021] + known[2022]), ("test", known[2023])}
    assert ml["error_summary"].count() == 5


def test_geography(spark):
    def square(name, x, y, s):
        return [(name, 0, i, x + dx * s, y + dy * s) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]

    ddl = "poly_id string, ring int, seq int, x double, y double"
    shapes = literal_table(spark, square("t1", 0.0, 0.0, 0.1) + square("t2", 0.5, 0.5, 0.1), ddl)
    places = literal_table(spark, square("Home city", -0.1, -0.1, 0.3), ddl)
    zips = literal_table(spark, square("61801", 0.4, 0.4, 0.3), ddl)
    dim = literal_table(spark, [("t1", "Census Tract 1"), ("t2", "Census Tract 2")], "tract_geoid string, tract_name_canonical string")
    context = literal_table(spark, [("t1", 45.0, 80.0)], "tract_geoid string, pct_age_18_24 double, pct_renter_occupied double")
    got = {r.tract_geoid: r for r in geography.geography_lookup(dim, context, shapes, places, zips).collect()}
    assert got["t1"].display_area_label == "Home — Student-dense area" and got["t1"].primary_zip is None
    assert got["t1"].landmark_context_note == "Higher student concentration; renter-heavy housing profile."
    assert got["t2"].primary_place == "Home" and got["t2"].primary_zip == "61801"  # nearest place, zip by location
    assert got["t2"].area_type == "Mixed residential area"
    assert got["t1"].centroid_lon == pytest.approx(0.05) and got["t1"].centroid_lat == pytest.approx(0.05, abs=1e-4)
    assert got["t1"].area_sqkm == pytest.approx((0.1 * np.pi / 180 * 6378.137) ** 2, rel=1e-4)


def test_period_dimension(spark):
    assert [r.year_label for r in dim_year(spark).orderBy("year").collect()] == [f"ACS {y} 5-Year" for y in PERIODS]
