"""Validation suites over staging, typed and fact tables (inventory Q1, Q2, Q9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthstat.functions.expressions import tag
from hearthstat.operators import quality
from hearthstat.operators.checks import Checks
from hearthstat.operators.reshape import rows_from, union_all
from hearthstat.operators.scale import stage
from hearthstat.plans.tracts import BATCHES, KEY
from hearthstat.sources.io import PERIODS, numeric_columns, text_columns

SOURCES = [code for codes in BATCHES.values() for code in codes]
BATCH_OF = {code: batch for batch, codes in BATCHES.items() for code in codes}
NAME_PATTERNS = {"stg": "stg_acs_{period}_{source}_raw", "int": "int_acs_{period}_{source}"}


def expected_tables(spark: SparkSession, layer: str, present: Sequence[str]) -> DataFrame:
    """Expected tables of a layer with batch and exists flag."""
    manifest = quality.table_manifest(spark, {s: PERIODS for s in SOURCES}, NAME_PATTERNS[layer], present)
    return manifest.withColumn("batch_group", tag("source", BATCH_OF, "other"))


def layer_suite(spark: SparkSession, layer: str, tables: Mapping[str, DataFrame], bridge: DataFrame) -> dict[str, DataFrame]:
    """Key, duplicate, coverage and missing checks of the tables of one layer, one scan per table (Q9)."""
    manifest = expected_tables(spark, layer, list(tables))
    spine = stage(bridge.select("year", "tract_geoid").distinct())
    suites, covered, missing = [], [], []
    for name, df in tables.items():
        columns = text_columns(df) if layer == "stg" else df.columns
        asked = Checks(df)
        quality.ask_suite(asked, ["tract_geoid"], "tract_geoid")
        asked.groups("bridge", {"year": F.col("year").cast("int"), "tract_geoid": F.col("tract_geoid")})
        asked.rows("missing", (), **quality.missing_counts(columns))
        found = asked.run()
        suites.append(quality.suite_row(name, found))
        covered.append(quality.reference_coverage(found["bridge"], spine, "tract_geoid", ["year"])
                       .where("source_keys > 0").select(F.lit(name).alias("table_name"), "*"))
        if columns:
            missing.append(quality.missing_rows(found["missing"], columns).select(F.lit(name).alias("table_name"), "*"))
    checks = union_all(suites).withColumns(dict(zip(("year", "source"), quality.parse_table_name("table_name"))))
    coverage, missing = union_all(covered), union_all(missing)
    wide = checks.agg(
        F.count(F.lit(1)).alias("discovered_table_count"),
        F.count_if(F.col("duplicate_groups") > 0).alias("tables_with_duplicate_geoids"))
    wide = wide.withColumns({
        "expected_table_count": manifest.agg(F.count(F.lit(1))).scalar(),
        "missing_table_count": manifest.agg(F.count_if(~F.col("table_exists"))).scalar(),
        "tables_with_bridge_mismatch": coverage.agg(F.count_if(F.col("missing_from_reference") > 0)).scalar()})
    summary = rows_from(wide, [], [
        {"layer": F.lit(layer), "metric": F.lit(c), "value": F.col(c).cast("bigint")} for c in sorted(wide.columns)])
    return {"manifest": manifest, "table_counts": checks, "bridge_coverage": coverage, "missing_profile": missing,
            "batch_coverage": quality.batch_coverage(manifest, ["year", "batch_group"]), "run_summary": summary}


def fact_suite(long: DataFrame, profile: DataFrame, bridge: DataFrame) -> dict[str, DataFrame]:
    """Checks of the long and the wide fact, one scan of each (Q9)."""
    long_key = [*KEY, "source_table", "metric_name"]
    spine = stage(bridge.select("year", "tract_geoid").distinct())
    of_long, of_profile = Checks(long.withColumn("source", F.lower("source_table"))), Checks(profile)
    quality.ask_suite(of_long, long_key, "tract_geoid")
    of_long.rows("missing", (), **quality.missing_counts([*long_key, "metric_value"])).rows("numeric", (), **quality.numeric_counts(["metric_value"]))
    of_long.groups("years", ["year"]).groups("sources", ["year", "source"]).groups("bridge", KEY)
    numbers = numeric_columns(profile, ["year"])
    quality.ask_suite(of_profile, KEY, "tract_geoid")
    of_profile.rows("missing", (), **quality.missing_counts(KEY)).rows("numeric", (), **quality.numeric_counts(numbers))
    of_profile.groups("years", ["year"])
    longs, profiles = of_long.run(), of_profile.run()
    flags = quality.grid_of(longs["sources"], "year", PERIODS, "source", SOURCES).withColumn("batch_group", tag("source", BATCH_OF, "other"))
    return {
        "long_keys": quality.suite_row("metric_long", longs), "long_key_missing": quality.missing_rows(longs["missing"], [*long_key, "metric_value"]),
        "long_year_counts": longs["years"], "long_year_source_counts": longs["sources"], "long_coverage_flags": flags,
        "long_batch_coverage": quality.batch_coverage(flags, ["year", "batch_group"], "is_present"),
        "long_numeric": quality.numeric_rows(longs["numeric"], ["metric_value"]),
        "long_bridge": quality.reference_coverage(longs["bridge"], spine, "tract_geoid", ["year"]),
        "profile_keys": quality.suite_row("tract_profile", profiles), "profile_key_missing": quality.missing_rows(profiles["missing"], KEY),
        "profile_year_counts": profiles["years"], "profile_numeric": quality.numeric_rows(profiles["numeric"], numbers),
        "profile_bridge": quality.reference_coverage(profiles["suite_keys"], spine, "tract_geoid", ["year"]),
    }
