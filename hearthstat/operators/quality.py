"""Data-quality checks over tables (inventory Q1-Q13, J8-J11, U5, P37)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.functions.expressions import has_text, is_blank
from hearthstat.operators.checks import Checks, excess
from hearthstat.operators.reshape import rows_from, union_all
from hearthstat.operators.scale import join_small, literal_table


def table_manifest(spark: SparkSession, expected: Mapping[str, Sequence[int]], pattern: str,
                   present: Sequence[str]) -> DataFrame:
    """One row per expected table with an exists flag (Q1). ``expected`` maps a source to its periods."""
    known = {t.lower() for t in present}
    rows = []
    for source, periods in expected.items():
        for period in periods:
            name = pattern.format(period=period, source=source)
            rows.append((name, int(period), source, name.lower() in known))
    return literal_table(spark, rows, "table_name string, year int, source string, table_exists boolean")


def parse_table_name(name: Column | str) -> list[Column]:
    """Period and source code out of a table name such as int_acs_2019_b19013 (Q13)."""
    pattern = r"_(\d{4})_([a-z0-9]+?)(_raw)?$"
    return [F.regexp_extract(name, pattern, 1).try_cast("int").alias("year"),
            F.regexp_extract(name, pattern, 2).alias("source")]


def batch_coverage(manifest: DataFrame, by: Sequence[str], exists: str = "table_exists") -> DataFrame:
    """Expected against present tables per group (Q2)."""
    found = F.count_if(F.col(exists))
    return manifest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected_tables"), found.alias("present_tables"),
        (found == F.count(F.lit(1))).alias("all_present"))


def key_checks(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct filled keys, null keys and blank keys in one aggregate (Q3)."""
    text = F.trim(F.col(key).cast("string"))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(F.when(has_text(key), text)).alias("distinct_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(F.col(key).isNotNull() & (text == "")).alias("blank_keys"))


def duplicate_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups that occur more than once and the excess rows (Q4)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(F.count(F.lit(1)).alias("duplicate_groups"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def reference_coverage(source: DataFrame, reference: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys on each side, matched, and missing either way.

    Both sides are stacked and aggregated by key, so a key with very many rows is combined before
    the shuffle instead of meeting a join.
    """
    def side(df: DataFrame, s: int, r: int) -> DataFrame:
        return df.select(*by, key).where(has_text(key)).withColumns({"_s": F.lit(s), "_r": F.lit(r)})

    seen = side(source, 1, 0).unionByName(side(reference, 0, 1)).groupBy(*by, key).agg(
        F.max("_s").alias("_s"), F.max("_r").alias("_r"))
    both = F.col("_s") * F.col("_r")
    return seen.groupBy(*by).agg(
        F.sum("_s").alias("source_keys"), F.sum("_r").alias("reference_keys"), F.sum(both).alias("matched_keys"),
        F.sum(F.col("_s") - both).alias("missing_from_reference"),
        F.sum(F.col("_r") - both).alias("missing_from_source"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and blank counts of every column in one scan; the share is a fraction of 1 (Q6)."""
    return missing_rows(df.agg(F.count(F.lit(1)).alias("row_count"), *[c.alias(n) for n, c in missing_counts(columns).items()]), columns)


def missing_counts(columns: Sequence[str]) -> dict[str, Column]:
    return {f"_n_{c}": F.count_if(F.col(c).isNull()) for c in columns} | {f"_b_{c}": F.count_if(is_blank(c)) for c in columns}


def missing_rows(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from the counts of one row."""
    return rows_from(wide, ["row_count"], [
        {"column_name": F.lit(c), "null_count": F.col(f"_n_{c}"), "blank_or_null_count": F.col(f"_b_{c}"),
         "missing_pct": F.round(F.col(f"_b_{c}") / F.nullif(F.col("row_count"), F.lit(0)), 6)} for c in columns])


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, zero and negative counts with the extremes of every numeric column in one scan (Q7)."""
    return numeric_rows(df.agg(F.count(F.lit(1)).alias("row_count"), *[c.alias(n) for n, c in numeric_counts(columns).items()]), columns)


def numeric_counts(columns: Sequence[str]) -> dict[str, Column]:
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        out |= {f"_v_{c}": F.count_if(v.isNull()), f"_z_{c}": F.count_if(v == 0), f"_g_{c}": F.count_if(v < 0),
                f"_l_{c}": F.min(v), f"_h_{c}": F.max(v)}
    return out


def numeric_rows(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from the counts of one row."""
    return rows_from(wide, ["row_count"], [
        {"column_name": F.lit(c), "null_count": F.col(f"_v_{c}"), "zero_count": F.col(f"_z_{c}"),
         "negative_count": F.col(f"_g_{c}"), "min_value": F.col(f"_l_{c}"), "max_value": F.col(f"_h_{c}")}
        for c in columns])


def period_counts(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Rows per period, or per period and source (Q8)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))


def grid_counts(df: DataFrame, key: str, key_values: Sequence, column: str, values: Sequence) -> DataFrame:
    """Rows in each cell of an expected literal grid; an unseen cell shows 0 and False."""
    return grid_of(df.groupBy(key, column).agg(F.count(F.lit(1)).alias("row_count")), key, key_values, column, values)


def grid_of(groups: DataFrame, key: str, key_values: Sequence, column: str, values: Sequence) -> DataFrame:
    """The same from groups with their sizes."""
    counts = groups.select(key, column, F.col("row_count").alias("_n"))
    kinds = [counts.schema[c].dataType.simpleString() for c in (key, column)]
    grid = literal_table(groups.sparkSession, [(k, v) for k in key_values for v in values],
                         f"{key} {kinds[0]}, {column} {kinds[1]}")
    seen = grid.join(counts, [key, column], "left")
    return seen.select(key, column, F.coalesce("_n", F.lit(0)).alias("row_count"),
                       F.col("_n").isNotNull().alias("is_present"))


def component_flags(df: DataFrame, keys: Sequence[str], component: str, values: Sequence[str]) -> DataFrame:
    """Rows of each expected component per key, fill 0, and whether all are there."""
    counts = [F.count_if(F.col(component) == v).alias(f"n_{v}") for v in values]
    wide = df.groupBy(*keys).agg(*counts)
    complete = F.lit(True)
    for v in values:
        complete = complete & (F.col(f"n_{v}") > 0)
    return wide.withColumn("has_all_components", complete)


def missing_combinations(df: DataFrame, entity: str, period: str, component: str, periods: Sequence,
                         components: Sequence[str]) -> DataFrame:
    """Missing (entity, period) cells with a status (J11): the whole period, or some components.

    The expected grid is the literal period list per known entity, so nothing is cross joined.
    """
    wanted_periods = F.array(*[F.lit(p) for p in periods])
    wanted = F.array_sort(F.array(*[F.lit(c) for c in components]))
    seen = df.groupBy(entity, period).agg(
        F.collect_set(F.when(F.col(component).isin(list(components)), F.col(component))).alias("_seen"))
    cell = F.when(F.col(period).isin(list(periods)), F.struct(period, "_seen"))
    cells = seen.groupBy(entity).agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    grid = cells.select(entity, "_cells", F.explode(wanted_periods).alias(period))
    have = F.try_element_at("_cells", F.col(period))
    lost = F.array_except(wanted, F.coalesce(have, F.array().cast("array<string>")))
    out = grid.select(entity, period, have.isNull().alias("_none"), F.array_join(lost, ",").alias("missing_components"))
    return out.where("missing_components <> ''").select(
        entity, period,
        F.when(F.col("_none"), "missing_year_entirely").otherwise("year_present_but_missing_components").alias("status"),
        "missing_components")


def name_conflicts(df: DataFrame, entity: str, name: str, detail: Sequence[str]) -> DataFrame:
    """Detail rows of entities that carry more than one name."""
    bad = df.groupBy(entity).agg(F.countDistinct(name).alias("distinct_name_count")).where("distinct_name_count > 1")
    return join_small(df.select(entity, *detail), bad, [entity], "inner")


def bad_keys(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that fail each named key check (Q11)."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in checks.items()])


def key_bounds(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Rows, distinct keys, smallest and largest key per group (A1)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(key).alias("distinct_keys"),
        F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def ask_suite(checks: Checks, keys: Sequence[str], entity: str) -> None:
    """Ask for what the row of a table in a suite needs."""
    text = F.trim(F.col(entity).cast("string"))
    checks.rows("suite_size", null_keys=F.count_if(F.col(entity).isNull()), blank_keys=F.count_if(F.col(entity).isNotNull() & (text == "")))
    checks.groups("suite_entities", {"_entity": F.when(has_text(entity), text)}).groups("suite_keys", keys)


def suite_row(name: str, found: Mapping[str, DataFrame]) -> DataFrame:
    """Sizes, keys and duplicates of one table (Q3, Q4, Q9)."""
    dup = excess(found["suite_keys"])
    return found["suite_size"].select(
        F.lit(name).alias("table_name"), "row_count", found["suite_entities"].agg(F.count("_entity")).scalar().alias("distinct_keys"),
        "null_keys", "blank_keys", dup.select("duplicate_groups").scalar().alias("duplicate_groups"),
        dup.select("duplicate_rows").scalar().alias("duplicate_rows"))


def table_suite(tables: Mapping[str, DataFrame], keys: Sequence[str], entity: str) -> DataFrame:
    """Key, duplicate and size checks over a set of tables, one row and one scan per table (Q9)."""
    rows = []
    for name, df in tables.items():
        checks = Checks(df)
        ask_suite(checks, keys, entity)
        rows.append(suite_row(name, checks.run()))
    return union_all(rows)


def suite_summary(suite: DataFrame, expected: int) -> DataFrame:
    """Run summary of a table suite (Q9)."""
    return suite.agg(
        F.lit(expected).alias("expected_tables"), F.count(F.lit(1)).alias("found_tables"),
        F.sum("duplicate_groups").alias("duplicate_groups"), F.sum("null_keys").alias("null_keys"),
        F.sum("blank_keys").alias("blank_keys"))
