"""Weighted and descriptive profiles: one aggregate pass, then reshaped (inventory A7-A24, A28-A33, A38-A40)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.functions.expressions import as_column
from hearthstat.operators.household import COMPOSITION_KEYS
from hearthstat.operators.ordered import quantiles
from hearthstat.operators.reshape import rows_from, to_long, union_all
from hearthstat.operators.scale import attach, join_rows, join_small, stage


def weighted_mean(x: Column | str, w: Column | str, skip_null: bool = False) -> Column:
    """Weighted mean; a missing value counts as zero with its weight unless ``skip_null``."""
    x, w = as_column(x), as_column(w).cast("double")
    if skip_null:
        w = F.when(x.isNotNull(), w)
    return F.sum(w * F.coalesce(x, F.lit(0))) / F.nullif(F.sum(w), F.lit(0.0))


def weighted_where(test: Column, w: Column | str) -> Column:
    """Sum of weights where a test holds."""
    return F.sum(F.when(test, as_column(w).cast("double")).otherwise(F.lit(0.0)))


def sort_position(key: Column | str, order: Sequence[str], start: int = 0) -> Column:
    """Fixed business order of a category (T2); unknown values come last."""
    key = as_column(key)
    places = [F.when(key == k, F.lit(start + i)) for i, k in enumerate(order[:-1], 1)]
    return F.coalesce(*places, F.lit(start + len(order)))


def category_shares(df: DataFrame, groups: Sequence[str], key: str, weight: str,
                    order: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Weighted distribution of a category with its share of the group total."""
    sums = df.groupBy(*groups, key).agg(
        F.sum(F.col(weight).cast("double")).alias("_w"), F.count(F.lit(1)).alias("records"))
    total = F.sum("_w").over(W.partitionBy(*groups))  # a handful of categories per group
    out = sums.withColumns({
        "weighted_households": F.round("_w", digits),
        "pct_of_households": F.round(100.0 * F.col("_w") / F.nullif(total, F.lit(0.0)), digits),
    }).drop("_w")
    return out if order is None else out.withColumn("sort_order", sort_position(key, order))


# The weighted means and flag shares of the profile: (name, group, source, digits, sort order).
PROFILE_MEANS = (
    ("weighted_avg_household_size", "overall", "coalesce(person_count, np, 0)", 4, 30),
    ("weighted_avg_adult_count", "overall", "adult_count", 4, 40),
    ("weighted_avg_child_count", "overall", "noc", 4, 50),
    ("weighted_avg_real_income", "income", "hincp_adj_real", 2, 60),
    ("weighted_avg_annual_threshold", "income", "annual_threshold", 2, 80),
)
PROFILE_SHARES = (
    ("share_student_heavy", "student_labor", "student_heavy_flag", 90),
    ("share_has_any_student", "student_labor", "has_any_student", 100),
    ("share_has_any_likely_college_student", "student_labor", "has_any_likely_college_student", 110),
    ("share_reference_person_student", "student_labor", "reference_person_student_flag", 120),
    ("share_has_any_employed_person", "student_labor", "has_any_employed_person", 130),
)
PROFILE_COLUMNS = ["metric_group", "metric_name", "metric_value", "pct_of_households", "sort_order"]


def profile_cube(df: DataFrame, groups: Sequence[str], weight: str = "analysis_weight") -> DataFrame:
    """All sums that the profiles need, from one scan of the households, written once.

    One row per group, composition, student-heavy and below flag, and income value: weights, records, and the weighted
    sums behind every mean and share. Populations are subsets of its rows, and medians follow from its records per value.
    """
    w = F.col(weight).cast("double")
    means = [F.sum(w * F.coalesce(F.expr(src), F.lit(0))).alias(f"_m_{name}") for name, _, src, _, _ in PROFILE_MEANS]
    shares = [weighted_where(F.coalesce(F.col(src), F.lit(0)) == 1, w).alias(f"_s_{name}") for name, _, src, _ in PROFILE_SHARES]
    flags = [F.coalesce(F.col("student_heavy_flag"), F.lit(0)).alias("_heavy"), F.col("below_flag").alias("_below")]
    return stage(df.groupBy(*groups, F.coalesce("hh_comp_key", F.lit(COMPOSITION_KEYS[-1])).alias("_key"), *flags,
                            F.col("hincp_adj_real").alias("_income")).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_records"), *means, *shares))


def profile_of(cube: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Tidy survey-weighted profile of each group (A12) from a cube or some of its rows: one row per statistic."""
    total = F.sum("_w")
    means = [(F.sum(f"_m_{name}") / F.nullif(total, F.lit(0.0))).alias(name) for name, *_ in PROFILE_MEANS]
    shares = [F.sum(f"_s_{name}").alias(name) for name, *_ in PROFILE_SHARES]
    wide = cube.groupBy(*groups).agg(F.coalesce(total, F.lit(0.0)).alias("_total"), F.sum("_records").alias("_records"), *means, *shares)
    median = quantiles(cube, groups, "_income", {"_median": 0.5}, count="_records")
    wide = join_rows(wide, median, groups)

    def row(name: str, group: str, value: Column, share: Column, place: int) -> dict[str, Column]:
        return {"metric_group": F.lit(group), "metric_name": F.lit(name), "metric_value": value.cast("double"),
                "pct_of_households": share.cast("double"), "sort_order": F.lit(place)}

    none = F.lit(None).cast("double")
    rows = [
        row("weighted_households", "overall", F.round("_total", 4), F.lit(100.0), 10),
        row("unweighted_records", "overall", F.col("_records"), none, 20),
        row("median_real_income_unweighted", "income", F.round("_median", 2), none, 70),
    ]
    rows += [row(n, g, F.round(n, d), none, place) for n, g, _, d, place in PROFILE_MEANS]
    rows += [row(n, g, F.round(n, 4), F.round(100.0 * F.col(n) / F.nullif(F.col("_total"), F.lit(0.0)), 4), place)
             for n, g, _, place in PROFILE_SHARES]
    scalars = rows_from(wide, groups, rows)

    parts = cube.groupBy(*groups, F.col("_key").alias("metric_name")).agg(F.sum("_w").alias("_w"))
    every = F.sum("_w").over(W.partitionBy(*groups))  # a handful of compositions per group
    parts = parts.select(
        *groups, F.lit("composition_hh_comp_key").alias("metric_group"), "metric_name", F.round("_w", 4).alias("metric_value"),
        F.round(100.0 * F.col("_w") / F.nullif(every, F.lit(0.0)), 4).alias("pct_of_households"),
        (F.lit(200) + sort_position("metric_name", COMPOSITION_KEYS)).alias("sort_order"))
    return scalars.unionByName(parts)


def stat_profile(df: DataFrame, groups: Sequence[str], weight: str = "analysis_weight") -> DataFrame:
    """Tidy survey-weighted profile of each group (A12): one scan, then one row per statistic."""
    return profile_of(profile_cube(df, groups, weight), groups)


def compare_profiles(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("year", "metric_group", "metric_name"),
                     base_name: str = "complete", other_name: str = "nonstudent") -> DataFrame:
    """Two tidy profiles side by side with differences and ratio; one-sided rows stay."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("metric_value").alias(f"{name}_metric_value"),
                         F.col("pct_of_households").alias(f"{name}_pct_of_households"),
                         F.col("sort_order").alias(f"_{name}_sort"))

    both = side(base, base_name).join(side(other, other_name), list(keys), "full")
    b, o = F.col(f"{base_name}_metric_value"), F.col(f"{other_name}_metric_value")
    bp, op = F.col(f"{base_name}_pct_of_households"), F.col(f"{other_name}_pct_of_households")
    zero = F.lit(0.0)
    return both.withColumns({
        "value_diff": F.round(F.coalesce(o, zero) - F.coalesce(b, zero), 4),
        "pct_point_diff": F.round(F.coalesce(op, zero) - F.coalesce(bp, zero), 4),
        "other_as_pct_of_base": F.round(100.0 * F.coalesce(o, zero) / F.nullif(b, zero), 4),
        "sort_order": F.coalesce(f"_{base_name}_sort", f"_{other_name}_sort"),
    }).drop(f"_{base_name}_sort", f"_{other_name}_sort")


def below_sums(weight: str = "analysis_weight", flag: str = "below_flag") -> dict[str, Column]:
    return {"total_households": F.sum(F.col(weight).cast("double")), "below_households": weighted_where(F.col(flag) == 1, weight),
            "above_households": weighted_where(F.col(flag) == 0, weight)}


def balanced(sums: DataFrame) -> DataFrame:
    """Totals with what their parts leave over."""
    return sums.withColumn("balance_check", F.round(
        F.col("total_households") - (F.col("below_households") + F.col("above_households")), 4))


def below_totals(df: DataFrame, groups: Sequence[str], weight: str = "analysis_weight",
                 flag: str = "below_flag") -> DataFrame:
    """Weighted total, below, above and balance per group."""
    return balanced(df.groupBy(*groups).agg(*[c.alias(n) for n, c in below_sums(weight, flag).items()]))


def county_totals(df: DataFrame, period: str = "year", weight: str = "analysis_weight") -> DataFrame:
    """Below-threshold households of each variant against all households."""
    heavy = F.coalesce("student_heavy_flag", F.lit(0))
    return _totals_of(df.select(period, F.col(weight).alias("_w"), F.col("below_flag").alias("_below"), heavy.alias("_heavy")), period)


def _totals_of(cube: DataFrame, period: str) -> DataFrame:
    """The same from the weights of households or of cube rows."""
    below, keep = F.col("_below") == 1, F.col("_heavy") == 0
    wide = cube.groupBy(period).agg(
        F.sum(F.col("_w").cast("double")).alias("_all"), weighted_where(below, "_w").alias("_complete"),
        weighted_where(below & keep, "_w").alias("_nonstudent"))
    rows = [{"source_variant": F.lit(f"{v}_calibrated"),
             "below_households": F.round(f"_{v}", 4),
             "county_total_households": F.coalesce("_all", F.lit(0.0)),
             "below_rate_pct": F.round(100.0 * F.round(f"_{v}", 4) / F.nullif(F.col("_all"), F.lit(0.0)), 4)}
            for v in ("complete", "nonstudent")]
    return rows_from(wide, [period], rows)


def survey_profiles(df: DataFrame, period: str = "year", weight: str = "analysis_weight") -> dict[str, DataFrame]:
    """Profiles of all and of non-student households below the threshold, their comparison and the county totals.

    Everything follows from one cube, so the households are read once.
    """
    cube = profile_cube(df, [period], weight)
    below = cube.where("_below = 1")
    complete, nonstudent = profile_of(below, [period]), profile_of(below.where("_heavy = 0"), [period])
    return {"complete": complete, "nonstudent": nonstudent,
            "comparison": compare_profiles(complete, nonstudent, (period, "metric_group", "metric_name")),
            "county_totals": _totals_of(cube, period)}


def target_compare(actual: DataFrame, targets: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Measures against external control totals, stacked (A17). ``targets`` carries ``target_<measure>``."""
    both = join_small(actual, targets, on, "inner")
    rows = []
    for m in measures:
        a, t = F.col(m).cast("double"), F.col(f"target_{m}").cast("double")
        rows.append({"measure": F.lit(m), "actual_value": F.round(a, 0), "target_value": t,
                     "diff": F.round(a - t, 0), "pct_diff": F.round(100.0 * (a - t) / F.nullif(t, F.lit(0.0)), 2)})
    return rows_from(both, on, rows)


def impact_counts(before: Column, after: Column, weight: str = "analysis_weight") -> dict[str, Column]:
    return {"before_total": weighted_where(before, weight), "after_total": weighted_where(before & after, weight)}


def impact_of(sums: DataFrame) -> DataFrame:
    """Totals with what the filter removed."""
    gone = F.col("before_total") - F.col("after_total")
    return sums.withColumns({
        "removed": gone, "pct_removed": F.round(100.0 * gone / F.nullif(F.col("before_total"), F.lit(0.0)), 2)})


def filter_impact(df: DataFrame, groups: Sequence[str], before: Column, after: Column,
                  weight: str = "analysis_weight") -> DataFrame:
    """Weighted total before and after a filter, and what it removed."""
    return impact_of(df.groupBy(*groups).agg(*[c.alias(n) for n, c in impact_counts(before, after, weight).items()]))


def threshold_match(df: DataFrame, thresholds: DataFrame, period: str = "year", tolerance: float = 0.01,
                    rows: str | None = None) -> DataFrame:
    """Rows whose stored threshold differs from the table (A19); ``rows`` names the sizes where ``df`` holds groups of rows."""
    table = thresholds.select(period, "hh_comp_key", F.col("annual_threshold").alias("_t"))
    both = join_small(df, table, [period, "hh_comp_key"], "inner")
    wrong = F.col("annual_threshold").isNull() | (F.abs(F.col("annual_threshold") - F.col("_t")) > tolerance)
    many = F.lit(1) if rows is None else F.col(rows)
    return both.groupBy(period).agg(
        F.sum(many).alias("row_count"), F.sum(F.when(wrong, many).otherwise(0)).alias("threshold_mismatch_rows"))


def flag_reconciliation(df: DataFrame, groups: Sequence[str], stored: Column, recomputed: Column) -> DataFrame:
    """Stored flag against the recomputed one."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(stored).cast("bigint").alias("stored_below"),
        F.sum(recomputed).cast("bigint").alias("recomputed_below"),
        F.count_if(~stored.eqNullSafe(recomputed)).alias("mismatch_rows"))


def null_counts(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULL count per column and group in one pass."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def weight_audit(df: DataFrame, groups: Sequence[str], raw: str, adjusted: str) -> DataFrame:
    """Raw and adjusted weight totals and their ratio."""
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col(raw).cast("double")).alias("raw_total"),
        F.sum(F.col(adjusted).cast("double")).alias("adjusted_total"))
    return sums.withColumn("ratio", F.col("adjusted_total") / F.nullif(F.col("raw_total"), F.lit(0.0)))


def summary_stats(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, missing, mean, spread and quartiles per (group, metric), one row each."""
    long = df.select(*groups, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(groups), list(metrics), "metric", "_v")
    keys = [*groups, "metric"]
    stats = long.groupBy(*keys).agg(
        F.count("_v").alias("non_null"), F.count_if(F.col("_v").isNull()).alias("missing"),
        F.min("_v").alias("min"), F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.stddev_samp("_v").alias("std"))
    return join_small(stats, quantiles(long, keys, "_v", {"p25": 0.25, "median": 0.5, "p75": 0.75}), keys)


def missingness(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Missing count and percentage per (group, column), one scan."""
    wide = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(m).isNull()).alias(f"_n_{m}") for m in metrics])
    return rows_from(wide, [*groups, "row_count"], [
        {"column_name": F.lit(m), "missing_count": F.col(f"_n_{m}"),
         "missing_pct": 100.0 * F.col(f"_n_{m}") / F.col("row_count")} for m in metrics])


def filled_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value per column, one scan."""
    wide = df.agg(*[F.count(F.col(c)).alias(f"_n_{c}") for c in columns])
    return rows_from(wide, [], [{"column_name": F.lit(c), "filled": F.col(f"_n_{c}")} for c in columns])


def trend(df: DataFrame, period: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and median of each metric by period."""
    long = to_long(df, [period], metrics, "metric", "_v")
    keys = [period, "metric"]
    means = long.groupBy(*keys).agg(F.avg("_v").alias("mean_value"))
    return join_small(means, quantiles(long, keys, "_v", {"median_value": 0.5}), keys)


def stable_comparison(df: DataFrame, groups: Sequence[str], stable: Column, metrics: Sequence[str]) -> DataFrame:
    """Mean over all areas against mean over stable areas."""
    wide = df.groupBy(*groups).agg(
        *[F.avg(m).alias(f"_a_{m}") for m in metrics], *[F.avg(F.when(stable, F.col(m))).alias(f"_s_{m}") for m in metrics])
    return rows_from(wide, groups, [
        {"metric": F.lit(m), "full_mean": F.col(f"_a_{m}"), "stable_mean": F.col(f"_s_{m}"),
         "difference": F.col(f"_s_{m}") - F.col(f"_a_{m}")} for m in metrics])


def correlation_matrix(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of all metric pairs in one aggregate."""
    pairs = list(combinations_with_replacement(metrics, 2))

    def both(m: str, other: str) -> Column:
        return F.when(F.col(m).isNotNull() & F.col(other).isNotNull(), F.col(m).cast("double"))

    wide = df.groupBy(*groups).agg(*[F.corr(both(a, b), both(b, a)).alias(f"{a}|{b}") for a, b in pairs])
    cells = [{"metric_a": F.lit(a), "metric_b": F.lit(b), "correlation": F.col(f"`{a}|{b}`")} for a, b in pairs]
    cells += [{"metric_a": F.lit(b), "metric_b": F.lit(a), "correlation": F.col(f"`{a}|{b}`")} for a, b in pairs if a != b]
    return rows_from(wide, groups, cells)


def iqr_outliers(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Quartile bounds and rows outside them per metric."""
    long = to_long(df, groups, metrics, "metric", "_v")
    keys = [*groups, "metric"]
    bounds = quantiles(long, keys, "_v", {"q1": 0.25, "q3": 0.75})
    bounds = bounds.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_bound": F.col("q1") - 1.5 * F.col("iqr"), "upper_bound": F.col("q3") + 1.5 * F.col("iqr")})
    out = (F.col("_v") < F.col("lower_bound")) | (F.col("_v") > F.col("upper_bound"))
    marked = join_small(long, bounds, keys)
    return marked.groupBy(*keys, "q1", "q3", "iqr", "lower_bound", "upper_bound").agg(
        F.count_if(out).alias("outlier_count"),
        F.round(100.0 * F.count_if(out) / F.count(F.lit(1)), 4).alias("outlier_pct"))


def core_complete(df: DataFrame, groups: Sequence[str], core: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Rows with all core metrics and means of chosen metrics."""
    complete = F.lit(True)
    for c in core:
        complete = complete & F.col(c).isNotNull()
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(complete).alias("rows_with_all_core_metrics"),
        *[F.avg(m).alias(f"avg_{m}") for m in means])


def formula_audit(df: DataFrame, groups: Sequence[str], checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Largest absolute gap between a stored and a recomputed metric."""
    wide = df.groupBy(*groups).agg(*[F.max(F.abs(a - b)).alias(n) for n, (a, b) in checks.items()])
    return wide.unpivot(list(groups), list(checks), "check_name", "max_abs_diff")


def plain_number(c: str) -> Column:
    """A text read as a number in any usual notation, with sign and exponent; NULL for all else."""
    text = F.trim(F.col(c))
    return F.when(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def parse_ratios(df: DataFrame, columns: Sequence[str], share: float = 0.6, least: int = 3) -> DataFrame:
    """How many values of each text column read as numbers, and whether to cast it (P33): the share of rows is rounded down."""
    wide = df.agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count(plain_number(c)).alias(f"_p_{c}") for c in columns],
        *[F.count_if(F.col(c).isNotNull()).alias(f"_v_{c}") for c in columns])
    return rows_from(wide, ["row_count"], [
        {"column_name": F.lit(c), "non_null_count": F.col(f"_v_{c}"), "parsed_count": F.col(f"_p_{c}"),
         "cast_to_number": F.col(f"_p_{c}") >= F.greatest(F.lit(least).cast("long"), F.floor(F.lit(share) * F.col("row_count")))}
        for c in columns])


def auto_cast(df: DataFrame, columns: Sequence[str], share: float = 0.6, least: int = 3) -> DataFrame:
    """Cast the columns that are mostly numeric."""
    chosen = {r.column_name for r in parse_ratios(df, columns, share, least).collect() if r.cast_to_number}
    return df.withColumns({c: plain_number(c) for c in columns if c in chosen}) if chosen else df


def column_ranking(df: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """Numeric columns by filled values, distinct values, spread and name."""
    wide = df.agg(*[F.count(c).alias(f"_c_{c}") for c in columns], *[F.countDistinct(c).alias(f"_u_{c}") for c in columns],
                  *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    long = rows_from(wide, [], [
        {"column_name": F.lit(c), "non_null": F.col(f"_c_{c}"), "n_unique": F.col(f"_u_{c}"), "std": F.col(f"_s_{c}")}
        for c in columns])
    ranked = long.orderBy(F.desc("non_null"), F.desc("n_unique"), F.desc_nulls_last("std"), F.asc("column_name"))
    return ranked if n is None else ranked.limit(n)


def group_summaries(df: DataFrame, period: str, keys: Sequence[str], entity: str, sums: Sequence[str],
                    means: Sequence[str]) -> DataFrame:
    """Entities, sums and means by period for each grouping column, stacked in one scan."""
    named = F.array(*[F.struct(F.lit(k).alias("group_name"), F.col(k).cast("string").alias("group_value")) for k in keys])
    spread = df.select(period, entity, *sums, *[m for m in means if m not in sums], F.inline(named))
    return spread.where("group_value is not null").groupBy(period, "group_name", "group_value").agg(
        F.countDistinct(entity).alias("entity_count"), *[F.sum(s).alias(f"sum_{s}") for s in sums],
        *[F.avg(m).alias(f"avg_{m}") for m in means])


def run_summary(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Scalar results as (metric, value) text rows."""
    wide = df.agg(*[c.cast("string").alias(n) for n, c in values.items()])
    return wide.unpivot([], list(values), "metric", "value")


def validation_pack(checks: Mapping[str, DataFrame]) -> DataFrame:
    """Named checks in one sparse table (Q10)."""
    return union_all([df.select(F.lit(n).alias("validation_name"), "*") for n, df in checks.items()], "all")
