"""Top-down allocation of control totals with a weighted hardship score (inventory D18, A42, A45, A46)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import clamp, floored, ratio, sum_of_parts
from hearthstat.operators.ordered import quantiles
from hearthstat.operators.reshape import rows_from
from hearthstat.operators.scale import attach, join_small, stage
from hearthstat.operators.standardize import scaled_between, share_of_total, zscores


@dataclass(frozen=True)
class ScoreMetric:
    """One part of the score: +1 raises hardship, -1 lowers it; weight 0 leaves it out."""

    metric: str
    direction: int
    weight: float
    group: str = ""


# Metrics, directions, weights and themes of the hardship score.
HARDSHIP_SPEC = (
    ScoreMetric("poverty_rate", 1, 1.00, "economic_stress"),
    ScoreMetric("unemployment_rate", 1, 0.85, "economic_stress"),
    ScoreMetric("pct_rent_burden_30_plus", 1, 0.90, "housing_stress"),
    ScoreMetric("pct_rent_burden_50_plus", 1, 0.90, "housing_stress"),
    ScoreMetric("pct_hh_income_under_25k", 1, 1.00, "income_distribution"),
    ScoreMetric("pct_hh_income_25k_50k", 1, 0.80, "income_distribution"),
    ScoreMetric("median_household_income", -1, 1.00, "income_distribution"),
    ScoreMetric("pct_hh_income_100k_plus", -1, 0.70, "income_distribution"),
    ScoreMetric("pct_bachelors_or_higher", -1, 0.60, "human_capital"),
    ScoreMetric("pct_less_than_high_school", 1, 0.50, "human_capital"),
    ScoreMetric("pct_renter_occupied", 1, 0.50, "housing_context"),
    ScoreMetric("pct_age_18_24", 0, 0.00, "student_proxy"),
)

# Student dampening strength, its limits, and the smallest capacity.
DAMPEN_STRENGTH = 0.35
DAMPEN_RANGE = (0.55, 1.00)
CAPACITY_FLOOR = 1.0

# Fixed value: smallest shifted score of a group.
SCORE_FLOOR = 0.01


def used_metrics(df: DataFrame, spec: Sequence[ScoreMetric]) -> list[ScoreMetric]:
    """Spec rows that carry weight and exist in the table."""
    return [s for s in spec if s.weight > 0 and s.metric in df.columns]


def hardship_score(df: DataFrame, groups: Sequence[str], spec: Sequence[ScoreMetric]) -> DataFrame:
    """Directed, weighted z-scores per metric and their sum; a missing part adds nothing."""
    used = used_metrics(df, spec)
    scored = zscores(df, groups, [s.metric for s in used])
    scored = scored.withColumns({
        f"directed_{s.metric}": F.col(f"z_{s.metric}") * float(s.direction) * float(s.weight) for s in used})
    return scored.withColumn("raw_hardship_score", sum_of_parts([f"directed_{s.metric}" for s in used]))


def dampened_component(df: DataFrame, groups: Sequence[str], proxy: str | None,
                       strength: float = DAMPEN_STRENGTH) -> DataFrame:
    """Positive score times a multiplier that falls with the student proxy, one pass for all group limits."""
    limits = {"_least": F.min("raw_hardship_score")}
    if proxy is not None:
        limits |= {"_lo": F.min(proxy), "_hi": F.max(proxy)}
    out = attach(df, groups, **limits)
    out = out.withColumn("score_shifted_positive", F.col("raw_hardship_score") - F.col("_least") + SCORE_FLOOR)
    if proxy is None:
        out = out.withColumns({"student_proxy_scaled": F.lit(0.0), "student_adjustment_multiplier": F.lit(1.0)})
    else:
        out = out.withColumn("student_proxy_scaled", scaled_between(proxy, "_lo", "_hi")).withColumn(
            "student_adjustment_multiplier", clamp(1 - F.lit(strength) * F.col("student_proxy_scaled"), *DAMPEN_RANGE))
    return out.withColumn(
        "adjusted_hardship_component",
        F.col("score_shifted_positive") * F.col("student_adjustment_multiplier")).drop(*limits)


def allocate_totals(df: DataFrame, totals: DataFrame, groups: Sequence[str], spec: Sequence[ScoreMetric],
                    proxy: str | None = None, capacity: str | None = None, total: str = "control_total",
                    staged: bool = True) -> DataFrame:
    """Estimates per area that add up to the control total of their group.

    ``totals`` is unique on ``groups`` and carries ``total``; a group without one raises an error.
    ``capacity`` names the column that limits and scales areas; without it every area counts once.
    The panel is read in four passes, so it is staged unless it already is a stored table.
    """
    base = stage(df) if staged else df
    _require_totals(base, totals, groups, total)
    out = dampened_component(hardship_score(base, groups, spec), groups, proxy)
    limit = floored(F.col(capacity).cast("double"), CAPACITY_FLOOR) if capacity else F.lit(1.0)
    out = out.withColumn("area_capacity", limit).withColumn(
        "weight_component", F.col("adjusted_hardship_component") * F.col("area_capacity"))
    out = join_small(out, totals.select(*groups, F.col(total).cast("double").alias(total)), groups)
    out = share_of_total(out, groups, "weight_component", "allocation_weight")
    estimate = F.col("allocation_weight") * F.col(total)
    return out.withColumns({
        "estimated_households": estimate,
        "estimated_share_pct": F.col("allocation_weight") * 100.0,
        "estimated_rate_proxy_pct": ratio(estimate, "area_capacity"),
    })


def _require_totals(df: DataFrame, totals: DataFrame, groups: Sequence[str], total: str) -> None:
    known = totals.where(F.col(total).isNotNull()).select(*groups, F.lit(True).alias("_known"))
    present = join_small(df.select(*groups).distinct(), known, groups)
    missing = present.where("_known is null").select(*groups).limit(20).collect()
    if missing:
        raise ValueError(f"no control total for {[tuple(r) for r in missing]}")


def allocation_check(df: DataFrame, groups: Sequence[str], entity: str, total: str = "control_total") -> DataFrame:
    """Sum of estimates against the control total."""
    sums = df.groupBy(*groups).agg(
        F.max(total).alias("control_total"), F.sum("estimated_households").alias("estimated_sum"),
        F.countDistinct(entity).alias("entity_count"), F.avg("allocation_weight").alias("avg_weight"),
        F.max("estimated_rate_proxy_pct").alias("max_rate_proxy"), F.avg("estimated_rate_proxy_pct").alias("mean_rate_proxy"))
    return sums.withColumn("sum_diff_abs", F.abs(F.col("estimated_sum") - F.col("control_total")))


def rate_sanity(df: DataFrame, groups: Sequence[str], rate: str = "estimated_rate_proxy_pct") -> DataFrame:
    """Upper quantiles, maximum and counts of implausible rates."""
    stats = df.groupBy(*groups).agg(
        F.max(rate).alias("max_rate"), F.count_if(F.col(rate) > 100).alias("over_100_pct"),
        F.count_if(F.col(rate) > 80).alias("over_80_pct"))
    return join_small(stats, quantiles(df, groups, rate, {"p95_rate": 0.95, "p99_rate": 0.99}), groups)


def year_summary(df: DataFrame, period: str = "year") -> DataFrame:
    """Sum of estimates and mean rate by period."""
    return df.groupBy(period).agg(
        F.sum("estimated_households").alias("estimated_total"), F.avg("estimated_rate_proxy_pct").alias("mean_rate"))


def component_rows(df: DataFrame, ids: Sequence[str], spec: Sequence[ScoreMetric]) -> DataFrame:
    """Raw value, z-score and directed part of every score metric, long."""
    return rows_from(df, ids, [
        {"metric": F.lit(s.metric), "raw_metric_value": F.col(s.metric).cast("double"),
         "z_score": F.col(f"z_{s.metric}"), "directed_component": F.col(f"directed_{s.metric}")}
        for s in spec if s.weight > 0 and f"z_{s.metric}" in df.columns])
