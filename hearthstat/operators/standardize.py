"""Per-group scaling and flags (inventory W1-W5, W12, W14).

Each operator aggregates the group first and joins the few statistics back (see ``scale``), so a
period with most of the rows is never one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import clamp
from hearthstat.operators.ordered import quantiles
from hearthstat.operators.scale import attach, join_small


def zscores(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], prefix: str = "z_",
            population: bool = False) -> DataFrame:
    """Z-score within each group (W1), or over all rows for no groups.

    A zero or undefined spread gives 0 for every row of the group.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    stats = {f"_m_{m}": F.avg(m) for m in metrics} | {f"_s_{m}": spread(m) for m in metrics}
    return attach(df, groups, **stats).withColumns({
        f"{prefix}{m}": F.when(F.coalesce(F.col(f"_s_{m}"), F.lit(0.0)) == 0, F.lit(0.0))
        .otherwise((F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}")) for m in metrics}).drop(*stats)


def mean_zscores(df: DataFrame, entity: str, metrics: Sequence[str], population: bool = True) -> DataFrame:
    """Average each entity over its periods, then z-score the averages."""
    means = df.groupBy(entity).agg(*[F.avg(m).alias(m) for m in metrics])
    return zscores(means, [], metrics, population=population)


def scaled_between(metric: str, low: str, high: str, flat: float = 0.5) -> Column:
    """Position between two limits as 0-1; ``flat`` where the limits meet."""
    width = F.col(high) - F.col(low)
    return F.when(F.coalesce(width, F.lit(0.0)) == 0, F.lit(flat)).otherwise((F.col(metric) - F.col(low)) / width)


def minmax(df: DataFrame, groups: Sequence[str], metric: str, out: str, flat: float = 0.5) -> DataFrame:
    """Scale to 0-1 within each group; a constant group becomes ``flat``."""
    with_ends = attach(df, groups, _lo=F.min(metric), _hi=F.max(metric))
    return with_ends.withColumn(out, scaled_between(metric, "_lo", "_hi", flat)).drop("_lo", "_hi")


def shift_positive(df: DataFrame, groups: Sequence[str], metric: str, out: str, floor: float = 0.01) -> DataFrame:
    """Shift so that the smallest value of the group is ``floor``."""
    return attach(df, groups, _lo=F.min(metric)).withColumn(out, F.col(metric) - F.col("_lo") + floor).drop("_lo")


def share_of_total(df: DataFrame, groups: Sequence[str], metric: str, out: str) -> DataFrame:
    """Share of the group total; equal shares when the total is missing or not positive."""
    totals = attach(df, groups, _sum=F.sum(metric), _n=F.count(F.lit(1)))
    share = F.when(F.col("_sum") > 0, F.col(metric) / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return totals.withColumn(out, share).drop("_sum", "_n")


def quantile_flag(df: DataFrame, groups: Sequence[str], metric: str, prob: float, out: str,
                  keep_cut: str | None = None) -> DataFrame:
    """1 where the value reaches the group's quantile."""
    cuts = quantiles(df, groups, metric, {"_cut": prob})
    marked = join_small(df, cuts, groups).withColumn(out, F.when(F.col(metric) >= F.col("_cut"), 1).otherwise(0))
    return marked.withColumnRenamed("_cut", keep_cut) if keep_cut else marked.drop("_cut")


def _cuts(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of all metrics at once, one row per group with columns like ``_lo_<metric>``."""
    long = df.select(*groups, *[F.col(m).cast("double") for m in metrics]).unpivot(list(groups), list(metrics), "_metric", "_v")
    found = quantiles(long, [*groups, "_metric"], "_v", probs)
    return found.groupBy(*groups).agg(*[
        F.max(F.when(F.col("_metric") == m, F.col(p))).alias(f"{p}_{m}") for m in metrics for p in probs])


def winsorize(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], low: float = 0.01,
              high: float = 0.99) -> DataFrame:
    """Limit each metric to its group quantiles (W14): one quantile pass and one join for all metrics."""
    joined = join_small(df, _cuts(df, groups, metrics, {"_lo": low, "_hi": high}), groups)
    return joined.withColumns({m: clamp(F.col(m), F.col(f"_lo_{m}"), F.col(f"_hi_{m}")) for m in metrics}).drop(
        *[f"{p}_{m}" for m in metrics for p in ("_lo", "_hi")])


def impute_median(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Fill missing values with the exact group median (part of ML1)."""
    joined = join_small(df, _cuts(df, groups, metrics, {"_med": 0.5}), groups)
    return joined.withColumns({m: F.coalesce(F.col(m).cast("double"), F.col(f"_med_{m}")) for m in metrics}).drop(
        *[f"_med_{m}" for m in metrics])
