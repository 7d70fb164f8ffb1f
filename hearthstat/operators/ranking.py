"""Ranks, top and bottom lists (inventory W6-W8, W13, T1, T4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.operators.ordered import both_ends, dense_ranks, top_n
from hearthstat.operators.reshape import to_long

__all__ = ["dense_ranks", "top_n", "metric_ranks", "top_and_bottom", "worst_both_sides"]


def metric_ranks(df: DataFrame, ids: Sequence[str], period: str, metrics: Sequence[str], **limits: int) -> DataFrame:
    """Dense ranks in both directions for every (period, metric), NULLs dropped."""
    long = to_long(df, [*ids, period], metrics, "metric", "metric_value")
    return dense_ranks(long, [period, "metric"], "metric_value", **limits)


def top_and_bottom(df: DataFrame, groups: Sequence[str], value: str, key: Sequence[str], n: int,
                   tag: str = "rank_group") -> DataFrame:
    """Highest and lowest ``n`` rows per group, tagged and numbered; the key settles ties."""
    return both_ends(df, groups, value, key, n, tag=tag, names=(f"top_{n}", f"bottom_{n}"))


def worst_both_sides(df: DataFrame, value: str, key: Sequence[Column | str], n: int = 15) -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows overall (T4, ML25)."""
    high = df.orderBy(F.desc(value), *key).limit(n).withColumn("side", F.lit("highest"))
    low = df.orderBy(F.asc(value), *key).limit(n).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)
