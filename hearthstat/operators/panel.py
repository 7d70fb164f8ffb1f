"""Entities over periods: dimensions, presence, change (inventory A2-A5, W9-W11, A44, J12, P39)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.functions.expressions import has_text
from hearthstat.operators.ordered import both_ends, quantiles
from hearthstat.operators.reshape import rows_from
from hearthstat.operators.scale import join_small


def latest(attribute: str, period: str, filled: bool = False) -> Column:
    """Attribute of the latest period, or of the latest period that has one (A3)."""
    order = F.struct(F.col(period), F.col(attribute))
    if filled:
        order = F.when(has_text(attribute), order)
    return F.max(order)[attribute].alias(attribute)


def entity_dimension(df: DataFrame, entity: str, period: str, attributes: Sequence[str], filled: Sequence[str] = (),
                     periods_expected: int | None = None) -> DataFrame:
    """One row per entity: latest attributes, first and last period, count, stability (A2, A3)."""
    seen = F.countDistinct(period)
    out = df.groupBy(entity).agg(
        *[latest(a, period, a in filled) for a in attributes],
        F.min(period).alias("first_year_seen"), F.max(period).alias("last_year_seen"), seen.alias("year_count"))
    if periods_expected is None:
        return out
    return out.withColumn("is_stable", (F.col("year_count") == periods_expected).cast("int"))


def entity_periods(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The spine: distinct entity-period rows."""
    return df.select(*columns).dropDuplicates()


def presence(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Sorted list of the periods in which an entity occurs (A5)."""
    years = F.array_sort(F.collect_set(period))
    return df.groupBy(entity).agg(F.size(years).alias("year_count"),
                                  F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


def stable_entities(df: DataFrame, entity: str, period: str, periods_expected: int) -> DataFrame:
    """Rows of entities seen in every expected period."""
    keep = df.groupBy(entity).agg(F.countDistinct(period).alias("_n")).where(F.col("_n") == periods_expected)
    return join_small(df, keep.select(entity), [entity], "inner")


def _by_period(df: DataFrame, entity: str, period: str, metrics: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """One row per entity with every metric in every listed period; one shuffle."""
    cols = [F.max(F.when(F.col(period) == p, F.col(m).cast("double"))).alias(f"_{m}_{p}")
            for m in metrics for p in periods]
    seen = [F.max(F.when(F.col(period) == p, 1)).alias(f"_seen_{p}") for p in periods]
    return df.groupBy(entity).agg(*cols, *seen)


def pair_changes(df: DataFrame, entity: str, period: str, metrics: Sequence[str],
                 pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Absolute and percentage change for chosen period pairs, long.

    Entities must occur in both periods of the pair; the (entity, period) key is unique.
    """
    periods = sorted({p for pair in pairs for p in pair})
    wide = _by_period(df, entity, period, metrics, periods)
    rows = []
    for a, b in pairs:
        for m in metrics:
            start, end = F.col(f"_{m}_{a}"), F.col(f"_{m}_{b}")
            rows.append({
                "start_year": F.lit(a), "end_year": F.lit(b), "metric": F.lit(m), "value_start": start, "value_end": end,
                "absolute_change": end - start,
                "pct_change": F.when(start != 0, (end - start) / start * 100.0),
                "_both": (F.col(f"_seen_{a}") == 1) & (F.col(f"_seen_{b}") == 1)})
    return rows_from(wide, [entity], rows).where("_both").drop("_both")


def consecutive_changes(df: DataFrame, entity: str, period: str, metrics: Sequence[str],
                        periods: Sequence[int]) -> DataFrame:
    """Values by period, each consecutive change and the first-to-last change, one row per metric."""
    wide = _by_period(df, entity, period, metrics, periods)
    rows = []
    for m in metrics:
        v = {p: F.col(f"_{m}_{p}") for p in periods}
        row = {"metric": F.lit(m)}
        row |= {f"change_{a}_to_{b}": v[b] - v[a] for a, b in zip(periods, periods[1:])}
        row["change_first_to_last"] = v[periods[-1]] - v[periods[0]]
        rows.append(row)
    return rows_from(wide, [entity], rows)


def lagged_changes(df: DataFrame, entity: str, period: str, metric: str) -> DataFrame:
    """Change against the previous period the entity has (W9, long form)."""
    w = W.partitionBy(entity).orderBy(period)
    return df.withColumns({"previous_period": F.lag(period).over(w),
                           "change": F.col(metric) - F.lag(metric).over(w)})


def change_summary(changes: DataFrame, keys: Sequence[str], value: str = "absolute_change") -> DataFrame:
    """Count, mean, median, min and max of a change."""
    stats = changes.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return join_small(stats, quantiles(changes, keys, value, {"median": 0.5}), keys)


def movers(changes: DataFrame, keys: Sequence[str], entity: str, n: int = 10,
           value: str = "absolute_change") -> DataFrame:
    """Biggest gainers and decliners per change window and metric."""
    return both_ends(changes, keys, value, [entity], n, tag="direction", names=("gainer", "decliner"))


def remap_by_period(period: str, rules: Mapping[str, Sequence[tuple[int | None, str | None]]]) -> dict[str, Column]:
    """Source column by period (P14): rules are (from_period, column), tried in order, None = any period."""
    out = {}
    for target, choices in rules.items():
        picks = []
        for since, source in choices:
            value = F.col(source).cast("double") if source else F.lit(None).cast("double")
            picks.append((F.lit(True) if since is None else F.col(period) >= since, value))
        column = F.lit(None).cast("double")
        for test, value in reversed(picks):
            column = F.when(test, value).otherwise(column)
        out[target] = column
    return out
