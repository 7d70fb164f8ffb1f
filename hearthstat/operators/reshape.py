"""Wide to long, long to wide, and unions by name (inventory A34-A37, A42, U1-U4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import metric_kind, tag


def rows_from(df: DataFrame, ids: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Several output rows per input row from named expressions: one scan, no union of branches."""
    made = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])
    return df.select(*ids, F.inline(made))


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric_name",
            value: str = "metric_value") -> DataFrame:
    """Unpivot; rows without a value are dropped."""
    doubled = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubled.unpivot(list(ids), list(metrics), name, value).where(F.col(value).isNotNull())


def metric_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], source: str | Column,
                groups: Mapping[str, str]) -> DataFrame:
    """Long fact with source, group and kind tags."""
    source = F.lit(source) if isinstance(source, str) else source
    return to_long(df, ids, metrics).withColumns({
        "source_table": F.upper(source),
        "metric_group": tag(F.lower(source), groups, "other"),
        "metric_kind": metric_kind("metric_name"),
    })


def to_wide(df: DataFrame, ids: Sequence[str], name: str, values: Sequence, agg: Column,
            fill: float | int | None = None) -> DataFrame:
    """Pivot over fixed column values, so no extra pass looks for them."""
    wide = df.groupBy(*ids).pivot(name, list(values)).agg(agg)
    return wide if fill is None else wide.na.fill(fill, [str(v) for v in values])


def union_all(frames: Sequence[DataFrame], columns: str = "same") -> DataFrame:
    """UNION ALL by name: the 'same' columns (U1), the 'common' ones (U2) or 'all' with NULLs."""
    if columns == "common":
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
        frames = [f.select(*shared) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=columns == "all"), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION without duplicates (U4)."""
    return union_all(frames).distinct()


def metric_dictionary(long: DataFrame) -> DataFrame:
    """Distinct metrics with their tags."""
    return long.select("source_table", "metric_group", "metric_name", "metric_kind").distinct()


def long_coverage(long: DataFrame, by: Sequence[str], entity: str = "tract_geoid") -> DataFrame:
    """Rows, distinct metrics and distinct entities per group."""
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("metric_name").alias("distinct_metrics"),
        F.countDistinct(entity).alias("distinct_entities"))
