"""Joins and staging that stay safe when one key holds a large part of the rows.

Group statistics are joined back to the rows they came from in many operators. A window over a
period column would put every row of a period in one task, so the statistics are aggregated first
(partial aggregation on the map side), measured, and broadcast only when they are proven small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8 << 20


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
               max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, where: Column | None = None) -> DataFrame:
    """Join rows to a table that is expected to be small, on equal keys and an optional condition.

    The small side is read up to ``max_rows`` and measured. Within both bounds it is broadcast, so the big side is not
    shuffled; beyond them it is the plain shuffle join, whose skewed keys Spark splits. The rows are the same either way.
    Keys match with null-safe equality: a NULL group finds its own statistics.
    """
    head = small.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= max_bytes:
        fixed = big.sparkSession.createDataFrame(head, small.schema)
        return _null_safe_join(big, F.broadcast(fixed), on, how, where)
    return join_rows(big, small, on, how, where)


def held(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A table that is expected to be small and is used more than once: computed now, and kept as a local relation within
    both bounds, as a staged table beyond them. The rows are the same either way.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= max_bytes:
        return df.sparkSession.createDataFrame(head, df.schema)
    return stage(df)


def join_rows(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", where: Column | None = None) -> DataFrame:
    """Join of two tables of any size on null-safe keys; the optimizer picks the plan and splits skewed keys."""
    return _null_safe_join(left, right, on, how, where)


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                    where: Column | None) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    test = F.lit(True) if where is None else where
    for c in on:
        test = test & left[c].eqNullSafe(renamed[f"_r_{c}"])
    joined = left.join(renamed, test, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def attach(df: DataFrame, groups: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add group aggregates to every row: two-phase aggregate, then a measured join back."""
    aggs = [c.alias(name) for name, c in aggregates.items()]
    if groups:
        return join_small(df, df.groupBy(*groups).agg(*aggs), groups)
    row = df.agg(*aggs)
    values = row.first()
    types = {f.name: f.dataType for f in row.schema}
    return df.withColumns({name: F.lit(values[name]).cast(types[name]) for name in aggregates})


def literal_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few fixed rows as a local relation, whose size the optimizer knows."""
    schema = StructType.fromDDL(ddl)
    data = pa.table({f.name: [r[i] for r in rows] for i, f in enumerate(schema)})
    return spark.createDataFrame(data).select(*[F.col(f.name).cast(f.dataType) for f in schema])


def stage_root(spark: SparkSession) -> str:
    """This application's folder for staged tables, where all executors can read: below ``spark.checkpoint.dir``, or below
    the warehouse where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame that several passes read once to the shared folder.

    Later passes read only the columns they need, survive lost executors and know the table's size.
    With ``by`` there is one folder per value, so a filter on that column reads only its folder.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged; results that are still to be computed from it are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
