"""Tables stored by key, so that joins on it need no shuffle (inventory J2, J3)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def save(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write a catalog table in buckets of its key, sorted in each, and read it back.

    One shuffle at writing replaces one in every later join: tables with equal keys and numbers of buckets join bucket by
    bucket. Each bucket is one file. The number follows the session's shuffle partitions where it is not given; all tables
    of a star must share it.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def buckets_of(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    """Number of buckets and bucket columns of a table; 0 and none if it has no buckets."""
    facts = {r.col_name: r.data_type for r in spark.sql(f"describe extended `{name}`").collect()}
    columns = re.findall(r"`([^`]+)`", facts.get("Bucket Columns", ""))
    return int(facts.get("Num Buckets") or 0), columns


def star(spark: SparkSession, spine: str, parts: Mapping[str, Sequence[Column | str]], keys: Sequence[str]) -> DataFrame:
    """The spine with the wanted columns of every part, left joined on the key; all are names of tables stored by ``save``.

    Refuses tables that are not stored alike, as they would be shuffled. Every part must hold a key once at most. Rows of
    the spine without a match in a part get NULL there.
    """
    shapes = {name: buckets_of(spark, name) for name in (spine, *parts)}
    odd = [name for name, shape in shapes.items() if shape != shapes[spine] or shape[1] != list(keys)]
    if odd or not shapes[spine][0]:
        raise ValueError(f"not stored by {list(keys)} like the others: {odd or [spine]}")
    out = spark.table(spine)
    for name, columns in parts.items():
        out = out.join(spark.table(name).select(*keys, *columns), list(keys), "left")
    return out


def drop(spark: SparkSession, names: Sequence[str]) -> None:
    """Delete stored tables."""
    for name in names:
        spark.sql(f"drop table if exists `{name}`")
