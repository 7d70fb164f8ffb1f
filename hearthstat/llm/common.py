"""Staging, ordered positions and word rules that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"
_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_DEALT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
MARKS, MARK_BITS = 2_048, 32_768  # rows of bits at most, and bits of a row as ``bitmap_construct_agg`` makes them


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a frame once, so that later passes read it back and no executor holds the only copy."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[staged] = path
    return staged


def stage_dealt(df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
    """``stage`` in buckets of a key: one shuffle at writing replaces that of this side in every join with ``dealt``.

    The frame itself is read without its buckets, so its joins are dealt anew and Spark can split their hot keys. There are as
    many buckets as shuffle partitions; deal the rows by the key to that number before, so that a bucket is one file.
    """
    spark, path, table = df.sparkSession, stage_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec).option("path", path).format("parquet")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    staged = spark.read.schema(df.schema).parquet(path)
    _STAGED[staged], _DEALT[staged] = path, table
    return staged


def dealt(df: DataFrame) -> DataFrame:
    """What ``stage_dealt`` wrote for a frame, in its buckets; any other frame as it is."""
    return df.sparkSession.table(_DEALT[df]) if df in _DEALT else df


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of ``ids`` (a staged column of that name), and some others: what a semi join need not move.

    A key marks the bit that its hash names. There are 16 bits a key up to 8 MB in all, so what Spark hands to all tasks is
    bounded; beyond some millions of keys more of the other rows stay.
    """
    blocks = max(1, min(MARKS, -(-ids.count() * 16 // MARK_BITS)))
    place = F.pmod(F.xxhash64(key), F.lit(blocks * MARK_BITS))
    marks = ids.select(F.floor(place / MARK_BITS).alias("_block"), (place % MARK_BITS).alias("_at")).repartition("_block")
    marks = marks.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    at = place % MARK_BITS
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(marks), F.floor(place / MARK_BITS) == F.col("_block"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def unstage(spark: SparkSession, path: str) -> None:
    """Delete one staged folder, through the file system that it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame | None) -> None:
    """Delete what ``stage`` wrote for these frames, once every reader of theirs has been written; others are left alone."""
    for df in frames:
        if df is not None and (path := _STAGED.pop(df, None)):
            if table := _DEALT.pop(df, None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            unstage(df.sparkSession, path)


def follow(result: DataFrame, staged: DataFrame) -> DataFrame:
    """``result``, which is read from a staged frame, to be dropped in its place."""
    _STAGED[result] = _STAGED.pop(staged)
    return result


def boxed(df: DataFrame, **columns: str) -> DataFrame:
    """Whole rows as one column ``row``, beside the columns that are needed, so that no other name can clash."""
    quoted = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*quoted).alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Mapping[str, str], name: str) -> DataFrame:
    """Add, for each item of ``sums`` (new column: summed column), the total of the rows before in the group's order.

    Rows are dealt by range and sorted, so that a task holds a stretch of the order whatever the groups' sizes. The
    stretch is written down with its number; per-stretch totals then give where each stretch begins. NULL sorts last.
    Rows equal in all order columns may change places.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*groups, *order]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    inside = W.partitionBy("_part", *groups).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = cut.groupBy("_part", *groups).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select("_part", *groups, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), zero).alias(f"_b_{n}") for n in sums])
    totals = totals.withColumnsRenamed({c: f"_k_{c}" for c in ["_part", *groups]})
    rows = cut.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
    test = rows["_part"] == totals["_k__part"]
    for c in groups:
        test = test & rows[c].eqNullSafe(totals[f"_k_{c}"])
    joined = rows.join(totals, test)
    return joined.select(*df.columns, *[(rows[n] + F.col(f"_b_{n}")).alias(n) for n in sums])


def ranks(df: DataFrame, groups: Sequence[str], order: Sequence[str], rank: str, name: str) -> DataFrame:
    """Add each row's number within its group, from 0, in the given order; dealt as in ``positions``, without a window."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*groups, *order]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        (F.col("_before") - F.col("_first")).alias("_shift"), *[F.col(c).alias(f"_k_{c}") for c in ["_part", *groups]])
    test = cut["_part"] == starts["_k__part"]
    for c in groups:
        test = test & cut[c].eqNullSafe(starts[f"_k_{c}"])
    return cut.join(starts, test).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(rank))
