"""Raw delimited files of many periods as one table, read in one scan (inventory S1, S3, S4, S7)."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.operators.scale import literal_table
from hearthstat.sources.io import unique_names

MALFORMED = "_malformed_line"


def first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The first line of each file, opened through the file system that holds it; no job, and no more is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(conf).open(where)
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            found[path] = (reader.readLine() or "").removeprefix("﻿")
        finally:
            stream.close()
    return found


def field_names(line: str, sep: str = ",") -> list[str]:
    """Cleaned, distinct column names of a header line."""
    names = next(csv.reader([line], delimiter=sep), [])
    return unique_names([n or f"_c{i}" for i, n in enumerate(names)])


def field_count(line: Column, sep: str = ",") -> Column:
    """Number of fields of a line: separators outside quotes and one; NULL if a quote stays open."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.when(~bare.contains('"'), F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1)


def _plain(path: Column) -> Column:
    """A path in one form, whatever part of Spark names it."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(path), path), r"^(\w+):/+", "$1:/")


def read_aligned(spark: SparkSession, files: DataFrame, sep: str = ",") -> DataFrame:
    """All files of a listing as one frame of text columns, from one scan whatever their number.

    ``files`` has a row per file: its ``path``, and columns that every row of the file gets (period, table code). Columns
    are aligned by the cleaned names of each file's header, in the order of their first appearance; a file without a
    column gives NULL there. Files with equal headers share one rule, so the plan grows with the number of different
    headers. A line that has another number of fields than its header, or an open quote, is kept with what could be read
    and stands whole in ``_malformed_line``. Header lines are dropped wherever they stand, so a table may come in parts
    that repeat it; empty lines are dropped. Quotes in quoted fields are doubled; a quoted field ends on its line.
    """
    tags = [c for c in files.columns if c != "path"]
    listed = files.withColumn("_plain", _plain(F.col("path"))).orderBy(*tags, "path").collect()  # one row per file: metadata
    if not listed:
        raise FileNotFoundError("no files to read")
    heads = first_lines(spark, [r.path for r in listed])
    kinds = {line: i for i, line in enumerate(dict.fromkeys(heads[r.path] for r in listed))}
    fields = [field_names(line, sep) for line in kinds]
    columns = list(dict.fromkeys(name for names in fields for name in names))
    clash = [c for c in tags if c in columns]
    if clash:
        raise ValueError(f"columns of the files are called like those of the listing: {clash}")
    shape = files.schema
    rows = [(r["_plain"], kinds[heads[r.path]], heads[r.path], len(fields[kinds[heads[r.path]]]), *[r[c] for c in tags]) for r in listed]
    ddl = ", ".join(["_path string", "_kind int", "_head string", "_fields int", *[f"`_t_{c}` {shape[c].dataType.simpleString()}" for c in tags]])
    known = literal_table(spark, rows, ddl)

    lines = spark.read.text([r.path for r in listed]).select("value", _plain(F.col("_metadata.file_path")).alias("_file"))
    found = lines.join(F.broadcast(known), F.col("_file") == F.col("_path"))  # one row per file
    line = F.ltrim(F.col("value"), F.lit("﻿"))
    found = found.where((F.trim(line) != "") & (line != F.col("_head")))
    most = max(map(len, fields))
    schema = ", ".join(f"f{i} string" for i in range(most))
    parsed = found.withColumn("_f", F.from_csv(line, schema, {"sep": sep, "mode": "PERMISSIVE", "escape": '"'}))

    def aligned(name: str) -> Column:
        places: dict[int, list[int]] = {}
        for kind, names in enumerate(fields):
            if name in names:
                places.setdefault(names.index(name), []).append(kind)
        if len(places) == 1 and sum(map(len, places.values())) == len(fields):
            return F.col(f"_f.f{next(iter(places))}").alias(name)
        return F.coalesce(*[F.when(F.col("_kind").isin(which), F.col(f"_f.f{i}")) for i, which in places.items()]).alias(name)

    bad = F.when(~field_count(line, sep).eqNullSafe(F.col("_fields")), line).alias(MALFORMED)
    return parsed.select(*[aligned(c) for c in columns], *[F.col(f"_t_{c}").alias(c) for c in tags], bad)


def shared_columns(spark: SparkSession, files: DataFrame, sep: str = ",") -> list[str]:
    """Columns that the headers of all files have, in the order of the first one."""
    heads = first_lines(spark, [r.path for r in files.orderBy(*[c for c in files.columns if c != "path"], "path").collect()])
    fields = [field_names(line, sep) for line in heads.values()]
    return [c for c in fields[0] if all(c in names for names in fields)]


def data_files(inventory: DataFrame, code: str) -> DataFrame:
    """Path, period and code of the data files of one table."""
    rows = inventory.where((F.col("table_code") == code.upper()) & (F.col("file_kind") == "Data"))
    return rows.select("path", "year", "table_code")


def read_inventory_table(spark: SparkSession, inventory: DataFrame, code: str) -> DataFrame:
    """All periods of one raw table in one scan, with period and code from the file names."""
    return read_aligned(spark, data_files(inventory, code))


def line_report(raw: DataFrame, by: Sequence[str] = ("year", "table_code")) -> DataFrame:
    """Lines and malformed lines per period and table."""
    return raw.groupBy(*by).agg(F.count(F.lit(1)).alias("line_count"), F.count(MALFORMED).alias("malformed_count"))
