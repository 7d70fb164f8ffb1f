"""Tables that are replaced as a whole and keep their versions (inventory S9, S15, S18).

A table is a folder. Every version lies in a folder of its own below ``data``; a small file below ``manifest`` names it.
A version exists once its manifest does, and manifests appear by an atomic rename that never replaces one: a reader sees
the version before or the one after, never a half-written table, and of two writers of one version one fails.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, path string, row_count long, columns string, note string, parent long, created timestamp"


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Published versions, by the names of their manifests."""
    folder = _path(spark, f"{root}/manifest")
    files = _files(spark, root)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def _publish(spark: SparkSession, root: str, entry: dict) -> None:
    """Write the manifest aside, then rename it; fails if its version is there already."""
    files, jvm = _files(spark, root), spark._jvm
    folder = f"{root}/manifest"
    files.mkdirs(_path(spark, folder))
    aside, name = _path(spark, f"{folder}/.{uuid.uuid4().hex}"), _path(spark, f"{folder}/{entry['version']:012d}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(rename, 1)
    kinds[0] = getattr(rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(name), kinds)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise VersionConflict(f"version {entry['version']} of {root} exists") from error
        raise


def replace(df: DataFrame, root: str, note: str = "", expect: int | None = None) -> int:
    """Make ``df`` the table's next version and return its number.

    The frame may be derived from the table itself, as nothing is overwritten. ``expect`` is the version that the change
    was made from; if another one is current by now, the write fails and the table stays as it is.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    known = _numbers(spark, root)
    parent = known[-1] if known else 0
    if expect is not None and expect != parent:
        raise VersionConflict(f"{root} is at version {parent}, not {expect}")
    path = f"{root}/data/{parent + 1:012d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    _publish(spark, root, {"version": parent + 1, "path": path, "row_count": rows, "columns": df.schema.json(), "note": note,
                           "parent": parent, "created": spark.range(1).select(F.current_timestamp().cast("string")).first()[0]})
    return parent + 1


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row per published version: where it lies, rows, columns, note, the version before, and when."""
    root = root.rstrip("/")
    paths = [f"{root}/manifest/{n:012d}.json" for n in _numbers(spark, root)]
    if not paths:
        raise FileNotFoundError(f"no version of {root}")
    return spark.read.schema(MANIFEST).json(paths)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or an older one (S18). A frame that was read stays valid when the table is replaced."""
    known = _numbers(spark, root.rstrip("/"))
    wanted = version if version is not None else (known[-1] if known else None)
    if wanted not in known:
        raise FileNotFoundError(f"{root} has no version {wanted}")
    entry = spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifest/{wanted:012d}.json").first()
    return spark.read.schema(StructType.fromJson(json.loads(entry["columns"]))).parquet(entry.path)


def restore(spark: SparkSession, root: str, version: int, note: str = "") -> int:
    """Publish an older version's files again as the next version; nothing is copied."""
    old = history(spark, root).where(F.col("version") == version).first()
    if old is None:
        raise FileNotFoundError(f"{root} has no version {version}")
    latest = _numbers(spark, root.rstrip("/"))[-1]
    _publish(spark, root.rstrip("/"), {**old.asDict(), "version": latest + 1, "parent": latest, "note": note or f"version {version} again",
                                       "created": spark.range(1).select(F.current_timestamp().cast("string")).first()[0]})
    return latest + 1


def changes(spark: SparkSession, root: str, before: int, after: int, key: list[str]) -> DataFrame:
    """What differs between two versions by key: 'added', 'removed' or 'changed' rows, from one pass over both."""
    old, new = read(spark, root, before), read(spark, root, after)
    shared = [c for c in old.columns if c in new.columns and c not in key]

    def marked(df: DataFrame, side: int) -> DataFrame:
        return df.select(*key, F.lit(side).alias("_side"), F.xxhash64(*shared).alias("_h"))

    both = marked(old, 0).unionByName(marked(new, 1)).groupBy(*key).agg(
        F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b"),
        F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    kind = F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").when(F.col("_lo") != F.col("_hi"), "changed")
    return both.select(*key, kind.alias("change")).where("change is not null")


def forget(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all but the latest ``keep`` versions; files that a kept version names stay. Returns the versions removed."""
    root = root.rstrip("/")
    if keep < 1:
        raise ValueError("the current version is always kept")
    rows = history(spark, root).orderBy("version").select("version", "path").collect()  # one row per version
    gone, kept = rows[:-keep], {r.path for r in rows[-keep:]}
    files = _files(spark, root)
    for r in gone:
        files.delete(_path(spark, f"{root}/manifest/{r.version:012d}.json"), False)
        if r.path not in kept:
            files.delete(_path(spark, r.path), True)
    return [r.version for r in gone]
