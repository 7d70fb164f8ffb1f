"""Raw text tables, file inventories, table sinks and literal tables (inventory S1-S22, M5)."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from hearthstat.operators.scale import literal_table

# Fixed value: file name of a raw table: type, period, code, part and extension.
FILE_PATTERN = r"(?i)ACS(DT|ST|DP)5Y(\d{4})\.([A-Z0-9]+)-(Data|Column-Metadata|Table-Notes)\.(csv|txt)"
# A large table may be a folder of that name with files in it.
PART_PATTERN = FILE_PATTERN + r"(?:/[^/]+)?$"


# Conditions by which Spark says that a path or table is not there.
MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")

# Periods of the pipeline; the label columns follow one form.
PERIODS = (2019, 2021, 2022, 2023)

# Column names that changed their meaning or clash with keywords on load.
MICRODATA_NAMES = {"st": "state", "type": "typehugq", "access": "accessinet", "ybl": "yrblt"}


def read_text_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with every column as text, so keys keep their leading zeros."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.csv(paths, header=True, inferSchema=False, multiLine=False, encoding="UTF-8")


def read_typed_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a declared schema; types are never guessed."""
    return spark.read.csv(path, header=True, schema=schema)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names only (S3)."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def clean_name(name: str) -> str:
    """Lower case, runs of other characters to one '_', no digit in front.

    The reader calls a column with an empty header ``_c<position>``; it becomes ``unnamed_<position>``.
    """
    empty = re.fullmatch(r"_c(\d+)", name)
    if empty:
        return f"unnamed_{empty[1]}"
    text = re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "col"
    return f"col_{text}" if text[0].isdigit() else text


def unique_names(names: Sequence[str], clean: Callable[[str], str] = clean_name) -> list[str]:
    """Cleaned names, repeated ones numbered _2, _3, ...."""
    seen: dict[str, int] = {}
    out = []
    for name in map(clean, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def microdata_name(name: str) -> str:
    """Name of a microdata column on load."""
    text = clean_name(name.replace("%", "percent"))
    return MICRODATA_NAMES.get(text, text)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with source type, period, table code and part; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    plain = F.url_decode(F.col("path"))

    def group(i: int) -> Column:
        return F.regexp_extract(plain, PART_PATTERN, i)

    found = files.select(
        "path", F.upper(group(1)).alias("source_type"), F.nullif(group(2), F.lit("")).cast("int").alias("year"),
        F.upper(group(3)).alias("table_code"), group(4).alias("file_kind"))
    return found.where("year is not null").withColumn("table_family", table_family("table_code"))


def table_family(code: Column | str) -> Column:
    """Family of a table from the first letters of its code."""
    c = F.upper(F.col(code) if isinstance(code, str) else code)
    return F.when(c.startswith("DP"), "Data Profile").when(c.startswith("S"), "Subject Table").when(
        c.startswith("B") | c.startswith("C"), "Detailed Table").otherwise("Unknown")


def write_dataset(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """Distributed write, one folder per partition value."""
    writer = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered CSV: the files in the order of their names hold the rows in the stated order (S11). A small table is one file."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> None:
    """Replace a catalog table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Keep a table as it was before a fix, under its version."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def first_available(spark: SparkSession, sources: Sequence[Callable[[], DataFrame] | str]) -> DataFrame:
    """First source that exists: a catalog table name or a reader.

    Only a missing path or table moves on to the next source; any other error is raised. If none exists, all are named.
    """
    tried = []
    for source in sources:
        if isinstance(source, str):
            if spark.catalog.tableExists(source):
                return spark.table(source)
            tried.append(source)
            continue
        try:
            return source()
        except (AnalysisException, FileNotFoundError) as error:
            missing = isinstance(error, FileNotFoundError) or error.getCondition() in MISSING
            if not missing:
                raise
            tried.append(f"{getattr(source, '__name__', 'reader')}: {type(error).__name__}")
    raise FileNotFoundError(f"no source available, tried {tried}")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns of a table."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def discover_tables(spark: SparkSession, pattern: str) -> list[str]:
    """Catalog tables whose name matches a pattern."""
    return sorted(t.name for t in spark.catalog.listTables() if re.search(pattern, t.name))


def resolve_column(columns: Sequence[str], candidates: Sequence[str], required: bool = False) -> str | None:
    """First candidate present, ignoring case."""
    known = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in known:
            return known[c.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {list(columns)}")
    return None


def require_columns(df: DataFrame, needed: Sequence[str], name: str = "table") -> None:
    """Stop with the list of missing columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{name} misses required columns: {missing}")


def measure_columns(columns: Sequence[str], code: str) -> list[str]:
    """Measures of a table by name pattern, sorted."""
    return sorted(c for c in columns if re.match(rf"^{re.escape(code)}_.+[em]$", c))


# Patterns for well-known metrics, the first that hits wins.
METRIC_PATTERNS = {
    "median_household_income": ("median.*household.*income", "household.*income.*median", "b19013"),
    "poverty_rate": ("poverty.*rate", "below.*poverty", "pct.*poverty", "s1701"),
    "rent_burden": ("rent.*burden", "gross.*rent.*income", "b25070"),
    "unemployment_rate": ("unemploy", "s2301"),
    "education_bachelors_or_higher": ("bachelor", "graduate", "college", "s1501"),
    "owner_occupied_share": ("owner.*occupied", "owner", "b25003"),
    "median_gross_rent": ("median.*gross.*rent", "gross.*rent.*median"),
    "median_home_value": ("median.*value", "home.*value"),
    "limited_english_share": ("limited.*english", "english.*less", "s1601"),
    "population_65_plus_share": ("65.*over", "65.*plus", "elder", "senior"),
}


def matching_metrics(columns: Sequence[str], patterns: Mapping[str, Sequence[str]] = METRIC_PATTERNS) -> dict[str, str]:
    """Column by metric name: the shortest that the first hitting pattern of the name matches, in any case."""
    chosen = {}
    for name, tried in patterns.items():
        hits = next((h for p in tried if (h := [c for c in columns if re.search(p, c.lower())])), None)
        if hits:
            chosen[name] = min(hits, key=len)
    return chosen


def column_dictionary(df: DataFrame) -> DataFrame:
    """Position, name and type of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)]
    return literal_table(df.sparkSession, rows, "position int, column_name string, data_type string")


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def build_manifest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per table and period with the column count and a status."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumns({"column_count": F.lit(len(df.columns)), "status": F.lit("ok")})


def named_views(df: DataFrame, prefix: str, period: str = "year", latest: int = PERIODS[-1],
                stable: str = "is_stable_all_4_years", cluster_columns: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Named subsets registered as views: all, latest period, stable areas, cluster input."""
    views = {f"{prefix}_all_years": df, f"{prefix}_{latest}": df.where(F.col(period) == latest),
             f"{prefix}_stable_4yr": df.where(F.col(stable) == 1)}
    if cluster_columns:
        views[f"{prefix}_cluster_input"] = df.select(*cluster_columns)
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return views


def dim_year(spark: SparkSession, periods: Sequence[int] = PERIODS) -> DataFrame:
    """Literal period dimension."""
    rows = [(y, f"ACS {y} 5-Year", "ACS5", "5-Year", 0, 1) for y in periods]
    return literal_table(spark, rows, "year int, year_label string, acs_dataset string, acs_period string, "
                                       "is_experimental int, is_in_pipeline int")
