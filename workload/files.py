"""Raw text files and tables derived from the test tables, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthstat.operators import reshape
from hearthstat.operators.scale import stage_root
from hearthstat.plans import tracts
from hearthstat.sources import io, raw, versions
from workload.base import CELLS_SQL, YEARS, cells_staged, query

FILE_SQL = CELLS_SQL + """,
tract AS (
  SELECT year, area, CASE WHEN area % 3 = 0 THEN '18' ELSE '17' END AS state, lpad(area::VARCHAR, 6, '0') AS code,
         spend, max_price, orders_total, pct_urgent FROM cells),
mine AS (SELECT year, area, state || '019' || code AS tract_geoid, code, spend, max_price, orders_total, pct_urgent,
                area // 100 || '.' || lpad((area % 100)::VARCHAR, 2, '0') AS number FROM tract WHERE state = '17')"""


def new_folder(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def raw_folder(spark, folder):
    """The customer-year panel as raw text tables, a file set per period; headers and their order change over the periods.

    Names hold commas. The files of 1996 were written without quotes, so their lines with such names have too many fields.
    """
    root = new_folder(spark, "raw")
    area = F.col("area")
    state = F.when(area % 3 == 0, "18").otherwise("17")
    number = F.concat(F.floor(area / 100).cast("string"), F.lit("."), F.lpad((area % 100).cast("string"), 2, "0"))
    name = F.concat(F.lit("Census Tract "), number, F.when(area % 2 == 0, ", Some County, Illinois").otherwise("; Some County; Illinois"))
    money = F.format_string("%.2f", "spend")
    rows = cells_staged(spark, folder).select(
        "year", F.concat(F.lit("1400000US"), state, F.lit("019"), F.lpad(area.cast("string"), 6, "0")).alias("GEO_ID"),
        F.when(area % 50 == 0, "250,000+").otherwise(money).alias("S1901_C01_001E"),
        F.when(area % 7 == 0, "(X)").otherwise(F.format_string("%.2f", "max_price")).alias("S1901_C01_001M"),
        F.col("orders_total").cast("string").alias("S1901_C02_001E"), F.col("pct_urgent").isNull().cast("string").alias("note"), name.alias("NAME"))
    label = rows.limit(1).select("year", F.lit("Geography").alias("GEO_ID"), F.lit("Estimate").alias("S1901_C01_001E"), F.lit("Margin").alias("S1901_C01_001M"),
                                 F.lit("Estimate").alias("S1901_C02_001E"), F.lit("x").alias("note"), F.lit("Name").alias("NAME"))
    for year in YEARS:
        shape = ["GEO_ID", "S1901_C01_001E", "S1901_C01_001M", "NAME"]
        if year >= 1998:
            shape = ["GEO_ID", "NAME", "S1901_C02_001E", "S1901_C01_001M", "S1901_C01_001E"]
        quote = "" if year == 1996 else '"'
        table = rows.where(F.col("year") == year).unionByName(label.withColumn("year", F.lit(year)))
        table.select(*shape).write.option("header", True).option("quote", quote).option("escape", '"').csv(f"{root}/ACSST5Y{year}.S1901-Data.csv")
    return root


def raw_table(spark, folder):
    inventory = io.file_inventory(spark, raw_folder(spark, folder))
    return raw.read_inventory_table(spark, inventory, "s1901")


@query("raw_files_typed", "year:i tract_geoid:s s1901_c01_001e:d s1901_c01_001m:d s1901_c02_001e:d", "WITH" + FILE_SQL + """---
       SELECT year, tract_geoid,
              CASE WHEN area % 50 <> 0 THEN round(spend, 2) END AS s1901_c01_001e,
              CASE WHEN year = 1996 AND area % 50 = 0 THEN NULL WHEN area % 7 <> 0 THEN round(max_price, 2) END AS s1901_c01_001m,
              CASE WHEN year >= 1998 THEN orders_total END AS s1901_c02_001e FROM mine""", digits=2)
def raw_files_typed(spark, folder):
    """Files to inventory, one aligned scan, staging rows of one county, typed measures."""
    staged = tracts.stage_files(raw_table(spark, folder), "s1901", "Subject Table", "ST", "17", "019")
    return tracts.typed_table([staged], "s1901")


@query("raw_files_lines", "year:i table_code:s line_count:i malformed_count:i", "WITH" + CELLS_SQL + """---
       SELECT year, 'S1901' AS table_code, count(*) + 1 AS line_count,
              count(*) FILTER (year = 1996 AND (area % 2 = 0 OR area % 50 = 0)) AS malformed_count FROM cells GROUP BY year""")
def raw_files_lines(spark, folder):
    """Lines of every period's files, label rows included, and those that do not fit their header."""
    return raw.line_report(raw_table(spark, folder))


@query("tract_dimension_files", "tract_geoid:s tract_number:s tract_name_canonical:s county_name:s state_name:s first_year:i last_year:i years:i",
       "WITH" + FILE_SQL + """---
       SELECT tract_geoid, any_value(number) AS tract_number, 'Census Tract ' || any_value(number) AS tract_name_canonical,
              'Some County' AS county_name, 'Illinois' AS state_name, min(year) AS first_year, max(year) AS last_year, count(*) AS years
       FROM mine WHERE year <> 1996 GROUP BY tract_geoid""")
def tract_dimension_files(spark, folder):
    """Tract dimension and bridge from the raw files of all periods but the broken one."""
    table = raw_table(spark, folder).where("year <> 1996")
    found = tracts.build_dimensions(tracts.audit_of_files(table, "17", "019"), [y for y in YEARS if y != 1996])
    spans = found["bridge_tract_year"].groupBy("tract_geoid").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("years"))
    return found["dim_tract"].select("tract_geoid", "tract_number", "tract_name_canonical", "county_name", "state_name").join(spans, "tract_geoid")


@query("versioned_replace", "version:i rows:i spend:d changed:i", "WITH" + CELLS_SQL + """,
       two AS (SELECT area, year, CASE WHEN area % 5 = 0 THEN spend + 1 ELSE spend END AS spend FROM cells WHERE year <> 1995)---
       SELECT 1 AS version, count(*) AS rows, sum(spend) AS spend, 0 AS changed FROM cells
       UNION ALL SELECT 2, count(*), sum(spend), (SELECT count(*) FROM cells WHERE year = 1995 OR area % 5 = 0) FROM two
       UNION ALL SELECT 3, count(*), sum(spend), (SELECT count(*) FROM cells WHERE year = 1995 OR area % 5 = 0) FROM cells""", digits=2)
def versioned_replace(spark, folder):
    """A table replaced from itself and set back: every version reads as it was."""
    root = new_folder(spark, "versions")
    versions.replace(cells_staged(spark, folder).select("area", "year", "spend"), root)
    spend = F.when(F.col("area") % 5 == 0, F.col("spend") + 1).otherwise(F.col("spend"))
    versions.replace(versions.read(spark, root).where("year <> 1995").withColumn("spend", spend), root, expect=1)
    versions.restore(spark, root, 1)
    sums = [versions.read(spark, root, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("rows"), F.sum("spend").alias("spend")) for v in (1, 2, 3)]
    steps = [versions.changes(spark, root, v, v + 1, ["area", "year"]).agg(F.lit(v + 1).alias("version"), F.count(F.lit(1)).alias("changed")) for v in (1, 2)]
    return reshape.union_all(sums).join(reshape.union_all(steps), "version", "left").na.fill(0, ["changed"])


@query("written_and_read", "kind:s year:i rows:i spend:d", "WITH" + CELLS_SQL + """---
       SELECT kind, year, count(*) AS rows, sum(round(spend, 2)) AS spend
       FROM cells, (VALUES ('csv'), ('partitioned'), ('report'), ('table'), ('variants')) k(kind) GROUP BY ALL""", digits=2)
def written_and_read(spark, folder):
    """Every sink read back: typed CSV (S2, S8), a folder per period (S12, S13), an ordered report (S11), a catalog table (S9, S10),
    and a folder per variant (S14)."""
    root = new_folder(spark, "sinks")
    panel = cells_staged(spark, folder).select("area", "year", F.round("spend", 2).alias("spend"))
    ddl = "area long, year int, spend double"
    io.write_dataset(panel, f"{root}/csv", fmt="csv")
    io.write_dataset(panel, f"{root}/partitioned", ["year"], order=["area"])
    io.write_report(panel, f"{root}/report", ["year", "area"])
    variant = F.when(F.col("area") % 2 == 0, "complete").otherwise("nonstudent")
    io.write_dataset(panel.withColumn("source_variant", variant), f"{root}/variants", ["source_variant"])
    name = f"panel_{uuid.uuid4().hex}"
    io.write_table(panel, name, ["year"])
    read = {"csv": io.read_typed_table(spark, f"{root}/csv", ddl), "partitioned": spark.read.schema(ddl).parquet(f"{root}/partitioned"),
            "report": io.read_typed_table(spark, f"{root}/report", ddl), "table": spark.table(name),
            "variants": spark.read.parquet(f"{root}/variants").where("source_variant in ('complete', 'nonstudent')")}
    rows = reshape.union_all([df.select(F.lit(kind).alias("kind"), "year", "spend") for kind, df in read.items()])
    return rows.groupBy("kind", "year").agg(F.count(F.lit(1)).alias("rows"), F.sum("spend").alias("spend"))
