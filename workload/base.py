"""Shared frames over the test tables, their SQL twins, and the registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hearthstat.operators import household as hh
from hearthstat.operators import thresholds as th
from hearthstat.operators.scale import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEARS = list(range(1995, 2002))
FULL_AREA, PART_AREA, PART_FACTOR = 1901, 1902, 0.25
INDEX = {1995: 250, 1996: 262, 1997: 275, 1998: 286, 1999: 295, 2000: 304, 2001: 318}
UPLIFTS = {1995: 25000, 1996: 37500, 1997: 37500}
BUDGET_SCALE = 5


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: whole numbers as bigint, other numbers as rounded double."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle_text(spec: str, sql: str, digits: int = 6) -> str:
    """Wrap SQL so that its columns have the types of ``spec``: name:i, name:d, name:s or name:b."""
    cols = []
    for item in spec.split():
        name, kind = item.rsplit(":", 1)
        q = f'"{name}"'
        cols.append({"i": f"CAST({q} AS BIGINT) AS {q}", "d": f"ROUND(CAST({q} AS DOUBLE), {digits}) + 0.0 AS {q}",
                     "s": f"CAST({q} AS VARCHAR) AS {q}", "b": f"CAST({q} AS BOOLEAN) AS {q}"}[kind])
    with_part, _, body = sql.rpartition("---")
    return f"{with_part}\nSELECT {', '.join(cols)} FROM ({body}) AS result"


def query(name: str, spec: str | None = None, sql: str | None = None, digits: int = 6):
    """Register a query and, where SQL can say it, its oracle. '---' ends the WITH part of the SQL."""
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: tidy(build(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = oracle_text(spec, sql, digits)
        return build
    return add


@cache
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Households: orders with their customer's area; persons: order lines.

def housing(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    key = F.col("o_orderkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        key.alias("serialno"), F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("state"),
        F.when(F.col("c_mktsegment") == "MACHINERY", PART_AREA).otherwise(FULL_AREA).alias("puma"),
        (1 + F.col("o_custkey") % 100).alias("wgtp"), (key % 6).alias("np"),
        F.when(key % 17 != 0, F.col("o_totalprice")).alias("hincp"),
        (1000000 + 1000 * (F.year("o_orderdate") - 1995)).alias("adjinc"),
        F.when(key % 23 != 0, key % 4).alias("noc"))


def persons(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("serialno"), line.alias("sporder"), F.col("l_quantity").cast("int").alias("agep"),
        F.when(line == 1, 20).otherwise(21).alias("relshipp"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 3).otherwise(1).alias("sch"),
        F.when(line != 7, F.when(F.col("l_linestatus") == "O", 15).otherwise(14)).alias("schg"),
        (line % 4).alias("esr"))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return hh.household_profile(housing(spark, folder), persons(spark, folder))


@cache
def raw_thresholds(spark: SparkSession) -> DataFrame:
    table = th.backfilled(th.base_thresholds(spark, BUDGET_SCALE), INDEX, 2001)
    return table.where("not (year = 1998 and hh_comp_key = 'other')")


@cache
def final_thresholds(spark: SparkSession) -> DataFrame:
    return th.calibrated(raw_thresholds(spark), UPLIFTS)


def final(spark: SparkSession, folder: str) -> DataFrame:
    weight = hh.analysis_weight("wgtp", "puma", [FULL_AREA], [PART_AREA], PART_FACTOR)
    return hh.household_final(profile(spark, folder), final_thresholds(spark), weight)


PROFILE_SQL = """
housing AS (
  SELECT o_orderkey AS serialno, year(o_orderdate) AS year, c_nationkey AS state,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 1902 ELSE 1901 END AS puma,
         1 + o_custkey % 100 AS wgtp, o_orderkey % 6 AS np,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS hincp,
         1000000 + 1000 * (year(o_orderdate) - 1995) AS adjinc,
         CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 4 END AS noc
  FROM orders JOIN customer ON o_custkey = c_custkey),
flags AS (
  SELECT l_orderkey AS serialno,
         CASE WHEN l_quantity >= 18 THEN 1 ELSE 0 END AS adult,
         CASE WHEN l_quantity BETWEEN 18 AND 24 THEN 1 ELSE 0 END AS college,
         CASE WHEN l_returnflag IN ('R', 'N') THEN 1 ELSE 0 END AS enrolled,
         CASE WHEN l_quantity BETWEEN 18 AND 24 AND l_returnflag IN ('R', 'N') AND l_linenumber <> 7
               AND l_linestatus = 'O' THEN 1 ELSE 0 END AS student,
         CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS head,
         CASE WHEN l_linenumber % 4 IN (1, 2) THEN 1 ELSE 0 END AS employed
  FROM lineitem),
agg AS (
  SELECT serialno, count(*) AS person_count, sum(adult) AS adult_count, sum(college) AS college_age_count,
         sum(enrolled) AS student_enrolled_count, sum(student) AS likely_college_student_count,
         sum(employed) AS employed_count, sum(head) AS reference_person_count,
         max(CASE WHEN head = 1 AND student = 1 THEN 1 ELSE 0 END) AS reference_person_student_flag,
         CASE WHEN sum(student) > 0 THEN 1 ELSE 0 END AS has_any_likely_college_student,
         CASE WHEN sum(enrolled) > 0 THEN 1 ELSE 0 END AS has_any_student,
         CASE WHEN sum(college) > 0 THEN 1 ELSE 0 END AS has_any_college_age_person,
         CASE WHEN sum(employed) > 0 THEN 1 ELSE 0 END AS has_any_employed_person,
         sum(student)::DOUBLE / nullif(count(*), 0) AS student_share_of_persons,
         sum(student)::DOUBLE / nullif(sum(adult), 0) AS student_share_of_adults,
         sum(college)::DOUBLE / nullif(count(*), 0) AS college_age_share_of_persons,
         CASE WHEN sum(student) > 0 AND (max(CASE WHEN head = 1 AND student = 1 THEN 1 ELSE 0 END) = 1
               OR sum(student)::DOUBLE / nullif(sum(adult), 0) >= 0.5) THEN 1 ELSE 0 END AS student_heavy_flag_rule_a,
         CASE WHEN sum(student)::DOUBLE / nullif(count(*), 0) >= 0.5 AND sum(employed) = 0
              THEN 1 ELSE 0 END AS student_heavy_flag_rule_b
  FROM flags GROUP BY serialno),
prof AS (SELECT h.*, a.* EXCLUDE (serialno) FROM housing h LEFT JOIN agg a USING (serialno))"""

THRESHOLD_SQL = """
base(hh_comp_key, monthly) AS (VALUES
  ('1_adult_0_child', 2779), ('1_adult_1_child', 3824), ('1_adult_2plus_child', 5186),
  ('2_adult_0_child', 3874), ('2_adult_1_child', 5230), ('2_adult_2plus_child', 6001),
  ('3plus_adult_0_child', 5340), ('3plus_adult_1plus_child', 6108), ('other', 2779)),
idx(year, v) AS (VALUES (1995, 250), (1996, 262), (1997, 275), (1998, 286), (1999, 295), (2000, 304), (2001, 318)),
raw_thr AS (
  SELECT year, hh_comp_key, round(60.0 * monthly * v / 318.0, 2)::DOUBLE AS annual_threshold
  FROM base, idx WHERE NOT (year = 1998 AND hh_comp_key = 'other')),
thr AS (
  SELECT year, hh_comp_key, annual_threshold AS raw_threshold, annual_threshold +
         CASE WHEN hh_comp_key IN ('1_adult_0_child', '2_adult_0_child')
              THEN CASE year WHEN 1995 THEN 25000 WHEN 1996 THEN 37500 WHEN 1997 THEN 37500 ELSE 0 END
              ELSE 0 END AS annual_threshold
  FROM raw_thr)"""

FINAL_SQL = "WITH" + PROFILE_SQL + "," + THRESHOLD_SQL + """,
keyed AS (
  SELECT p.*, p.wgtp * CASE WHEN puma = 1902 THEN 0.25 ELSE 1.0 END::DOUBLE AS analysis_weight,
         hincp * adjinc / 1000000.0 AS hincp_adj_real, coalesce(student_heavy_flag_rule_b, 0) AS student_heavy_flag,
         CASE WHEN adult_count >= 3 AND noc = 0 THEN '3plus_adult_0_child'
              WHEN adult_count >= 3 AND noc >= 1 THEN '3plus_adult_1plus_child'
              WHEN adult_count IN (1, 2) AND noc >= 0
              THEN adult_count::INT || '_adult_' || CASE WHEN noc >= 2 THEN '2plus' ELSE noc::VARCHAR END || '_child'
              ELSE 'other' END AS hh_comp_key
  FROM prof p
  WHERE coalesce(np, 0) > 0 AND coalesce(person_count, 0) > 0 AND hincp IS NOT NULL),
fin AS (
  SELECT k.*, t.annual_threshold, t.raw_threshold,
         CASE WHEN t.annual_threshold IS NULL THEN NULL
              WHEN k.hincp_adj_real < t.annual_threshold THEN 1 ELSE 0 END AS below_flag
  FROM keyed k LEFT JOIN thr t ON t.year = k.year AND t.hh_comp_key = k.hh_comp_key)
"""


# Panel: customers (areas) over order years, unbalanced since not every customer orders every year; one metric has gaps.

METRICS = ["orders_total", "spend", "max_price", "pct_open", "pct_urgent"]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("area"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    n = F.count(F.lit(1))
    out = orders.groupBy("area", "year").agg(
        n.alias("orders_total"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
        F.max("o_totalprice").alias("max_price"),
        (100.0 * F.count_if(F.col("o_orderstatus") == "O") / n).cast("double").alias("pct_open"),
        (100.0 * F.count_if(F.col("o_orderpriority") == "1-URGENT") / n).cast("double").alias("_u"))
    return out.withColumn("pct_urgent", F.when((F.col("area") + F.col("year")) % 13 != 0, F.col("_u"))).drop("_u")


def cells_staged(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written once, for queries that read it several times."""
    return stage(cells(spark, folder))


def cells_with_groups(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("area"), "c_nationkey", F.col("c_mktsegment").alias("segment"), "c_name", "c_acctbal")
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"), "n_name")
    return cells(spark, folder).join(customer, "area").join(nation, "c_nationkey")


CELLS_SQL = """
cells AS (
  SELECT o_custkey AS area, year(o_orderdate) AS year, count(*) AS orders_total,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend, max(o_totalprice) AS max_price,
         100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*) AS pct_open,
         CASE WHEN (o_custkey + year(o_orderdate)) % 13 <> 0
              THEN 100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) END AS pct_urgent
  FROM orders
  GROUP BY o_custkey, year(o_orderdate))"""

GROUPED_SQL = CELLS_SQL + """,
gcells AS (
  SELECT c.*, c_nationkey, c_mktsegment AS segment, c_name, c_acctbal, n_regionkey AS region, n_name
  FROM cells c JOIN customer ON c_custkey = area JOIN nation ON n_nationkey = c_nationkey)"""

LONG_SQL = CELLS_SQL + """,
long AS (
  SELECT area, year, metric, value FROM (
    SELECT area, year, orders_total::DOUBLE AS orders_total, spend, max_price, pct_open, pct_urgent FROM cells)
  UNPIVOT (value FOR metric IN (orders_total, spend, max_price, pct_open, pct_urgent)))"""
