"""Typed tract tables, the long and the wide fact, on text tables derived from the customer-year panel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthstat.operators import metrics as mt
from hearthstat.operators import profile as pf
from hearthstat.operators.scale import stage
from hearthstat.plans import tracts
from workload.base import CELLS_SQL, cells, query
from workload.tables import SPECS

# The panel's years stand for the periods of the tract tables.
YEAR_OF = {1995: 2019, 1997: 2021, 1998: 2022, 1999: 2023}


def source_columns():
    """Columns that the typed tables and metrics read, by table, in order."""
    needed = {code: set() for code in tracts.METRIC_GROUPS}
    for metric in [*tracts.V2_METRICS, *[m for table in tracts.CORE_TABLES.values() for m in table]]:
        for c in metric.sources:
            needed[c.split("_")[0]].add(c)
    needed["b03002"] |= set(tracts.RACE_COLUMNS)
    needed["s2401"] |= {"s2401_c01_001e", "s2401_c01_001m"}
    return {code: sorted(columns) for code, columns in needed.items()}


COLUMNS = source_columns()
PLACES = {c: (t, i) for t, columns in enumerate(COLUMNS.values()) for i, c in enumerate(columns)}


def cell_sql(column):
    """Value of a source column; one row in 13 has none."""
    t, i = PLACES[column]
    return f"CASE WHEN (area + {i} + {t}) % 13 <> 0 THEN ((area * {2 * i + 3} + year * {i + 5} + {t}) % 97 + 1)::DOUBLE END AS {column}"


PANEL_SQL = CELLS_SQL + """,
panel AS (SELECT area, CASE year WHEN 1995 THEN 2019 WHEN 1997 THEN 2021 WHEN 1998 THEN 2022 ELSE 2023 END AS year, 17019000000 + area AS tract_geoid
          FROM cells WHERE year IN (1995, 1997, 1998, 1999))""" + "".join(
    # A table holds most areas, each another part of them.
    f",\n{code} AS (SELECT year, tract_geoid, {', '.join(map(cell_sql, columns))} FROM panel WHERE (area + {t}) % 11 <> 0)"
    for t, (code, columns) in enumerate(COLUMNS.items()))


def panel(spark, folder):
    year = F.coalesce(*[F.when(F.col("year") == a, F.lit(b)) for a, b in YEAR_OF.items()])
    rows = cells(spark, folder).where(F.col("year").isin(list(YEAR_OF))).select("area", year.alias("year"))
    return stage(rows.withColumn("tract_geoid", (F.lit(17019000000) + F.col("area")).cast("string")))


def typed_tables(rows):
    """All-text staging tables of all periods, typed."""
    area, year = F.col("area"), F.col("year")
    out = {}
    for t, (code, columns) in enumerate(COLUMNS.items()):
        texts = []
        for i, c in enumerate(columns):
            value = ((area * (2 * i + 3) + year * (i + 5) + t) % 97 + 1).cast("string")
            texts.append(F.when((area + i + t) % 13 != 0, F.concat(value, F.lit(".0"))).otherwise(F.lit("(X)")).alias(c))
        staged = rows.where((area + t) % 11 != 0).select(year.cast("string").alias("year"), "tract_geoid", *texts)
        out[code] = tracts.typed_table([staged], code)
    return out


def dimensions(rows):
    dim = rows.groupBy("tract_geoid").agg(F.count(F.lit(1)).alias("year_count"))
    return {"bridge_tract_year": rows.select("year", "tract_geoid"), "dim_tract": dim}


WIDE_SQL = PANEL_SQL + """,
wide AS (
  SELECT p.year, p.tract_geoid::VARCHAR AS tract_geoid, b19013_001e, b25003_001e, b25003_002e, b25003_003e, b25070_001e, b25070_007e, b25070_008e, b25070_009e,
         b25070_010e, dp04_0001e, dp04_0003e, b03002_001e, b03002_003e, s2401_c01_001e, s2401_c01_001m, h.year AS ty1, s1701.year AS ty2, s1901.year AS ty3,
         s2301.year AS ty4, s1501.year AS ty5, s2401.year AS ty6, b03002.year AS ty7, s0101.year AS ty8, s1601.year AS ty9
  FROM panel p LEFT JOIN b19013 USING (year, tract_geoid) LEFT JOIN b25003 USING (year, tract_geoid) LEFT JOIN b25070 USING (year, tract_geoid)
  LEFT JOIN dp04 USING (year, tract_geoid) LEFT JOIN b03002 ON b03002.year = p.year AND b03002.tract_geoid = p.tract_geoid
  LEFT JOIN s1101 h ON h.year = p.year AND h.tract_geoid = p.tract_geoid""" + "".join(
    f"\n  LEFT JOIN {code} ON {code}.year = p.year AND {code}.tract_geoid = p.tract_geoid" for code in ("s1701", "s1901", "s2301", "s1501", "s2401", "s0101", "s1601")) + ")"


@query("wide_fact_stored", "year:i tract_geoid:s year_label:s year_count:i median_household_income:d pct_owner_occupied:d pct_rent_burden_30_plus:d "
       "pct_vacant_housing_units:d total_population:d pct_white_non_hispanic:d s2401_metrics_json:s has_core_housing_metrics:i has_batch2_metrics:i "
       "has_batch3_metrics:i", "WITH" + WIDE_SQL + """---
       SELECT year, tract_geoid, 'ACS ' || year || ' 5-Year' AS year_label, count(*) OVER (PARTITION BY tract_geoid) AS year_count,
              b19013_001e AS median_household_income, CASE WHEN b25003_001e > 0 THEN round(100.0 * b25003_002e / b25003_001e, 2) END AS pct_owner_occupied,
              CASE WHEN b25070_001e > 0 THEN round(100.0 * (coalesce(b25070_007e, 0) + coalesce(b25070_008e, 0) + coalesce(b25070_009e, 0)
                   + coalesce(b25070_010e, 0)) / b25070_001e, 2) END AS pct_rent_burden_30_plus,
              CASE WHEN dp04_0001e > 0 THEN round(100.0 * dp04_0003e / dp04_0001e, 2) END AS pct_vacant_housing_units,
              b03002_001e AS total_population, CASE WHEN b03002_001e > 0 THEN round(100.0 * b03002_003e / b03002_001e, 2) END AS pct_white_non_hispanic,
              CASE WHEN ty6 IS NOT NULL THEN '{"s2401_c01_001e":' || coalesce(s2401_c01_001e::VARCHAR, 'null') || ',"s2401_c01_001m":'
                   || coalesce(s2401_c01_001m::VARCHAR, 'null') || '}' END AS s2401_metrics_json,
              (b19013_001e IS NOT NULL AND b25003_001e IS NOT NULL AND b25070_001e IS NOT NULL AND dp04_0001e IS NOT NULL)::INT AS has_core_housing_metrics,
              (ty1 IS NOT NULL AND ty2 IS NOT NULL AND ty3 IS NOT NULL AND ty4 IS NOT NULL)::INT AS has_batch2_metrics,
              (ty5 IS NOT NULL AND ty6 IS NOT NULL AND ty7 IS NOT NULL AND ty8 IS NOT NULL AND ty9 IS NOT NULL)::INT AS has_batch3_metrics FROM wide""")
def wide_fact_stored(spark, folder):
    """Thirteen tables and the spine stored by (year, tract), joined bucket by bucket."""
    rows = panel(spark, folder)
    known = dimensions(rows)
    stored = tracts.store_typed({"spine": known["bridge_tract_year"], **typed_tables(rows)}, f"wide_{uuid.uuid4().hex}")
    fact = tracts.tract_profile(known | {"bridge_tract_year": stored.pop("spine")}, stored)
    return fact.select("year", "tract_geoid", "year_label", "year_count", "median_household_income", "pct_owner_occupied", "pct_rent_burden_30_plus",
                       "pct_vacant_housing_units", "total_population", "pct_white_non_hispanic", "s2401_metrics_json", "has_core_housing_metrics",
                       "has_batch2_metrics", "has_batch3_metrics")


AUDITED_SQL = PANEL_SQL + """,
v2 AS (
  SELECT p.year, p.tract_geoid::VARCHAR AS tract_geoid, s1701_c03_001e AS poverty_rate, s2301_c04_001e AS unemployment_rate,
         CASE WHEN s1101_c01_001e > 0 THEN round(100.0 * s1101_c01_005e / s1101_c01_001e, 2) END AS pct_households_with_own_children_under_18,
         round(coalesce(s1901_c01_002e, 0) + coalesce(s1901_c01_003e, 0) + coalesce(s1901_c01_004e, 0), 2) AS pct_hh_income_under_25k,
         round(coalesce(s1901_c01_009e, 0) + coalesce(s1901_c01_010e, 0) + coalesce(s1901_c01_011e, 0), 2) AS pct_hh_income_100k_plus,
         CASE WHEN s1501_c02_010e IS NOT NULL OR s1501_c02_011e IS NOT NULL
              THEN round(coalesce(s1501_c02_010e, 0) + coalesce(s1501_c02_011e, 0), 2) END AS pct_some_college_or_associate,
         CASE WHEN p.year >= 2021 THEN s1101_c01_012e END AS pct_households_with_65_plus,
         CASE WHEN p.year >= 2021 THEN s1101_c01_013e ELSE s1101_c01_012e END AS pct_one_person_households,
         CASE WHEN p.year >= 2021 THEN s1101_c01_014e ELSE s1101_c01_013e END AS pct_senior_living_alone_households,
         s0101_c02_023e AS pct_age_18_24, round(100.0 - s1501_c02_014e, 2) AS pct_less_than_high_school
  FROM panel p """ + " ".join(f"LEFT JOIN {code} ON {code}.year = p.year AND {code}.tract_geoid = p.tract_geoid"
                              for code in ("s1701", "s2301", "s1101", "s1901", "s1501", "s0101")) + ")"
AUDITED = ["poverty_rate", "unemployment_rate", "pct_households_with_own_children_under_18", "pct_hh_income_under_25k", "pct_hh_income_100k_plus",
           "pct_some_college_or_associate", "pct_households_with_65_plus", "pct_one_person_households", "pct_senior_living_alone_households",
           "pct_age_18_24", "pct_less_than_high_school"]


@query("wide_fact_audited", "year:i tract_geoid:s " + " ".join(f"{c}:d" for c in AUDITED), "WITH" + AUDITED_SQL + "---SELECT * FROM v2")
def wide_fact_audited(spark, folder):
    """The audited metrics joined to the wide fact, with the columns that moved."""
    rows = panel(spark, folder)
    tables = typed_tables(rows)
    first = tracts.tract_profile(dimensions(rows), {"b19013": tables["b19013"]} | {c: t.limit(0) for c, t in tables.items() if c != "b19013"})
    return tracts.tract_profile_v2(first, tables).select("year", "tract_geoid", *AUDITED)


@query("long_fact_tables", "year:i source_table:s metric_group:s row_count:i distinct_metrics:i distinct_entities:i", "WITH" + PANEL_SQL + """,
       l AS (""" + " UNION ALL ".join(
    f"SELECT year, tract_geoid, '{code.upper()}' AS source_table, '{tracts.METRIC_GROUPS[code]}' AS metric_group, m FROM "
    f"(SELECT * FROM {code}) UNPIVOT (v FOR m IN ({', '.join(columns)}))" for code, columns in COLUMNS.items() if code not in tracts.CORE_TABLES) + """)---
       SELECT year, source_table, metric_group, count(*) AS row_count, count(DISTINCT m) AS distinct_metrics, count(DISTINCT tract_geoid) AS distinct_entities
       FROM l GROUP BY ALL""")
def long_fact_tables(spark, folder):
    """Nine typed tables as one long fact with its coverage."""
    tables = {c: t for c, t in typed_tables(panel(spark, folder)).items() if c not in tracts.CORE_TABLES}
    known = dimensions(panel(spark, folder))
    return tracts.metric_long_checks(tracts.metric_long(tables), known["bridge_tract_year"])["coverage"]


# Lineage

CHAIN = [*SPECS,
         mt.Metric("open_gap", "status", "pct_open_of_all - pct_either", ("pct_open_of_all", "pct_either"), "derived"),
         mt.Metric("value_per_gap", "value", "case when open_gap <> 0 then avg_order / open_gap end", ("open_gap", "avg_order"), "derived")]


@query("metric_lineage", "metric:s column_name:s steps:i rows_with_column:i rows_with_metric:i", "WITH" + CELLS_SQL + """,
       edge(metric, column_name, steps) AS (VALUES
         ('pct_open_of_all', 'pct_open', 1), ('avg_order', 'spend', 1), ('avg_order', 'orders_total', 1), ('pct_either', 'pct_open', 1),
         ('pct_either', 'pct_urgent', 1), ('pct_not_open', 'pct_open', 1), ('open_gap', 'pct_open', 2), ('open_gap', 'pct_urgent', 2),
         ('value_per_gap', 'pct_open', 3), ('value_per_gap', 'pct_urgent', 3), ('value_per_gap', 'spend', 2), ('value_per_gap', 'orders_total', 2)),
       v AS (SELECT *, round(pct_open, 2) AS a, round(pct_open + coalesce(pct_urgent, 0), 2) AS b FROM cells),
       n AS (SELECT count(pct_open) AS pct_open, count(pct_urgent) AS pct_urgent, count(spend) AS spend, count(orders_total) AS orders_total,
                    count(*) AS rows, count(*) FILTER (a - b <> 0) AS gaps FROM v)---
       SELECT metric, column_name, steps,
              CASE column_name WHEN 'pct_open' THEN pct_open WHEN 'pct_urgent' THEN pct_urgent WHEN 'spend' THEN spend ELSE orders_total END AS rows_with_column,
              CASE metric WHEN 'value_per_gap' THEN gaps ELSE rows END AS rows_with_metric FROM edge, n""")
def metric_lineage(spark, folder):
    """Base columns of every metric through all derived ones, with the rows that have them."""
    rows = stage(cells(spark, folder))
    full = mt.project_all(rows, CHAIN, ["area", "year", *mt.base_columns(CHAIN)])
    counted = pf.filled_counts(full, [*mt.base_columns(CHAIN), *[m.name for m in CHAIN]])
    edges = mt.closed_lineage(spark, CHAIN)
    own = counted.select(F.col("column_name"), F.col("filled").alias("rows_with_column"))
    made = counted.select(F.col("column_name").alias("metric"), F.col("filled").alias("rows_with_metric"))
    return edges.select("metric", "column_name", "steps").join(own, "column_name").join(made, "metric")
