"""Text cleaning, keys, dimensions, facts and data quality over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.functions import expressions as ex
from hearthstat.functions import keys as ky
from hearthstat.operators import household as hh
from hearthstat.operators import metrics as mt
from hearthstat.operators import panel as pn
from hearthstat.operators import profile as pf
from hearthstat.operators import quality as ql
from hearthstat.operators import reshape as rs
from hearthstat.operators.scale import join_small, literal_table
from hearthstat.plans.geography import with_context
from hearthstat.sources import io
from workload.base import (CELLS_SQL, GROUPED_SQL, LONG_SQL, METRICS, YEARS, cells, cells_with_groups, query, table)

DIRTY_SQL = """
dirty AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 8 WHEN 0 THEN '-' WHEN 1 THEN '250,000+' WHEN 2 THEN ''
  WHEN 3 THEN ' 12 ' WHEN 4 THEN '1e5' WHEN 5 THEN '-3.5' WHEN 6 THEN NULL
  ELSE (o_custkey * 10)::VARCHAR END AS amount FROM orders)"""


def dirty(spark, folder):
    kinds = ["-", "250,000+", "", " 12 ", "1e5", "-3.5", None]
    key = F.col("o_orderkey") % 8
    amount = F.coalesce(*[F.when(key == i, F.lit(k)) for i, k in enumerate(kinds) if k is not None],
                        F.when(key == 7, (F.col("o_custkey") * 10).cast("string")))
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate", amount.alias("amount"))


@query("safe_numeric", "o_orderkey:i number:d no_sentinel:d filled:b blank:b", "WITH" + DIRTY_SQL + """---
       SELECT o_orderkey, CASE WHEN regexp_matches(trim(amount), '^-?[0-9]+([.][0-9]+)?$') THEN trim(amount)::DOUBLE END
                AS number,
              CASE WHEN regexp_matches(trim(amount), '^-?[0-9]+([.][0-9]+)?$') AND trim(amount) <> '-3.5'
                   THEN trim(amount)::DOUBLE END AS no_sentinel,
              amount IS NOT NULL AND trim(amount) <> '' AS filled, amount IS NULL OR trim(amount) = '' AS blank
       FROM dirty""")
def safe_numeric(spark, folder):
    return dirty(spark, folder).select(
        "o_orderkey", ex.safe_number("amount").alias("number"), ex.safe_number("amount", [-3.5]).alias("no_sentinel"),
        ex.has_text("amount").alias("filled"), ex.is_blank("amount").alias("blank"))


@query("pct_expressions",
       "area:i year:i pct_ok:d pct_guarded:d bundle_zero:d bundle_any:d rest:d has_all:i per_order:d", "WITH" + CELLS_SQL + """---
       SELECT area, year, round(100.0 * pct_open / spend, 2) AS pct_ok,
              CASE WHEN pct_open > 0 THEN round(100.0 * orders_total / pct_open, 2) END AS pct_guarded,
              round(coalesce(pct_urgent, 0) + 0.0, 2) AS bundle_zero, round(pct_urgent, 2) AS bundle_any,
              round(100.0 - pct_urgent, 2) AS rest, CASE WHEN pct_urgent IS NOT NULL THEN 1 ELSE 0 END AS has_all,
              orders_total / nullif(pct_open, 0) * 100.0 AS per_order
       FROM cells""", digits=1)
def pct_expressions(spark, folder):
    return cells(spark, folder).select(
        "area", "year", ex.pct("pct_open", "spend").alias("pct_ok"), ex.pct("orders_total", "pct_open").alias("pct_guarded"),
        ex.bundle(["pct_urgent"]).alias("bundle_zero"), ex.bundle(["pct_urgent"], need_any=True).alias("bundle_any"),
        ex.complement("pct_urgent").alias("rest"), ex.all_present("pct_open", "pct_urgent").alias("has_all"),
        ex.ratio("orders_total", "pct_open").alias("per_order"))


GEO_SQL = """
geo AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '0100000US' ELSE '1400000US' END
    || lpad(c_nationkey::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 3, '0')
    || lpad(c_custkey::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 6 END, '0') AS geo_id,
  CASE WHEN c_custkey % 9 = 0 THEN 'Block ' || c_custkey
       WHEN c_custkey % 2 = 0 THEN 'Census Tract ' || c_custkey || '.01, County ' || c_nationkey || ', State'
       ELSE 'Census Tract ' || c_custkey || '; County ' || c_nationkey || '; State' END AS name
  FROM customer)"""


def geo(spark, folder):
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = key.cast("string")
    prefix = F.when(key % 10 == 0, "0100000US").otherwise("1400000US")
    tail = F.when(key % 7 == 0, F.lpad(text, 5, "0")).otherwise(F.lpad(text, 6, "0"))
    name = (F.when(key % 9 == 0, F.concat(F.lit("Block "), text))
            .when(key % 2 == 0, F.concat(F.lit("Census Tract "), text, F.lit(".01, County "), nation, F.lit(", State")))
            .otherwise(F.concat(F.lit("Census Tract "), text, F.lit("; County "), nation, F.lit("; State"))))
    return table(spark, folder, "customer").select(
        "c_custkey", F.concat(prefix, F.lpad(nation, 2, "0"), F.lpad((key % 1000).cast("string"), 3, "0"), tail).alias("geo_id"),
        name.alias("name"))


@query("geo_key_parse",
       "tract_geoid:s statefp:s countyfp:s tractce:s tract_number:s county_name:s padded:s good_key:b", "WITH" + GEO_SQL + """---
       SELECT substr(geo_id, 10) AS tract_geoid, substr(geo_id, 10, 2) AS statefp, substr(geo_id, 12, 3) AS countyfp,
              substr(geo_id, 15, 6) AS tractce,
              CASE WHEN name LIKE 'Census Tract %' THEN split_part(replace(replace(name, ';', ','), 'Census Tract ', ''), ',', 1)
                END AS tract_number,
              CASE WHEN name LIKE 'Census%' THEN trim(split_part(replace(name, ';', ','), ',', 2)) END AS county_name,
              CASE WHEN length(c_custkey::VARCHAR) >= 4 THEN c_custkey::VARCHAR
                   ELSE lpad(c_custkey::VARCHAR, 4, '0') END AS padded,
              length(geo_id) = 20 AS good_key
       FROM geo WHERE geo_id LIKE '1400000US%'""")
def geo_key_parse(spark, folder):
    return geo(spark, folder).where(ky.is_tract_row("geo_id")).select(
        *ky.key_parts("geo_id"), ky.tract_number("name").alias("tract_number"), ky.name_part("name", 2).alias("county_name"),
        ex.zero_padded("c_custkey", 4).alias("padded"),
        ex.digits_of_length(ky.key_parts("geo_id")[0], 11).alias("good_key"))


@query("drift_remap", "area:i year:i one_person:d senior_alone:d age_65:d", "WITH" + CELLS_SQL + """---
       SELECT area, year, CASE WHEN year >= 1998 THEN pct_open ELSE pct_urgent END AS one_person,
              CASE WHEN year >= 1998 THEN max_price ELSE pct_open END AS senior_alone,
              CASE WHEN year >= 1998 THEN spend END AS age_65 FROM cells""")
def drift_remap(spark, folder):
    moved = pn.remap_by_period("year", {
        "one_person": [(1998, "pct_open"), (None, "pct_urgent")],
        "senior_alone": [(1998, "max_price"), (None, "pct_open")], "age_65": [(1998, "spend")]})
    return cells(spark, folder).select("area", "year", *[c.alias(n) for n, c in moved.items()])


@query("json_payload", "o_orderkey:i has_payload:b l_lines:i l_max:i", """---
       SELECT o_orderkey, l.n IS NOT NULL AS has_payload, l.n AS l_lines, l.m AS l_max
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_partkey) AS m FROM lineitem GROUP BY 1) l
       ON l_orderkey = o_orderkey""")
def json_payload(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("l_lines"), F.max("l_partkey").alias("l_max"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    packed = joined.select("o_orderkey", ex.json_payload("l_orderkey", ["l_lines", "l_max"]).alias("payload"))
    fields = F.from_json("payload", "l_lines bigint, l_max bigint")
    return packed.select("o_orderkey", F.col("payload").isNotNull().alias("has_payload"),
                         fields["l_lines"].alias("l_lines"), fields["l_max"].alias("l_max"))


@query("area_type_rules", "area:i year:i area_type:s landmark_context_note:s display_area_label:s", "WITH" + GROUPED_SQL + """,
       f AS (SELECT area, year, pct_open AS a18, pct_urgent AS renter, (area * 7 + year) % 40 AS a65, area % 20 AS alone,
                    (area + year) % 80 AS family, area % 37 AS kids, year % 60 AS poverty, (area * 3) % 50 AS low,
                    (area * 11 + year) % 60 AS high, (area * 5) % 80 AS bach,
                    CASE WHEN region = 2 THEN NULL ELSE n_name END AS place, 'Area ' || area AS nm FROM gcells),
       t AS (SELECT *, CASE WHEN a18 >= 40 AND renter >= 70 THEN 'Student-dense area'
                WHEN a65 >= 18 AND alone >= 10 THEN 'Senior-heavy residential area'
                WHEN family >= 55 AND kids >= 25 THEN 'Family-oriented residential area'
                WHEN poverty >= 25 AND low >= 30 THEN 'Higher economic stress area'
                WHEN high >= 35 AND bach >= 50 THEN 'Higher-income residential area'
                ELSE 'Mixed residential area' END AS area_type,
             array_to_string(list_filter([CASE WHEN a18 >= 40 THEN 'higher student concentration' END,
                CASE WHEN renter >= 65 THEN 'renter-heavy housing profile' END,
                CASE WHEN poverty >= 25 THEN 'higher poverty rate' END,
                CASE WHEN low >= 30 THEN 'more very-low-income households' END,
                CASE WHEN kids >= 25 THEN 'more households with children' END,
                CASE WHEN a65 >= 18 THEN 'older age profile' END], lambda x: x IS NOT NULL), '; ') AS note FROM f)---
       SELECT area, year, area_type, coalesce(place, nm) || ' — ' || area_type AS display_area_label,
              CASE WHEN note = '' OR note IS NULL THEN 'General tract context note not flagged by the current rule set.'
                   ELSE upper(note[1]) || lower(note[2:]) || '.' END AS landmark_context_note FROM t""")
def area_type_rules(spark, folder):
    area, year = F.col("area"), F.col("year")
    rows = cells_with_groups(spark, folder).select(
        "area", "year", F.col("pct_open").alias("pct_age_18_24"), F.col("pct_urgent").alias("pct_renter_occupied"),
        ((area * 7 + year) % 40).alias("pct_age_65_plus"), (area % 20).alias("pct_senior_living_alone_households"),
        ((area + year) % 80).alias("pct_family_households"), (area % 37).alias("pct_households_with_own_children_under_18"),
        (year % 60).alias("poverty_rate"), (area * 3 % 50).alias("pct_hh_income_under_25k"),
        ((area * 11 + year) % 60).alias("pct_hh_income_100k_plus"), (area * 5 % 80).alias("pct_bachelors_or_higher"),
        ex.tidy_place(F.when(F.col("region") != 2, F.concat("n_name", F.lit(" city")))).alias("primary_place"),
        F.concat(F.lit("Area "), area.cast("string")).alias("tract_name_canonical"))
    return with_context(rows).select("area", "year", "area_type", "landmark_context_note", "display_area_label")


GROUP_TAGS = {"promo": "retail", "large": "size", "medium": "size", "small": "size"}


@query("tag_and_kind", "p_partkey:i metric_group:s batch:s metric_kind:s", """---
       SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'retail' WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'size'
                ELSE 'other' END AS metric_group,
              CASE p_type WHEN 'PROMO' THEN 'retail' WHEN 'STANDARD' THEN NULL WHEN 'ECONOMY' THEN NULL ELSE 'size' END AS batch,
              CASE WHEN p_size % 3 = 0 THEN 'estimate' WHEN p_size % 3 = 1 THEN 'moe' ELSE 'derived' END AS metric_kind
       FROM part""")
def tag_and_kind(spark, folder):
    size = F.col("p_size") % 3
    name = F.concat("p_name", F.when(size == 0, "_E").when(size == 1, "_m").otherwise("001e"))
    return table(spark, folder, "part").select(
        "p_partkey", ex.tag(F.lower("p_type"), GROUP_TAGS, "other").alias("metric_group"),
        ex.tag(F.lower("p_type"), GROUP_TAGS).alias("batch"), ex.metric_kind(name).alias("metric_kind"))


@query("auto_cast_profile", "column_name:s row_count:i non_null_count:i parsed_count:i cast_to_number:b",
       "WITH" + DIRTY_SQL + """,
       t AS (SELECT amount AS mixed, o_orderkey::VARCHAR AS number_text, 'n' || o_orderkey AS word FROM dirty),
       u AS (SELECT column_name, v FROM (SELECT coalesce(mixed, '~') AS mixed, number_text, word FROM t)
             UNPIVOT (v FOR column_name IN (mixed, number_text, word))),
       c AS (SELECT column_name, count(*) AS n, count(*) FILTER (v <> '~') AS filled,
                    count(*) FILTER (regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) AS parsed FROM u GROUP BY 1)---
       SELECT column_name, n AS row_count, filled AS non_null_count, parsed AS parsed_count,
              parsed >= greatest(3, floor(0.6 * n)) AS cast_to_number FROM c""")
def auto_cast_profile(spark, folder):
    text = dirty(spark, folder).select(
        F.col("amount").alias("mixed"), F.col("o_orderkey").cast("string").alias("number_text"),
        F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("word"))
    return pf.parse_ratios(text, ["mixed", "number_text", "word"])


NAMES_SQL = GROUPED_SQL + """,
named AS (SELECT area, year, region, segment, CASE WHEN (area + year) % 5 = 0 THEN NULL ELSE segment || year END AS label,
                 'Area ' || area || CASE WHEN year >= 1999 AND area % 3 = 0 THEN ' new' ELSE '' END AS raw_name FROM gcells)"""


def named(spark, folder):
    area, year = F.col("area"), F.col("year")
    return cells_with_groups(spark, folder).select(
        "area", "year", "region", "segment", F.when((area + year) % 5 != 0, F.concat("segment", year.cast("string"))).alias("label"),
        F.concat(F.lit("Area "), area.cast("string"),
                 F.when((year >= 1999) & (area % 3 == 0), " new").otherwise("")).alias("raw_name"))


@query("dim_entity",
       "area:i raw_name:s label:s region:i first_year_seen:i last_year_seen:i year_count:i is_stable:i", "WITH" + NAMES_SQL + """---
       SELECT area, arg_max(raw_name, year) AS raw_name, arg_max(label, year) FILTER (label IS NOT NULL) AS label,
              max(region) AS region, min(year) AS first_year_seen, max(year) AS last_year_seen,
              count(DISTINCT year) AS year_count, CASE WHEN count(DISTINCT year) = 6 THEN 1 ELSE 0 END AS is_stable
       FROM named GROUP BY area""")
def dim_entity(spark, folder):
    return pn.entity_dimension(named(spark, folder), "area", "year", ["raw_name", "label", "region"], ["label"], 6)


@query("bridge_entity_year", "area:i year:i year_label:s segment:s", """---
       SELECT DISTINCT o_custkey AS area, year(o_orderdate) AS year, 'Y' || year(o_orderdate) AS year_label,
              c_mktsegment AS segment
       FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) <= 2000""")
def bridge_entity_year(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("area"), F.year("o_orderdate").alias("year"))
    dim = table(spark, folder, "customer").select(F.col("c_custkey").alias("area"), F.col("c_mktsegment").alias("segment"))
    years = literal_table(spark, [(y, f"Y{y}") for y in YEARS if y <= 2000], "year int, year_label string")
    return join_small(pn.entity_periods(orders, ["area", "year"]), years, ["year"], "inner").join(dim, "area")


@query("name_conflicts", "area:i year:i raw_name:s distinct_name_count:i", "WITH" + NAMES_SQL + """---
       SELECT area, year, raw_name, n AS distinct_name_count FROM named
       JOIN (SELECT area, count(DISTINCT raw_name) AS n FROM named GROUP BY 1 HAVING count(DISTINCT raw_name) > 1) USING (area)""")
def name_conflicts(spark, folder):
    return ql.name_conflicts(named(spark, folder), "area", "raw_name", ["year", "raw_name"])


@query("presence_list", "area:i year_count:i years:s", "WITH" + CELLS_SQL + """---
       SELECT area, count(DISTINCT year) AS year_count, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years
       FROM cells GROUP BY area""")
def presence_list(spark, folder):
    return pn.presence(cells(spark, folder), "area", "year")


LONG_GROUPS = {"cells": "orders"}


def long_cells(spark, folder):
    return rs.metric_long(cells(spark, folder), ["area", "year"], METRICS, "cells", LONG_GROUPS)


@query("long_fact", "area:i year:i source_table:s metric_group:s metric_name:s metric_kind:s metric_value:d",
       "WITH" + LONG_SQL + """---
       SELECT area, year, 'CELLS' AS source_table, 'orders' AS metric_group, metric AS metric_name, 'derived' AS metric_kind,
              value AS metric_value FROM long""")
def long_fact(spark, folder):
    return long_cells(spark, folder)


@query("long_fact_coverage", "year:i metric_group:s row_count:i distinct_metrics:i distinct_entities:i", "WITH" + LONG_SQL + """---
       SELECT year, 'orders' AS metric_group, count(*) AS row_count, count(DISTINCT metric) AS distinct_metrics,
              count(DISTINCT area) AS distinct_entities FROM long GROUP BY year""")
def long_fact_coverage(spark, folder):
    return rs.long_coverage(long_cells(spark, folder), ["year", "metric_group"], "area")


@query("metric_dictionary", "source_table:s metric_group:s metric_name:s metric_kind:s", "WITH" + LONG_SQL + """---
       SELECT DISTINCT 'CELLS' AS source_table, 'orders' AS metric_group, metric AS metric_name, 'derived' AS metric_kind
       FROM long""")
def metric_dictionary(spark, folder):
    return rs.metric_dictionary(long_cells(spark, folder))


@query("wide_profile_star", "area:i year:i spend:d lines:i urgent:i error_events:i has_core:i has_batch:i", "WITH" + CELLS_SQL + """,
       l AS (SELECT o_custkey AS area, year(o_orderdate) AS year, count(*) AS lines FROM lineitem
             JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL),
       u AS (SELECT o_custkey AS area, year(o_orderdate) AS year, count(*) AS urgent FROM orders
             WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
       e AS (SELECT user_id AS area, 1990 + user_id % 12 AS year, count(*) AS error_events FROM events
             WHERE event_type = 'error' GROUP BY ALL)---
       SELECT c.area, c.year, spend, lines, urgent, error_events,
              CASE WHEN spend IS NOT NULL AND lines IS NOT NULL THEN 1 ELSE 0 END AS has_core,
              CASE WHEN urgent IS NOT NULL AND error_events IS NOT NULL THEN 1 ELSE 0 END AS has_batch
       FROM cells c LEFT JOIN l ON c.area = l.area AND c.year = l.year
       LEFT JOIN u ON c.area = u.area AND c.year = u.year LEFT JOIN e ON c.area = e.area AND c.year = e.year""")
def wide_profile_star(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("area"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    lines = (table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy("area", "year").agg(F.sum("n").alias("lines")))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy("area", "year").agg(F.count(F.lit(1)).alias("urgent"))
    errors = table(spark, folder, "events").where("event_type = 'error'").groupBy(
        F.col("user_id").alias("area"), (1990 + F.col("user_id") % 12).cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("error_events"))
    out = cells(spark, folder).select("area", "year", "spend")
    for part in (lines, urgent, errors):
        out = out.join(part, ["area", "year"], "left")
    return out.withColumns({"has_core": ex.all_present("spend", "lines"), "has_batch": ex.all_present("urgent", "error_events")})


SPECS = [
    mt.Metric("pct_open_of_all", "status", mt.sql_pct("pct_open", "100"), ("pct_open",)),
    mt.Metric("avg_order", "value", "case when orders_total > 0 then spend / orders_total end", ("spend", "orders_total"), "derived"),
    mt.Metric("pct_either", "status", mt.sql_bundle(["pct_open", "pct_urgent"]), ("pct_open", "pct_urgent"), "derived"),
    mt.Metric("pct_not_open", "status", "round(100.0D - pct_open, 2)", ("pct_open",), "derived"),
]


@query("spec_driven_profile", "area:i year:i pct_open_of_all:d avg_order:d pct_either:d pct_not_open:d", "WITH" + CELLS_SQL + """---
       SELECT area, year, round(100.0 * pct_open / 100, 2) AS pct_open_of_all, spend / orders_total AS avg_order,
              round(pct_open + coalesce(pct_urgent, 0), 2) AS pct_either, round(100.0 - pct_open, 2) AS pct_not_open
       FROM cells""")
def spec_driven_profile(spark, folder):
    return mt.project(cells(spark, folder), SPECS, ["area", "year"])


@query("formula_audit", "year:i check_name:s max_abs_diff:d", "WITH" + CELLS_SQL + """---
       SELECT year, 'avg_order' AS check_name, 0.0 AS max_abs_diff FROM cells GROUP BY year
       UNION ALL SELECT year, 'open_and_rest', max(abs(100.0 - (pct_open + round(100.0 - pct_open, 2)))) FROM cells GROUP BY year""")
def formula_audit(spark, folder):
    stored = mt.project(cells(spark, folder), SPECS, ["area", "year", "orders_total", "spend", "pct_open", "pct_urgent"])
    checks = {"avg_order": mt.recomputed(stored, SPECS)["avg_order"],
              "open_and_rest": (F.lit(100.0), F.col("pct_open") + F.col("pct_not_open"))}
    return pf.formula_audit(stored, ["year"], checks)


@query("all_years_union", "area:i year:i spend:d pct_urgent:d is_experimental:i", "WITH" + CELLS_SQL + """---
       SELECT area, year, spend, CASE WHEN year > 1996 THEN pct_urgent END AS pct_urgent,
              CASE WHEN year = 1996 THEN 1 ELSE 0 END AS is_experimental FROM cells""")
def all_years_union(spark, folder):
    panel = cells(spark, folder)
    early = panel.where("year <= 1996").select("area", "year", "spend", ex.flag(F.col("year") == 1996).alias("is_experimental"))
    late = panel.where("year > 1996").select(F.lit(0).alias("is_experimental"), "pct_urgent", "spend", "year", "area")
    return rs.union_all([early, late], "all")


@query("common_columns_union", "area:i year:i spend:d", "WITH" + CELLS_SQL + "---SELECT area, year, spend FROM cells")
def common_columns_union(spark, folder):
    panel = cells(spark, folder)
    return rs.union_all([panel.where("year <= 1996").select("area", "spend", "year", "max_price"),
                         panel.where("year > 1996").select("year", "pct_open", "area", "spend")], "common").select(
        "area", "year", "spend")


@query("union_distinct", "year:i nation:i", """---
       SELECT DISTINCT year(o_orderdate) AS year, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey
       UNION SELECT DISTINCT year(l_shipdate), s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def union_distinct(spark, folder):
    orders = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)))
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    shipped = table(spark, folder, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)))
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return rs.union_distinct([
        orders.join(customer, orders.o_custkey == customer.c_custkey).select("year", "nation"),
        shipped.join(supplier, shipped.l_suppkey == supplier.s_suppkey).select("year", "nation")])


KEYED_SQL = """
keyed AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 50 = 1 THEN '  '
                 ELSE ' ' || l_orderkey END AS k, l_orderkey, l_linenumber FROM lineitem)"""


def keyed(spark, folder):
    key = F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        F.when(key % 50 == 1, "  ").when(key % 50 != 0, F.concat(F.lit(" "), key.cast("string"))).alias("k"),
        "l_orderkey", "l_linenumber")


@query("key_checks", "row_count:i distinct_keys:i null_keys:i blank_keys:i", "WITH" + KEYED_SQL + """---
       SELECT count(*) AS row_count, count(DISTINCT CASE WHEN trim(k) <> '' THEN trim(k) END) AS distinct_keys,
              count(*) FILTER (k IS NULL) AS null_keys, count(*) FILTER (trim(k) = '') AS blank_keys FROM keyed""")
def key_checks(spark, folder):
    return ql.key_checks(keyed(spark, folder), "k")


@query("duplicate_stats", "duplicate_groups:i duplicate_rows:i", """---
       SELECT count(*) AS duplicate_groups, sum(n - 1) AS duplicate_rows
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_stats(spark, folder):
    return ql.duplicate_stats(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("reference_coverage",
       "year:i source_keys:i reference_keys:i matched_keys:i missing_from_reference:i missing_from_source:i", """
       WITH o AS (SELECT DISTINCT year(o_orderdate) AS year, o_custkey AS k FROM orders),
       s AS (SELECT DISTINCT year(l_shipdate) AS year, l_partkey AS k FROM lineitem)---
       SELECT coalesce(o.year, s.year) AS year, count(s.k) AS source_keys, count(o.k) AS reference_keys,
              count(*) FILTER (s.k IS NOT NULL AND o.k IS NOT NULL) AS matched_keys,
              count(*) FILTER (o.k IS NULL) AS missing_from_reference, count(*) FILTER (s.k IS NULL) AS missing_from_source
       FROM o FULL JOIN s ON o.year = s.year AND o.k = s.k GROUP BY 1""")
def reference_coverage(spark, folder):
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("k"))
    parts = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("k"))
    return ql.reference_coverage(parts, orders, "k", ["year"])


@query("missing_profile", "column_name:s row_count:i null_count:i blank_or_null_count:i missing_pct:d", "WITH" + KEYED_SQL + """,
       u AS (SELECT 'k' AS column_name, k AS v FROM keyed UNION ALL SELECT 'l_orderkey', l_orderkey::VARCHAR FROM keyed
             UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM keyed)---
       SELECT column_name, count(*) AS row_count, count(*) - count(v) AS null_count,
              count(*) FILTER (v IS NULL OR trim(v) = '') AS blank_or_null_count,
              round(count(*) FILTER (v IS NULL OR trim(v) = '') / count(*), 6) AS missing_pct
       FROM u GROUP BY 1""")
def missing_profile(spark, folder):
    return ql.missing_profile(keyed(spark, folder), ["k", "l_orderkey", "l_linenumber"])


@query("numeric_profile",
       "column_name:s row_count:i null_count:i zero_count:i negative_count:i min_value:d max_value:d", "WITH" + CELLS_SQL + """,
       u AS (SELECT 'pct_open' AS column_name, pct_open AS v FROM cells UNION ALL SELECT 'pct_urgent', pct_urgent - 20 FROM cells
             UNION ALL SELECT 'spend', spend FROM cells)---
       SELECT column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(*) FILTER (v = 0) AS zero_count,
              count(*) FILTER (v < 0) AS negative_count, min(v) AS min_value, max(v) AS max_value FROM u GROUP BY 1""")
def numeric_profile(spark, folder):
    shifted = cells(spark, folder).withColumn("pct_urgent", F.col("pct_urgent") - 20)
    return ql.numeric_profile(shifted, ["pct_open", "pct_urgent", "spend"])


@query("year_source_counts", "year:i source:s row_count:i", """---
       SELECT year(o_orderdate) AS year, lower(o_orderpriority) AS source, count(*) AS row_count FROM orders GROUP BY 1, 2""")
def year_source_counts(spark, folder):
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    return ql.period_counts(orders, ["year", F.lower("o_orderpriority").alias("source")])


@query("batch_coverage", "year:i expected_tables:i present_tables:i all_present:b", """
       WITH g AS (SELECT * FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) CROSS JOIN range(1994, 2003) r(year)),
       o AS (SELECT o_orderstatus AS status, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL)---
       SELECT g.year, count(*) AS expected_tables, count(n) AS present_tables, count(*) = count(n) AS all_present
       FROM g LEFT JOIN o USING (status, year) GROUP BY g.year""")
def batch_coverage(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    grid = ql.grid_counts(orders, "status", ["F", "O", "P", "X"], "year", list(range(1994, 2003)))
    return ql.batch_coverage(grid, ["year"], "is_present")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("expected_grid_gaps", "user_id:i day:i status:s missing_components:s", """
       WITH seen AS (SELECT DISTINCT user_id, day(ts) AS day, event_type FROM events),
       g AS (SELECT u.user_id, d.day, t.event_type FROM (SELECT DISTINCT user_id FROM events) u
             CROSS JOIN range(1, 31) d(day)
             CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)),
       m AS (SELECT g.user_id, g.day, string_agg(g.event_type, ',' ORDER BY g.event_type) AS missing_components, count(*) AS n
             FROM g ANTI JOIN seen s ON s.user_id = g.user_id AND s.day = g.day AND s.event_type = g.event_type GROUP BY ALL)---
       SELECT user_id, day, missing_components,
              CASE WHEN n = 5 THEN 'missing_year_entirely' ELSE 'year_present_but_missing_components' END AS status FROM m""")
def expected_grid_gaps(spark, folder):
    events = table(spark, folder, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_type")
    return ql.missing_combinations(events, "user_id", "day", "event_type", list(range(1, 31)), EVENT_TYPES)


@query("component_flags", "user_id:i n_click:i n_error:i n_purchase:i n_signup:i n_view:i has_all_components:b", """---
       SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
              count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup,
              count(*) FILTER (event_type = 'view') AS n_view, count(DISTINCT event_type) = 5 AS has_all_components
       FROM events GROUP BY user_id""")
def component_flags(spark, folder):
    return ql.component_flags(table(spark, folder, "events"), ["user_id"], "event_type", EVENT_TYPES)


@query("pivot_counts", "user_id:i click:i error:i purchase:i signup:i view:i", """---
       SELECT user_id, coalesce(click, 0) AS click, coalesce(error, 0) AS error, coalesce(purchase, 0) AS purchase,
              coalesce(signup, 0) AS signup, coalesce("view", 0) AS "view"
       FROM (PIVOT (SELECT user_id, event_type FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view')
             USING count(*) GROUP BY user_id)""")
def pivot_counts(spark, folder):
    return rs.to_wide(table(spark, folder, "events"), ["user_id"], "event_type", EVENT_TYPES, F.count(F.lit(1)), 0)


@query("validation_pack", "validation_name:s year:i row_count:i null_urgent:i duplicate_rows:i duplicate_groups:i",
       "WITH" + CELLS_SQL + """---
       SELECT '01_nulls' AS validation_name, year, count(*) AS row_count, count(*) - count(pct_urgent) AS null_urgent,
              NULL AS duplicate_rows, NULL AS duplicate_groups FROM cells GROUP BY year
       UNION ALL SELECT '02_duplicates', NULL, NULL, NULL, sum(n - 1), count(*) FROM
              (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)""")
def validation_pack(spark, folder):
    nulls = pf.null_counts(cells(spark, folder).withColumnRenamed("pct_urgent", "urgent"), ["year"], ["urgent"])
    return pf.validation_pack({
        "01_nulls": nulls, "02_duplicates": ql.duplicate_stats(table(spark, folder, "orders"), ["o_custkey", "o_orderdate"])})


@query("table_suite",
       "table_name:s row_count:i distinct_keys:i null_keys:i blank_keys:i duplicate_groups:i duplicate_rows:i", """---
       SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS row_count,
              (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS distinct_keys, 0 AS null_keys, 0 AS blank_keys,
              count(*) AS duplicate_groups, sum(n - 1) AS duplicate_rows
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
       UNION ALL
       SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_orderkey) FROM orders), 0, 0, 0, 0""")
def table_suite(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("part"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("part"))
    return ql.table_suite({"lineitem": lines, "orders": orders}, ["k", "part"], "k")


@query("entity_counts", "year:i row_count:i distinct_keys:i min_key:i max_key:i", """---
       SELECT year(o_orderdate) AS year, count(*) AS row_count, count(DISTINCT o_custkey) AS distinct_keys,
              min(o_custkey) AS min_key, max(o_custkey) AS max_key FROM orders GROUP BY 1""")
def entity_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return ql.key_bounds(orders, ["year"], "o_custkey")


@query("subset_views", "subset:s area:i year:i spend:d extra:d", "WITH" + GROUPED_SQL + """,
       st AS (SELECT area FROM cells GROUP BY area HAVING count(DISTINCT year) = 6)---
       SELECT 'stable' AS subset, area, year, spend, NULL AS extra FROM cells JOIN st USING (area)
       UNION ALL SELECT 'latest', area, year, spend, NULL FROM cells WHERE year = 2001
       UNION ALL SELECT 'region', area, year, spend, NULL FROM gcells
         WHERE (year <= 1998 AND region = 1) OR (year > 1998 AND region IN (2, 3))""")
def subset_views(spark, folder):
    grouped = cells_with_groups(spark, folder)
    codes = {y: [1] if y <= 1998 else [2, 3] for y in YEARS}
    parts = {"stable": pn.stable_entities(grouped, "area", "year", 6), "latest": grouped.where("year = 2001"),
             "region": ky.areas_of_period(grouped, "year", "region", codes)}
    return rs.union_all([
        df.select(F.lit(n).alias("subset"), "area", "year", "spend", ex.optional_column(df, "not_there", "extra"))
        for n, df in parts.items()])


@query("clamp_floor", "l_orderkey:i l_linenumber:i l_partkey:i clamped:d raised:d", """---
       SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_discount, 0.02), 0.06) AS clamped,
              greatest(coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, 10), 10) AS raised FROM lineitem""")
def clamp_floor(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ex.clamp("l_discount", 0.02, 0.06).alias("clamped"),
        ex.floored(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), 10).alias("raised"))


@query("top_numeric_columns", "column_name:s non_null:i n_unique:i std:d", """
       WITH u AS (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL
                  SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
                  UNION ALL SELECT 'l_tax', l_tax FROM lineitem)---
       SELECT column_name, count(v) AS non_null, count(DISTINCT v) AS n_unique, stddev_samp(v) AS std FROM u GROUP BY 1
       ORDER BY non_null DESC, n_unique DESC, std DESC, column_name LIMIT 3""")
def top_numeric_columns(spark, folder):
    return pf.column_ranking(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


@query("label_fallback_join", "area:i year:i label:s", "WITH" + CELLS_SQL + """---
       SELECT area, year, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, 'area_' || area) AS label
       FROM customer RIGHT JOIN cells ON c_custkey = area""")
def label_fallback_join(spark, folder):
    labels = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("area"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("geo_label"))
    estimates = cells(spark, folder).select("area", "year")
    return labels.join(estimates, "area", "right").select(
        "area", "year", F.coalesce("geo_label", F.concat(F.lit("area_"), F.col("area").cast("string"))).alias("label"))


@query("sanity_means", "region:i row_count:i rows_with_all_core_metrics:i avg_spend:d avg_pct_open:d", "WITH" + GROUPED_SQL + """---
       SELECT region, count(*) AS row_count, count(pct_urgent) AS rows_with_all_core_metrics, avg(spend) AS avg_spend,
              avg(pct_open) AS avg_pct_open FROM gcells WHERE year = 1999 GROUP BY region""")
def sanity_means(spark, folder):
    one_year = cells_with_groups(spark, folder).where("year = 1999")
    return pf.core_complete(one_year, ["region"], ["spend", "pct_urgent"], ["spend", "pct_open"])


@query("dim_validation", "bad_tract_geoid:i bad_tractce:i missing_number:i", "WITH" + GEO_SQL + """---
       SELECT count(*) FILTER (length(geo_id) <> 20) AS bad_tract_geoid, count(*) FILTER (length(geo_id) <> 20) AS bad_tractce,
              count(*) FILTER (name LIKE 'Block%') AS missing_number FROM geo WHERE geo_id LIKE '1400000US%'""")
def dim_validation(spark, folder):
    rows = geo(spark, folder).where(ky.is_tract_row("geo_id")).select(
        *ky.key_parts("geo_id"), ky.tract_number("name").alias("tract_number"))
    return ql.bad_keys(rows, {"bad_tract_geoid": ex.digits_of_length("tract_geoid", 11),
                              "bad_tractce": ex.digits_of_length("tractce", 6),
                              "missing_number": F.col("tract_number").isNotNull()})


@query("run_summary", "metric:s value:s", "WITH" + CELLS_SQL + """---
       SELECT 'row_count' AS metric, count(*)::VARCHAR AS value FROM cells
       UNION ALL SELECT 'distinct_areas', count(DISTINCT area)::VARCHAR FROM cells
       UNION ALL SELECT 'years', string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) FROM cells
       UNION ALL SELECT 'urgent_filled', count(pct_urgent)::VARCHAR FROM cells""")
def run_summary(spark, folder):
    years = F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ", ")
    return pf.run_summary(cells(spark, folder), {
        "row_count": F.count(F.lit(1)), "distinct_areas": F.countDistinct("area"), "years": years,
        "urgent_filled": F.count("pct_urgent")})


@query("update_from", "area:i year:i label:s spend:d", "WITH" + GROUPED_SQL + """---
       SELECT area, year, segment AS label, CASE WHEN segment = 'BUILDING' THEN 1.0 WHEN segment = 'FURNITURE' THEN NULL
              ELSE spend END AS spend FROM gcells""")
def update_from(spark, folder):
    fix = literal_table(spark, [("BUILDING", 1.0), ("FURNITURE", None)], "label string, new_spend double")
    rows = cells_with_groups(spark, folder).select("area", "year", F.col("segment").alias("label"), "spend")
    return hh.update_from(rows, fix, ["label"], {"spend": "new_spend"})


@query("build_manifest", "year:i segment:s row_count:i column_count:i status:s", "WITH" + GROUPED_SQL + """---
       SELECT year, segment, count(*) AS row_count, 3 AS column_count, 'ok' AS status FROM gcells GROUP BY ALL""")
def build_manifest(spark, folder):
    return io.build_manifest(cells_with_groups(spark, folder).select("area", "year", "segment"), ["year", "segment"])


@query("ordered_preview", "o_orderkey:i o_totalprice:d", """---
       SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def ordered_preview(spark, folder):
    return io.preview(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), "o_orderkey"])
