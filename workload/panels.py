"""Standardising, ranking, change, description and allocation over the customer-year panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import allocate as al
from hearthstat.operators import panel as pn
from hearthstat.operators import profile as pf
from hearthstat.operators import ranking as rk
from hearthstat.operators import standardize as sd
from hearthstat.operators.ordered import quantiles
from hearthstat.operators.scale import stage
from workload.base import (CELLS_SQL, GROUPED_SQL, LONG_SQL, METRICS, YEARS, cells, cells_staged, cells_with_groups, query, table)


def _z(column, group="PARTITION BY year", spread="stddev_samp"):
    return (f"CASE WHEN coalesce({spread}({column}) OVER ({group}), 0) = 0 THEN 0 "
            f"ELSE ({column} - avg({column}) OVER ({group})) / {spread}({column}) OVER ({group}) END")


@query("zscore_by_group", "area:i year:i z_spend:d z_pct_open:d z_pct_urgent:d", "WITH" + CELLS_SQL + f"""---
       SELECT area, year, {_z('spend')} AS z_spend, {_z('pct_open')} AS z_pct_open, {_z('pct_urgent')} AS z_pct_urgent FROM cells""")
def zscore_by_group(spark, folder):
    out = sd.zscores(cells(spark, folder), ["year"], ["spend", "pct_open", "pct_urgent"])
    return out.select("area", "year", "z_spend", "z_pct_open", "z_pct_urgent")


@query("zscore_global", "area:i year:i z_spend:d p_spend:d", "WITH" + CELLS_SQL + f"""---
       SELECT area, year, {_z('spend', '')} AS z_spend, {_z('spend', '', 'stddev_pop')} AS p_spend FROM cells""")
def zscore_global(spark, folder):
    out = sd.zscores(cells_staged(spark, folder), [], ["spend"])
    return sd.zscores(out, [], ["spend"], prefix="p_", population=True).select("area", "year", "z_spend", "p_spend")


@query("entity_mean_zscore", "area:i spend:d z_spend:d z_pct_open:d", "WITH" + CELLS_SQL + f""",
       m AS (SELECT area, avg(spend) AS spend, avg(pct_open) AS pct_open FROM cells GROUP BY area)---
       SELECT area, spend, {_z('spend', '', 'stddev_pop')} AS z_spend, {_z('pct_open', '', 'stddev_pop')} AS z_pct_open FROM m""")
def entity_mean_zscore(spark, folder):
    return sd.mean_zscores(cells(spark, folder), "area", ["spend", "pct_open"]).select("area", "spend", "z_spend", "z_pct_open")


@query("minmax_shift_share", "area:i year:i scaled:d flat:d shifted:d share:d equal_share:d", "WITH" + CELLS_SQL + """---
       SELECT area, year, (spend - min(spend) OVER w) / (max(spend) OVER w - min(spend) OVER w) AS scaled, 0.5 AS flat,
              spend - min(spend) OVER w + 0.01 AS shifted, spend / sum(spend) OVER w AS share, 1.0 / count(*) OVER w AS equal_share
       FROM cells WINDOW w AS (PARTITION BY year)""")
def minmax_shift_share(spark, folder):
    out = sd.minmax(cells_staged(spark, folder), ["year"], "spend", "scaled")
    out = sd.minmax(out, ["year"], "year", "flat")
    out = sd.shift_positive(out, ["year"], "spend", "shifted")
    out = sd.share_of_total(out, ["year"], "spend", "share").withColumn("nothing", F.lit(0.0))
    return sd.share_of_total(out, ["year"], "nothing", "equal_share").select(
        "area", "year", "scaled", "flat", "shifted", "share", "equal_share")


RANK_SPEC = "area:i year:i metric:s metric_value:d rank_asc:i rank_desc:i"
RANK_SQL = "WITH" + LONG_SQL + """---
       SELECT area, year, metric, value AS metric_value, dense_rank() OVER (PARTITION BY year, metric ORDER BY value) AS rank_asc,
              dense_rank() OVER (PARTITION BY year, metric ORDER BY value DESC) AS rank_desc FROM long"""


@query("dense_ranks", RANK_SPEC, RANK_SQL)
def dense_rank_rows(spark, folder):
    return rk.metric_ranks(cells(spark, folder), ["area"], "year", METRICS)


@query("dense_ranks_by_ranges", RANK_SPEC, RANK_SQL)
def dense_rank_ranges(spark, folder):
    """The form for groups too large for one task, on the same panel."""
    return rk.metric_ranks(cells(spark, folder), ["area"], "year", METRICS, group_rows=0)


@query("top_bottom_n", "area:i year:i spend:d rank_order:i rank_group:s", "WITH" + CELLS_SQL + """,
       r AS (SELECT area, year, spend, row_number() OVER (PARTITION BY year ORDER BY spend DESC, area) AS t,
                    row_number() OVER (PARTITION BY year ORDER BY spend, area) AS b FROM cells)---
       SELECT area, year, spend, t AS rank_order, 'top_5' AS rank_group FROM r WHERE t <= 5
       UNION ALL SELECT area, year, spend, b, 'bottom_5' FROM r WHERE b <= 5""")
def top_bottom_n(spark, folder):
    panel = cells(spark, folder).select("area", "year", "spend")
    return rk.top_and_bottom(panel, ["year"], "spend", ["area"], 5)


@query("top_per_group", "l_suppkey:i l_orderkey:i l_linenumber:i l_extendedprice:d rank_order:i", """---
       SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank_order FROM (
         SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)
           AS rank_order FROM lineitem) WHERE rank_order <= 10""")
def top_per_group(spark, folder):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return rk.top_n(table(spark, folder, "lineitem"), ["l_suppkey"], order, 10).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank_order")


def _change_columns():
    steps = [f'v{b} - v{a} AS "change_{a}_to_{b}"' for a, b in zip(YEARS, YEARS[1:])]
    return ", ".join([*steps, f"v{YEARS[-1]} - v{YEARS[0]} AS change_first_to_last"])


@query("consecutive_change", "area:i metric:s " + " ".join(f"change_{a}_to_{b}:d" for a, b in zip(YEARS, YEARS[1:]))
       + " change_first_to_last:d", "WITH" + LONG_SQL + """,
       m AS (SELECT area, metric, """ + ", ".join(f"max(value) FILTER (year = {y}) AS v{y}" for y in YEARS) + """
             FROM (SELECT a.area, m.metric, l.year, l.value FROM (SELECT DISTINCT area FROM cells) a
                   CROSS JOIN (VALUES ('spend'), ('pct_urgent')) m(metric)
                   LEFT JOIN long l ON l.area = a.area AND l.metric = m.metric) GROUP BY ALL)---
       SELECT area, metric, """ + _change_columns() + " FROM m")
def consecutive_change(spark, folder):
    return pn.consecutive_changes(cells(spark, folder), "area", "year", ["spend", "pct_urgent"], YEARS)


@query("lagged_change", "area:i year:i previous_period:i change:d", "WITH" + CELLS_SQL + """---
       SELECT area, year, lag(year) OVER w AS previous_period, spend - lag(spend) OVER w AS change FROM cells
       WINDOW w AS (PARTITION BY area ORDER BY year)""")
def lagged_change(spark, folder):
    return pn.lagged_changes(cells(spark, folder), "area", "year", "spend").select("area", "year", "previous_period", "change")


PAIRS = [(1995, 1997), (1997, 1999), (1999, 2001), (1995, 2001)]
CHANGE_SQL = "WITH" + CELLS_SQL + """,
       p(start_year, end_year) AS (VALUES (1995, 1997), (1997, 1999), (1999, 2001), (1995, 2001)),
       w AS (SELECT a.area, start_year, end_year, a.spend AS s1, b.spend AS s2, a.pct_urgent AS u1, b.pct_urgent AS u2
             FROM p JOIN cells a ON a.year = start_year JOIN cells b ON b.year = end_year AND b.area = a.area),
       ch AS (SELECT area, start_year, end_year, 'spend' AS metric, s1 AS value_start, s2 AS value_end FROM w
              UNION ALL SELECT area, start_year, end_year, 'pct_urgent', u1, u2 FROM w),
       changes AS (SELECT *, value_end - value_start AS absolute_change,
                   CASE WHEN value_start <> 0 THEN (value_end - value_start) / value_start * 100 END AS pct_change FROM ch)"""


def changes(spark, folder):
    return pn.pair_changes(cells(spark, folder), "area", "year", ["spend", "pct_urgent"], PAIRS)


@query("pair_change", "area:i start_year:i end_year:i metric:s value_start:d value_end:d absolute_change:d pct_change:d",
       CHANGE_SQL + "---SELECT * FROM changes")
def pair_change(spark, folder):
    return changes(spark, folder)


@query("change_summary", "start_year:i end_year:i metric:s count:i mean:d median:d min:d max:d", CHANGE_SQL + """---
       SELECT start_year, end_year, metric, count(absolute_change) AS "count", avg(absolute_change) AS mean,
              quantile_cont(absolute_change, 0.5) AS median, min(absolute_change) AS "min", max(absolute_change) AS "max"
       FROM changes GROUP BY ALL""")
def change_summary(spark, folder):
    return pn.change_summary(stage(changes(spark, folder)), ["start_year", "end_year", "metric"])


@query("movers", "area:i start_year:i end_year:i metric:s absolute_change:d rank_order:i direction:s", CHANGE_SQL + """,
       r AS (SELECT *, row_number() OVER (PARTITION BY start_year, end_year, metric ORDER BY absolute_change DESC, area) AS g,
                    row_number() OVER (PARTITION BY start_year, end_year, metric ORDER BY absolute_change, area) AS d
             FROM (SELECT * REPLACE (round(absolute_change, 6) AS absolute_change) FROM changes)
             WHERE absolute_change IS NOT NULL)---
       SELECT area, start_year, end_year, metric, absolute_change, g AS rank_order, 'gainer' AS direction FROM r WHERE g <= 10
       UNION ALL SELECT area, start_year, end_year, metric, absolute_change, d, 'decliner' FROM r WHERE d <= 10""")
def movers(spark, folder):
    rows = changes(spark, folder).select("area", "start_year", "end_year", "metric", F.round("absolute_change", 6).alias("absolute_change"))
    return pn.movers(rows, ["start_year", "end_year", "metric"], "area", 10)


QUANTILE_SPEC = "year:i status:s q01:d q25:d median:d q75:d q99:d"
QUANTILE_SQL = """---SELECT year(o_orderdate) AS year, o_orderstatus AS status, quantile_cont(o_totalprice, 0.01) AS q01,
       quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS median,
       quantile_cont(o_totalprice, 0.75) AS q75, quantile_cont(o_totalprice, 0.99) AS q99 FROM orders GROUP BY ALL"""
QUANTILES = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}


def _prices(spark, folder):
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), "o_totalprice")


@query("quantiles", QUANTILE_SPEC, QUANTILE_SQL)
def quantile_rows(spark, folder):
    return quantiles(_prices(spark, folder), ["year", "status"], "o_totalprice", QUANTILES)


@query("quantiles_by_ranges", QUANTILE_SPEC, QUANTILE_SQL)
def quantile_ranges(spark, folder):
    """The form for groups too large for one task, on the same rows."""
    return quantiles(_prices(spark, folder), ["year", "status"], "o_totalprice", QUANTILES, bins=8, few=4)


@query("quantile_flag", "area:i year:i cut:d high:i", "WITH" + CELLS_SQL + """---
       SELECT area, year, q AS cut, CASE WHEN spend >= q THEN 1 ELSE 0 END AS high
       FROM cells JOIN (SELECT year, quantile_cont(spend, 0.75) AS q FROM cells GROUP BY year) USING (year)""")
def quantile_flag(spark, folder):
    return sd.quantile_flag(cells_staged(spark, folder), ["year"], "spend", 0.75, "high", "cut").select("area", "year", "cut", "high")


@query("winsorize", "area:i year:i spend:d pct_urgent:d", "WITH" + CELLS_SQL + """,
       q AS (SELECT year, quantile_cont(spend, 0.05) AS s1, quantile_cont(spend, 0.95) AS s2, quantile_cont(pct_urgent, 0.05) AS u1,
                    quantile_cont(pct_urgent, 0.95) AS u2 FROM cells GROUP BY year)---
       SELECT area, year, least(greatest(spend, s1), s2) AS spend,
              CASE WHEN pct_urgent IS NOT NULL THEN least(greatest(pct_urgent, u1), u2) END AS pct_urgent FROM cells JOIN q USING (year)""")
def winsorize(spark, folder):
    return sd.winsorize(cells_staged(spark, folder), ["year"], ["spend", "pct_urgent"], 0.05, 0.95).select(
        "area", "year", "spend", "pct_urgent")


@query("summary_stats", "year:i metric:s non_null:i missing:i min:d mean:d max:d std:d p25:d median:d p75:d", "WITH" + LONG_SQL + """,
       s AS (SELECT year, metric, count(*) AS non_null, min(value) AS mn, avg(value) AS mean, max(value) AS mx,
                    stddev_samp(value) AS std, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median,
                    quantile_cont(value, 0.75) AS p75 FROM long GROUP BY ALL)---
       SELECT s.year, metric, non_null, n - non_null AS missing, mn AS "min", mean, mx AS "max", std, p25, median, p75
       FROM s JOIN (SELECT year, count(*) AS n FROM cells GROUP BY year) USING (year)""", digits=5)
def summary_stats(spark, folder):
    return pf.summary_stats(cells_staged(spark, folder), ["year"], METRICS)


@query("missingness", "year:i row_count:i column_name:s missing_count:i missing_pct:d", "WITH" + CELLS_SQL + """---
       SELECT year, count(*) AS row_count, 'pct_urgent' AS column_name, count(*) - count(pct_urgent) AS missing_count,
              100.0 * (count(*) - count(pct_urgent)) / count(*) AS missing_pct FROM cells GROUP BY year
       UNION ALL SELECT year, count(*), 'spend', 0, 0 FROM cells GROUP BY year""")
def missingness(spark, folder):
    return pf.missingness(cells(spark, folder), ["year"], ["spend", "pct_urgent"])


@query("trend", "year:i metric:s mean_value:d median_value:d", "WITH" + LONG_SQL + """---
       SELECT year, metric, avg(value) AS mean_value, quantile_cont(value, 0.5) AS median_value FROM long GROUP BY ALL""", digits=5)
def trend(spark, folder):
    return pf.trend(cells_staged(spark, folder), "year", METRICS)


@query("stable_comparison", "year:i metric:s full_mean:d stable_mean:d difference:d", "WITH" + LONG_SQL + """,
       st AS (SELECT area FROM cells GROUP BY area HAVING count(DISTINCT year) = 6)---
       SELECT year, metric, avg(value) AS full_mean, avg(value) FILTER (area IN (FROM st)) AS stable_mean,
              avg(value) FILTER (area IN (FROM st)) - avg(value) AS difference
       FROM long WHERE metric IN ('spend', 'pct_open') GROUP BY ALL""", digits=5)
def stable_comparison(spark, folder):
    panel = cells(spark, folder)
    counts = panel.groupBy("area").agg(F.countDistinct("year").alias("n"))
    return pf.stable_comparison(panel.join(counts, "area"), ["year"], F.col("n") == 6, ["spend", "pct_open"])


def _corr_sql():
    parts = []
    for a in METRICS:
        for b in METRICS:
            parts.append(f"SELECT year, '{a}' AS metric_a, '{b}' AS metric_b, corr({a}, {b}) AS correlation FROM cells GROUP BY year")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", "year:i metric_a:s metric_b:s correlation:d", "WITH" + CELLS_SQL + "---" + _corr_sql())
def correlation_matrix(spark, folder):
    return pf.correlation_matrix(cells(spark, folder), ["year"], METRICS)


@query("correlation_overall", "metric_a:s metric_b:s correlation:d", "WITH" + CELLS_SQL + "---"
       + _corr_sql().replace("SELECT year, ", "SELECT ").replace(" GROUP BY year", ""))
def correlation_overall(spark, folder):
    return pf.correlation_matrix(cells(spark, folder), [], METRICS)


@query("iqr_outliers",
       "year:i metric:s q1:d q3:d iqr:d lower_bound:d upper_bound:d outlier_count:i outlier_pct:d", "WITH" + LONG_SQL + """,
       q AS (SELECT year, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)---
       SELECT year, metric, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
              count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count,
              round(100.0 * count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 4)
                AS outlier_pct
       FROM long JOIN q USING (year, metric) WHERE metric IN ('spend', 'max_price', 'pct_open') GROUP BY ALL""", digits=5)
def iqr_outliers(spark, folder):
    return pf.iqr_outliers(cells_staged(spark, folder), ["year"], ["spend", "max_price", "pct_open"])


@query("event_outliers",
       "event_type:s metric:s q1:d q3:d iqr:d lower_bound:d upper_bound:d outlier_count:i outlier_pct:d", """
       WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)---
       SELECT event_type, 'value' AS metric, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound,
              q3 + 1.5 * (q3 - q1) AS upper_bound,
              count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count,
              round(100.0 * count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 4)
                AS outlier_pct FROM events JOIN q USING (event_type) GROUP BY ALL""")
def event_outliers(spark, folder):
    return pf.iqr_outliers(table(spark, folder, "events"), ["event_type"], ["value"])


@query("group_summaries", "year:i group_name:s group_value:s entity_count:i sum_spend:d avg_pct_open:d", "WITH" + GROUPED_SQL + """,
       u AS (SELECT year, 'segment' AS group_name, segment AS group_value, area, spend, pct_open FROM gcells
             UNION ALL SELECT year, 'n_name', CASE WHEN region <> 3 THEN n_name END, area, spend, pct_open FROM gcells
             UNION ALL SELECT year, 'region', region::VARCHAR, area, spend, pct_open FROM gcells)---
       SELECT year, group_name, group_value, count(DISTINCT area) AS entity_count, sum(spend) AS sum_spend, avg(pct_open) AS avg_pct_open
       FROM u WHERE group_value IS NOT NULL GROUP BY ALL""", digits=3)
def group_summaries(spark, folder):
    grouped = cells_with_groups(spark, folder).withColumn("n_name", F.when(F.col("region") != 3, F.col("n_name")))
    return pf.group_summaries(grouped, "year", ["segment", "n_name", "region"], "area", ["spend"], ["pct_open"])


# Allocation: region totals of households to customers, with a five-metric hardship score.

SPEC = (
    al.ScoreMetric("pct_open", 1, 1.0, "status"), al.ScoreMetric("pct_urgent", 1, 0.8, "status"),
    al.ScoreMetric("spend", -1, 1.0, "value"), al.ScoreMetric("max_price", -1, 0.7, "value"),
    al.ScoreMetric("orders_total", 1, 0.5, "size"), al.ScoreMetric("proxy", 0, 0.0, "student"))

SCORE_SQL = "WITH" + GROUPED_SQL + f""",
z AS (SELECT area, year, region, orders_total, (area * 13 + year) % 50 AS proxy, pct_open, pct_urgent, spend, max_price,
             {_z('pct_open', 'PARTITION BY year, region')} AS z1, {_z('pct_urgent', 'PARTITION BY year, region')} AS z2,
             {_z('spend', 'PARTITION BY year, region')} AS z3, {_z('max_price', 'PARTITION BY year, region')} AS z4,
             {_z('orders_total', 'PARTITION BY year, region')} AS z5 FROM gcells),
s AS (SELECT *, coalesce(z1, 0) + 0.8 * coalesce(z2, 0) - coalesce(z3, 0) - 0.7 * coalesce(z4, 0) + 0.5 * coalesce(z5, 0) AS raw
      FROM z),
p AS (SELECT *, raw - min(raw) OVER w + 0.01 AS pos,
             1 - 0.35 * CASE WHEN max(proxy) OVER w = min(proxy) OVER w THEN 0.5
               ELSE (proxy - min(proxy) OVER w)::DOUBLE / (max(proxy) OVER w - min(proxy) OVER w) END AS mult
      FROM s WINDOW w AS (PARTITION BY year, region)),
a AS (SELECT *, pos * mult AS comp, greatest(coalesce(CASE WHEN area % 9 <> 0 THEN orders_total * 10 END, 1), 1) AS cap,
             1000.0 * (region + 1) + year AS total FROM p),
alloc AS (SELECT *, comp / sum(comp) OVER (PARTITION BY year, region) AS w1,
                 comp * cap / sum(comp * cap) OVER (PARTITION BY year, region) AS w2 FROM a)"""


def allocation_base(spark, folder):
    grouped = cells_with_groups(spark, folder)
    return grouped.select(
        "area", "year", "region", *METRICS, ((F.col("area") * 13 + F.col("year")) % 50).cast("double").alias("proxy"),
        F.when(F.col("area") % 9 != 0, F.col("orders_total") * 10).alias("capacity"))


def control_totals(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_regionkey").alias("region")).distinct()
    years = F.explode(F.array(*[F.lit(y) for y in YEARS]))
    return nation.select("region", years.alias("year")).withColumn(
        "control_total", 1000.0 * (F.col("region") + 1) + F.col("year"))


def allocated(spark, folder, capacity):
    return al.allocate_totals(allocation_base(spark, folder), control_totals(spark, folder), ["year", "region"], SPEC,
                              "proxy", capacity)


@query("hardship_score", "area:i year:i z_spend:d directed_pct_urgent:d raw_hardship_score:d", SCORE_SQL + """---
       SELECT area, year, z3 AS z_spend, 0.8 * z2 AS directed_pct_urgent, raw AS raw_hardship_score FROM s""")
def hardship_score(spark, folder):
    return al.hardship_score(allocation_base(spark, folder), ["year", "region"], SPEC).select(
        "area", "year", "z_spend", "directed_pct_urgent", "raw_hardship_score")


@query("risk_components", "area:i year:i metric:s raw_metric_value:d z_score:d directed_component:d", SCORE_SQL + """---
       SELECT area, year, 'pct_open' AS metric, pct_open AS raw_metric_value, z1 AS z_score, z1 AS directed_component FROM z
       UNION ALL SELECT area, year, 'pct_urgent', pct_urgent, z2, 0.8 * z2 FROM z
       UNION ALL SELECT area, year, 'spend', spend, z3, -z3 FROM z UNION ALL SELECT area, year, 'max_price', max_price, z4, -0.7 * z4 FROM z
       UNION ALL SELECT area, year, 'orders_total', orders_total, z5, 0.5 * z5 FROM z""")
def risk_components(spark, folder):
    scored = al.hardship_score(stage(allocation_base(spark, folder)), ["year", "region"], SPEC)
    return al.component_rows(scored, ["area", "year"], SPEC)


ALLOCATE_SPEC = ("area:i year:i score_shifted_positive:d student_adjustment_multiplier:d area_capacity:d allocation_weight:d "
                 "estimated_households:d estimated_share_pct:d estimated_rate_proxy_pct:d")
ALLOCATE_COLUMNS = [c.split(":")[0] for c in ALLOCATE_SPEC.split()]


@query("allocate_totals", ALLOCATE_SPEC, SCORE_SQL + """---
       SELECT area, year, pos AS score_shifted_positive, mult AS student_adjustment_multiplier, 1.0 AS area_capacity,
              w1 AS allocation_weight, w1 * total AS estimated_households, 100 * w1 AS estimated_share_pct,
              100 * w1 * total AS estimated_rate_proxy_pct FROM alloc""")
def allocate_totals(spark, folder):
    return allocated(spark, folder, None).select(*ALLOCATE_COLUMNS)


@query("allocate_capacity", ALLOCATE_SPEC, SCORE_SQL + """---
       SELECT area, year, pos AS score_shifted_positive, mult AS student_adjustment_multiplier, cap AS area_capacity,
              w2 AS allocation_weight, w2 * total AS estimated_households, 100 * w2 AS estimated_share_pct,
              100 * w2 * total / cap AS estimated_rate_proxy_pct FROM alloc""")
def allocate_capacity(spark, folder):
    return allocated(spark, folder, "capacity").select(*ALLOCATE_COLUMNS)


@query("allocation_check",
       "year:i region:i control_total:d estimated_sum:d entity_count:i avg_weight:d max_rate_proxy:d mean_rate_proxy:d "
       "sum_diff_abs:d", SCORE_SQL + """---
       SELECT year, region, max(total) AS control_total, sum(w2 * total) AS estimated_sum, count(DISTINCT area) AS entity_count,
              avg(w2) AS avg_weight, max(100 * w2 * total / cap) AS max_rate_proxy, avg(100 * w2 * total / cap) AS mean_rate_proxy,
              0.0 AS sum_diff_abs FROM alloc GROUP BY ALL""")
def allocation_check(spark, folder):
    return al.allocation_check(allocated(spark, folder, "capacity"), ["year", "region"], "area")


@query("rate_sanity", "year:i max_rate:d over_100_pct:i over_80_pct:i p95_rate:d p99_rate:d", SCORE_SQL + """,
       r AS (SELECT year, 100 * w2 * total / cap AS rate FROM alloc)---
       SELECT year, max(rate) AS max_rate, count(*) FILTER (rate > 100) AS over_100_pct, count(*) FILTER (rate > 80) AS over_80_pct,
              quantile_cont(rate, 0.95) AS p95_rate, quantile_cont(rate, 0.99) AS p99_rate FROM r GROUP BY year""")
def rate_sanity(spark, folder):
    return al.rate_sanity(stage(allocated(spark, folder, "capacity").select("year", "estimated_rate_proxy_pct")), ["year"])


@query("allocation_year_summary", "year:i estimated_total:d mean_rate:d", SCORE_SQL + """---
       SELECT year, sum(w2 * total) AS estimated_total, avg(100 * w2 * total / cap) AS mean_rate FROM alloc GROUP BY year""")
def allocation_year_summary(spark, folder):
    return al.year_summary(allocated(spark, folder, "capacity"))
