"""Whole analyses over the customer-year panel, and fits whose right answer is known beforehand."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import cluster as cl
from hearthstat.operators import metrics as mt
from hearthstat.operators import ml
from hearthstat.operators import profile as pf
from hearthstat.operators import reshape as rs
from hearthstat.operators.scale import stage
from hearthstat.plans import analysis
from workload.base import CELLS_SQL, GROUPED_SQL, YEARS, cells, cells_with_groups, query
from workload.tables import SPECS

STABLE_SQL = """,
st AS (SELECT area FROM cells GROUP BY area HAVING count(DISTINCT year) >= 6)"""


def tract_panel(spark, folder, rows=None):
    """The panel under the names of the analyses, with the stability flag."""
    rows = cells(spark, folder) if rows is None else rows
    seen = rows.groupBy("area").agg(F.countDistinct("year").alias("_n"))
    return stage(rows.join(seen, "area").withColumn("is_stable_all_4_years", (F.col("_n") >= 6).cast("int")).drop("_n").withColumnRenamed("area", "tract_geoid"))


EDA_METRICS = ["spend", "pct_open", "pct_urgent"]


@query("panel_eda", "part:s year:i metric:s value:d", "WITH" + CELLS_SQL + STABLE_SQL + """,
       l AS (SELECT area, year, metric, value FROM cells UNPIVOT INCLUDE NULLS (value FOR metric IN (spend, pct_open, pct_urgent))),
       q AS (SELECT metric, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM l GROUP BY metric)---
       SELECT 'mean' AS part, year, metric, avg(value) AS value FROM l GROUP BY ALL
       UNION ALL SELECT 'median', year, metric, quantile_cont(value, 0.5) FROM l GROUP BY ALL
       UNION ALL SELECT 'missing', year, metric, count(*) - count(value) FROM l GROUP BY ALL
       UNION ALL SELECT 'stable_gap', year, metric, avg(value) FILTER (area IN (FROM st)) - avg(value) FROM l GROUP BY ALL
       UNION ALL SELECT 'p75', year, metric, quantile_cont(value, 0.75) FROM l GROUP BY ALL
       UNION ALL SELECT 'ranked', year, metric, least(10, count(value)) * 2 FROM l GROUP BY ALL
       UNION ALL SELECT 'outliers', NULL, metric, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) FROM l JOIN q USING (metric) GROUP BY metric
       UNION ALL SELECT 'best_rank', year, metric, count(DISTINCT value) FROM l WHERE value IS NOT NULL GROUP BY ALL""", digits=5)
def panel_eda(spark, folder):
    """Descriptive tables of the panel, as one list of values."""
    found = analysis.eda(tract_panel(spark, folder), EDA_METRICS)
    ranks = found["ranks"].groupBy("year", "metric").agg(F.max("rank_asc").alias("v"))
    ranked = found["rankings"].groupBy("year", "metric").agg(F.count(F.lit(1)).alias("v"))
    pick = {
        "mean": found["trend"].select("year", "metric", F.col("mean_value").alias("v")), "median": found["trend"].select("year", "metric", F.col("median_value").alias("v")),
        "missing": found["missing"].select("year", F.col("column_name").alias("metric"), F.col("missing_count").alias("v")),
        "stable_gap": found["stable_vs_full"].select("year", "metric", F.col("difference").alias("v")),
        "p75": found["summary"].select("year", "metric", F.col("p75").alias("v")), "ranked": ranked, "best_rank": ranks,
        "outliers": found["outliers"].select(F.lit(None).cast("int").alias("year"), "metric", F.col("outlier_count").alias("v"))}
    return rs.union_all([df.select(F.lit(part).alias("part"), "year", "metric", F.col("v").cast("double").alias("value")) for part, df in pick.items()])


@query("panel_change_tables", "start_year:i end_year:i metric:s count:i mean:d median:d min:d max:d gainers:i", "WITH" + CELLS_SQL + STABLE_SQL + """,
       c AS (SELECT a.area, a.year AS start_year, b.year AS end_year, metric, CASE metric WHEN 'spend' THEN b.spend - a.spend ELSE b.pct_urgent - a.pct_urgent END AS d
             FROM cells a JOIN cells b ON a.area = b.area AND (a.year, b.year) IN ((1995, 1997), (1997, 2001)), (VALUES ('spend'), ('pct_urgent')) m(metric)
             WHERE a.area IN (FROM st))---
       SELECT start_year, end_year, metric, count(d) AS "count", avg(d) AS mean, quantile_cont(d, 0.5) AS median, min(d) AS "min", max(d) AS "max",
              least(count(d), 10) AS gainers FROM c GROUP BY ALL""", digits=5)
def panel_change_tables(spark, folder):
    """Changes of the stable areas between chosen years."""
    found = analysis.panel_change(tract_panel(spark, folder), ["spend", "pct_urgent"], YEARS, ((1995, 1997), (1997, 2001)))
    keys = ["start_year", "end_year", "metric"]
    gainers = found["movers"].where("direction = 'gainer'").groupBy(*keys).agg(F.count(F.lit(1)).alias("gainers"))
    return found["summary"].join(gainers, keys)


# Groups that no fit can miss: three places far apart, some areas move in 1999.

MOVED_SQL = CELLS_SQL + STABLE_SQL + """,
g AS (SELECT area, year, (area + CASE WHEN year >= 1999 AND area % 10 = 0 THEN 1 ELSE 0 END) % 3 AS g FROM cells)"""


@query("clusters_and_transitions", "from_year:i to_year:i entities_compared:i stayed_same_count:i changed_count:i sizes:s", "WITH" + MOVED_SQL + """,
       s AS (SELECT year, string_agg(n::VARCHAR, ',' ORDER BY n) AS sizes FROM (SELECT year, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY year)---
       SELECT a.year AS from_year, b.year AS to_year, count(*) AS entities_compared, count(*) FILTER (a.g = b.g) AS stayed_same_count,
              count(*) FILTER (a.g <> b.g) AS changed_count, any_value(sizes) AS sizes
       FROM g a JOIN g b ON a.area = b.area AND b.year = a.year + 1 JOIN s ON s.year = b.year WHERE a.area IN (FROM st) GROUP BY ALL""")
def clusters_and_transitions(spark, folder):
    """Fits, alignment and transitions find the groups and who moved (D17, ML3-ML5, ML10-ML13)."""
    area, year = F.col("area"), F.col("year")
    group = (area + F.when((year >= 1999) & (area % 10 == 0), 1).otherwise(0)) % 3
    rows = cells(spark, folder).select("area", "year", (group * 50 + area % 7 * 0.1).alias("p"), (group * -30 + area % 5 * 0.1).alias("q"))
    found = analysis.clusters(tract_panel(spark, folder, rows), ["p", "q"], restarts=4)
    sizes = found["counts"].groupBy(F.col("year").alias("to_year")).agg(F.array_join(F.array_sort(F.collect_list("entity_count")).cast("array<string>"), ",").alias("sizes"))
    return found["transition_summary"].join(sizes, "to_year")


@query("kmeans_known_groups", "year:i selected_k:i row_count:i inertia:d silhouette:d", "WITH" + CELLS_SQL + """,
       x AS (SELECT year, area, area % (2 + year % 3) AS g, area % (2 + year % 3) * 5 + area % 7 * 0.01 AS p, area % 11 * 0.01 AS q FROM cells),
       m AS (SELECT year, g, avg(p) AS mp, avg(q) AS mq FROM x GROUP BY ALL),
       i AS (SELECT year, sum((p - mp) ** 2 + (q - mq) ** 2) AS inertia, count(*) AS n FROM x JOIN m USING (year, g) GROUP BY year),
       d AS (SELECT a.year, a.area, a.g, b.g AS other, sum((a.p - b.p) ** 2 + (a.q - b.q) ** 2) AS s, count(*) AS n FROM x a JOIN x b ON a.year = b.year GROUP BY ALL),
       ab AS (SELECT year, area, max(CASE WHEN g = other THEN s / (n - 1) END) AS a, min(CASE WHEN g <> other THEN s / n END) AS b FROM d GROUP BY ALL),
       w AS (SELECT year, avg((b - a) / greatest(a, b)) AS silhouette FROM ab GROUP BY year)---
       SELECT year, 2 + year % 3 AS selected_k, n AS row_count, inertia, silhouette FROM i JOIN w USING (year)""", digits=5)
def kmeans_known_groups(spark, folder):
    """Two, three or four groups by year: the number, the inertia and the silhouette are known (ML3-ML5)."""
    groups = 2 + F.col("year") % 3
    rows = cells(spark, folder).select("year", "area", (F.col("area") % groups * 5 + F.col("area") % 7 * 0.01).alias("s_p"), (F.col("area") % 11 * 0.01).alias("s_q"))
    return cl.kmeans_by_period(stage(rows), "year", ["p", "q"], restarts=5)[2]


@query("final_tables", "year:i rank_basis:s rank_group:s rank_order:i tract_geoid:i display_area_label:s basis_value:d", "WITH" + GROUPED_SQL + """,
       b AS (SELECT year, area, CASE WHEN area % 9 <> 0 THEN 'Area ' || area || ' in ' || n_name ELSE area::VARCHAR END AS label,
                    unnest(['estimated_households', 'estimated_rate_proxy_pct']) AS basis, unnest([spend / 1000, pct_open]) AS v FROM gcells),
       r AS (SELECT *, row_number() OVER (PARTITION BY year, basis ORDER BY v DESC, area) AS t, row_number() OVER (PARTITION BY year, basis ORDER BY v, area) AS u FROM b)---
       SELECT year, basis AS rank_basis, 'top_15' AS rank_group, t AS rank_order, area AS tract_geoid, label AS display_area_label, v AS basis_value FROM r WHERE t <= 15
       UNION ALL SELECT year, basis, 'bottom_15', u, area, label, v FROM r WHERE u <= 15""")
def final_tables(spark, folder):
    """Estimates joined to their labels, with top and bottom lists."""
    grouped = stage(cells_with_groups(spark, folder))
    estimates = grouped.select(F.col("area").alias("tract_geoid"), "year", (F.col("spend") / 1000).alias("estimated_households"),
                               F.col("pct_open").alias("estimated_rate_proxy_pct"), F.col("pct_urgent").alias("poverty_rate"))
    label = F.concat(F.lit("Area "), F.col("area").cast("string"), F.lit(" in "), F.col("n_name"))
    places = grouped.where(F.col("area") % 9 != 0).select(
        F.col("area").alias("tract_geoid"), label.alias("display_area_label"), F.col("segment").alias("area_type"), F.col("n_name").alias("primary_place"))
    return analysis.final_outputs(estimates, places, YEARS)["top_bottom"].select(
        "year", "rank_basis", "rank_group", "rank_order", "tract_geoid", "display_area_label", "basis_value")


# A target that is a step function of one feature, so trees must hit it exactly.

STEPS = {0: 40.0, 1: 10.0, 2: 25.0}
STEP_SQL = CELLS_SQL + """,
s AS (SELECT area, year, area % 3 AS v, year % 4 AS idle, CASE area % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 10.0 ELSE 25.0 END AS target FROM cells)"""
SMALL = {"forest": {"numTrees": 8, "minInstancesPerNode": 2, "maxDepth": 5, "seed": 42}, "boost": {"maxIter": 4, "stepSize": 0.1, "maxDepth": 3, "seed": 42}}
TREES = ("random_forest", "gradient_boosting")


def steps(spark, folder):
    value = F.coalesce(*[F.when(F.col("area") % 3 == v, F.lit(t)) for v, t in STEPS.items()])
    return cells(spark, folder).select("area", "year", (F.col("area") % 3).alias("v"), (F.col("year") % 4).alias("idle"), value.alias("target"),
                                       (F.col("area") % 3 == 0).cast("int").alias("high_risk"))


@query("trees_hit_steps", "model:s area:i predicted_target:d predicted_class:i", "WITH" + STEP_SQL + """---
       SELECT model, area, target AS predicted_target, (v = 0)::INT AS predicted_class FROM s, (VALUES ('random_forest'), ('gradient_boosting')) m(model) WHERE year = 2001""")
def trees_hit_steps(spark, folder):
    """Regressions and classifiers of trees give every test row the value of its step (ML19, ML21)."""
    rows = steps(spark, folder)
    train, test = ml.split(stage(rows), "year", YEARS[:-1], YEARS[-1:], "target")
    made, _ = ml.fit_regression(train, test, ["v", "idle"], "target", ["area"], models=TREES, **SMALL)
    classes, _ = ml.fit_classification(train, test, ["v", "idle"], "high_risk", ["area"], models=TREES, **SMALL)
    return made.select("model", "area", "predicted_target").join(classes.select("model", "area", F.col("predicted_class").cast("int").alias("predicted_class")), ["model", "area"])


@query("importance_of_steps", "model:s feature:s importance:d", "WITH" + STEP_SQL + """---
       SELECT model, feature, (feature = 'v' AND (SELECT count(*) FROM s) > 0)::INT::DOUBLE AS importance
       FROM (VALUES ('random_forest'), ('gradient_boosting')) m(model), (VALUES ('v'), ('idle')) f(feature)""")
def importance_of_steps(spark, folder):
    """All importance lies with the feature that the target follows (ML24)."""
    train, test = ml.split(stage(steps(spark, folder)), "year", YEARS[:-1], YEARS[-1:], "target")
    return ml.fit_regression(train, test, ["v", "idle"], "target", ["area"], models=TREES, **SMALL)[1].select("model", "feature", "importance")


@query("model_tables", "part:s model:s row_count:i value:d", "WITH" + STEP_SQL + """,
       t AS (SELECT count(*) AS n, count(*) FILTER (v = 0) AS pos FROM s WHERE year = 2001), r AS (SELECT count(*) AS n FROM s WHERE year < 2001)---
       SELECT 'rmse' AS part, model, n AS row_count, 0.0 AS value FROM t, (VALUES ('random_forest'), ('gradient_boosting')) m(model)
       UNION ALL SELECT 'roc_auc', model, n, 1.0 FROM t, (VALUES ('random_forest'), ('gradient_boosting')) m(model)
       UNION ALL SELECT 'train', 'all', n, 0.0 FROM r UNION ALL SELECT 'test', 'all', n, 0.0 FROM t
       UNION ALL SELECT 'hits', 'best', n, pos FROM t UNION ALL SELECT 'worst', 'best', 30, 0.0""")
def model_tables(spark, folder):
    """Targets, split, models and evaluation as a whole."""
    rows = stage(steps(spark, folder).withColumnRenamed("area", "tract_geoid").drop("high_risk"))
    found = analysis.ml_layer(rows, "target", YEARS[:-1], YEARS[-1], ["v", "idle"], **SMALL)
    trees = F.col("model").isin(list(TREES))
    hits = found["confusion"].agg(F.sum(F.col("predicted_0") + F.col("predicted_1")).alias("row_count"),
                                  F.sum(F.when(F.col("actual") == 1, F.col("predicted_1"))).alias("value"))
    parts = [
        found["regression_metrics"].where(trees).select(F.lit("rmse").alias("part"), "model", "row_count", F.col("rmse").alias("value")),
        found["classification_metrics"].where(trees).select(F.lit("roc_auc").alias("part"), "model", "row_count", F.col("roc_auc").alias("value")),
        found["split_summary"].select(F.col("split").alias("part"), F.lit("all").alias("model"), "row_count", F.lit(0.0).alias("value")),
        hits.select(F.lit("hits").alias("part"), F.lit("best").alias("model"), "row_count", F.col("value").cast("double").alias("value")),
        found["worst_areas"].agg(F.count(F.lit(1)).alias("row_count"), F.max(F.abs("residual")).alias("value")).select(
            F.lit("worst").alias("part"), F.lit("best").alias("model"), "row_count", "value")]
    return rs.union_all(parts)


@query("formula_audit_drift", "year:i check_name:s max_abs_diff:d", "WITH" + CELLS_SQL + """---
       SELECT year, 'avg_order' AS check_name, max(CASE WHEN area % 10 = 3 THEN (area % 100) / 8.0 ELSE 0 END) AS max_abs_diff FROM cells GROUP BY year
       UNION ALL SELECT year, 'pct_open_of_all', max(CASE WHEN area % 4 = 0 THEN year - 1990 ELSE 0 END) FROM cells GROUP BY year""")
def formula_audit_drift(spark, folder):
    """Stored metrics that were changed in known rows; the audit must find by how much."""
    stored = mt.project(cells(spark, folder), SPECS, ["area", "year", "orders_total", "spend", "pct_open", "pct_urgent"])
    area = F.col("area")
    changed = stored.withColumns({
        "avg_order": F.col("avg_order") + F.when(area % 10 == 3, area % 100 / 8.0).otherwise(0.0),
        "pct_open_of_all": F.col("pct_open_of_all") - F.when(area % 4 == 0, F.col("year") - 1990).otherwise(0)})
    again = mt.recomputed(changed, SPECS)
    return pf.formula_audit(changed, ["year"], {c: again[c] for c in ("avg_order", "pct_open_of_all")})
