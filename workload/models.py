"""Clusters, transitions, models and their evaluation over the customer-year panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.operators import cluster as cl
from hearthstat.operators import ml
from hearthstat.operators import panel as pn
from hearthstat.operators.scale import stage
from hearthstat.operators.standardize import zscores
from workload.base import CELLS_SQL, GROUPED_SQL, YEARS, cells, cells_staged, cells_with_groups, query, table

FEATURES = ["price", "urgent", "mod"]
CENTROID_SQL = """
cents AS (SELECT year(o_orderdate) AS year, o_orderstatus AS cluster, avg(o_totalprice) / 1000 AS price,
                 100.0 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
                 avg(o_custkey % 10) AS mod FROM orders GROUP BY ALL),
dist AS (SELECT a.year AS from_year, b.year AS to_year, a.cluster AS from_cluster, b.cluster AS to_cluster,
                sqrt((a.price - b.price) ** 2 + (a.urgent - b.urgent) ** 2 + (a.mod - b.mod) ** 2) AS distance
         FROM cents a JOIN cents b ON b.year = a.year + 1)"""


def fixed_centroids(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("cluster"), (F.col("o_totalprice") / 1000).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 100.0).otherwise(0.0).alias("urgent"), (F.col("o_custkey") % 10).alias("mod"))
    return cl.centroids(rows, "year", "cluster", FEATURES)


@query("centroid_distances", "from_period:i to_period:i from_cluster:s to_cluster:s distance:d", "WITH" + CENTROID_SQL + """---
       SELECT from_year AS from_period, to_year AS to_period, from_cluster, to_cluster, distance FROM dist""")
def centroid_distances(spark, folder):
    return cl.centroid_distances(fixed_centroids(spark, folder), "year", "cluster", FEATURES, YEARS)


@query("cluster_match", "year:i cluster:s aligned_cluster_id:i match_type:s distance_to_previous:d aligned_cluster_label:s",
       "WITH RECURSIVE" + CENTROID_SQL + """,
       perm AS (SELECT f.to_year AS year, f.to_cluster AS tf, o.to_cluster AS t_o, p.to_cluster AS tp,
                       f.distance AS df, o.distance AS d_o, p.distance AS dp
                FROM dist f JOIN dist o USING (to_year) JOIN dist p USING (to_year)
                WHERE f.from_cluster = 'F' AND o.from_cluster = 'O' AND p.from_cluster = 'P'
                  AND f.to_cluster <> o.to_cluster AND o.to_cluster <> p.to_cluster AND f.to_cluster <> p.to_cluster),
       best AS (SELECT * FROM perm QUALIFY row_number() OVER (PARTITION BY year ORDER BY df + d_o + dp) = 1),
       pair AS (SELECT year, 'F' AS prev, tf AS cur, df AS d FROM best UNION ALL SELECT year, 'O', t_o, d_o FROM best
                UNION ALL SELECT year, 'P', tp, dp FROM best),
       chain AS (SELECT 1995 AS year, c AS cluster, i AS id, 'anchor' AS kind, 0.0::DOUBLE AS d
                 FROM (VALUES ('F', 0), ('O', 1), ('P', 2)) v(c, i)
                 UNION ALL SELECT pair.year, pair.cur, id, 'matched_to_previous', pair.d
                 FROM chain JOIN pair ON pair.year = chain.year + 1 AND pair.prev = chain.cluster)---
       SELECT year, cluster, id AS aligned_cluster_id, kind AS match_type, d AS distance_to_previous,
              'aligned_cluster_' || id AS aligned_cluster_label FROM chain""")
def cluster_match(spark, folder):
    return cl.align_clusters(stage(fixed_centroids(spark, folder)), "year", "cluster", FEATURES)


@query("centroid_profile", "year:i cluster:s entity_count:i price:d urgent:d", "WITH" + CENTROID_SQL + """---
       SELECT c.year, cluster, n AS entity_count, price, urgent FROM cents c
       JOIN (SELECT year(o_orderdate) AS year, o_orderstatus AS cluster, count(*) AS n FROM orders GROUP BY ALL) USING (year, cluster)""")
def centroid_profile(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("cluster"), (F.col("o_totalprice") / 1000).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 100.0).otherwise(0.0).alias("urgent"))
    return cl.cluster_profiles(rows, "year", "cluster", ["price", "urgent"])


@query("centroid_spread", "year:i metric:s centroid_range:d centroid_std:d", "WITH" + CENTROID_SQL + "---"
       + " UNION ALL ".join(f"SELECT year, '{m}' AS metric, max({m}) - min({m}) AS centroid_range, stddev_samp({m}) AS centroid_std "
                            f"FROM cents GROUP BY year" for m in FEATURES))
def centroid_spread(spark, folder):
    return cl.centroid_spread(fixed_centroids(spark, folder), "year", FEATURES)


# Fixed price bands stand for clusters, so paths and transitions have an exact answer.

LABEL_SQL = CELLS_SQL + """,
lab AS (SELECT area, year, spend, pct_open, CASE WHEN spend >= 600000 THEN 'high' WHEN spend >= 250000 THEN 'mid' ELSE 'low' END AS label
        FROM cells),
st AS (SELECT area FROM cells GROUP BY area HAVING count(DISTINCT year) >= 5),
mv AS (SELECT a.year AS from_year, b.year AS to_year, a.label AS from_cluster, b.label AS to_cluster
       FROM lab a JOIN lab b ON a.area = b.area AND b.year = a.year + 1 WHERE a.area IN (FROM st))"""


def labelled(spark, folder):
    band = F.when(F.col("spend") >= 600000, "high").when(F.col("spend") >= 250000, "mid").otherwise("low")
    return cells(spark, folder).withColumn("label", band)


def paths(spark, folder):
    rows = labelled(spark, folder)
    seen = cl.label_paths(rows, "area", "year", "label", YEARS)
    filled = sum((F.when(F.col(f"label_{y}").isNotNull(), 1).otherwise(0) for y in YEARS), F.lit(0))
    return seen.where(filled >= 5)


@query("path_wide", "area:i " + " ".join(f"label_{y}:s" for y in YEARS), "WITH" + LABEL_SQL + "---SELECT area, "
       + ", ".join(f"max(label) FILTER (year = {y}) AS label_{y}" for y in YEARS) + " FROM lab WHERE area IN (FROM st) GROUP BY area")
def path_wide(spark, folder):
    return paths(spark, folder)


@query("transition_edges", "from_year:i to_year:i from_cluster:s to_cluster:s entity_count:i", "WITH" + LABEL_SQL + """---
       SELECT *, count(*) AS entity_count FROM mv GROUP BY ALL""")
def transition_edges(spark, folder):
    return cl.transition_edges(paths(spark, folder), YEARS)


@query("transition_matrix", "from_year:i to_year:i from_cluster:s high:i low:i mid:i", "WITH" + LABEL_SQL + """---
       SELECT from_year, to_year, from_cluster, count(*) FILTER (to_cluster = 'high') AS high,
              count(*) FILTER (to_cluster = 'low') AS low, count(*) FILTER (to_cluster = 'mid') AS mid FROM mv GROUP BY ALL""")
def transition_matrix(spark, folder):
    return cl.transition_matrix(cl.transition_edges(paths(spark, folder), YEARS), ["high", "low", "mid"])


@query("transition_summary", "from_year:i to_year:i entities_compared:i stayed_same_count:i changed_count:i", "WITH" + LABEL_SQL + """---
       SELECT from_year, to_year, count(*) AS entities_compared, count(*) FILTER (from_cluster = to_cluster) AS stayed_same_count,
              count(*) FILTER (from_cluster <> to_cluster) AS changed_count FROM mv GROUP BY ALL""")
def transition_summary(spark, folder):
    return cl.transition_summary(cl.transition_edges(paths(spark, folder), YEARS))


@query("first_last", "stable_entity_count:i same_cluster:i changed_cluster:i change_rate_pct:d", "WITH" + LABEL_SQL + """,
       e AS (SELECT a.label AS l1, b.label AS l2 FROM lab a JOIN lab b ON a.area = b.area
             WHERE a.year = 1995 AND b.year = 2001 AND a.area IN (FROM st))---
       SELECT count(*) AS stable_entity_count, count(*) FILTER (l1 = l2) AS same_cluster,
              count(*) FILTER (l1 <> l2) AS changed_cluster, round(100.0 * count(*) FILTER (l1 <> l2) / count(*), 2) AS change_rate_pct
       FROM e""", digits=2)
def first_last(spark, folder):
    return cl.first_to_last(paths(spark, folder), YEARS)


@query("label_counts", "year:i label:s entity_count:i", "WITH" + LABEL_SQL + """---
       SELECT year, label, count(*) AS entity_count FROM lab GROUP BY ALL""")
def label_counts(spark, folder):
    return cl.label_counts(labelled(spark, folder), "year", "label")


@query("silhouette_by_year", "year:i silhouette:d row_count:i", "WITH" + LABEL_SQL + """,
       h AS (SELECT h, count(*) AS n FROM (SELECT label AS h FROM lab) GROUP BY 1),
       x AS (SELECT area, year, label, spend / 100000 AS a, pct_open / 100 AS b FROM lab),
       d AS (SELECT p.year, p.area, p.label, q.label AS other, sum((p.a - q.a) ** 2 + (p.b - q.b) ** 2) AS s, count(*) AS n
             FROM x p JOIN x q ON p.year = q.year GROUP BY ALL),
       ab AS (SELECT year, area, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a,
                     min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY ALL)---
       SELECT year, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette,
              count(*) AS row_count FROM ab GROUP BY year""")
def silhouette_by_year(spark, folder):
    rows = stage(labelled(spark, folder)).withColumns({"a": F.col("spend") / 100000, "b": F.col("pct_open") / 100})
    return cl.silhouette(rows, "year", ["a", "b"], "label").groupBy("year").agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("row_count"))


CLUSTER_METRICS = ["spend", "pct_open", "pct_urgent"]


@query("impute_and_scale", "area:i year:i pct_urgent:d s_pct_urgent:d s_spend:d", "WITH" + CELLS_SQL + """,
       f AS (SELECT area, year, spend, coalesce(pct_urgent, m) AS u FROM cells
             JOIN (SELECT year, quantile_cont(pct_urgent, 0.5) AS m FROM cells GROUP BY year) USING (year))---
       SELECT area, year, u AS pct_urgent, (u - avg(u) OVER w) / stddev_pop(u) OVER w AS s_pct_urgent,
              (spend - avg(spend) OVER w) / stddev_pop(spend) OVER w AS s_spend FROM f WINDOW w AS (PARTITION BY year)""")
def impute_and_scale(spark, folder):
    return cl.prepare(cells_staged(spark, folder), "year", CLUSTER_METRICS).select(
        "area", "year", "pct_urgent", "s_pct_urgent", "s_spend")


@query("kmeans_by_year", "year:i entity_count:i clusters_in_range:b not_nearest:i inertia_gap:d sizes_add_up:b", "WITH" + CELLS_SQL + """---
       SELECT year, count(*) AS entity_count, TRUE AS clusters_in_range, 0 AS not_nearest, 0.0 AS inertia_gap, TRUE AS sizes_add_up
       FROM cells GROUP BY year""", digits=4)
def kmeans_by_year(spark, folder):
    """What holds for every finished fit: all rows are assigned to their nearest mean and the inertia is their distance to it."""
    prepared = cl.prepare(cells_staged(spark, folder), "year", CLUSTER_METRICS)
    assigned, _, picks = cl.kmeans_by_period(prepared, "year", CLUSTER_METRICS)
    rows = stage(assigned.select("area", "year", "cluster_id", F.array(*[f"s_{m}" for m in CLUSTER_METRICS]).alias("x")))
    means = rows.groupBy("year", "cluster_id").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(CLUSTER_METRICS))]).alias("m"))
    means = means.groupBy(F.col("year").alias("_year")).agg(F.collect_list(F.struct("cluster_id", "m")).alias("all"))

    def gap(m):
        return F.aggregate(F.zip_with(m, "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    gaps = rows.join(means, F.col("year") == F.col("_year")).withColumns({
        "least": F.array_min(F.transform("all", lambda c: gap(c["m"]))), "k": F.size("all"),
        "own": gap(F.filter("all", lambda c: c["cluster_id"] == F.col("cluster_id"))[0]["m"])})
    found = gaps.groupBy("year").agg(F.count(F.lit(1)).alias("entity_count"), F.count_if(F.col("own") > F.col("least") + 1e-6).alias("not_nearest"),
                                     F.sum("own").alias("inertia_now"), F.max("k").alias("k"))
    return found.join(picks, "year").select(
        "year", "entity_count", (F.col("k") == F.col("selected_k")).alias("clusters_in_range"), "not_nearest",
        (F.abs(F.col("inertia_now") - F.col("inertia")) / F.col("inertia")).alias("inertia_gap"),
        (F.col("entity_count") == F.col("row_count")).alias("sizes_add_up"))


@query("pca_points", "year:i entity_count:i variance_1:d variance_2:d covariance:d", "WITH" + CELLS_SQL + """,
       f AS (SELECT year, spend, pct_open, coalesce(pct_urgent, m) AS u FROM cells
             JOIN (SELECT year, quantile_cont(pct_urgent, 0.5) AS m FROM cells GROUP BY year) USING (year)),
       c AS (SELECT year, count(*) AS n, corr(spend, pct_open) AS a, corr(spend, u) AS b, corr(pct_open, u) AS c FROM f GROUP BY year),
       p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c),
       e AS (SELECT *, 1 + 2 * p * cos(acos(a * b * c / p ** 3) / 3) AS high, 1 + 2 * p * cos(acos(a * b * c / p ** 3) / 3 + 2 * pi() / 3) AS low FROM p)---
       SELECT year, n AS entity_count, high AS variance_1, 3 - high - low AS variance_2, 0.0 AS covariance FROM e""", digits=5)
def pca_points(spark, folder):
    """Variances of the components are the largest eigenvalues of the correlations, which have a closed form for three metrics."""
    prepared = cl.prepare(cells_staged(spark, folder), "year", CLUSTER_METRICS)
    points = cl.pca_points(prepared, "year", CLUSTER_METRICS)
    return points.groupBy("year").agg(F.count(F.lit(1)).alias("entity_count"), F.var_pop("pc1").alias("variance_1"),
                                      F.var_pop("pc2").alias("variance_2"), F.covar_pop("pc1", "pc2").alias("covariance"))


# Supervised layer: train on the years to 2000, test on 2001, with the spend of a customer as target.

TRAIN, TEST = list(range(1995, 2001)), [2001]
ML_SQL = "WITH" + GROUPED_SQL + """,
t AS (SELECT g.*, CASE WHEN spend >= q THEN 1 ELSE 0 END AS high_risk
      FROM gcells g JOIN (SELECT year, quantile_cont(spend, 0.75) AS q FROM cells GROUP BY year) USING (year)),
grp AS (SELECT region, segment, avg(spend) AS m, avg(high_risk) AS p FROM t WHERE year <= 2000 GROUP BY ALL),
allr AS (SELECT avg(spend) AS m FROM t WHERE year <= 2000),
pred AS (SELECT area, year, 'group_mean' AS model, spend AS actual, high_risk, m AS predicted_target, p AS prob,
                CASE WHEN p >= 0.25 THEN 1 ELSE 0 END AS predicted_class
         FROM t JOIN grp USING (region, segment) WHERE year = 2001
         UNION ALL SELECT area, year, 'constant', spend, high_risk, (SELECT m FROM allr), 0.1, 0 FROM t WHERE year = 2001),
rp AS (SELECT *, actual - predicted_target AS residual FROM pred)"""


def targets(spark, folder):
    return ml.targets(stage(cells_with_groups(spark, folder)), "year", "spend")


def predictions(spark, folder):
    """Closed-form predictors, so the evaluation can be checked exactly."""
    train, test = ml.split(stage(targets(spark, folder)), "year", TRAIN, TEST, "spend")
    by_group = train.groupBy("region", "segment").agg(F.avg("spend").alias("predicted_target"), F.avg("high_risk").alias("p"))
    overall = train.agg(F.avg("spend").alias("m"))
    grouped = test.join(by_group, ["region", "segment"]).withColumn("model", F.lit("group_mean"))
    constant = test.withColumns({"predicted_target": overall.scalar(), "p": F.lit(0.1), "model": F.lit("constant")})
    both = grouped.select(*constant.columns).unionByName(constant)
    return both.select(
        "area", "year", "model", F.col("spend").alias("actual"), "predicted_target", "high_risk",
        F.col("p").alias("predicted_probability"),
        F.when((F.col("p") >= 0.25) & (F.col("model") == "group_mean"), 1).otherwise(0).alias("predicted_class"),
        (F.col("spend") - F.col("predicted_target")).alias("residual"))


@query("ml_targets", "year:i entity_count:i mean_target:d high_risk_count:i median_target:d", ML_SQL + """---
       SELECT year, count(DISTINCT area) AS entity_count, avg(spend) AS mean_target, sum(high_risk) AS high_risk_count,
              quantile_cont(spend, 0.5) AS median_target FROM t GROUP BY year""", digits=5)
def ml_targets(spark, folder):
    return ml.target_summary(targets(spark, folder), "year", "area", "spend")


@query("ml_split", "split:s row_count:i years:s", ML_SQL + """---
       SELECT CASE WHEN year <= 2000 THEN 'train' ELSE 'test' END AS split, count(pct_urgent) AS row_count,
              string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) AS years FROM t GROUP BY 1""")
def ml_split(spark, folder):
    return ml.split_summary(cells(spark, folder), "year", TRAIN, TEST, "pct_urgent")


@query("regression_metrics", "model:s row_count:i mae:d rmse:d r2:d", ML_SQL + """---
       SELECT model, count(*) AS row_count, avg(abs(residual)) AS mae, sqrt(avg(residual ** 2)) AS rmse,
              1 - sum(residual ** 2) / (var_pop(actual) * count(*)) AS r2 FROM rp GROUP BY model""", digits=5)
def regression_metrics(spark, folder):
    return ml.regression_metrics(predictions(spark, folder))


@query("classification_metrics", "model:s row_count:i accuracy:d precision:d recall:d f1:d roc_auc:d", ML_SQL + """,
       c AS (SELECT model, count(*) AS n, count(*) FILTER (high_risk = 1 AND predicted_class = 1) AS tp,
                    count(*) FILTER (high_risk = 0 AND predicted_class = 1) AS fp,
                    count(*) FILTER (high_risk = 1 AND predicted_class = 0) AS fn,
                    avg(CASE WHEN high_risk = predicted_class THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY model),
       auc AS (SELECT a.model, avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) AS roc_auc
               FROM pred a JOIN pred b ON a.model = b.model WHERE a.high_risk = 1 AND b.high_risk = 0 GROUP BY a.model)---
       SELECT c.model, n AS row_count, accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
              coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, roc_auc
       FROM c JOIN auc ON auc.model = c.model""")
def classification_metrics(spark, folder):
    return ml.classification_metrics(predictions(spark, folder), "high_risk")


@query("confusion_matrix", "model:s actual:i predicted_0:i predicted_1:i", ML_SQL + """---
       SELECT model, high_risk AS actual, count(*) FILTER (predicted_class = 0) AS predicted_0,
              count(*) FILTER (predicted_class = 1) AS predicted_1 FROM pred GROUP BY ALL""")
def confusion_matrix(spark, folder):
    return ml.confusion(predictions(spark, folder), "high_risk")


@query("error_summary", "model:s metric:s value:d", ML_SQL + """,
       e AS (SELECT model, avg(abs(residual)) AS mean_abs_error, quantile_cont(abs(residual), 0.5) AS median_abs_error,
                    max(abs(residual)) AS max_abs_error, count(*) FILTER (residual > 0)::DOUBLE AS positive_residual_count,
                    count(*) FILTER (residual < 0)::DOUBLE AS negative_residual_count FROM rp GROUP BY model)---
       SELECT model, metric, value FROM (UNPIVOT e ON mean_abs_error, median_abs_error, max_abs_error,
              positive_residual_count, negative_residual_count INTO NAME metric VALUE value)""", digits=5)
def error_summary(spark, folder):
    return ml.error_summary(predictions(spark, folder))


@query("worst_areas", "area:i residual:d side:s", ML_SQL + """,
       g AS (SELECT area, residual FROM rp WHERE model = 'group_mean')---
       SELECT area, residual, 'underpredicted' AS side FROM (FROM g ORDER BY residual DESC, area LIMIT 15)
       UNION ALL SELECT area, residual, 'overpredicted' FROM (FROM g ORDER BY residual, area LIMIT 15)""")
def worst_areas(spark, folder):
    rows = predictions(spark, folder).where("model = 'group_mean'").select("area", "residual")
    return ml.worst_areas(rows, ["area"])


ML_FEATURES = ["orders_total", "max_price", "pct_open", "pct_urgent"]
REGRESSORS, CLASSIFIERS = ("ridge", "random_forest", "gradient_boosting"), ("logistic_regression", "random_forest", "gradient_boosting")


def fitted_regression(spark, folder):
    train, test = ml.split(stage(targets(spark, folder)), "year", TRAIN, TEST, "spend")
    made, importance = ml.fit_regression(train, test, ML_FEATURES, "spend", ["area", "year"])
    return stage(made), importance


def _models_sql(names):
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") m(model)"


@query("fit_regression", "model:s row_count:i residual_gap:d error_gap:d beats_mean:b", ML_SQL + f"""---
       SELECT model, count(*) AS row_count, 0.0 AS residual_gap, 0.0 AS error_gap, TRUE AS beats_mean
       FROM t, {_models_sql(REGRESSORS)} WHERE year = 2001 GROUP BY model""", digits=5)
def fit_regression(spark, folder):
    """What holds for every fit: all test rows are predicted, residuals add up, metrics follow from them, the mean is beaten."""
    made, _ = fitted_regression(spark, folder)
    direct = made.groupBy("model").agg(
        F.max(F.abs(F.col("actual") - F.col("predicted_target") - F.col("residual"))).alias("residual_gap"),
        F.sqrt(F.avg(F.col("residual") ** 2)).alias("again"), F.stddev_pop("actual").alias("spread"))
    return ml.regression_metrics(made).join(direct, "model").select(
        "model", "row_count", "residual_gap", (F.abs(F.col("rmse") - F.col("again")) / F.col("rmse")).alias("error_gap"),
        (F.col("rmse") < F.col("spread")).alias("beats_mean"))


@query("fit_classification", "model:s row_count:i positives:i classes_fit:i shares_in_range:b better_than_chance:b", ML_SQL + f"""---
       SELECT model, count(*) AS row_count, sum(high_risk) AS positives, count(*) AS classes_fit, TRUE AS shares_in_range,
              TRUE AS better_than_chance
       FROM t, {_models_sql(CLASSIFIERS)} WHERE year = 2001 GROUP BY model""")
def fit_classification(spark, folder):
    """What holds for every fit: all test rows are predicted, a class is 1 where its probability says so, ranks beat chance."""
    train, test = ml.split(stage(targets(spark, folder)), "year", TRAIN, TEST, "spend")
    made = stage(ml.fit_classification(train, test, ML_FEATURES, "high_risk", ["area", "year"])[0])
    p = F.col("predicted_probability")
    fits = ((p > 0.5) == (F.col("predicted_class") == 1)) | (F.abs(p - 0.5) < 1e-9)
    direct = made.groupBy("model").agg(F.sum("actual").alias("positives"), F.count_if(fits).alias("classes_fit"),
                                       (F.min(p) >= 0).alias("_lo"), (F.max(p) <= 1).alias("_hi"))
    return ml.classification_metrics(made).join(direct, "model").select(
        "model", "row_count", "positives", "classes_fit", (F.col("_lo") & F.col("_hi")).alias("shares_in_range"),
        (F.col("roc_auc") > 0.5).alias("better_than_chance"))


@query("feature_importance", "model:s feature_count:i total:d smallest_is_negative:b", f"""---
       SELECT model, {len(ML_FEATURES)} AS feature_count, CASE WHEN model = 'ridge' THEN 0.0 ELSE 1.0 END AS total, FALSE AS smallest_is_negative
       FROM {_models_sql(REGRESSORS)}""")
def feature_importance(spark, folder):
    """Importances of trees add up to one; those of ridge are the sizes of its signed values."""
    importance = fitted_regression(spark, folder)[1]
    total = F.sum(F.when(F.col("signed_value").isNull(), F.col("importance")).otherwise(F.col("importance") - F.abs("signed_value")))
    return importance.groupBy("model").agg(F.count(F.lit(1)).alias("feature_count"), total.alias("total"),
                                           (F.min("importance") < 0).alias("smallest_is_negative"))


@query("ridge_predictions", "area:i year:i actual:d predicted_target:d residual:d", ML_SQL + """,
       tr AS (SELECT spend AS y, coalesce(pct_urgent, (SELECT quantile_cont(pct_urgent, 0.5) FROM t WHERE year <= 2000)) AS x
              FROM t WHERE year <= 2000),
       fit AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
                      sum((x - (SELECT avg(x) FROM tr)) / (SELECT stddev_pop(x) FROM tr) * (y - (SELECT avg(y) FROM tr)))
                        / (count(*) + 1.0) AS w FROM tr),
       te AS (SELECT area, year, spend, coalesce(pct_urgent, (SELECT quantile_cont(pct_urgent, 0.5) FROM t WHERE year <= 2000)) AS x
              FROM t WHERE year = 2001)---
       SELECT area, year, spend AS actual, my + w * (x - mx) / sx AS predicted_target, spend - (my + w * (x - mx) / sx) AS residual
       FROM te, fit""", digits=3)
def ridge_predictions(spark, folder):
    """Ridge on one median-filled, standardised feature, whose solution has a closed form."""
    train, test = ml.split(targets(spark, folder), "year", TRAIN, TEST, "spend")
    made, _ = ml.fit_regression(train, test, ["pct_urgent"], "spend", ["area", "year"], models=["ridge"])
    return made.drop("model")


@query("pca_two_metrics", "area:i year:i pc1:d pc2:d", "WITH" + CELLS_SQL + """,
       z AS (SELECT area, year, (spend - avg(spend) OVER w) / stddev_pop(spend) OVER w AS a,
                    (pct_open - avg(pct_open) OVER w) / stddev_pop(pct_open) OVER w AS b FROM cells WINDOW w AS (PARTITION BY year)),
       r AS (SELECT year, sign(corr(spend, pct_open)) AS s FROM cells GROUP BY year)---
       SELECT area, z.year, abs(a + s * b) / sqrt(2) AS pc1, abs(a - s * b) / sqrt(2) AS pc2 FROM z JOIN r ON r.year = z.year""")
def pca_two_metrics(spark, folder):
    """Components of two standardised metrics are their sum and difference; signs are free, so sizes are compared."""
    prepared = cl.prepare(cells_staged(spark, folder), "year", ["spend", "pct_open"])
    return cl.pca_points(prepared, "year", ["spend", "pct_open"]).select(
        "area", "year", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"))


@query("best_k", "year:i selected_k:i silhouette:d", "WITH" + CELLS_SQL + """,
       s AS (SELECT year, k, avg(CASE WHEN k = 2 THEN pct_open ELSE spend / 10000 END) AS score
             FROM cells, (VALUES (2), (3), (4)) v(k) GROUP BY ALL)---
       SELECT year, arg_min(k, (-score, k)) AS selected_k, max(score) AS silhouette FROM s GROUP BY year""", digits=5)
def best_k(spark, folder):
    """Choice among candidate scores with a tie: k 3 and 4 score the same."""
    scores = cells(spark, folder).groupBy("year").agg(
        F.avg("pct_open").alias("k2"), F.round(F.avg(F.col("spend") / 10000), 9).alias("k34"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("silhouette")) for k, c in ((2, "k2"), (3, "k34"), (4, "k34"))])
    return cl.choose_k(scores.select("year", F.inline(rows)), "year")
