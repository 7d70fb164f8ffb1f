"""Targets, splits, models and their evaluation (inventory ML16-ML25)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.operators import forest as forests
from hearthstat.operators.ordered import quantiles, totals_below
from hearthstat.operators.ranking import worst_both_sides
from hearthstat.operators.reshape import rows_from, union_all
from hearthstat.operators.scale import join_small, literal_table, stage
from hearthstat.operators.standardize import quantile_flag

# Share that marks high risk, forest size and leaf size, boosting rounds, rate and depth.
HIGH_RISK_QUANTILE = 0.75
FOREST = {"numTrees": 400, "minInstancesPerNode": 2, "maxDepth": 30, "seed": 42}
LOGISTIC_ITER = 2000
BOOST = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42}


# Candidate metrics where no metric sheet is given.
FALLBACK_FEATURES = (
    "median_household_income", "poverty_rate", "unemployment_rate", "pct_rent_burden_30_plus", "pct_rent_burden_50_plus",
    "pct_hh_income_under_25k", "pct_hh_income_25k_50k", "pct_hh_income_100k_plus", "pct_bachelors_or_higher",
    "pct_less_than_high_school", "pct_renter_occupied", "pct_age_18_24", "pct_age_65_plus", "pct_family_households",
    "pct_one_person_households", "pct_households_with_own_children_under_18", "pct_households_with_60_plus",
)


def feature_pool(columns: Sequence[str], candidates: Sequence[str] = (), excluded: Sequence[str] = ()) -> list[str]:
    """Candidate metrics that exist and are not excluded, in candidate order (ML16); a fixed list where none are given."""
    return [c for c in candidates or FALLBACK_FEATURES if c in columns and c not in excluded]


def targets(df: DataFrame, period: str, target: str, out: str = "high_risk",
            prob: float = HIGH_RISK_QUANTILE) -> DataFrame:
    """Regression target plus the top-quartile flag of its period (ML17)."""
    return quantile_flag(df, [period], target, prob, out)


def target_summary(df: DataFrame, period: str, entity: str, target: str, flag: str = "high_risk") -> DataFrame:
    """Entities, mean and median target and flagged rows by period (ML17)."""
    stats = df.groupBy(period).agg(
        F.countDistinct(entity).alias("entity_count"), F.avg(target).alias("mean_target"), F.sum(flag).alias("high_risk_count"))
    return join_small(stats, quantiles(df, [period], target, {"median_target": 0.5}), [period])


def split(df: DataFrame, period: str, train: Sequence, test: Sequence, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the training and the test periods with a known target (ML18)."""
    known = df.where(F.col(target).isNotNull())
    return known.where(F.col(period).isin(list(train))), known.where(F.col(period).isin(list(test)))


def split_summary(df: DataFrame, period: str, train: Sequence, test: Sequence, target: str) -> DataFrame:
    """Rows and periods of each split in one scan (ML18)."""
    name = F.when(F.col(period).isin(list(train)), "train").when(F.col(period).isin(list(test)), "test")
    years = F.array_sort(F.collect_set(period))
    return df.where(F.col(target).isNotNull()).withColumn("split", name).where("split is not null").groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.array_join(F.transform(years, lambda y: y.cast("string")), ", ").alias("years"))


def _filled(train: DataFrame, other: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both splits with missing features filled by the exact training medians."""
    long = train.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "f", "v")
    medians = {r["f"]: r["m"] for r in quantiles(long, ["f"], "v", {"m": 0.5}).collect()}
    fill = {f: F.coalesce(F.col(f).cast("double"), F.lit(medians.get(f, 0.0))) for f in features}
    return train.withColumns(fill), other.withColumns(fill)


def _scaled(train: DataFrame, other: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both splits standardised by the training mean and population deviation."""
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    cols = {f: (F.col(f) - row[f"m_{f}"]) / (row[f"s_{f}"] or 1.0) for f in features}
    return train.withColumns(cols), other.withColumns(cols)


def _ridge(train: DataFrame, label: str, alpha: float) -> LinearRegression:
    # Penalty alpha on the sum of squares, expressed in the solver's units of label spread per row.
    n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return LinearRegression(elasticNetParam=0.0, regParam=alpha / n * (spread or 1.0), standardization=False, solver="normal")


def _binned(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, ids: Sequence[str]) -> tuple[list, DataFrame, DataFrame]:
    """Cuts of the training features, and both splits with label ``_y`` and bins ``_cell``; the test rows keep their ids."""
    cuts = forests.cut_points(train, features)
    assemble = VectorAssembler(inputCols=list(features), outputCol="_x")

    def rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        x = assemble.transform(df.withColumn("_y", F.col(label).cast("double"))).withColumn("_x", vector_to_array("_x"))
        return stage(forests.coded(x, "_x", cuts, keep))

    return cuts, rows(train, ["_y"]), rows(test, [*ids, "_y"])


def _boosted(estimator, rows: DataFrame, boost: Mapping, by_label: bool):
    """Boosted trees on bins. Rows of equal bins get the same prediction in every round, so they count as one of their number and
    mean label (per class where the loss is not squared); options that look at single rows keep them apart.
    """
    x = array_to_vector(F.col("_cell").cast("array<double>")).alias("_x")
    if set(boost) <= {"maxIter", "stepSize", "maxDepth", "seed"}:
        weight = F.count(F.lit(1)).cast("double").alias("_w")
        equal = rows.groupBy("_cell", "_y").agg(weight) if by_label else rows.groupBy("_cell").agg(weight, F.avg("_y").alias("_y"))
    else:
        equal = rows.withColumn("_w", F.lit(1.0))
    return estimator.setLabelCol("_y").setFeaturesCol("_x").setWeightCol("_w").fit(stage(equal.select("_y", "_w", "_cell")).select("_y", "_w", x)), x


def fit_regression(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, ids: Sequence[str],
                   models: Sequence[str] = ("ridge", "random_forest", "gradient_boosting"), alpha: float = 1.0,
                   forest: Mapping = FOREST, boost: Mapping = BOOST) -> tuple[DataFrame, DataFrame]:
    """Fit each model on the training periods; return (test predictions, feature importance) (ML19, ML20, ML24)."""
    train, test = _filled(train, test, features)
    train = stage(train)
    cuts, known, asked = _binned(train, test, features, label, ids) if set(models) - {"ridge"} else (None, None, None)
    predictions, importance = [], []
    for name in models:
        if name == "ridge":
            a, b = _scaled(train, test, features)
            estimator = _ridge(a, label, alpha).setLabelCol(label).setFeaturesCol("_x").setPredictionCol("predicted_target")
            assemble = VectorAssembler(inputCols=list(features), outputCol="_x")
            model = estimator.fit(assemble.transform(a))
            found = model.transform(assemble.transform(b)).withColumn("_y", F.col(label).cast("double"))
            values, trees = model.coefficients.toArray(), False
        elif name == "random_forest":
            by_cell, values = forests.fit(known, asked, cuts, len(features), **forest)
            found, trees = join_small(asked, by_cell.withColumnRenamed("value", "predicted_target"), ["_cell"]), True
        else:
            model, x = _boosted(GBTRegressor(**boost).setPredictionCol("predicted_target"), known, boost, False)
            found, values, trees = model.transform(asked.select("*", x)), model.featureImportances.toArray(), True
        predictions.append(found.select(
            *ids, F.col("_y").alias("actual"), F.lit(name).alias("model"), "predicted_target",
            (F.col("_y") - F.col("predicted_target")).alias("residual")))
        importance.append(_importance(values, trees, features, name, "regression", train))
    return union_all(predictions), union_all(importance)


def fit_classification(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, ids: Sequence[str],
                       models: Sequence[str] = ("logistic_regression", "random_forest", "gradient_boosting"),
                       forest: Mapping = FOREST, boost: Mapping = BOOST) -> tuple[DataFrame, DataFrame]:
    """Fit each classifier of a label that is 0 or 1; return (test predictions, feature importance) (ML21, ML22, ML24)."""
    train, test = _filled(train, test, features)
    train = stage(train.withColumn(label, F.col(label).cast("double")))
    cuts, known, asked = _binned(train, test, features, label, ids) if set(models) - {"logistic_regression"} else (None, None, None)
    predictions, importance = [], []
    for name in models:
        if name == "logistic_regression":
            a, b = _scaled(train, test, features)
            estimator = LogisticRegression(regParam=1.0 / max(a.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ITER)
            assemble = VectorAssembler(inputCols=list(features), outputCol="_x")
            model = estimator.setLabelCol(label).setFeaturesCol("_x").fit(assemble.transform(a))
            found = model.transform(assemble.transform(b)).withColumn("_y", F.col(label).cast("double"))
            values, trees = model.coefficients.toArray(), False
        elif name == "random_forest":
            by_cell, values = forests.fit(known, asked, cuts, math.ceil(math.sqrt(len(features))), **forest)
            p = F.col("value")
            found = join_small(asked, by_cell, ["_cell"]).withColumns({"prediction": (p > 0.5).cast("int"), "probability": F.array(1 - p, p)})
            trees = True
        else:
            model, x = _boosted(GBTClassifier(**boost), known, boost, True)
            found, values, trees = model.transform(asked.select("*", x)), model.featureImportances.toArray(), True
        probability = F.col("probability") if name == "random_forest" else vector_to_array("probability")
        predictions.append(found.select(
            *ids, F.col("_y").cast("int").alias("actual"), F.lit(name).alias("model"),
            F.col("prediction").cast("int").alias("predicted_class"), probability[1].alias("predicted_probability")))
        importance.append(_importance(values, trees, features, name, "classification", train))
    return union_all(predictions), union_all(importance)


def _importance(values: Sequence[float], trees: bool, features: Sequence[str], name: str, kind: str, df: DataFrame) -> DataFrame:
    """Tree importance, or absolute coefficient with its sign (ML24)."""
    rows = [(f, float(abs(v)), None if trees else float(v), kind, name) for f, v in zip(features, values)]
    return literal_table(
        df.sparkSession,
        rows, "feature string, importance double, signed_value double, model_type string, model string")


def regression_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted_target") -> DataFrame:
    """MAE, RMSE and R2 per model, best first (ML20)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    out = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))
    return out.orderBy("rmse", "model")


def confusion(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted_class") -> DataFrame:
    """2 x 2 table of actual against predicted classes per model (ML23)."""
    return predictions.groupBy("model", F.col(actual).alias("actual")).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"), F.count_if(F.col(predicted) == 1).alias("predicted_1"))


def roc_auc(predictions: DataFrame, actual: str = "actual", score: str = "predicted_probability", **limits: int) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half; exact at any size (ML22).

    Rows are counted per distinct score first, so equal scores never meet in a window.
    """
    per_score = predictions.groupBy("model", score).agg(
        F.count_if(F.col(actual) == 1).alias("_p"), F.count_if(F.col(actual) == 0).alias("_n"))
    ranked = totals_below(per_score, ["model"], score, {"_below": F.col("_n")}, **limits)
    return ranked.groupBy("model").agg(
        (F.sum(F.col("_p").cast("double") * (F.col("_below") + F.col("_n") / 2.0))
         / F.nullif(F.sum("_p").cast("double") * F.sum("_n").cast("double"), F.lit(0.0))).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted_class",
                           score: str = "predicted_probability") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and AUC per model, best first (ML22)."""
    a, p = F.col(actual), F.col(predicted)
    counts = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if((a == 1) & (p == 1)).alias("_tp"),
        F.count_if((a == 0) & (p == 1)).alias("_fp"), F.count_if((a == 1) & (p == 0)).alias("_fn"),
        F.avg(F.when(a == p, 1.0).otherwise(0.0)).alias("accuracy"))

    def share(num: Column, den: Column) -> Column:
        return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))

    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    out = counts.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
    out = join_small(out.drop("_tp", "_fp", "_fn"), roc_auc(predictions, actual, score), ["model"])
    return out.orderBy(F.desc("f1"), F.desc("roc_auc"), "model")


def error_summary(predictions: DataFrame) -> DataFrame:
    """Mean, median and largest absolute error and the residual signs per model (ML25)."""
    r = F.col("residual")
    stats = predictions.groupBy("model").agg(
        F.avg(F.abs(r)).alias("mean_abs_error"), F.max(F.abs(r)).alias("max_abs_error"),
        F.count_if(r > 0).cast("double").alias("positive_residual_count"),
        F.count_if(r < 0).cast("double").alias("negative_residual_count"))
    errors = predictions.withColumn("_e", F.abs(r))
    both = join_small(stats, quantiles(errors, ["model"], "_e", {"median_abs_error": 0.5}), ["model"])
    names = ["mean_abs_error", "median_abs_error", "max_abs_error", "positive_residual_count", "negative_residual_count"]
    return rows_from(both, ["model"], [{"metric": F.lit(n), "value": F.col(n)} for n in names])


def worst_areas(predictions: DataFrame, keys: Sequence[str], n: int = 15) -> DataFrame:
    """Most under- and overpredicted rows: a high residual means the model predicted too little (ML25)."""
    both = worst_both_sides(predictions, "residual", keys, n)
    named = F.when(F.col("side") == "highest", "underpredicted").otherwise("overpredicted")
    return both.withColumn("side", named)


def best_model(metrics: DataFrame, order: Sequence[Column]) -> str:
    """Name of the first model in the given order (ML23)."""
    return metrics.orderBy(*order).select("model").first()[0]


def top_features(importance: DataFrame, model: str, n: int = 15) -> DataFrame:
    """Most important features of one model (T4)."""
    return importance.where(F.col("model") == model).orderBy(F.desc("importance"), "feature").limit(n)
