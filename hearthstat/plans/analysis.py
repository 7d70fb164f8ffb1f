"""Exploration, change, clusters, allocation, final tables and models over a panel (inventory D15-D20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hearthstat.operators import allocate as al
from hearthstat.operators import cluster as cl
from hearthstat.operators import ml, panel, profile, ranking, standardize
from hearthstat.operators.scale import literal_table, stage
from hearthstat.plans.tracts import CLUSTER_METRICS, LABELS, METRIC_SHEET
from hearthstat.sources.io import PERIODS

ENTITY, PERIOD, STABLE = "tract_geoid", "year", "is_stable_all_4_years"

# Metrics of the rankings, of the change tables, and the period pairs compared.
RANKING_METRICS = (
    "median_household_income", "poverty_rate", "unemployment_rate", "pct_rent_burden_30_plus", "pct_rent_burden_50_plus",
    "pct_hh_income_under_25k", "pct_bachelors_or_higher", "pct_age_18_24", "pct_family_households",
)
CHANGE_PAIRS = ((2019, 2021), (2021, 2022), (2022, 2023), (2019, 2023))
FINAL_CHANGE_METRICS = ("estimated_households", "estimated_rate_proxy_pct", "poverty_rate", "median_household_income")

# Columns a model may not see because they are the target or follow from it, or are not comparable.
ML_EXCLUDED = ("pct_households_with_65_plus", "estimated_households", "estimated_rate_proxy_pct", "estimated_share_pct")
TRAIN_PERIODS, TEST_PERIOD = (2019, 2021, 2022), 2023


def eda(df: DataFrame, metrics: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Descriptive tables of a panel."""
    wanted = [m for m in (metrics or [name for name, _, _ in METRIC_SHEET]) if m in df.columns]
    ranked = [m for m in RANKING_METRICS if m in df.columns] or wanted
    long = df.select(ENTITY, PERIOD, *[F.col(m).cast("double").alias(m) for m in ranked]).unpivot(
        [ENTITY, PERIOD], ranked, "metric", "metric_value")
    return {
        "summary": profile.summary_stats(df, [PERIOD], wanted), "missing": profile.missingness(df, [PERIOD], wanted),
        "trend": profile.trend(df, PERIOD, wanted),
        "stable_vs_full": profile.stable_comparison(df, [PERIOD], F.col(STABLE) == 1, wanted),
        "correlation": profile.correlation_matrix(df, [], wanted),
        "correlation_by_year": profile.correlation_matrix(df, [PERIOD], wanted),
        "outliers": profile.iqr_outliers(df, [], wanted),
        "rankings": ranking.top_and_bottom(long, [PERIOD, "metric"], "metric_value", [ENTITY], 10),
        "ranks": ranking.metric_ranks(df, [ENTITY], PERIOD, ranked),
        "zscores": standardize.zscores(df, [], wanted).select(ENTITY, PERIOD, *[f"z_{m}" for m in wanted]),
        "entity_zscores": standardize.mean_zscores(df, ENTITY, wanted),
    }


def panel_change(df: DataFrame, metrics: Sequence[str], periods: Sequence[int] = PERIODS,
                 pairs: Sequence[tuple[int, int]] = CHANGE_PAIRS) -> dict[str, DataFrame]:
    """Change tables of the stable areas."""
    stable = stage(df.where(F.col(STABLE) == 1).select(ENTITY, PERIOD, *metrics))
    changes = stage(panel.pair_changes(stable, ENTITY, PERIOD, metrics, pairs))
    labels = literal_table(df.sparkSession, [(m, LABELS.get(m, m)) for m in metrics], "metric string, metric_label string")
    keys = ["start_year", "end_year", "metric"]
    return {
        "changes": changes.join(labels, "metric"), "summary": panel.change_summary(changes, keys),
        "movers": panel.movers(changes, keys, ENTITY),
        "wide": panel.consecutive_changes(stable, ENTITY, PERIOD, metrics, periods)}


def clusters(df: DataFrame, metrics: Sequence[str] | None = None, **options) -> dict[str, DataFrame]:
    """Clusters per period, aligned over the periods, with transitions of the stable areas."""
    wanted = [m for m in (metrics or CLUSTER_METRICS) if m in df.columns]
    scaled = [f"s_{m}" for m in wanted]
    periods = cl.period_list(df, PERIOD)
    base = stage(df.select(ENTITY, PERIOD, STABLE, *[F.col(m).cast("double").alias(m) for m in wanted]))
    assigned, diagnostics, picks = cl.kmeans_by_period(cl.prepare(base, PERIOD, wanted), PERIOD, wanted, **options)
    assigned = stage(assigned)
    cents = stage(cl.centroids(assigned, PERIOD, "cluster_id", scaled))
    mapping = cl.align_clusters(cents, PERIOD, "cluster_id", scaled)
    aligned = cl.apply_alignment(assigned, mapping, PERIOD, "cluster_id")
    labels = assigned.select(ENTITY, PERIOD, "cluster_id")
    paths = cl.label_paths(aligned.where(F.col(STABLE) == 1), ENTITY, PERIOD, "aligned_cluster_label", periods)
    edges = cl.transition_edges(paths, periods)
    return {
        "assignments": aligned, "diagnostics": diagnostics, "selected_k": picks, "centroids_scaled": cents,
        "centroids_original": cl.centroids(assigned, PERIOD, "cluster_id", wanted),
        "profiles": cl.cluster_profiles(base.join(labels, [ENTITY, PERIOD]), PERIOD, "cluster_id", wanted),
        "spread": cl.centroid_spread(cents, PERIOD, scaled), "mapping": mapping, "paths": paths, "edges": edges,
        "transition_summary": cl.transition_summary(edges), "first_to_last": cl.first_to_last(paths, periods),
        "counts": cl.label_counts(aligned, PERIOD, "aligned_cluster_label")}


def allocation(df: DataFrame, totals: DataFrame, capacity: str | None = "occupied_units",
               spec: Sequence[al.ScoreMetric] = al.HARDSHIP_SPEC) -> dict[str, DataFrame]:
    """Control totals of each period down to its areas, plain or capacity-adjusted."""
    proxy = "pct_age_18_24" if "pct_age_18_24" in df.columns else None
    estimates = stage(al.allocate_totals(df, totals, [PERIOD], spec, proxy, capacity))
    return {
        "estimates": estimates, "validation": al.allocation_check(estimates, [PERIOD], ENTITY),
        "rate_sanity": al.rate_sanity(estimates, [PERIOD]), "components": al.component_rows(estimates, [PERIOD, ENTITY], spec),
        "year_summary": al.year_summary(estimates)}


def final_outputs(estimates: DataFrame, geography: DataFrame, periods: Sequence[int] = PERIODS, n: int = 15) -> dict[str, DataFrame]:
    """Map-ready rows, top and bottom lists, group summaries and change of the estimates.

    Every estimate row is kept, also where the geography is missing.
    """
    extra = [c for c in geography.columns if c == ENTITY or c not in estimates.columns]
    flat = estimates.join(geography.select(*extra).dropDuplicates([ENTITY]), ENTITY, "left")
    label = [c for c in ("display_area_label", "tract_name_canonical", ENTITY) if c in flat.columns]
    flat = stage(flat.withColumn("display_area_label", F.coalesce(*[F.col(c).cast("string") for c in label])))
    lists = []
    for basis in ("estimated_households", "estimated_rate_proxy_pct"):
        rows = flat.select(ENTITY, PERIOD, "display_area_label", F.col(basis).alias("basis_value"))
        lists.append(ranking.top_and_bottom(rows, [PERIOD], "basis_value", [ENTITY], n).withColumn("rank_basis", F.lit(basis)))
    groups = [g for g in ("cluster_label", "area_type", "primary_place") if g in flat.columns]
    metrics = [m for m in FINAL_CHANGE_METRICS if m in flat.columns]
    means = [m for m in ("estimated_rate_proxy_pct", "poverty_rate") if m in flat.columns]
    stable = flat.where(F.coalesce(F.col(STABLE), F.lit(0)) == 1) if STABLE in flat.columns else flat
    changes = stage(panel.consecutive_changes(stable, ENTITY, PERIOD, metrics, periods))
    out = {
        "flat": flat, "top_bottom": lists[0].unionByName(lists[1]), "stable_changes": changes,
        "stable_change_summary": panel.change_summary(changes, ["metric"], "change_first_to_last"),
        "year_summary": al.year_summary(flat),
        "run_summary": profile.run_summary(flat, {
            "row_count": F.count(F.lit(1)), "distinct_tracts": F.countDistinct(ENTITY),
            "labels_filled": F.count("display_area_label")})}
    if groups:
        out["group_summary"] = profile.group_summaries(flat, PERIOD, groups, ENTITY, ["estimated_households"], means)
    return out


def ml_layer(df: DataFrame, target: str = "estimated_rate_proxy_pct", train: Sequence[int] = TRAIN_PERIODS,
             test: int = TEST_PERIOD, features: Sequence[str] | None = None, sheet: Sequence[tuple] = METRIC_SHEET, **options) -> dict[str, DataFrame]:
    """Targets, split, three regressions, three classifiers and their evaluation."""
    pool = ml.feature_pool(df.columns, features or [name for name, _, _ in sheet], (*ML_EXCLUDED, target))
    marked = stage(ml.targets(df.withColumn(target, F.col(target).cast("double")), PERIOD, target))
    train_rows, test_rows = ml.split(marked, PERIOD, train, [test], target)
    ids = [PERIOD, ENTITY]
    fitted, importance = ml.fit_regression(train_rows, test_rows, pool, target, ids, **options)
    classified, class_importance = ml.fit_classification(train_rows, test_rows, pool, "high_risk", ids, **options)
    fitted, classified = stage(fitted), stage(classified)
    scores = ml.regression_metrics(fitted)
    class_scores = ml.classification_metrics(classified)
    best = ml.best_model(scores, [F.asc("rmse"), F.asc("model")])
    best_class = ml.best_model(class_scores, [F.desc("f1"), F.desc("roc_auc"), F.asc("model")])
    chosen = fitted.where(F.col("model") == best)
    every = importance.unionByName(class_importance)
    return {
        "target_summary": ml.target_summary(marked, PERIOD, ENTITY, target),
        "split_summary": ml.split_summary(marked, PERIOD, train, [test], target), "regression_predictions": fitted,
        "regression_metrics": scores, "classification_predictions": classified, "classification_metrics": class_scores,
        "feature_importance": every, "top_regression_features": ml.top_features(every, best),
        "confusion": ml.confusion(classified.where(F.col("model") == best_class)), "error_summary": ml.error_summary(chosen),
        "worst_areas": ml.worst_areas(chosen, [ENTITY])}
