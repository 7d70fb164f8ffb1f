"""Area types, notes and labels, and the geography lookup (inventory P24-P27, D14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import area_label, first_rule, rule_note, tidy_place
from hearthstat.operators.scale import stage
from hearthstat.operators.spatial import area_centroid, locate, shapes, within

# Area types in order of priority, each with the least value of its two metrics.
AREA_TYPES = (
    ("Student-dense area", {"pct_age_18_24": 40, "pct_renter_occupied": 70}),
    ("Senior-heavy residential area", {"pct_age_65_plus": 18, "pct_senior_living_alone_households": 10}),
    ("Family-oriented residential area", {"pct_family_households": 55, "pct_households_with_own_children_under_18": 25}),
    ("Higher economic stress area", {"poverty_rate": 25, "pct_hh_income_under_25k": 30}),
    ("Higher-income residential area", {"pct_hh_income_100k_plus": 35, "pct_bachelors_or_higher": 50}),
)
DEFAULT_AREA_TYPE = "Mixed residential area"

# Phrases of the context note with the least value of their metric.
CONTEXT_PHRASES = (
    ("higher student concentration", {"pct_age_18_24": 40}),
    ("renter-heavy housing profile", {"pct_renter_occupied": 65}),
    ("higher poverty rate", {"poverty_rate": 25}),
    ("more very-low-income households", {"pct_hh_income_under_25k": 30}),
    ("more households with children", {"pct_households_with_own_children_under_18": 25}),
    ("older age profile", {"pct_age_65_plus": 18}),
)
DEFAULT_NOTE = "General tract context note not flagged by the current rule set."


def _rules(table: Sequence[tuple[str, Mapping[str, float]]], columns: Sequence[str]) -> list[tuple[Column, str]]:
    rules = []
    for text, limits in table:
        if all(m in columns for m in limits):
            test = F.lit(True)
            for metric, least in limits.items():
                test = test & (F.col(metric) >= least)
            rules.append((test, text))
    return rules


def with_context(df: DataFrame) -> DataFrame:
    """Area type, context note and display label from the metrics of an area."""
    typed = df.withColumns({
        "area_type": first_rule(_rules(AREA_TYPES, df.columns), DEFAULT_AREA_TYPE),
        "landmark_context_note": rule_note(_rules(CONTEXT_PHRASES, df.columns), DEFAULT_NOTE)})
    return typed.withColumn("display_area_label", area_label("primary_place", "tract_name_canonical", "area_type"))


def geography_lookup(dimension: DataFrame, context: DataFrame, tracts: DataFrame, places: DataFrame | None = None,
                     zips: DataFrame | None = None) -> DataFrame:
    """Area, centroid, place, zip, type, note and label of every tract.

    ``tracts``, ``places`` and ``zips`` are vertex rows (poly_id, ring, seq, x, y) in degrees; the
    poly_id is the tract key, the place name and the zip code.
    """
    measured = stage(area_centroid(shapes(tracts)).withColumnRenamed("poly_id", "tract_geoid"))
    points = measured.select("tract_geoid", F.col("centroid_lon").alias("x"), F.col("centroid_lat").alias("y"))
    out = dimension.join(measured, "tract_geoid").join(context, "tract_geoid", "left")
    if places is not None:
        near = locate(points, shapes(places), "tract_geoid")
        out = out.join(near.select("tract_geoid", tidy_place("poly_id").alias("primary_place")), "tract_geoid", "left")
    else:
        out = out.withColumn("primary_place", F.lit(None).cast("string"))
    if zips is not None:
        inside = within(points, shapes(zips)).groupBy("tract_geoid").agg(F.min("poly_id").alias("primary_zip"))
        out = out.join(inside, "tract_geoid", "left")
    else:
        out = out.withColumn("primary_zip", F.lit(None).cast("string"))
    return with_context(out)
