"""Persons to households: flags, roll-up, weights, thresholds (inventory P15-P21, A6, J4, J5, J7)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import first_rule, flag
from hearthstat.operators.scale import join_small

# The composition keys in report order, with their reading order 1-9.
COMPOSITION_KEYS = (
    "1_adult_0_child",
    "1_adult_1_child",
    "1_adult_2plus_child",
    "2_adult_0_child",
    "2_adult_1_child",
    "2_adult_2plus_child",
    "3plus_adult_0_child",
    "3plus_adult_1plus_child",
    "other",
)


def person_flags(persons: DataFrame) -> DataFrame:
    """Six 0/1 flags per person from age, schooling, relationship and employment codes."""
    college_age = F.col("agep").between(18, 24)
    enrolled = F.col("sch").isin(2, 3)
    return persons.withColumns({
        "is_adult": flag(F.col("agep") >= 18),
        "is_college_age": flag(college_age),
        "is_student_enrolled": flag(enrolled),
        "is_likely_college_student": flag(college_age & enrolled & F.col("schg").isin(15, 16)),
        "is_reference_person": flag(F.col("relshipp") == 20),
        "is_employed": flag(F.col("esr").isin(1, 2)),
    })


def roll_up(flags: DataFrame, keys: tuple[str, ...] = ("serialno",)) -> DataFrame:
    """One row per household: counts, any-flags, shares and the two student-heavy rules."""
    student_head = F.col("is_reference_person") * F.col("is_likely_college_student")
    counts = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("person_count"),
        F.sum("is_adult").alias("adult_count"),
        F.sum("is_college_age").alias("college_age_count"),
        F.sum("is_student_enrolled").alias("student_enrolled_count"),
        F.sum("is_likely_college_student").alias("likely_college_student_count"),
        F.sum("is_employed").alias("employed_count"),
        F.sum("is_reference_person").alias("reference_person_count"),
        F.max(student_head).alias("reference_person_student_flag"),
    )
    students = F.col("likely_college_student_count")
    per_person = students.cast("double") / F.col("person_count")
    per_adult = students.cast("double") / F.nullif(F.col("adult_count"), F.lit(0))
    return counts.withColumns({
        "has_any_likely_college_student": flag(students > 0),
        "has_any_student": flag(F.col("student_enrolled_count") > 0),
        "has_any_college_age_person": flag(F.col("college_age_count") > 0),
        "has_any_employed_person": flag(F.col("employed_count") > 0),
        "student_share_of_persons": per_person,
        "student_share_of_adults": per_adult,
        "college_age_share_of_persons": F.col("college_age_count").cast("double") / F.col("person_count"),
        "student_heavy_flag_rule_a": flag(
            (students > 0) & ((F.col("reference_person_student_flag") == 1) | (per_adult >= 0.5))),
        "student_heavy_flag_rule_b": flag((per_person >= 0.5) & (F.col("employed_count") == 0)),
    })


def household_profile(housing: DataFrame, persons: DataFrame, keys: tuple[str, ...] = ("serialno",)) -> DataFrame:
    """Every household with its person roll-up; households without persons stay, unmatched."""
    return housing.join(roll_up(person_flags(persons), keys), list(keys), "left")


def composition_key(adults: str = "adult_count", children: str = "noc") -> Column:
    """Household composition bucket (P16); no adults or unknown children give 'other'."""
    a, c = F.col(adults), F.col(children)
    names = iter(COMPOSITION_KEYS)
    rules = []
    for adult_test in (a == 1, a == 2):
        for child_test in (c == 0, c == 1, c >= 2):
            rules.append((adult_test & child_test, next(names)))
    for child_test in (c == 0, c >= 1):
        rules.append(((a >= 3) & child_test, next(names)))
    return first_rule(rules, next(names))


def in_universe(df: DataFrame) -> DataFrame:
    """Occupied households with persons and a known income."""
    return df.where("coalesce(np, 0) > 0 and coalesce(person_count, 0) > 0 and hincp is not null")


def analysis_weight(weight: str, area: str, full: list, partial: list, factor: Column | float) -> Column:
    """Survey weight in fully included areas, scaled weight in partly included ones, else NULL (P20)."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    w = F.col(weight).cast("double")
    return F.when(F.col(area).isin(full), w).when(F.col(area).isin(partial), w * factor)


def derive(df: DataFrame) -> DataFrame:
    """Real income, student-heavy flag and composition bucket."""
    return df.withColumns({
        "hincp_adj_real": F.col("hincp").cast("double") * F.col("adjinc").cast("double") / 1000000.0,
        "student_heavy_flag": F.coalesce("student_heavy_flag_rule_b", F.lit(0)),
        "hh_comp_key": composition_key(),
    })


def below_flag(income: str = "hincp_adj_real", threshold: str = "annual_threshold") -> Column:
    """1 below the threshold, 0 otherwise, NULL where the threshold is unknown."""
    return F.when(F.col(threshold).isNotNull(), flag(F.col(income) < F.col(threshold)))


def below_flag_raw(income: str = "hincp_adj_real", threshold: str = "annual_threshold") -> Column:
    """1 below the threshold, 0 otherwise, also where the threshold is unknown (P19, uncalibrated form)."""
    return flag(F.col(income) < F.col(threshold))


def with_threshold(df: DataFrame, thresholds: DataFrame, period: str = "year") -> DataFrame:
    """Attach the (period, composition) threshold and the below flag."""
    table = thresholds.select(period, "hh_comp_key", "annual_threshold")
    joined = join_small(df.drop("annual_threshold"), table, [period, "hh_comp_key"])
    return joined.withColumn("below_flag", below_flag())


def household_final(profile: DataFrame, thresholds: DataFrame, weight: Column, period: str = "year") -> DataFrame:
    """Universe, weight, derived columns, threshold and flag in one pass."""
    weighted = in_universe(profile).withColumn("analysis_weight", weight)
    return with_threshold(derive(weighted.where("analysis_weight is not null")), thresholds, period)


def allocation_factor(crosswalk: DataFrame, groups: list[str], part_flag: str, households: str) -> DataFrame:
    """Share of an area's households that lies in the study region."""
    part = F.sum(F.when(F.col(part_flag) == 1, F.col(households)).otherwise(0))
    total = F.sum(households)
    return crosswalk.groupBy(*groups).agg(
        part.alias("part_households"), total.alias("total_households"),
        (part / F.nullif(total, F.lit(0))).alias("factor"))


def update_from(df: DataFrame, source: DataFrame, on: list[str], columns: Mapping[str, str]) -> DataFrame:
    """Overwrite columns from a keyed table; rows without a match keep their old value."""
    marked = source.select(*on, F.lit(True).alias("_hit"), *[F.col(s).alias(f"_n_{t}") for t, s in columns.items()])
    joined = join_small(df, marked, on)
    kept = joined.withColumns({t: F.when(F.col("_hit"), F.col(f"_n_{t}")).otherwise(F.col(t)) for t in columns})
    return kept.drop("_hit", *[f"_n_{t}" for t in columns])
