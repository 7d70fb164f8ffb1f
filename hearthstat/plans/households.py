"""Survey microdata to weighted profiles and their validation (inventory D9-D13)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.functions.keys import areas_of_period
from hearthstat.operators import household as hh
from hearthstat.operators import profile as pf
from hearthstat.operators import thresholds as th
from hearthstat.operators.checks import Checks
from hearthstat.operators.scale import literal_table

# State, area codes of the study region by period, and the area only partly inside it.
STATE = 17
AREAS = {2019: (2100,), 2020: (2100,), 2021: (2100,), 2022: (1901, 1902), 2023: (1901, 1902)}
EXPERIMENTAL = (2020,)
FULL_AREAS, PART_AREA = [2100, 1901], 1902

# Share of the partly included area by period, where no crosswalk is given.
PART_SHARE = {2022: 0.218974, 2023: 0.214517}

# Control totals by period: households, below and above the threshold.
CONTROL_TOTALS = {
    2019: (81764, 36933, 44831), 2021: (84248, 37298, 46950), 2022: (84713, 39534, 45179), 2023: (89155, 39243, 49912),
}

HOUSEHOLD_KEY = ("year", "serialno")


def region_rows(df: DataFrame) -> DataFrame:
    """Microdata rows of the study region, all periods in one frame with a ``year`` column."""
    return areas_of_period(df.where(F.col("state") == STATE), "year", "puma", AREAS)


def household_profile(persons: DataFrame, housing: DataFrame) -> DataFrame:
    """Households with their person roll-up, keyed by (year, serialno)."""
    rows = hh.household_profile(region_rows(housing), region_rows(persons), HOUSEHOLD_KEY)
    return rows.withColumn("is_experimental", F.col("year").isin(list(EXPERIMENTAL)).cast("int"))


def period_weight(shares: Mapping[int, float] = PART_SHARE) -> Column:
    """Analysis weight with the share of the partly included area by period."""
    factor = F.coalesce(*[F.when(F.col("year") == y, F.lit(float(a))) for y, a in shares.items()], F.lit(None))
    return hh.analysis_weight("wgtp", "puma", FULL_AREAS, [PART_AREA], factor)


def thresholds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Back-filled and calibrated thresholds of all periods."""
    raw = th.backfilled(th.base_thresholds(spark))
    return raw, th.calibrated(raw)


def household_final(profile: DataFrame, calibrated: DataFrame, shares: Mapping[int, float] = PART_SHARE) -> DataFrame:
    """Analysis table of the regular periods."""
    return hh.household_final(profile.where("is_experimental = 0"), calibrated, period_weight(shares))


def below(final: DataFrame, nonstudent: bool = False) -> DataFrame:
    """Households below the threshold, optionally without student-heavy ones."""
    rows = final.where("below_flag = 1")
    return rows.where("coalesce(student_heavy_flag, 0) = 0") if nonstudent else rows


def profiles(final: DataFrame) -> dict[str, DataFrame]:
    """Both tidy profiles, their comparison and the county totals."""
    found = pf.survey_profiles(final)
    return {
        "complete_profile": found["complete"].withColumn("population_type", F.lit("complete_below")),
        "nonstudent_profile": found["nonstudent"].withColumn("population_type", F.lit("nonstudent_below")),
        "comparison": found["comparison"], "county_totals": found["county_totals"]}


def control_totals(spark: SparkSession) -> DataFrame:
    rows = [(year, *map(float, values)) for year, values in CONTROL_TOTALS.items()]
    return literal_table(spark, rows, "year int, target_total_households double, target_below_households double, "
                                      "target_above_households double")


def validation_checks(final: DataFrame, raw: DataFrame, calibrated: DataFrame) -> dict[str, DataFrame]:
    """The named checks of the final table, which is read once."""
    columns = ["analysis_weight", "hincp_adj_real", "hh_comp_key", "annual_threshold", "below_flag", "student_heavy_flag"]
    asked = Checks(final).rows("nulls", ["year"], **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in columns})
    asked.rows("totals", ["year"], **pf.below_sums())
    asked.rows("impact", ["year"], **pf.impact_counts(F.col("below_flag") == 1, F.coalesce("student_heavy_flag", F.lit(0)) == 0))
    asked.groups("thresholds", ["year", "hh_comp_key", "annual_threshold"])
    found = asked.run()
    totals = pf.balanced(found["totals"].drop("row_count"))
    measures = ["total_households", "below_households", "above_households"]
    return {
        "01_calibrated_threshold_match": pf.threshold_match(found["thresholds"], calibrated, rows="row_count"),
        "02_calibration_spot_check": th.spot_check(raw, calibrated),
        "03_final_table_null_check": found["nulls"],
        "04_balance_check": totals,
        "05_control_total_compare": pf.target_compare(totals, control_totals(final.sparkSession), ["year"], measures),
        "06_nonstudent_filter_impact": pf.impact_of(found["impact"].drop("row_count")),
    }


def validation_pack(final: DataFrame, raw: DataFrame, calibrated: DataFrame) -> DataFrame:
    """All checks in one sparse table."""
    return pf.validation_pack(validation_checks(final, raw, calibrated))
