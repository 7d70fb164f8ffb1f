"""Household survey: roll-up, thresholds, weighted profiles and the checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthstat.functions.expressions import flag
from hearthstat.operators import household as hh
from hearthstat.operators import profile as pf
from hearthstat.operators import thresholds as th
from hearthstat.operators.scale import join_small, literal_table, stage
from workload.base import (FINAL_SQL, PROFILE_SQL, UPLIFTS, final, final_thresholds, housing, profile, query,
                           raw_thresholds, table)

PROFILE_SPEC = (
    "serialno:i year:i puma:i wgtp:i np:i hincp:d noc:i person_count:i adult_count:i college_age_count:i "
    "student_enrolled_count:i likely_college_student_count:i employed_count:i reference_person_count:i "
    "reference_person_student_flag:i has_any_likely_college_student:i has_any_student:i has_any_college_age_person:i "
    "has_any_employed_person:i student_share_of_persons:d student_share_of_adults:d college_age_share_of_persons:d "
    "student_heavy_flag_rule_a:i student_heavy_flag_rule_b:i")


@query("household_profile", PROFILE_SPEC, "WITH" + PROFILE_SQL + "---SELECT * FROM prof")
def household_profile(spark, folder):
    return profile(spark, folder).drop("state", "adjinc")


@query("household_final",
       "serialno:i year:i analysis_weight:d hincp_adj_real:d student_heavy_flag:i hh_comp_key:s annual_threshold:d "
       "below_flag:i", FINAL_SQL + "---SELECT * FROM fin")
def household_final(spark, folder):
    return final(spark, folder).select(
        "serialno", "year", "analysis_weight", "hincp_adj_real", "student_heavy_flag", "hh_comp_key", "annual_threshold",
        "below_flag")


@query("below_threshold_by_year",
       "year:i total_households:d below_households:d above_households:d balance_check:d", FINAL_SQL + """---
       SELECT year, sum(analysis_weight) AS total_households,
              sum(CASE WHEN below_flag = 1 THEN analysis_weight ELSE 0 END) AS below_households,
              sum(CASE WHEN below_flag = 0 THEN analysis_weight ELSE 0 END) AS above_households,
              round(sum(analysis_weight) - sum(CASE WHEN below_flag IN (0, 1) THEN analysis_weight ELSE 0 END), 4)
                AS balance_check
       FROM fin GROUP BY year""")
def below_threshold_by_year(spark, folder):
    return pf.below_totals(final(spark, folder), ["year"])


def _shares(name, source, place):
    w = f"sum(CASE WHEN coalesce({source}, 0) = 1 THEN analysis_weight ELSE 0 END)"
    return (f"SELECT year, 'student_labor' AS metric_group, '{name}' AS metric_name, round({w}, 4) AS metric_value, "
            f"round(100.0 * {w} / sum(analysis_weight), 4) AS pct_of_households, {place} AS sort_order FROM pop GROUP BY year")


def _scalar(group, name, expression, place, share="NULL"):
    return (f"SELECT year, '{group}' AS metric_group, '{name}' AS metric_name, {expression} AS metric_value, "
            f"{share} AS pct_of_households, {place} AS sort_order FROM pop GROUP BY year")


def profile_sql(condition):
    """SQL of the tidy profile for the households that meet a condition."""
    def mean(x, d=4):
        return f"round(sum(analysis_weight * coalesce({x}, 0)) / nullif(sum(analysis_weight), 0), {d})"

    parts = [
        _scalar("overall", "weighted_households", "round(sum(analysis_weight), 4)", 10, "100.0"),
        _scalar("overall", "unweighted_records", "count(*)", 20),
        _scalar("overall", "weighted_avg_household_size", mean("coalesce(person_count, np)"), 30),
        _scalar("overall", "weighted_avg_adult_count", mean("adult_count"), 40),
        _scalar("overall", "weighted_avg_child_count", mean("noc"), 50),
        _scalar("income", "weighted_avg_real_income", mean("hincp_adj_real", 2), 60),
        _scalar("income", "median_real_income_unweighted", "round(quantile_cont(hincp_adj_real, 0.5), 2)", 70),
        _scalar("income", "weighted_avg_annual_threshold", mean("annual_threshold", 2), 80),
        _shares("share_student_heavy", "student_heavy_flag", 90),
        _shares("share_has_any_student", "has_any_student", 100),
        _shares("share_has_any_likely_college_student", "has_any_likely_college_student", 110),
        _shares("share_reference_person_student", "reference_person_student_flag", 120),
        _shares("share_has_any_employed_person", "has_any_employed_person", 130),
        """SELECT year, 'composition_hh_comp_key', hh_comp_key, round(sum(analysis_weight), 4),
                  round(100.0 * sum(analysis_weight) / max(total), 4),
                  200 + CASE hh_comp_key WHEN '1_adult_0_child' THEN 1 WHEN '1_adult_1_child' THEN 2
                    WHEN '1_adult_2plus_child' THEN 3 WHEN '2_adult_0_child' THEN 4 WHEN '2_adult_1_child' THEN 5
                    WHEN '2_adult_2plus_child' THEN 6 WHEN '3plus_adult_0_child' THEN 7
                    WHEN '3plus_adult_1plus_child' THEN 8 ELSE 9 END
           FROM pop JOIN (SELECT year, sum(analysis_weight) AS total FROM pop GROUP BY year) USING (year)
           GROUP BY year, hh_comp_key"""]
    body = " UNION ALL ".join(parts)
    return f"SELECT * FROM (WITH pop AS (SELECT * FROM fin WHERE {condition}) {body})"


STAT_SPEC = "year:i metric_group:s metric_name:s metric_value:d pct_of_households:d sort_order:i"


@query("stat_profile", STAT_SPEC, FINAL_SQL + "---" + profile_sql("below_flag = 1"), digits=2)
def stat_profile(spark, folder):
    return pf.stat_profile(final(spark, folder).where("below_flag = 1"), ["year"])


@query("profile_compare",
       "year:i metric_group:s metric_name:s complete_metric_value:d complete_pct_of_households:d "
       "nonstudent_metric_value:d nonstudent_pct_of_households:d value_diff:d pct_point_diff:d "
       "other_as_pct_of_base:d sort_order:i",
       FINAL_SQL + f""",
       c AS ({profile_sql("below_flag = 1")}), n AS ({profile_sql("below_flag = 1 AND student_heavy_flag = 0")})---
       SELECT coalesce(c.year, n.year) AS year, coalesce(c.metric_group, n.metric_group) AS metric_group,
              coalesce(c.metric_name, n.metric_name) AS metric_name,
              c.metric_value AS complete_metric_value, c.pct_of_households AS complete_pct_of_households,
              n.metric_value AS nonstudent_metric_value, n.pct_of_households AS nonstudent_pct_of_households,
              round(coalesce(n.metric_value, 0) - coalesce(c.metric_value, 0), 4) AS value_diff,
              round(coalesce(n.pct_of_households, 0) - coalesce(c.pct_of_households, 0), 4) AS pct_point_diff,
              round(100.0 * coalesce(n.metric_value, 0) / nullif(c.metric_value, 0), 4) AS other_as_pct_of_base,
              coalesce(c.sort_order, n.sort_order) AS sort_order
       FROM c FULL JOIN n ON c.year = n.year AND c.metric_group = n.metric_group AND c.metric_name = n.metric_name""",
       digits=2)
def profile_compare(spark, folder):
    return pf.survey_profiles(final(spark, folder))["comparison"]


@query("county_totals", "year:i source_variant:s below_households:d county_total_households:d below_rate_pct:d",
       FINAL_SQL + """, v AS (
         SELECT year, 'complete_calibrated' AS source_variant,
                sum(CASE WHEN below_flag = 1 THEN analysis_weight ELSE 0 END) AS b, sum(analysis_weight) AS t
         FROM fin GROUP BY year
         UNION ALL
         SELECT year, 'nonstudent_calibrated',
                sum(CASE WHEN below_flag = 1 AND student_heavy_flag = 0 THEN analysis_weight ELSE 0 END),
                sum(analysis_weight)
         FROM fin GROUP BY year)---
       SELECT year, source_variant, b AS below_households, t AS county_total_households,
              round(100.0 * b / t, 4) AS below_rate_pct FROM v""")
def county_totals(spark, folder):
    return pf.county_totals(final(spark, folder))


@query("weighted_composition",
       "year:i hh_comp_key:s records:i weighted_households:d pct_of_households:d sort_order:i", FINAL_SQL + """---
       SELECT year, hh_comp_key, count(*) AS records, sum(analysis_weight) AS weighted_households,
              round(100.0 * sum(analysis_weight) / sum(sum(analysis_weight)) OVER (PARTITION BY year), 4)
                AS pct_of_households,
              list_position(['1_adult_0_child', '1_adult_1_child', '1_adult_2plus_child', '2_adult_0_child',
                '2_adult_1_child', '2_adult_2plus_child', '3plus_adult_0_child', '3plus_adult_1plus_child', 'other'],
                hh_comp_key) AS sort_order
       FROM fin GROUP BY year, hh_comp_key""")
def weighted_composition(spark, folder):
    return pf.category_shares(final(spark, folder), ["year"], "hh_comp_key", "analysis_weight", hh.COMPOSITION_KEYS)


@query("thresholds_backfilled",
       "year:i hh_comp_key:s raw_threshold:d calibrated_threshold:d uplift:d households:i weighted_households:d",
       FINAL_SQL + """---
       SELECT year, hh_comp_key, raw_threshold, annual_threshold AS calibrated_threshold,
              annual_threshold - raw_threshold AS uplift, count(*) AS households,
              sum(analysis_weight) AS weighted_households
       FROM fin WHERE annual_threshold IS NOT NULL GROUP BY ALL""")
def thresholds_backfilled(spark, folder):
    both = th.spot_check(raw_thresholds(spark), final_thresholds(spark), hh.COMPOSITION_KEYS)
    counts = final(spark, folder).groupBy("year", "hh_comp_key").agg(
        F.count(F.lit(1)).alias("households"), F.sum("analysis_weight").alias("weighted_households"))
    return join_small(counts, both, ["year", "hh_comp_key"], "inner")


SCENARIOS = {
    "no_uplift": {}, "plus_25000": {y: 25000 for y in range(1995, 2002)},
    "early_years": {1995: 25000, 1996: 25000, 1997: 25000}, "chosen": UPLIFTS}


@query("threshold_scenarios", "year:i scenario:s below_total:d", FINAL_SQL + """,
       s(scenario, first_year, last_year, step) AS (VALUES ('no_uplift', 0, 0, 0), ('plus_25000', 1995, 2001, 25000),
         ('early_years', 1995, 1997, 25000), ('chosen', 1995, 1995, 25000), ('chosen', 1996, 1997, 37500)),
       step AS (SELECT DISTINCT f.year, n.scenario, coalesce(s.step, 0) AS step
                FROM (SELECT DISTINCT year FROM fin) f CROSS JOIN (SELECT DISTINCT scenario FROM s) n
                LEFT JOIN s ON s.scenario = n.scenario AND f.year BETWEEN first_year AND last_year)---
       SELECT year, scenario, sum(CASE WHEN hincp_adj_real < raw_threshold +
                CASE WHEN hh_comp_key IN ('1_adult_0_child', '2_adult_0_child') THEN step ELSE 0 END
                THEN analysis_weight ELSE 0 END) AS below_total
       FROM fin JOIN step USING (year) GROUP BY year, scenario""")
def threshold_scenarios(spark, folder):
    base = hh.with_threshold(final(spark, folder), raw_thresholds(spark))
    return th.scenario_totals(base, SCENARIOS)


@query("allocation_factor", "region:i part_households:d total_households:d factor:d", """---
       SELECT n_regionkey AS region, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 + o_custkey % 100 ELSE 0 END)
                AS part_households, sum(1 + o_custkey % 100) AS total_households,
              sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 + o_custkey % 100 ELSE 0 END)::DOUBLE
                / sum(1 + o_custkey % 100) AS factor
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def allocation_factor(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("state"), F.col("n_regionkey").alias("region"))
    rows = housing(spark, folder).withColumns({
        "in_part": flag(F.col("puma") == 1902), "households": F.col("wgtp").cast("double")})
    return hh.allocation_factor(rows.join(nation, "state"), ["region"], "in_part", "households")


@query("weight_audit", "year:i puma:i records:i raw_total:d adjusted_total:d ratio:d", FINAL_SQL + """---
       SELECT year, puma, count(*) AS records, sum(wgtp) AS raw_total, sum(analysis_weight) AS adjusted_total,
              sum(analysis_weight) / sum(wgtp) AS ratio FROM fin GROUP BY year, puma""")
def weight_audit(spark, folder):
    return pf.weight_audit(final(spark, folder), ["year", "puma"], "wgtp", "analysis_weight")


@query("flag_reconciliation", "year:i row_count:i stored_below:i recomputed_below:i mismatch_rows:i", FINAL_SQL + """---
       SELECT year, count(*) AS row_count, sum(below_flag) AS stored_below,
              sum(CASE WHEN hincp_adj_real < raw_threshold THEN 1 ELSE 0 END) AS recomputed_below,
              count(*) FILTER (below_flag IS DISTINCT FROM CASE WHEN hincp_adj_real < raw_threshold THEN 1 ELSE 0 END)
                AS mismatch_rows
       FROM fin GROUP BY year""")
def flag_reconciliation(spark, folder):
    stored = final(spark, folder).withColumnRenamed("below_flag", "stored_flag")
    raw = hh.with_threshold(stored, raw_thresholds(spark))
    return pf.flag_reconciliation(raw, ["year"], F.col("stored_flag"), hh.below_flag_raw())


@query("threshold_match", "year:i row_count:i threshold_mismatch_rows:i", FINAL_SQL + """---
       SELECT f.year, count(*) AS row_count,
              count(*) FILTER (f.annual_threshold IS NULL OR abs(f.annual_threshold - t.annual_threshold) > 0.01)
                AS threshold_mismatch_rows
       FROM fin f JOIN raw_thr t ON t.year = f.year AND t.hh_comp_key = f.hh_comp_key GROUP BY f.year""")
def threshold_match(spark, folder):
    return pf.threshold_match(final(spark, folder), raw_thresholds(spark))


@query("target_compare", "year:i measure:s actual_value:d target_value:d diff:d pct_diff:d", FINAL_SQL + """,
       a AS (SELECT year, sum(analysis_weight) AS total_households,
                    sum(CASE WHEN below_flag = 1 THEN analysis_weight ELSE 0 END) AS below_households
             FROM fin GROUP BY year),
       m AS (SELECT year, 'total_households' AS measure, total_households AS v, 1000.0 + 70000 AS t FROM a
             UNION ALL SELECT year, 'below_households', below_households, 500.0 + 30000 FROM a)---
       SELECT year, measure, round(v, 0) AS actual_value, t AS target_value, round(v - t, 0) AS diff,
              round(100.0 * (v - t) / t, 2) AS pct_diff FROM m""", digits=1)
def target_compare(spark, folder):
    actual = pf.below_totals(final(spark, folder), ["year"])
    targets = literal_table(spark, [(y, 71000.0, 30500.0) for y in range(1995, 2002)],
                                    "year int, target_total_households double, target_below_households double")
    return pf.target_compare(actual, targets, ["year"], ["total_households", "below_households"])


@query("filter_impact", "year:i before_total:d after_total:d removed:d pct_removed:d", FINAL_SQL + """---
       SELECT year, sum(CASE WHEN below_flag = 1 THEN analysis_weight ELSE 0 END) AS before_total,
              sum(CASE WHEN below_flag = 1 AND student_heavy_flag = 0 THEN analysis_weight ELSE 0 END) AS after_total,
              sum(CASE WHEN below_flag = 1 AND student_heavy_flag = 1 THEN analysis_weight ELSE 0 END) AS removed,
              round(100.0 * sum(CASE WHEN below_flag = 1 AND student_heavy_flag = 1 THEN analysis_weight ELSE 0 END)
                / sum(CASE WHEN below_flag = 1 THEN analysis_weight END), 2) AS pct_removed
       FROM fin GROUP BY year""", digits=2)
def filter_impact(spark, folder):
    return pf.filter_impact(final(spark, folder), ["year"], F.col("below_flag") == 1, F.col("student_heavy_flag") == 0)


@query("null_completeness", "year:i row_count:i null_hincp:i null_noc:i null_person_count:i null_student_share_of_adults:i",
       "WITH" + PROFILE_SQL + """---
       SELECT year, count(*) AS row_count, count(*) - count(hincp) AS null_hincp, count(*) - count(noc) AS null_noc,
              count(*) - count(person_count) AS null_person_count,
              count(*) - count(student_share_of_adults) AS null_student_share_of_adults
       FROM prof GROUP BY year""")
def null_completeness(spark, folder):
    return pf.null_counts(profile(spark, folder), ["year"], ["hincp", "noc", "person_count", "student_share_of_adults"])
