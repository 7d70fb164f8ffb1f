"""Geographic key parsing (inventory P1-P4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.functions.expressions import as_column

# Prefix of a tract row in the raw tables, and the name pattern of a tract.
TRACT_PREFIX = "1400000US"
TRACT_NAME_PATTERN = r"Census Tract\s+([^,;]+)"


def is_tract_row(geo_id: Column | str) -> Column:
    return as_column(geo_id).startswith(TRACT_PREFIX)


def key_parts(geo_id: Column | str) -> list[Column]:
    """Area key and its state, county and tract parts."""
    key = F.replace(F.trim(as_column(geo_id)), F.lit(TRACT_PREFIX), F.lit(""))
    return [
        key.alias("tract_geoid"),
        F.substring(key, 1, 2).alias("statefp"),
        F.substring(key, 3, 3).alias("countyfp"),
        F.substring(key, 6, 6).alias("tractce"),
    ]


def tract_number(name: Column | str) -> Column:
    """Number inside the area name; both ',' and ';' end it."""
    found = F.trim(F.regexp_extract(as_column(name), TRACT_NAME_PATTERN, 1))
    return F.nullif(found, F.lit(""))


def name_part(name: Column | str, position: int) -> Column:
    """Part of 'tract, county, state' (or the ';' form) counted from 1, NULL if absent."""
    return F.trim(F.try_element_at(F.split(as_column(name), "[,;]"), F.lit(position)))


def areas_of_period(df: DataFrame, period: str, area: str, areas: Mapping[int, Sequence[int]]) -> DataFrame:
    """Rows whose area code belongs to the study region in that period."""
    keep = F.lit(False)
    for when, codes in areas.items():
        keep = keep | ((F.col(period) == F.lit(when)) & F.col(area).isin(list(codes)))
    return df.where(keep)
