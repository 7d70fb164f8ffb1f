"""Metrics declared as data: projection, lineage and audit (inventory P13, A40, A41, M13)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthstat.operators.scale import literal_table


@dataclass(frozen=True)
class Metric:
    """One metric: a Spark SQL expression over its source columns, with its lineage."""

    name: str
    category: str
    expression: str
    sources: tuple[str, ...]
    policy: str = "official"


def sql_pct(num: str, den: str) -> str:
    return f"case when {den} > 0 then round(100.0D * {num} / {den}, 2) end"


def sql_bundle(parts: Sequence[str], need_any: bool = False) -> str:
    total = "round(" + " + ".join(f"coalesce({p}, 0D)" for p in parts) + ", 2)"
    if not need_any:
        return total
    return f"case when coalesce({', '.join(parts)}) is not null then {total} end"


def project(df: DataFrame, specs: Sequence[Metric], keep: Sequence[str]) -> DataFrame:
    """One select list from the specs; stops when a source column is missing."""
    missing = {s.name: [c for c in s.sources if c not in df.columns] for s in specs}
    missing = {name: cols for name, cols in missing.items() if cols}
    if missing:
        raise ValueError(f"metrics with missing sources: {missing}")
    return df.select(*keep, *[F.expr(s.expression).alias(s.name) for s in specs])


TOKEN = re.compile(r"'(?:[^']|'')*'|`([^`]+)`|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]*|([A-Za-z_]\w*)(\s*\()?")
# Words of an expression that name no column.
WORDS = frozenset("and as between bigint boolean case cast date decimal distinct div double else end escape false float ilike in int integer is "
                  "like long not null or rlike string then timestamp true when".split())


def referenced(expression: str) -> list[str]:
    """Column names in a SQL expression, each once, in order: identifiers that are no keyword, function, number or text."""
    names = []
    for quoted, plain, call in TOKEN.findall(expression):
        name = quoted or ("" if call or plain.lower() in WORDS else plain)
        if name and name not in names:
            names.append(name)
    return names


def wrong_sources(specs: Sequence[Metric]) -> dict[str, tuple[list[str], list[str]]]:
    """Metrics whose declared sources differ from what their expression reads: (undeclared, unused) by name."""
    found = {}
    for s in specs:
        read = referenced(s.expression)
        undeclared, unused = [c for c in read if c not in s.sources], [c for c in s.sources if c not in read]
        if undeclared or unused:
            found[s.name] = (undeclared, unused)
    return found


def in_order(specs: Sequence[Metric]) -> list[list[Metric]]:
    """Metrics in layers such that each reads only columns and metrics of earlier layers; stops at a circle or a repeated name.

    A metric that bears the name of a column it reads itself is taken to read the column.
    """
    by_name = {s.name: s for s in specs}
    if len(by_name) < len(specs):
        raise ValueError("metric names repeat")
    needs = {s.name: {c for c in referenced(s.expression) if c in by_name and c != s.name} for s in specs}
    layers, done = [], set()
    while len(done) < len(specs):
        ready = [s for s in specs if s.name not in done and needs[s.name] <= done]
        if not ready:
            raise ValueError(f"metrics that read each other: {sorted(set(by_name) - done)}")
        layers.append(ready)
        done |= {s.name for s in ready}
    return layers


def base_reach(specs: Sequence[Metric]) -> dict[str, dict[str, int]]:
    """Base columns that each metric depends on, through all derived metrics, with the longest number of steps to each."""
    reach: dict[str, dict[str, int]] = {}
    for layer in in_order(specs):
        for s in layer:
            mine: dict[str, int] = {}
            for c in referenced(s.expression):
                for base, steps in (reach[c].items() if c in reach and c != s.name else [(c, 0)]):
                    mine[base] = max(mine.get(base, 0), steps + 1)
            reach[s.name] = mine
    return reach


def base_columns(specs: Sequence[Metric]) -> list[str]:
    """Every base column that some metric depends on, in order of first use."""
    return list(dict.fromkeys(c for columns in base_reach(specs).values() for c in columns))


def closed_lineage(spark: SparkSession, specs: Sequence[Metric]) -> DataFrame:
    """One row per metric and base column, over all derived metrics: steps between them, and whether read directly."""
    direct = {s.name: referenced(s.expression) for s in specs}
    policy = {s.name: s.policy for s in specs}
    rows = [(m, c, steps, c in direct[m], policy[m]) for m, columns in base_reach(specs).items() for c, steps in columns.items()]
    return literal_table(spark, rows, "metric string, column_name string, steps int, direct boolean, policy string")


def affected(specs: Sequence[Metric], column: str) -> list[str]:
    """Metrics that change when a base column does."""
    return [m for m, columns in base_reach(specs).items() if column in columns]


def project_all(df: DataFrame, specs: Sequence[Metric], keep: Sequence[str]) -> DataFrame:
    """Like ``project`` for specs that read each other: one select per layer, in any order of the specs."""
    out, names = df, list(keep)
    for layer in in_order(specs):
        out = project(out, layer, [*dict.fromkeys([*names, *[c for c in df.columns if c not in names]])])
        names += [s.name for s in layer]
    return out.select(*names)


def lineage(spark: SparkSession, specs: Sequence[Metric]) -> DataFrame:
    """One row per metric with its sources and policy."""
    rows = [(s.name, s.category, s.expression, ", ".join(s.sources), s.policy) for s in specs]
    return literal_table(spark, rows, "metric string, category string, expression string, sources string, policy string")


def inventory(df: DataFrame, sheet: DataFrame, name: str = "final_column_name") -> DataFrame:
    """Metric sheet with a flag whether the table carries the column."""
    return sheet.withColumn("exists_in_table", F.col(name).isin(df.columns))


def recomputed(df: DataFrame, specs: Sequence[Metric]) -> Mapping[str, tuple[Column, Column]]:
    """Stored and recomputed column of each metric the table already carries, for a formula audit."""
    return {s.name: (F.col(s.name), F.expr(s.expression)) for s in specs if s.name in df.columns}
