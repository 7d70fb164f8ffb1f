"""Many checks of one table in one scan (inventory Q9, Q10, D6, D13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from hearthstat.operators.scale import stage


class Checks:
    """Collects what checks need of a table and gets all of it in one scan and one shuffle.

    A check asks for aggregates per group (``rows``) or for the groups of some keys with their sizes (``groups``). ``run``
    deals every row once to each different set of group columns, aggregates all sets together with map-side combine, and
    writes the outcome; each check is a part of it. All aggregates are kept for every set, so checks of hundreds of columns
    are better not put beside keys that are nearly unique.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._columns: dict[str, Column] = {}
        self._sets: list[tuple[str, ...]] = []
        self._aggregates: dict[str, Column] = {}
        self._wanted: dict[str, tuple[int, tuple[str, ...], dict[str, str]]] = {}

    def _set(self, by: Mapping[str, Column] | Sequence[str]) -> tuple[int, tuple[str, ...]]:
        named = dict(by) if isinstance(by, Mapping) else {c: F.col(f"`{c}`") for c in by}
        for c, expression in named.items():
            if c in self._columns and str(self._columns[c]) != str(expression):
                raise ValueError(f"group column {c} means two things")
            self._columns.setdefault(c, expression)
        names = tuple(sorted(named))
        if names not in self._sets:
            self._sets.append(names)
        return self._sets.index(names), tuple(named)

    def rows(self, name: str, by: Mapping[str, Column] | Sequence[str] = (), **aggregates: Column) -> Checks:
        """Ask for aggregates per group, beside ``row_count``. Without groups there is one row, also for an empty table."""
        if name in self._wanted:
            raise ValueError(f"check {name} is there already")
        which, order = self._set(by)
        self._wanted[name] = which, order, {}
        for alias, column in aggregates.items():
            inner = next((k for k, c in self._aggregates.items() if str(c) == str(column)), f"_a{len(self._aggregates)}")
            self._aggregates[inner] = column
            self._wanted[name][2][alias] = inner
        return self

    def groups(self, name: str, by: Mapping[str, Column] | Sequence[str]) -> Checks:
        """Ask for the different groups with their ``row_count``; NULL is a group."""
        return self.rows(name, by)

    def run(self) -> dict[str, DataFrame]:
        """One frame per check."""
        kinds = {c: self.df.select(e).schema[0].dataType for c, e in self._columns.items()}

        def part(i: int, names: tuple[str, ...]) -> Column:
            return F.struct(F.lit(i).alias("_set"), *[
                (e if c in names else F.lit(None).cast(kinds[c])).alias(f"_g_{c}") for c, e in self._columns.items()])

        dealt = self.df.withColumn("_e", F.explode(F.array(*[part(i, names) for i, names in enumerate(self._sets)])))
        groups = [F.col("_e._set").alias("_set"), *[F.col(f"_e.`_g_{c}`").alias(f"_g_{c}") for c in self._columns]]
        out = stage(dealt.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("_rows"), *[c.alias(inner) for inner, c in self._aggregates.items()]))
        found = {}
        for name, (which, order, aliases) in self._wanted.items():
            mine = out.where(F.col("_set") == which)
            values = {"row_count": "_rows", **aliases}
            if order:
                found[name] = mine.select(*[F.col(f"_g_{c}").alias(c) for c in order], *[F.col(i).alias(a) for a, i in values.items()])
                continue
            whole = [F.coalesce(F.max(i), F.lit(0)) if isinstance(out.schema[i].dataType, LongType) else F.max(i) for i in values.values()]
            found[name] = mine.agg(*[c.alias(a) for c, a in zip(whole, values)])
        return found


def excess(groups: DataFrame) -> DataFrame:
    """Groups that occur more than once and the excess rows, from groups with their sizes (Q4)."""
    more = F.col("row_count") > 1
    return groups.agg(F.count_if(more).alias("duplicate_groups"),
                      F.coalesce(F.sum(F.when(more, F.col("row_count") - 1)), F.lit(0)).alias("duplicate_rows"))
