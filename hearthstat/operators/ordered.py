"""Exact order statistics that never put a whole group into one task.

Quantiles are selected by counting: a pass counts values by range, for all groups at once, and the
next one looks only into the ranges that hold a wanted rank, until they are small. No group is
sorted or gathered. Ranks and running totals need every row's place: windows serve groups measured to be
small, larger ones are dealt by ranges of their values, every task holds a stretch of the order, and
per-stretch totals say where each stretch begins. Both ways give the same rows for numbers, NaN,
infinities, text, dates and decimals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.operators.scale import held, join_rows, join_small, stage

GROUP_ROWS = 500_000
BINS, FEW = 1024, 65_536


def group_sizes(df: DataFrame, groups: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and rows in all."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    biggest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return biggest or 0, total or 0


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add, per row, the sum of each expression over the rows that come before it in its group, 0 for the first.

    The rows are dealt by ranges of groups and order, sorted, and written with the number of their stretch, so the number
    of tasks and not the groups decides how much one task holds. Totals per stretch are a small table. NULL sorts last;
    rows equal in all order columns may change places.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*groups, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = df.withColumns({f"_s_{n}": c for n, c in sums.items()})
    cut = stage(flat.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    unbounded = W.unboundedPreceding
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(unbounded, -1)
    inside = W.partitionBy("_part", *groups).orderBy("_row").rowsBetween(unbounded, -1)
    totals = cut.groupBy(*groups, "_part").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(*groups, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    rows = cut.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)) for n in sums})
    joined = join_rows(rows, totals, [*groups, "_part"], "inner")
    return joined.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def _magnitude(v: Column) -> Column:
    """Number of the power of two that a value lies at, in the order of the values; NaN is the largest."""
    power = (F.floor(F.log2(F.abs(v))) + 2000).cast("long")  # from 926 to 3023 for finite values other than 0
    power = F.when(F.abs(v) == float("inf"), F.lit(4000)).otherwise(power)
    return F.when(F.isnan(v), F.lit(4001)).when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power)


def _holds_wanted(first: Column, many: Column, probs: Sequence[float]) -> Column:
    """Whether a stretch of ``many`` values from rank ``first``, of ``_total`` in all, holds a rank that a quantile stands on or between."""
    holds = F.lit(False)
    for p in dict.fromkeys(probs):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        holds = holds | ((F.ceil(place) >= first) & (F.floor(place) < first + many))
    return holds


def _ranges(counted: DataFrame, groups: Sequence[str], within: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The counted bins (_bin, _n, _lo, _hi) that hold a wanted rank, with the number of values ``_before`` them."""
    order = W.partitionBy(*groups, *within).orderBy("_bin")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_before", F.col("_base") + before)
    return held(placed.where(_holds_wanted(F.col("_before"), F.col("_n"), probs)).select(*groups, "_total", "_before", "_n", "_lo", "_hi"))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float], bins: int = BINS,
              few: int = FEW, count: str | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles of ``value`` per group; NULL values are skipped, NaN is the largest.

    ``count`` names a column that says how many times a row's value stands there, for tables that are value counts.

    The first pass counts values by power of two, for all groups and ranks together, with map-side combine. Ranges that
    hold a wanted rank go on: those of more than ``few`` values are cut into ``bins`` equal parts and counted again, on
    their own rows only, which are written once; at last the values of what is left are looked at one by one, at most
    ``few`` per range. So the input is read twice whatever its size, and a group of 10^10 rows takes two counts more than
    a small one, whatever its share of the rows. Groups that hold no value are absent from the result.
    """
    ranks = list(probs.values())
    times = (F.lit(1) if count is None else F.col(count)).cast("long").alias("_c")
    rows = df.select(*groups, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"), times).where("_v is not null")
    sums = [F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    counted = rows.groupBy(*groups, _magnitude(F.col("_v")).alias("_bin")).agg(*sums)
    total = F.sum("_n").over(W.partitionBy(*groups))
    found = _ranges(counted.withColumns({"_total": total, "_base": F.lit(0)}), groups, [], ranks)
    same, inside = F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_v").between(F.col("_lo"), F.col("_hi"))
    ranges = found.where(same | (F.col("_n") <= few))
    wide = found.where(~same & (F.col("_n") > few))
    first = True
    while not wide.isEmpty():
        if first:
            rows = stage(join_rows(rows, found.where(~same).select(*groups, "_lo", "_hi"), groups, "inner", inside).select(*groups, "_v", "_c"))
            first = False
        open_rows = join_rows(rows, wide.withColumnRenamed("_n", "_m"), groups, "inner", inside)
        part = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
        parts = open_rows.select(*groups, "_v", "_c", F.col("_before").alias("_base"), "_total", part.alias("_bin"))
        found = _ranges(parts.groupBy(*groups, "_base", "_total", "_bin").agg(*sums), groups, ["_base"], ranks)
        ranges = ranges.unionByName(found.where(same | (F.col("_n") <= few)))
        wide = found.where(~same & (F.col("_n") > few))

    some = join_rows(rows, ranges.where(~same), groups, "inner", inside)
    counts = some.repartition(*groups, "_before").groupBy(*groups, "_total", "_before", "_v").agg(F.sum("_c").alias("_n"))
    order = W.partitionBy(*groups, "_before").orderBy("_v")
    before = F.col("_before") + F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_first", before).where(_holds_wanted(F.col("_first"), F.col("_n"), ranks))
    alone = ranges.where(same).withColumns({"_v": F.col("_lo"), "_first": F.col("_before")})
    each = [*groups, "_total", F.struct("_first", "_n", "_v").alias("_e")]
    pieces = placed.select(*each).unionByName(alone.select(*each)).groupBy(*groups, "_total").agg(F.collect_list("_e").alias("_p"))

    def at(rank: Column) -> Column:
        return F.filter("_p", lambda e: (e["_first"] <= rank) & (rank < e["_first"] + e["_n"]))[0]["_v"]

    out = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise(between).alias(name))
    return pieces.select(*groups, *out)


def totals_below(df: DataFrame, groups: Sequence[str], value: str, sums: Mapping[str, Column],
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add, per row, the sum of each expression over the rows of its group with a smaller value.

    ``df`` holds one row per (group, value); aggregate first.
    """
    if group_sizes(df, groups)[0] > group_rows:
        return positions(df, groups, [value], sums)
    flat = df.withColumns({f"_s_{n}": c for n, c in sums.items()})
    w = W.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    out = flat.withColumns({n: F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)) for n in sums})
    return out.drop(*[f"_s_{n}" for n in sums])


def dense_ranks(df: DataFrame, groups: Sequence[str], value: str, up: str = "rank_asc", down: str = "rank_desc",
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Dense rank in both directions within each group; rows without a value are dropped."""
    rows = df.where(F.col(value).isNotNull())
    if group_sizes(rows, groups)[0] <= group_rows:
        w = W.partitionBy(*groups)
        return rows.withColumns({
            up: F.dense_rank().over(w.orderBy(F.col(value).asc())),
            down: F.dense_rank().over(w.orderBy(F.col(value).desc())),
        })
    values = rows.select(*groups, value).distinct()
    ranked = positions(values, groups, [value], {"_lower": F.lit(1)})
    size = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("_values"))
    ranked = join_small(ranked, size, groups).select(
        *groups, value,
        (F.col("_lower") + 1).cast("int").alias(up),
        (F.col("_values") - F.col("_lower")).cast("int").alias(down))
    return join_rows(rows, ranked, [*groups, value], "inner")


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_order") -> DataFrame:
    """First ``n`` rows per group in the given order, numbered from 1.

    The filter on ``row_number`` lets Spark keep only n rows per group and task before the shuffle,
    so a hot group never travels whole. ``order`` must end in a unique key.
    """
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def both_ends(df: DataFrame, groups: Sequence[str], value: str, key: Sequence[str], n: int, rank: str = "rank_order",
              tag: str = "_end", names: tuple[str, str] = ("high", "low")) -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows per group, numbered and tagged, from one scan; the key settles ties.

    Every row is offered once for each end, so both lists are one group limit per task before the shuffle.
    """
    ends = F.array(F.struct(F.lit(names[0]).alias("t"), F.lit(-1).alias("s")), F.struct(F.lit(names[1]).alias("t"), F.lit(1).alias("s")))
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.explode(ends))
    w = W.partitionBy(*groups, "_e").orderBy(F.col(value) * F.col("_e.s"), *[F.asc(k) for k in key])
    picked = rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
    return picked.withColumn(tag, F.col("_e.t")).drop("_e")
