"""Clusters per period, their profiles, alignment and transitions (inventory J17, J18, ML1-ML15)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.operators.reshape import rows_from
from hearthstat.operators.scale import held, join_small, literal_table, stage
from hearthstat.operators.standardize import impute_median, winsorize, zscores

K_MIN, K_MAX = 2, 6
# Passes at most, and the squared shift of all centres, relative to the mean variance of the features, that ends a fit.
MAX_ITER, TOLERANCE = 300, 1e-4
SAMPLE_ROWS = 10_000
SHARE = 10


def period_list(df: DataFrame, period: str) -> list:
    """Sorted periods, the NULL period last; each is one model."""
    found = [r[0] for r in df.select(period).distinct().collect()]
    return sorted([p for p in found if p is not None]) + [None] * (None in found)


def k_values(n_rows: int, low: int = K_MIN, high: int = K_MAX) -> list[int]:
    """Cluster numbers worth trying for this many rows (ML2)."""
    return list(range(low, min(high, max(2, n_rows - 1)) + 1))


def prepare(df: DataFrame, period: str, metrics: Sequence[str], winsor: tuple[float, float] | None = None) -> DataFrame:
    """Median-filled and population-standardised features as ``s_<metric>`` (ML1)."""
    if winsor:
        df = winsorize(df, [period], metrics, *winsor)
    return zscores(impute_median(df, [period], metrics), [period], metrics, prefix="s_", population=True)


def _numbered(df: DataFrame, period: str, features: Sequence[str]) -> tuple[DataFrame, list]:
    """Rows with the number of their period and their features as one array, written once; and the periods."""
    periods = period_list(df, period)
    number = F.coalesce(*[F.when(F.col(period).eqNullSafe(F.lit(p)), F.lit(i)) for i, p in enumerate(periods)], F.lit(0))
    kept = stage(df.withColumns({"_p": number, "_x": F.array(*[F.col(f).cast("double") for f in features])}))
    return kept, periods


def _seeded(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres spread over a sample: each next one drawn by squared distance to the nearest so far."""
    chosen = [points[rng.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = gap.sum()
        at = rng.choice(len(points), p=gap / total) if total > 0 else rng.integers(len(points))
        chosen.append(points[at])
        gap = np.minimum(gap, ((points - points[at]) ** 2).sum(1))
    return np.array(chosen)


def _sums(points: np.ndarray, fits: list[np.ndarray]) -> list[np.ndarray]:
    """Per fit and centre: the sum of the points nearest to it, their number, squared distances and squared lengths.

    Points lie in columns. One matrix product gives the distances to the centres of all fits.
    """
    every = np.concatenate(fits)
    gaps = (every * every).sum(1)[:, None] - 2 * (every @ points)
    long = (points * points).sum(0)
    out, first = [], 0
    for centres in fits:
        k = len(centres)
        mine = gaps[first:first + k]
        first += k
        near = mine.argmin(0)
        left = np.maximum(mine[near, np.arange(len(near))] + long, 0.0)
        out.append(np.column_stack([np.bincount(near, c, k)[:k] for c in (*points, None, left, long)]))
    return out


def _settled(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres that stand still on the given points.

    Every point keeps an upper bound of the distance to its centre and a lower bound of that to any other one, moved on by
    how far the centres went. By the triangle inequality only points whose bounds cross can change, and only they are
    measured again and moved between the sums.
    """
    def gaps(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0.0))

    def two(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near, at = d.argmin(1), np.arange(len(d))
        best = d[at, near]
        d[at, near] = np.inf
        return near, best, d.min(1)

    def added(near: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(near, c, k)[:k] for c in (*x.T, None)])

    k = len(centres)
    label, upper, lower = two(gaps(points))
    sums = added(label, points)
    for turn in range(1, MAX_ITER + 1):
        new = _moved(centres, sums)
        shift = np.sqrt(((new - centres) ** 2).sum(1))
        centres = new
        if not shift.any():
            break
        upper += shift[label]
        lower -= shift.max()
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        bound = np.maximum(lower, apart.min(1)[label] / 2)
        some = np.flatnonzero(upper * (1 + 1e-9) >= bound)
        if len(some):
            near, best, second = two(gaps(points[some]))
            other = near != label[some]
            moved = some[other]
            sums += added(near[other], points[moved]) - added(label[moved], points[moved])
            label[some], upper[some], lower[some] = near, best, second
        if turn % 16 == 0:
            sums = added(label, points)
    return centres


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The means of what is nearest to each centre; a centre without points stays."""
    size, count = centres.shape[1], sums[:, centres.shape[1]:centres.shape[1] + 1]
    return np.where(count > 0, sums[:, :size] / np.maximum(count, 1), centres)


def _on_samples(rows: DataFrame, wanted: dict[int, list[int]], restarts: int, seed: int, size: int) -> dict[tuple, np.ndarray]:
    """Centres of every (period, k, restart), settled on a bounded sample of the period's rows.

    The sample is a fixed number of rows per period by hash; its fits run in tasks, a few restarts each. Fits that settle
    on the same centres are one from here on.
    """
    order = W.partitionBy("_p").orderBy(F.xxhash64("_x", F.lit(seed)), "_x")
    drawn = rows.select("_p", "_x").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE_ROWS)
    sample = drawn.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("_r", "_x")))["_x"].alias("xs"))
    jobs = [(p, k, a, min(a + SHARE, restarts)) for p in wanted for k in wanted[p] for a in range(0, restarts, SHARE)]
    listed = literal_table(rows.sparkSession, jobs, "p int, k int, a int, b int")
    work = listed.join(sample, F.col("p") == F.col("_p")).select("p", "k", "a", "b", "xs").repartition(max(1, len(jobs)), "p", "k", "a")

    def settle(batches):
        for batch in batches:
            p, k, a, b = (batch.column(c).to_pylist() for c in ("p", "k", "a", "b"))
            for j in range(batch.num_rows):
                points = batch.column("xs")[j].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                fits = [_settled(points, _seeded(points, k[j], np.random.default_rng([seed, p[j], k[j], i]))) for i in range(a[j], b[j])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[j]] * len(fits), pa.int32()), pa.array([k[j]] * len(fits), pa.int32()), pa.array(range(a[j], b[j]), pa.int32()),
                     pa.array([f.ravel() for f in fits], pa.list_(pa.float64()))], ["p", "k", "i", "c"])

    found, seen = {}, set()
    for r in sorted(work.mapInArrow(settle, "p int, k int, i int, c array<double>").collect(), key=lambda r: r[:3]):  # one row per fit
        centres = np.array(r.c).reshape(-1, size)
        centres = centres[np.lexsort(centres.T[::-1])]
        mark = (r.p, r.k, np.round(centres, 9).tobytes())
        if mark not in seen:
            seen.add(mark)
            found[r.p, r.k, r.i] = centres
    return found


def _lloyd(rows: DataFrame, centres: dict[tuple, np.ndarray], size: int, least: dict[int, float]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Run all fits, keyed (period number, k, restart), side by side: one pass over the rows moves every centre.

    A task adds up what it holds for each centre, so only sums by centre are shuffled. A fit is done when the squared shift
    of its centres is at most ``least`` of its period, or after ``MAX_ITER`` passes. Returns centres and sums.
    """
    done: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    open_fits, turn = dict(centres), 0
    while open_fits:
        names = list(open_fits)
        by_period: dict[int, list[int]] = {}
        for n, key in enumerate(names):
            by_period.setdefault(key[0], []).append(n)
        current = [open_fits[key] for key in names]

        def add(batches):
            sums = [np.zeros((len(c), size + 3)) for c in current]
            for batch in batches:
                period = batch.column("_p").to_numpy()
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                for p in np.unique(period).tolist():
                    if mine := by_period.get(p):
                        for n, part in zip(mine, _sums(np.ascontiguousarray(x[period == p].T), [current[n] for n in mine])):
                            sums[n] += part
            flat = np.concatenate(sums)
            fit = np.repeat(np.arange(len(sums)), [len(s) for s in sums])
            cell = np.concatenate([np.arange(len(s)) for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(cell), *[pa.array(flat[:, i]) for i in range(size + 3)]],
                                             ["fit", "cell", *[f"s{i}" for i in range(size + 3)]])

        schema = "fit long, cell long, " + ", ".join(f"s{i} double" for i in range(size + 3))
        added = rows.select("_p", "_x").mapInArrow(add, schema).groupBy("fit", "cell").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(size + 3)])
        totals = [np.zeros((len(c), size + 3)) for c in current]
        for r in added.collect():  # one row per centre
            totals[r[0]][r[1]] = r[2:]
        turn += 1
        for n, key in enumerate(names):
            new = _moved(current[n], totals[n])
            if ((new - current[n]) ** 2).sum() <= least[key[0]] or turn > MAX_ITER:
                done[key] = (current[n], totals[n])
                del open_fits[key]
            else:
                open_fits[key] = new
    return done


def _mean_silhouettes(rows: DataFrame, fits: dict[tuple[int, int], np.ndarray], size: int) -> dict[tuple[int, int], float]:
    """Mean silhouette by squared distance of each (period, k) from the sums of its clusters, all in one pass."""
    keys = list(fits)
    by_period: dict[int, list[int]] = {}
    for n, (p, _) in enumerate(keys):
        by_period.setdefault(p, []).append(n)
    count = [fits[key][:, size] for key in keys]
    mean = [fits[key][:, :size] / np.maximum(fits[key][:, size:size + 1], 1) for key in keys]
    norm = [fits[key][:, size + 2] / np.maximum(fits[key][:, size], 1) for key in keys]

    def score(batches):
        total = np.zeros((len(keys), 2))
        for batch in batches:
            period = batch.column("_p").to_numpy()
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for p in np.unique(period).tolist():
                part = x[period == p]
                long, at = (part * part).sum(1), np.arange(len(part))
                for n in by_period.get(p, []):
                    dots = part @ mean[n].T
                    near = ((mean[n] * mean[n]).sum(1) - 2 * dots + np.where(count[n] > 0, 0, np.inf)).argmin(1)
                    apart = np.maximum(long[:, None] - 2 * dots + norm[n], 0.0)
                    own = count[n][near]
                    a = apart[at, near] * own / np.maximum(own - 1, 1)
                    apart[:, count[n] == 0] = np.inf
                    apart[at, near] = np.inf
                    b = apart.min(1)
                    top = np.maximum(a, b)
                    value = np.where((own > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where((top > 0) & np.isfinite(top), top, 1.0), 0.0)
                    total[n] += value.sum(), len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["fit", "s", "n"])

    found = rows.select("_p", "_x").mapInArrow(score, "fit long, s double, n double").groupBy("fit").agg((F.sum("s") / F.sum("n")).alias("v"))
    return {keys[r.fit]: r.v for r in found.collect()}  # one row per period and k


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray], size: int) -> DataFrame:
    """Rows with the nearest centre of their period as ``cluster_id``; ties go to the smaller id."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres[p]]) for p in sorted(centres)])
    own = F.get(tables, F.col("_p"))
    gaps = F.transform(own, lambda c: F.aggregate(F.zip_with(c, F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return rows.withColumn("_g", gaps).withColumn("cluster_id", (F.array_position("_g", F.array_min("_g")) - 1).cast("int")).drop("_g")


def kmeans_by_period(prepared: DataFrame, period: str, metrics: Sequence[str], ks: Sequence[int] | None = None,
                     restarts: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best of several k-means fits per period and k (ML3-ML5).

    Every restart settles on a bounded sample of its period first, then on all rows, where all fits share their passes
    (``_lloyd``) and stop at ``TOLERANCE`` of the features' mean variance; the best of each period and k goes on until its
    centres stand still, so that every row is at its nearest mean. On the sample, bounds by the triangle inequality are
    kept between the steps; on all rows they are not: they would be numbers for each row and fit, to be written and read
    with every pass, where the distances are one matrix product.
    Rows of the NULL period are a period of their own. Returns (assignments of the chosen k, diagnostics per k, chosen k
    per period).
    """
    features = [f"s_{m}" for m in metrics]
    rows, periods = _numbered(prepared, period, features)
    spread = sum((F.var_pop(F.col("_x")[i]) for i in range(len(features))), F.lit(0.0)) / len(features)
    known = rows.groupBy("_p").agg(F.count(F.lit(1)), spread).collect()  # one row per period
    sizes, least = {r[0]: r[1] for r in known}, {r[0]: TOLERANCE * (r[2] or 0.0) for r in known}
    wanted = {p: list(ks or k_values(sizes[p])) for p in range(len(periods)) if p in sizes}
    fitted = _lloyd(rows, _on_samples(rows, wanted, restarts, seed, len(features)), len(features), least)
    inertia = len(features) + 1

    def total(key: tuple) -> float:
        return float(fitted[key][1][:, inertia].sum())

    firsts = {(p, k): min((key for key in fitted if key[:2] == (p, k)), key=lambda key: (total(key), key)) for p in wanted for k in wanted[p]}
    final = _lloyd(rows, {key: _moved(*fitted[key]) for key in firsts.values()}, len(features), {p: 1e-20 for p in wanted})
    best = {(p, k): (final[key][0], float(final[key][1][:, inertia].sum())) for (p, k), key in firsts.items()}
    scores = _mean_silhouettes(rows, {pk: final[key][1] for pk, key in firsts.items()}, len(features))
    chosen = {p: min(wanted[p], key=lambda k: (-scores[p, k], k)) for p in wanted}
    spark, kind = prepared.sparkSession, prepared.schema[period].dataType.simpleString()
    diagnostics = literal_table(spark, [(periods[p], k, best[p, k][1], scores[p, k]) for p, k in sorted(best)],
                                f"{period} {kind}, k int, inertia double, silhouette double")
    picks = literal_table(spark, [(periods[p], k, sizes[p], best[p, k][1], scores[p, k]) for p, k in sorted(chosen.items())],
                          f"{period} {kind}, selected_k int, row_count long, inertia double, silhouette double")
    finals = {p: best[p, chosen[p]][0] if p in chosen else np.empty((0, len(features))) for p in range(len(periods))}
    assigned = _assigned(rows, finals, len(features)).drop("_p", "_x")
    return assigned.withColumn("cluster_label", cluster_label("cluster_id")), diagnostics, picks


def cluster_label(c: str, prefix: str = "cluster_") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def silhouette(df: DataFrame, period: str, features: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """Silhouette of every row within its period, by squared Euclidean distance.

    The mean distance to a cluster follows from its size, centroid and mean squared norm, so the cost is linear and no
    pairs are formed. Plain distances have no such form: they need all pairs, and are not offered.
    """
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    stats = df.groupBy(period, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in features]).alias("c"), F.avg(norm).alias("q"))
    table = stats.groupBy(period).agg(F.collect_list(F.struct(F.col(cluster).alias("id"), "n", "c", "q")).alias("_t"))
    own = df.withColumns({"_f": F.array(*features), "_q": norm})

    def mean_distance(t: Column) -> Column:
        dot = F.aggregate(F.zip_with(t["c"], F.col("_f"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.col("_q") - 2 * dot + t["q"], F.lit(0.0))

    joined = join_small(own, table, [period])
    mine = F.filter("_t", lambda t: t["id"] == F.col(cluster))[0]
    a = mean_distance(mine) * mine["n"] / (mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("_t", lambda t: t["id"] != F.col(cluster)), mean_distance))
    top = F.greatest(F.col("_a"), F.col("_b"))
    scored = joined.withColumns({"_one": mine["n"] == 1, "_b": b}).withColumn("_a", F.when(~F.col("_one"), a))
    value = F.when(F.col("_one") | (top == 0), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / top)
    return scored.withColumn("silhouette", value).drop("_t", "_f", "_q", "_a", "_b", "_one")


def choose_k(diagnostics: DataFrame, period: str) -> DataFrame:
    """Highest silhouette per period, ties to the smaller k (ML4)."""
    best = F.max(F.struct("silhouette", (-F.col("k")).alias("m"))).alias("b")
    return diagnostics.groupBy(period).agg(best).select(
        period, (-F.col("b.m")).alias("selected_k"), F.col("b.silhouette").alias("silhouette"))


def centroids(df: DataFrame, period: str, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean of each feature by cluster; scaled or original, as the columns given are (ML6)."""
    return df.groupBy(period, cluster).agg(*[F.avg(f).alias(f) for f in features])


def cluster_profiles(df: DataFrame, period: str, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Cluster size and mean of the unfilled metrics (ML7)."""
    return df.groupBy(period, cluster).agg(
        F.count(F.lit(1)).alias("entity_count"), *[F.avg(m).alias(m) for m in metrics])


def centroid_spread(cents: DataFrame, period: str, features: Sequence[str]) -> DataFrame:
    """Range and sample deviation of the centroids per metric (ML9)."""
    wide = cents.groupBy(period).agg(
        *[(F.max(f) - F.min(f)).alias(f"_r_{f}") for f in features], *[F.stddev_samp(f).alias(f"_s_{f}") for f in features])
    return rows_from(wide, [period], [
        {"metric": F.lit(f), "centroid_range": F.col(f"_r_{f}"), "centroid_std": F.col(f"_s_{f}")} for f in features])


def pca_points(prepared: DataFrame, period: str, metrics: Sequence[str]) -> DataFrame:
    """First two principal components per period; the largest loading of each is positive (ML8).

    One aggregate gives the means and products of all periods; the rows are projected in one more pass, without centring,
    as the features are standardised. Rows of the NULL period are a period of their own.
    """
    features, size = [f"s_{m}" for m in metrics], len(metrics)
    rows, _ = _numbered(prepared, period, features)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    x = [F.col("_x")[i] for i in range(size)]
    stats = rows.groupBy("_p").agg(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).collect()
    loads: dict[int, np.ndarray] = {}
    for r in stats:  # one row per period
        matrix = np.zeros((size, size))
        for (i, j), v in zip(pairs, r[1:], strict=True):
            matrix[i, j] = matrix[j, i] = v or 0.0
        vectors = np.linalg.eigh(matrix)[1][:, ::-1][:, :2]
        if size == 1:
            vectors = np.column_stack([vectors, np.zeros(1)])
        peak = vectors[np.abs(vectors).argmax(0), [0, 1]]
        loads[r[0]] = vectors * np.where(peak < 0, -1.0, 1.0)
    count = max(loads, default=-1) + 1
    out = {}
    for c in range(2):
        table = F.array(*[F.array(*[F.lit(float(v)) for v in loads.get(p, np.zeros((size, 2)))[:, c]]) for p in range(count)]) if count else F.array(F.array(F.lit(0.0)))
        out[f"pc{c + 1}"] = F.aggregate(F.zip_with(F.get(table, F.col("_p")), F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumns(out).drop("_p", "_x")


def centroid_distances(cents: DataFrame, period: str, cluster: str, features: Sequence[str],
                       periods: Sequence) -> DataFrame:
    """Distances between the clusters of consecutive periods (J17); a missing coordinate counts as 0.

    The input is a centroid table: a few rows per period.
    """
    follows = F.coalesce(*[F.when(F.col("from_period") == a, F.lit(b)) for a, b in zip(periods, periods[1:])])
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    left = cents.select(F.col(period).alias("from_period"), F.col(cluster).alias("from_cluster"),
                        F.array(*values).alias("_f")).withColumn("to_period", follows)
    right = cents.select(F.col(period).alias("to_period"), F.col(cluster).alias("to_cluster"), F.array(*values).alias("_g"))
    gaps = F.zip_with("_f", "_g", lambda a, b: (a - b) * (a - b))
    return left.join(right, "to_period").select(
        "from_period", "to_period", "from_cluster", "to_cluster",
        F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)).alias("distance"))


def _prices(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cheapest one-to-one assignment of a square table: the column of each row, and row and column prices that prove it.

    Rows enter one by one; each goes along the cheapest path of reduced costs to a free column, in cubic time over all.
    """
    n = len(cost)
    u, v, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for i in range(n):
        least, back, used = cost[i] - u[i] - v, np.full(n, -1), np.zeros(n, bool)
        while True:
            free = np.where(used, np.inf, least)
            to = int(free.argmin())
            step = free[to]
            used[to] = True
            if owner[to] < 0:
                break
            row = owner[to]
            through = step + cost[row] - u[row] - v
            better = ~used & (through < least)
            least[better], back[better] = through[better], to
        seen = used.copy()
        seen[to] = False
        u[i] += step
        u[owner[seen]] += step - least[seen]
        v[seen] -= step - least[seen]
        while to >= 0:
            before = back[to]
            owner[to] = owner[before] if before >= 0 else i
            to = before
    match = np.empty(n, int)
    match[owner] = np.arange(n)
    return match, u, v


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row (rows <= columns) at least total cost; among equal totals, each row in turn takes the first
    column that some cheapest assignment gives it.

    Only pairs of reduced cost zero occur in cheapest assignments, so the choice among them is a search along alternating
    paths of such pairs. Columns that stay over belong to rows of cost 0 that are added.
    """
    n, m = cost.shape
    if not n:
        return []
    square = np.zeros((m, m))
    square[:n] = cost
    match, u, v = _prices(square)
    tight = square - u[:, None] - v <= 1e-9 * max(1.0, float(np.abs(square).max()))
    tight[np.arange(m), match] = True
    owner = np.empty(m, int)
    owner[match] = np.arange(m)
    fixed = np.zeros(m, bool)
    for i in range(n):
        for j in np.flatnonzero(tight[i] & ~fixed).tolist():
            if j == match[i]:
                break
            came, line, found = {int(owner[j]): -1}, [int(owner[j])], -1  # who loses j looks for a way to the column that i leaves
            while line and found < 0:
                row = line.pop(0)
                if tight[row, match[i]]:
                    found = row
                    break
                for c in np.flatnonzero(tight[row] & ~fixed).tolist():
                    if c != j and (other := int(owner[c])) != i and other not in came:
                        came[other] = row
                        line.append(other)
            if found >= 0:
                column = match[i]
                while found >= 0:
                    column, match[found] = match[found], column
                    owner[match[found]] = found
                    found = came[found]
                match[i], owner[j] = j, i
                break
        fixed[match[i]] = True
    return match[:n].tolist()


def match_one_to_one(cost: dict[tuple, float], left: Sequence, right: Sequence) -> list[tuple]:
    """Pairs of least total cost, every cluster of the shorter side used once; equal totals go to the first in order."""
    if not left or not right:
        return []
    flip = len(left) > len(right)
    a, b = (list(right), list(left)) if flip else (list(left), list(right))
    columns = assignment(np.array([[cost[(y, x) if flip else (x, y)] for y in b] for x in a], float))
    pairs = [(b[j], x) if flip else (x, b[j]) for x, j in zip(a, columns, strict=True)]
    place = {x: i for i, x in enumerate(left)}
    return sorted(pairs, key=lambda p: place[p[0]])


def match_periods(distances: DataFrame) -> DataFrame:
    """One-to-one pairs of least total distance for every two periods in a row, each two in a task of its own.

    A task holds the distances between the clusters of two periods: the square of their number, which is a parameter of
    the fit and not of the rows. Equal totals go to the smaller cluster ids.
    """
    def solve(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        cost = dict(zip(zip(rows["from_cluster"], rows["to_cluster"]), rows["distance"]))
        pairs = match_one_to_one(cost, sorted(set(rows["from_cluster"])), sorted(set(rows["to_cluster"])))
        found = {c: [rows[c][0]] * len(pairs) for c in ("from_period", "to_period")}
        found |= {"from_cluster": [a for a, _ in pairs], "to_cluster": [b for _, b in pairs], "distance": [float(cost[p]) for p in pairs]}
        return pa.table(found, schema=table.schema)

    columns = ["from_period", "to_period", "from_cluster", "to_cluster", "distance"]
    return distances.select(*columns).groupBy("from_period", "to_period").applyInArrow(solve, distances.select(*columns).schema)


def align_clusters(cents: DataFrame, period: str, cluster: str, features: Sequence[str]) -> DataFrame:
    """Carry cluster ids through the periods (ML10): anchor, matched to previous, or new.

    Costs and matches stay in Spark. Every matched cluster points to the one before; pointers are doubled until each shows
    the first of its chain, and the firsts are numbered by period and id. The centroid table has a row per cluster and
    period.
    """
    periods = [p for p in period_list(cents, period) if p is not None]
    spark, kind = cents.sparkSession, cents.schema[period].dataType.simpleString()
    order = literal_table(spark, list(enumerate(periods)), f"_i int, {period} {kind}")
    pairs = match_periods(centroid_distances(cents, period, cluster, features, periods))
    pairs = pairs.select(F.col("to_period").alias(period), F.col("to_cluster").alias(cluster), F.col("from_cluster").alias("_before"),
                         F.col("distance").alias("distance_to_previous"))
    rows = cents.select(period, cluster).distinct().join(order, period).join(pairs, [period, cluster], "left")
    met = F.col("_before").isNotNull()
    rows = held(rows.select("*", F.when(met, F.col("_i") - 1).otherwise(F.col("_i")).alias("_ri"), F.coalesce("_before", cluster).alias("_rc")))
    step = 1
    while step < len(periods):
        further = rows.select(F.col("_i").alias("_ri"), F.col(cluster).alias("_rc"), F.col("_ri").alias("_fi"), F.col("_rc").alias("_fc"))
        rows = held(rows.join(further, ["_ri", "_rc"]).select(period, cluster, "_i", "_before", "distance_to_previous", F.col("_fi").alias("_ri"), F.col("_fc").alias("_rc")))
        step *= 2
    firsts = rows.where("_before is null").select("_i", cluster)
    number = F.row_number().over(W.orderBy("_i", cluster)) - 1  # over the firsts of all chains, a part of the centroid table
    named = firsts.select(F.col("_i").alias("_ri"), F.col(cluster).alias("_rc"), number.alias("aligned_cluster_id"))
    kinds = F.when(F.col("_i") == 0, "anchor").when(met, "matched_to_previous").otherwise("new_unmatched_cluster")
    away = F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(F.col("distance_to_previous"))
    return rows.join(named, ["_ri", "_rc"]).select(
        period, cluster, "aligned_cluster_id", kinds.alias("match_type"), away.alias("distance_to_previous"),
        cluster_label("aligned_cluster_id", "aligned_cluster_").alias("aligned_cluster_label"))


def apply_alignment(df: DataFrame, mapping: DataFrame, period: str, cluster: str) -> DataFrame:
    """Aligned id and label on assignments, centroids or profiles (ML11)."""
    return join_small(df, mapping.select(period, cluster, "aligned_cluster_id", "aligned_cluster_label"), [period, cluster])


def label_paths(df: DataFrame, entity: str, period: str, label: str, periods: Sequence) -> DataFrame:
    """One row per entity with its label in every period (ML12); one shuffle."""
    return df.groupBy(entity).agg(
        *[F.min(F.when(F.col(period) == p, F.col(label))).alias(f"label_{p}") for p in periods])


def transition_edges(paths: DataFrame, periods: Sequence) -> DataFrame:
    """Entities per (from, to) label for each consecutive period pair (ML13)."""
    steps = F.array(*[F.struct(F.lit(a).alias("from_year"), F.lit(b).alias("to_year"),
                               F.col(f"label_{a}").alias("from_cluster"), F.col(f"label_{b}").alias("to_cluster"))
                      for a, b in zip(periods, periods[1:])])
    moves = paths.select(F.inline(steps)).where("from_cluster is not null and to_cluster is not null")
    return moves.groupBy("from_year", "to_year", "from_cluster", "to_cluster").agg(
        F.count(F.lit(1)).alias("entity_count"))


def transition_matrix(edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges as one row per (pair, from label), a column per to label, fill 0 (ML13)."""
    wide = edges.groupBy("from_year", "to_year", "from_cluster").pivot("to_cluster", list(labels)).agg(F.sum("entity_count"))
    return wide.na.fill(0, list(labels))


def transition_summary(edges: DataFrame) -> DataFrame:
    """Compared, unchanged and changed entities per period pair (ML13)."""
    same = F.col("from_cluster") == F.col("to_cluster")
    return edges.groupBy("from_year", "to_year").agg(
        F.sum("entity_count").alias("entities_compared"),
        F.sum(F.when(same, F.col("entity_count")).otherwise(0)).alias("stayed_same_count"),
        F.sum(F.when(~same, F.col("entity_count")).otherwise(0)).alias("changed_count"))


def first_to_last(paths: DataFrame, periods: Sequence) -> DataFrame:
    """Entities seen at both ends, how many changed, and the rate (ML14)."""
    start, end = F.col(f"label_{periods[0]}"), F.col(f"label_{periods[-1]}")
    both = paths.where(start.isNotNull() & end.isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("stable_entity_count"), F.count_if(start == end).alias("same_cluster"),
        F.count_if(start != end).alias("changed_cluster"),
        F.round(100.0 * F.count_if(start != end) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("change_rate_pct"))


def label_counts(df: DataFrame, period: str, label: str) -> DataFrame:
    """Entities per period and label (ML15)."""
    return df.groupBy(period, label).agg(F.count(F.lit(1)).alias("entity_count"))
