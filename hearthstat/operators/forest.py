"""Random forests on binned features (inventory ML19, ML21).

A feature has at most 32 bins, as in MLlib, and a tree looks at bins only. So rows of equal bins, a cell, go the same way in
every tree, and their bootstrap count and label sum are all that a tree needs of them. Tasks draw the counts row by row and
add them up per tree and cell; a node of few cells grows to its leaves in one task, a larger one is split by counts per bin
that all tasks add up. The cells to predict travel down the trees with the others, so no model is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hearthstat.operators.ordered import quantiles
from hearthstat.operators.scale import stage

BINS = 32
# Cells of a node that one task grows to its leaves, cells that a task holds before it passes them on, and cells of all trees
# that are worked on at a time.
NODE_CELLS, HELD, BLOCK = 500_000, 3_000_000, 50_000_000
# Draws made at once.
DRAWS = 2_000_000
# Nodes times features whose counts per bin are held at once.
AT_ONCE = 16_384
# Two means that differ by less than this share of their size are equal but for rounding.
EQUAL = 1e-12
# Gains this near to the best, as a share of it, are ties, of which the first holds; the order in which sums were added is no matter.
TIED = 1e-9
PIECE = "tree int, node long, cells binary, n binary, s binary, value double"
GROWN = "tree int, cells binary, values binary, gains array<double>"


def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature at most ``bins - 1`` values to cut it at; a value equal to a cut lies below it.

    Up to ``bins`` distinct values are all kept apart. More are cut at equal numbers of rows; where frequent values leave cuts
    over, the rest go to equal numbers of distinct values.
    """
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "f", "v")
    counted = stage(long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
    ranks = {f"q{i}": i / bins for i in range(1, bins)}
    by_value = {r["f"]: sorted({r[q] for q in ranks}) for r in quantiles(counted, ["f"], "v", ranks).collect()}
    by_row = {r["f"]: sorted({r[q] for q in ranks}) for r in quantiles(counted, ["f"], "v", ranks, count="n").collect()}
    distinct = {r["f"]: r["count"] for r in counted.groupBy("f").count().collect()}
    cuts = []
    for f in features:
        if distinct.get(f, 0) <= bins:
            cuts.append(by_value.get(f, []))
            continue
        left = [v for v in by_value[f] if v not in by_row[f]]
        more = bins - 1 - len(by_row[f])
        cuts.append(sorted(by_row[f] + [left[i * len(left) // more] for i in range(min(more, len(left)))]))
    return cuts


def coded(df: DataFrame, x: str, cuts: Sequence[Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and the bins of the array of features ``x`` as ``_cell``."""
    edges = [np.array(c, dtype=float) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            found = np.stack([np.searchsorted(e, points[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.int32)
            offsets = np.arange(0, found.size + 1, len(edges), dtype=np.int32)
            cell = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], cell], names=[*keep, "_cell"])

    schema = df.select(*keep).withColumn("_cell", F.lit(None).cast("array<int>")).schema
    return df.select(*keep, x).mapInArrow(run, schema)


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of bytes, and the number of each row among them."""
    width = cells.shape[1]
    named = np.ascontiguousarray(cells)
    if width <= 8:  # whole numbers sort faster
        named = np.zeros((len(cells), 8), dtype=np.uint8)
        named[:, :width] = cells
    names = named.view(np.uint64 if width <= 8 else f"V{width}").ravel()
    _, first, number = np.unique(names, return_index=True, return_inverse=True)
    return cells[first], number


def _by_cell(cells: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct cells and the sums of the values' rows per cell."""
    found, number = _distinct(cells)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(found)))
    return found, *[np.add.reduceat(v[order], starts, axis=0, dtype=v.dtype) for v in values]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
    names = ["tree", "node", "cells", "n", "s", "value"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _bag(trees: range, seed: int, held: int) -> Callable:
    """Bootstrap counts and label sums per tree and cell of a task's rows; every row is drawn Poisson(1) times per tree."""

    def out(cells: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        rows = []
        for i, t in enumerate(trees):
            some = n[:, i] > 0
            rows.append((t, 0, cells[some].tobytes(), n[some, i].tobytes(), s[some, i].tobytes(), None))
        return _pieces(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, trees.start, TaskContext.get().partitionId()])
        kept, size, step = [], 0, max(256, DRAWS // len(trees))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cells = part.column("_cell").flatten().to_numpy().astype(np.uint8).reshape(part.num_rows, -1)
                y = part.column("_y").to_numpy(zero_copy_only=False)
                if not np.isfinite(y).all():
                    raise ValueError("labels must be finite numbers")
                drawn = rng.poisson(1.0, (len(y), len(trees))).astype(np.int32)
                kept.append(_by_cell(cells, drawn, drawn * y[:, None]))
                size += kept[-1][1].size
                if size > held:
                    kept = [_by_cell(*[np.concatenate(p) for p in zip(*kept)])]
                    size = kept[0][1].size
                    if size > held // 2:
                        yield out(*kept[0])
                        kept, size = [], 0
        if kept:
            yield out(*_by_cell(*[np.concatenate(p) for p in zip(*kept)]))

    return run


def _asked(trees: range) -> Callable:
    """Cells to predict as pieces of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("_cell").flatten().to_numpy().astype(np.uint8).tobytes()
            if cells:
                yield _pieces([(t, 0, cells, b"", b"", None) for t in trees])

    return run


def _histogram(at: np.ndarray, cells: np.ndarray, n: np.ndarray, s: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Counts and label sums by node, feature and bin."""
    out = np.empty((2, nodes, cells.shape[1], bins))
    for f in range(cells.shape[1]):
        key = at * bins + cells[:, f]
        out[0, :, f] = np.bincount(key, n, nodes * bins).reshape(nodes, bins)
        out[1, :, f] = np.bincount(key, s, nodes * bins).reshape(nodes, bins)
    return out


def _best(counts: np.ndarray, least: int, subset: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Feature, last bin of the left side and gain of every node's best split; gain 0 where none is allowed.

    The gain is the fall of the sum of squared deviations, which for labels 0 and 1 is half that of the Gini impurity.
    """
    n, s = counts
    size = n[:, :1].sum(2, keepdims=True)
    mean = s[:, :1].sum(2, keepdims=True) / size
    left, moved = n.cumsum(2)[:, :, :-1], (s - n * mean).cumsum(2)[:, :, :-1]
    right = size - left
    allowed = (left >= least) & (right >= least)
    if subset < n.shape[1]:
        ranks = rng.random(n.shape[:2]).argsort(1).argsort(1)
        allowed &= (ranks < subset)[:, :, None]
    gain = np.where(allowed, moved ** 2 / np.maximum(left, 1) + moved ** 2 / np.maximum(right, 1), 0.0)
    flat = gain.reshape(len(gain), -1)
    top = flat.max(1)
    best = (flat >= top[:, None] * (1 - TIED)).argmax(1)
    top = np.where(top > size[:, 0, 0] * (EQUAL * mean[:, 0, 0]) ** 2, top, 0.0)
    return best // gain.shape[2], best % gain.shape[2], top


def _grow(cells: np.ndarray, n: np.ndarray, s: np.ndarray, asked: np.ndarray, depth: int, least: int, subset: int, bins: int,
          rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Grow a node level by level to its leaves; the value of the leaf of every asked cell, and the gains by feature."""
    values, gains = np.zeros(len(asked)), np.zeros(cells.shape[1])
    at, there, place = np.zeros(len(cells), dtype=np.int64), np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
    nodes = 1
    while nodes:
        values[there] = (np.bincount(at, s, nodes) / np.bincount(at, n, nodes))[place]
        if depth == 0:
            break
        order = np.argsort(at, kind="stable")
        at, cells, n, s = at[order], cells[order], n[order], s[order]
        found = []
        step = max(1, AT_ONCE // len(gains))
        for low in range(0, nodes, step):
            high = min(nodes, low + step)
            a, b = np.searchsorted(at, [low, high])
            found.append(_best(_histogram(at[a:b] - low, cells[a:b], n[a:b], s[a:b], high - low, bins), least, subset, rng))
        feature, last, gain = (np.concatenate(c) for c in zip(*found))
        np.add.at(gains, feature, gain)
        split = gain > 0
        child = 2 * (np.cumsum(split) - 1)

        def below(at: np.ndarray, cells: np.ndarray) -> np.ndarray:
            return child[at] + (cells[np.arange(len(at)), feature[at]] > last[at])

        go, go_there = split[at], split[place]
        cells, n, s, at = cells[go], n[go], s[go], below(at[go], cells[go])
        there, place = there[go_there], below(place[go_there], asked[there[go_there]])
        nodes, depth = 2 * int(split.sum()), depth - 1
    return values, gains


def _grow_group(width: int, depth: int, least: int, subset: int, bins: int, seed: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        rows = table.to_pylist()
        done = [r for r in rows if r["value"] is not None]
        fit, ask = [r for r in rows if r["n"]], [r for r in rows if not r["n"] and r["value"] is None]
        out = [(tree, r["cells"], np.full(len(r["cells"]) // width, r["value"]).tobytes(), [0.0] * width) for r in done]
        if fit:
            def joined(name: str, kind: type, of: list[dict]) -> np.ndarray:
                return np.frombuffer(b"".join(r[name] for r in of), kind)

            cells, n, s = _by_cell(joined("cells", np.uint8, fit).reshape(-1, width), joined("n", np.int32, fit), joined("s", float, fit))
            asked = joined("cells", np.uint8, ask).reshape(-1, width)
            used = (node + 1).bit_length() - 1
            values, gains = _grow(cells, n.astype(float), s, asked, depth - used, least, subset, bins, np.random.default_rng([seed, tree, node]))
            out.append((tree, asked.tobytes(), values.tobytes(), gains.tolist()))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "cells", "values", "gains"])

    return run


def _split_large(pieces: DataFrame, width: int, limit: int, depth: int, least: int, subset: int, bins: int, seed: int) -> tuple[DataFrame, dict]:
    """Split nodes of more than ``limit`` cells, one level of all trees at a time; the pieces below, and gains by tree and feature."""
    gains: dict[tuple[int, int], float] = {}
    while True:
        open_ = pieces.where("value is null")
        sizes = open_.groupBy("tree", "node").agg(F.sum(F.octet_length("cells")).alias("size")).where(F.col("size") > limit * width)
        large = {(r["tree"], r["node"]) for r in sizes.collect()}
        if not large:
            return pieces, gains

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    key = (r["tree"], r["node"])
                    if r["n"] and key in large:
                        cells = np.frombuffer(r["cells"], np.uint8).reshape(-1, width)
                        counts = _histogram(np.zeros(len(cells), dtype=np.int64), cells, np.frombuffer(r["n"], np.int32), np.frombuffer(r["s"]), 1, bins)
                        sums[key] = sums.get(key, 0) + counts
            for (tree, node), counts in sums.items():
                yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": [node], "counts": [counts.tobytes()]})

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            counts = sum(np.frombuffer(b).reshape(2, 1, width, bins) for b in table.column("counts").to_pylist())
            tree, node = (k.as_py() for k in key)
            feature, last, gain = _best(counts, least, subset, np.random.default_rng([seed, tree, node]))
            value = counts[1, 0, 0].sum() / counts[0, 0, 0].sum()
            return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], "feature": [int(feature[0])], "last": [int(last[0])],
                             "gain": [float(gain[0]) if (node + 1).bit_length() <= depth else 0.0], "value": [float(value)]})

        counted = open_.mapInArrow(add, "tree int, node long, counts binary").groupBy("tree", "node")
        chosen = {(r["tree"], r["node"]): r for r in counted.applyInArrow(choose, "tree int, node long, feature long, last long, gain double, value double").collect()}
        for (tree, _), r in chosen.items():
            if r["gain"] > 0:
                gains[tree, r["feature"]] = gains.get((tree, r["feature"]), 0.0) + r["gain"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.to_pylist():
                    r = chosen.get((p["tree"], p["node"])) if p["value"] is None else None
                    if r is None:
                        yield _pieces([tuple(p.values())])
                    elif r["gain"] > 0:
                        cells = np.frombuffer(p["cells"], np.uint8).reshape(-1, width)
                        right = cells[:, r["feature"]] > r["last"]
                        for side, some in ((1, ~right), (2, right)):
                            if some.any():
                                n, s = (np.frombuffer(p[c], k)[some].tobytes() if p["n"] else b"" for c, k in (("n", np.int32), ("s", float)))
                                yield _pieces([(p["tree"], 2 * p["node"] + side, cells[some].tobytes(), n, s, None)])
                    elif not p["n"]:
                        yield _pieces([(p["tree"], p["node"], p["cells"], b"", b"", r["value"])])

        pieces = stage(pieces.mapInArrow(route, PIECE))


def _totals(width: int) -> Callable:
    """Values of a task's trees summed per cell."""

    def flat(cells: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, cells.size + 1, width, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(cells.astype(np.int32).ravel())), pa.array(total)], names=["_cell", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for c, v in zip(batch.column("cells"), batch.column("values")):
                cells = np.frombuffer(c.as_py(), np.uint8).reshape(-1, width)
                if len(cells):
                    kept.append((cells, np.frombuffer(v.as_py())))
                    size += len(cells)
                if size > HELD:
                    yield flat(*_by_cell(*[np.concatenate(p) for p in zip(*kept)]))
                    kept, size = [], 0
        if kept:
            yield flat(*_by_cell(*[np.concatenate(p) for p in zip(*kept)]))

    return run


def fit(train: DataFrame, asked: DataFrame, cuts: Sequence[Sequence[float]], subset: int, numTrees: int = 20, maxDepth: int = 5,
        minInstancesPerNode: int = 1, seed: int = 42, node_cells: int = NODE_CELLS, held: int = HELD, block: int = BLOCK) -> tuple[DataFrame, list[float]]:
    """Fit a forest to ``_y`` by ``_cell`` (as ``coded`` made it); (mean value of the trees per distinct asked ``_cell``, importances).

    Options are named as in MLlib: the trees' bootstrap is Poisson, a side of a split holds ``minInstancesPerNode`` drawn rows,
    and a node looks at ``subset`` features picked anew. Leaves of equal class are not merged. ``train`` is read once per block of
    trees and should be staged.
    """
    spark, width, bins = train.sparkSession, len(cuts), max([1, *[len(c) for c in cuts]]) + 1
    wanted = stage(asked.select("_cell").distinct())
    n_cells = wanted.count() + train.select("_cell").distinct().count()
    at_once = min(numTrees, max(1, block // max(1, n_cells)))
    parts = 4 * spark.sparkContext.defaultParallelism
    grown, gains = [], {}
    for low in range(0, numTrees, at_once):
        trees = range(low, min(numTrees, low + at_once))
        pieces = train.select("_cell", "_y").mapInArrow(_bag(trees, seed, held), PIECE).unionByName(wanted.mapInArrow(_asked(trees), PIECE))
        if n_cells > node_cells:
            pieces, more = _split_large(stage(pieces), width, node_cells, maxDepth, minInstancesPerNode, subset, bins, seed)
            gains |= more
        run = _grow_group(width, maxDepth, minInstancesPerNode, subset, bins, seed)
        grown.append(stage(pieces.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(run, GROWN)))
    whole = grown[0]
    for g in grown[1:]:
        whole = whole.unionByName(g)
    values = whole.select("cells", "values").mapInArrow(_totals(width), "_cell array<int>, total double")
    by_tree = whole.select("tree", F.posexplode("gains").alias("feature", "gain")).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    if gains:
        top = spark.createDataFrame([(t, f, g) for (t, f), g in gains.items()], "tree int, feature int, gain double")
        by_tree = by_tree.unionByName(top).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    sums = by_tree.groupBy("tree").agg(F.sum("gain").alias("all"))
    shares = by_tree.join(sums, "tree").where(F.col("all") > 0).groupBy("feature").agg(F.sum(F.col("gain") / F.col("all")).alias("share"))
    found = {r["feature"]: r["share"] for r in shares.collect()}
    total = sum(found.values()) or 1.0
    drawn = whole.agg(F.count_distinct("tree")).first()[0]  # of a handful of rows a tree may have drawn none
    return values.groupBy("_cell").agg((F.sum("total") / max(1, drawn)).alias("value")), [found.get(f, 0.0) / total for f in range(width)]
