"""Approximate nearest neighbours: inverted lists scanned in column blocks with early abandonment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthstat.llm.common import stage
from hearthstat.llm.vectors import cosine, matrix, units, usable

K = 5
SAMPLE = 16_384
AUDIT = 128
RECALL = 0.99
COLUMNS = 16
CHUNK = 1_024
QUERIES = 256
EPSILON = 3.0
TIE = 1e-5


def rotation(size: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix: after it, the first columns of a difference are a fair sample of all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, count: int, seed: int = 3, rounds: int = 10) -> np.ndarray:
    """k-means on a bounded sample; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = nearest_centres(sample, found, 1)[:, 0]
        n = np.bincount(cell, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, cell, sample)
        found = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], found)
    return found


def nearest_centres(rows: np.ndarray, found: np.ndarray, count: int) -> np.ndarray:
    """The nearest centres of each row, nearest first."""
    gap = (found * found).sum(1)[None, :] - 2 * rows @ found.T
    return np.argsort(gap, axis=1, kind="stable")[:, :count]


def scan(query: np.ndarray, blocks: list[np.ndarray], limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list and their squared distances, for what is not abandoned: the k nearest below ``limit``, and ties.

    ``blocks`` hold the rotated vectors by columns. After each block a row is abandoned if its partial distance, carried on
    to all columns, exceeds the limit by more than chance allows: the test of a sampled mean against the limit.
    """
    size = sum(b.shape[0] for b in blocks)
    left = np.arange(blocks[0].shape[1])
    gone = np.zeros(len(left), np.float32)
    seen = 0
    for block in blocks:
        part = block if len(left) == block.shape[1] else block[:, left]
        apart = part - query[seen:seen + len(block), None]
        gone = gone + (apart * apart).sum(0)
        seen += len(block)
        bound = limit * (seen / size) * (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < size else limit * (1 + 1e-5) + 1e-6
        stay = gone <= bound
        left, gone = left[stay], gone[stay]
        if not len(left):
            break
    if len(left) > k:
        edge = np.partition(gone, k - 1)[k - 1]
        near = gone <= edge * (1 + 1e-5) + 1e-6
        left, gone = left[near], gone[near]
    return left, gone


def search(df: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by cosine, nearest first, ties to the smaller id.

    Every row lies in the list of its nearest centre; about the square root of the number of rows is the number of lists,
    and the centres come from k-means on at most ``SAMPLE`` rows. Lists are stored in chunks by column blocks of the rotated
    unit vectors. A query's nearest list gives its first limit; then all probed lists are scanned against that limit, with
    early abandonment. How many lists are probed is set so that, for a bounded sample of queries compared with all rows,
    the wanted share of true neighbours lies in them. Whatever is as near as the k-th within the error of single precision is
    scored on the original vectors in double precision, so ties are settled there.

    Equal vectors are one candidate that stands for its k + 1 smallest ids, so no number of copies makes a long list.
    A query is no candidate of its own. Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor
    do rows without an id; rows that repeat an id count once, with their nearest vector. Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    reps = rows.groupBy("vector").agg(F.min("vec_id").alias("rep"))
    known = stage(reps, "vectors", "lz4")
    asked = queries.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("vector")).dropDuplicates(["query_id"])
    total = known.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, math.isqrt(total))
    sample = units(matrix(known.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column("vector").combine_chunks()))
    turn = rotation(sample.shape[1])
    found = centres(sample @ turn, lists)
    probes = _probes(known, asked, found, turn, k, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = units(matrix(batch.column("vector"))) @ turn
                cell = np.concatenate([nearest_centres(turned[a:a + 4096], found, 1)[:, 0] for a in range(0, len(turned), 4096)])
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(cell.astype(np.int32)), pa.array(list(turned.astype(np.float32)))],
                                                 ["rep", "list", "turned"])

    placed = stage(known.mapInArrow(place, "rep long, list int, turned array<float>"), "placed", "lz4")
    sizes = placed.groupBy(F.col("list").alias("_list")).agg(F.count(F.lit(1)).alias("_n"))
    cut = placed.join(sizes, F.col("list") == F.col("_list")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / CHUNK)))
    grouped = cut.groupBy("list", "chunk").agg(F.collect_list(F.struct("rep", "turned")).alias("rows"))

    def by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = [], []
            for n in range(batch.num_rows):
                inner = batch.column("rows")[n].values
                body = np.ascontiguousarray(matrix(inner.field(1), np.float32).T)
                ids.append(inner.field(0).to_pylist())
                cells.append([body[a:a + COLUMNS].tobytes() for a in range(0, len(body), COLUMNS)])
            yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.binary()))],
                                             ["list", "chunk", "ids", "blocks"])

    chunks = stage(grouped.mapInArrow(by_columns, "list int, chunk long, ids array<long>, blocks array<binary>"), "lists", "lz4")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = units(matrix(batch.column("vector"))) @ turn
                near = np.concatenate([nearest_centres(turned[a:a + 4096], found, probes) for a in range(0, len(turned), 4096)])
                n, width = near.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("query_id").to_numpy(), width)), pa.array(near.reshape(-1).astype(np.int32)),
                     pa.array(np.tile(np.arange(width, dtype=np.int32), n)), pa.array(list(np.repeat(turned.astype(np.float32), width, axis=0)))],
                    ["query_id", "list", "place", "turned"])

    routed = stage(asked.mapInArrow(route, "query_id long, list int, place int, turned array<float>"), "routed", "lz4")
    want = k + 1

    def probe(parts: DataFrame) -> DataFrame:
        """Candidates (query_id, rep, gap) of routed queries that carry a limit."""
        sized = parts.groupBy(F.col("list").alias("_list")).agg(F.count(F.lit(1)).alias("_n"))
        packed = parts.join(sized, F.col("list") == F.col("_list")).withColumn("pack", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_n") / QUERIES)))
        packed = packed.groupBy(F.col("list").alias("_list"), "pack").agg(F.collect_list(F.struct("query_id", "limit", "turned")).alias("queries"))
        both = chunks.join(packed, F.col("list") == F.col("_list")).select("ids", "blocks", "queries")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    ids = batch.column("ids")[n].values.to_numpy()
                    blocks = [np.frombuffer(b.as_py(), np.float32).reshape(-1, len(ids)) for b in batch.column("blocks")[n].values]
                    inner = batch.column("queries")[n].values
                    names, limits, vecs = inner.field(0).to_numpy(), inner.field(1).to_numpy(), matrix(inner.field(2), np.float32)
                    got = [scan(v, blocks, float(x), want) for v, x in zip(vecs, limits, strict=True)]
                    many = [len(g[0]) for g in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(names, many)), pa.array(ids[np.concatenate([g[0] for g in got])]),
                         pa.array(np.concatenate([g[1] for g in got]).astype(np.float32))], ["query_id", "rep", "gap"])

        return both.mapInArrow(run, "query_id long, rep long, gap float")

    def nearest(candidates: DataFrame, count: int) -> DataFrame:
        order = W.partitionBy("query_id").orderBy("gap", "rep")
        return candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count)

    wide = F.lit(4.1).cast("double")
    first = stage(probe(routed.where("place = 0").withColumn("limit", wide)), "first", "lz4")
    limits = nearest(first, want).groupBy(F.col("query_id").alias("_query")).agg(F.when(F.count(F.lit(1)) >= want, F.max("gap").cast("double")).alias("_limit"))
    rest = routed.where("place > 0").join(limits, F.col("query_id") == F.col("_query"), "left").withColumn("limit", F.coalesce("_limit", wide))
    every = stage(first.unionByName(probe(rest.select("query_id", "list", "turned", "limit"))), "candidates", "lz4")
    edges = nearest(every, want).groupBy(F.col("query_id").alias("_query")).agg(F.when(F.count(F.lit(1)) >= want, F.max("gap").cast("double")).alias("_edge"))
    near = F.col("_edge").isNull() | (F.col("gap") <= F.col("_edge") * (1 + TIE) + TIE)
    close = every.join(edges, F.col("query_id") == F.col("_query")).where(near).select("query_id", "rep")
    ids = rows.distinct().withColumn("_r", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= want)
    ids = ids.select("vec_id", F.col("vector").alias("_same"))
    originals = known.select(F.col("rep").alias("_rep"), F.col("vector").alias("_vector"))
    scored = close.join(originals, F.col("rep") == F.col("_rep")).join(asked.withColumnRenamed("query_id", "_query"), F.col("query_id") == F.col("_query"))
    scored = scored.select("query_id", "_vector", cosine(F.col("vector"), F.col("_vector")).alias("score"))
    named = scored.join(ids, F.col("_vector") == F.col("_same")).where("vec_id != query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place_of = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def true_neighbours(known: DataFrame, names: np.ndarray, vecs: np.ndarray, k: int) -> DataFrame:
    """(query, rep, sim): the k nearest of a bounded set of queries among all rows, by comparing them with every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("rep").to_numpy()
                sims = vecs @ units(matrix(batch.column("vector"))).T
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, top.shape[1])), pa.array(ids[top].reshape(-1)), pa.array(np.take_along_axis(sims, top, 1).reshape(-1)),
                     batch.column("vector").take(pa.array(top.reshape(-1)))], ["query", "rep", "sim", "vector"])

    kind = dict(known.dtypes)["vector"]
    found = known.mapInArrow(run, f"query long, rep long, sim double, vector {kind}")
    return found.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "rep"))).where(F.col("_r") <= k)


def _probes(known: DataFrame, asked: DataFrame, found: np.ndarray, turn: np.ndarray, k: int, recall: float) -> int:
    """The smallest number of probed lists in which the wanted share of a sample's true neighbours lies."""
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT).toArrow()
    if not some.num_rows:
        return 1
    names, vecs = some.column("query_id").to_numpy(), units(matrix(some.column("vector").combine_chunks()))
    truth = true_neighbours(known, names, vecs, k + 1).select("query", "vector").toArrow()
    cell = nearest_centres(units(matrix(truth.column("vector").combine_chunks())) @ turn, found, 1)[:, 0]
    order = nearest_centres(vecs @ turn, found, len(found))
    place = np.argsort(order, axis=1)
    row = {int(q): i for i, q in enumerate(names)}
    at = np.sort(place[[row[int(q)] for q in truth.column("query").to_numpy()], cell])
    return int(at[min(len(at) - 1, math.ceil(recall * len(at)) - 1)]) + 1
