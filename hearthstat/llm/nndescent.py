"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthstat.llm.common import stage
from hearthstat.llm.graph import components
from hearthstat.llm.vectors import distinct_vectors, matrix, units

LEAST = 0.9
NEIGHBOURS = 12
TABLES = 3
REACH = 4
JOIN = 48
AUDIT = 256
RECALL = 0.99
ROUNDS = 3
BLOCK = 256
SLACK = 0.005


def _halves(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())


def _from_halves(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.float16).astype(np.float32).reshape(len(cells), -1)


def nodes(distinct: DataFrame) -> DataFrame:
    """Representatives with their unit vectors in half precision, which only choose candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("rep"), _halves(units(matrix(batch.column("vector"))))], ["rep", "half"])

    return distinct.select("rep", "vector").mapInArrow(run, "rep long, half binary")


def first_graph(known: DataFrame, size: int, tables: int, seed: int, count: int) -> DataFrame:
    """Edges (u, v, sim) to start from: in several random orders, every vector and the next few.

    An order sorts by the signs of random projections, as many as leave about ``REACH`` of the ``count`` vectors with equal
    signs, then by one more projection. It is dealt by range, so a task holds a stretch of it.
    """
    spark = known.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(40, max(1, math.ceil(math.log2(max(2, count) / REACH))))
    made = None
    for k in range(tables):
        planes = np.random.default_rng([seed, k]).standard_normal((size, bits + 1)).astype(np.float32)

        def place(batches: Iterator[pa.RecordBatch], planes: np.ndarray = planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    side = _from_halves(batch.column("half")) @ planes
                    code = ((side[:, :-1] > 0) * (1 << np.arange(bits))).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("half"), pa.array(code * 100.0 + side[:, -1])], ["rep", "half", "at"])

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail_id, tail = np.empty(0, np.int64), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, rows = batch.column("rep").to_numpy(), _from_halves(batch.column("half"))
                if tail is not None:
                    ids, rows = np.concatenate((tail_id, ids)), np.concatenate((tail, rows))
                for step in range(1, REACH + 1):
                    if len(ids) > step:
                        sims = (rows[:-step] * rows[step:]).sum(1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[:-step], ids[step:]))), pa.array(np.concatenate((ids[step:], ids[:-step]))),
                                                          pa.array(np.concatenate((sims, sims)))], ["u", "v", "sim"])
                tail_id, tail = ids[-REACH:], rows[-REACH:]

        order = known.mapInArrow(place, "rep long, half binary, at double").repartitionByRange(parts, "at", "rep").sortWithinPartitions("at", "rep")
        edges = order.mapInArrow(link, "u long, v long, sim float")
        made = edges if made is None else made.unionByName(edges)
    return made


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every u, from (u, v, sim, new); an edge is new only if it was not known before."""
    single = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    ranked = single.withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v")))
    return ranked.where(F.col("_r") <= k).drop("_r")


def descend(lists: DataFrame, known: DataFrame, k: int, least: float = LEAST, turn: int = 0) -> DataFrame:
    """Edges that neighbours of neighbours bring: all who have a vector in common compare, if one of them is new there.

    The forward and backward neighbours of a vector meet in groups of about ``JOIN``, so a vector that very many have as
    neighbour is no large group. An edge is returned if it is better than the worst of a full list.
    """
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("x"), "new").unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("x"), "new"))
    around = around.groupBy("w", "x").agg(F.max("new").alias("new"))
    sizes = around.groupBy(F.col("w").alias("_w")).agg(F.count(F.lit(1)).alias("_n"), F.max("new").alias("_any")).where("_any")
    around = around.join(sizes, F.col("w") == F.col("_w")).withColumn("part", F.pmod(F.xxhash64("x", "w", F.lit(turn)), F.ceil(F.col("_n") / JOIN)))
    full = lists.groupBy(F.col("u").alias("_u")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(-2.0).cast("float").alias("worst"))
    rows = known.join(full, F.col("rep") == F.col("_u"), "left").select("rep", "half", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    groups = around.join(rows, F.col("x") == F.col("rep")).groupBy("w", "part").agg(F.collect_list(F.struct("x", "new", "worst", "half")).alias("all"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("all")
            ends, inner = cells.offsets.to_numpy(), cells.values
            ids, new, worst = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = _from_halves(inner.field(3)) if len(inner) else np.empty((0, 0), np.float32)
            u, v, s = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                sims = rows[a:b] @ rows[a:b].T
                np.fill_diagonal(sims, -3)
                better = (sims > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
                floor = np.partition(sims, -min(6, b - a), axis=1)[:, -min(6, b - a)]
                i, j = np.nonzero(better & ((sims >= floor[:, None]) | (sims >= least - SLACK)))
                u.append(ids[a + i])
                v.append(ids[a + j])
                s.append(sims[i, j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, s)], ["u", "v", "sim"])

    return groups.select("all").mapInArrow(compare, "u long, v long, sim float")


def audit(known: DataFrame, least: float, count: int = AUDIT) -> dict[int, int]:
    """True numbers of links of a bounded sample of vectors, by comparing it with all: what lists are measured against."""
    sample = known.orderBy(F.xxhash64("rep"), "rep").limit(count).toArrow()
    if not sample.num_rows:
        return {}
    ids, rows = sample.column("rep").to_numpy(), _from_halves(sample.column("half").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                sims = _from_halves(batch.column("half")) @ rows.T
                found += ((sims >= least) & (batch.column("rep").to_numpy()[:, None] != ids)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], ["rep", "n"])

    counted = known.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n")).collect()
    return {r[0]: r[1] for r in counted}


def plant(known: DataFrame, least: float, lonely: list[int]) -> tuple[DataFrame, dict[int, int]]:
    """The nodes and, beside the ones named, one more node each just above the threshold; and (planted: its partner).

    The audit names the vectors of its sample that have no link, so it is not empty however rare links are.
    """
    spark = known.sparkSession
    sample = known.where(F.col("rep").isin(lonely)).toArrow() if lonely else None
    if sample is None:
        return known, {}
    rng = np.random.default_rng(17)
    rows = _from_halves(sample.column("half").combine_chunks()).astype(float)
    aside = rng.standard_normal(rows.shape)
    aside -= rows * ((aside * rows).sum(1) / (rows * rows).sum(1))[:, None]
    cosines = rng.uniform(least, least + (1 - least) / 4, len(rows))
    norms = np.sqrt((aside * aside).sum(1))
    aside /= np.where(norms > 1e-6, norms, 1)[:, None]
    made = units(cosines[:, None] * units(rows) + np.sqrt(1 - cosines**2)[:, None] * aside)
    while True:
        first = int(rng.integers(-2**62, 2**62))
        if known.where(F.col("rep").between(first, first + len(rows))).isEmpty():
            break
    names = [first + i for i in range(len(rows))]
    planted = spark.createDataFrame([(i, r.astype(np.float16).tobytes()) for i, r in zip(names, made, strict=True)], "rep long, half binary")
    return known.unionByName(planted), dict(zip(names, sample.column("rep").to_pylist(), strict=True))


def candidate_edges(distinct: DataFrame, least: float = LEAST, k: int = NEIGHBOURS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of the neighbour graph that may reach ``least``, and the nodes (rep) whose lists are full of such edges.

    After each round the lists of a sample are held against its true links, or a planted one where it has none, so the audit is
    never empty. While lists change by a twentieth or more the descent goes on; otherwise twice as many new random orders as
    before are added, until both reach ``recall``.
    """
    single = stage(nodes(distinct), "nodes")
    truth = audit(single, least)
    known, partner = plant(single, least, [i for i, n in truth.items() if not n])
    known = stage(known, "planted")
    row, count = known.select(F.max(F.octet_length("half")), F.count(F.lit(1))).first()
    size = (row or 0) // 2
    lists, turn, tables, fresh = None, 0, TABLES, True
    while True:
        if fresh:
            start = first_graph(known, size, tables, 100 + turn, count).withColumn("new", F.lit(True))
            start = start if lists is None else start.where(F.col("sim") >= least - SLACK).unionByName(lists.withColumn("new", F.lit(False)))
            tables *= 2
        else:
            start = descend(lists, known, k, least, turn).withColumn("new", F.lit(True)).unionByName(lists.withColumn("new", F.lit(False)))
        lists = stage(best(start, k), "lists")
        turn += 1
        if turn < ROUNDS:
            fresh = False
            continue
        asked = [*truth, *partner]
        near = lists.where(F.col("u").isin(asked) & (F.col("sim") >= least - SLACK)).select("u", "v", "sim").collect() if asked else []
        own, lengths, seen = {(r.u, r.v) for r in near}, Counter(r.u for r in near), Counter()
        for r in near:
            if r.sim >= least and (r.v not in partner or lengths[r.u] >= k):
                seen[r.u] += 1
        hits, links = sum(min(seen[i], n, k) for i, n in truth.items()), sum(min(n, k) for n in truth.values())
        # A full list may leave a partner out; what is saturated is compared whole afterwards.
        met = sum((i, j) in own or (j, i) in own or lengths[i] >= k and lengths[j] >= k for i, j in partner.items())
        if hits >= recall * links and met >= recall * len(partner):
            break
        total, changed = lists.agg(F.count(F.lit(1)), F.sum(F.col("new").cast("long"))).first()
        fresh = 20 * (changed or 0) < total or turn % ROUNDS == 0
    lists = lists.where(F.col("sim") >= least - SLACK)
    full = lists.groupBy(F.col("u").alias("rep")).count().where(F.col("count") >= k).select("rep")
    real = lists.where(~F.col("u").isin([*partner]) & ~F.col("v").isin([*partner])) if partner else lists
    return real.select("u", "v"), full.where(~F.col("rep").isin([*partner])) if partner else full


def cross_links(distinct: DataFrame, parts: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """(a, b): links between different components of vectors whose lists are full, one at least for each two blocks that have any.

    A link that no list holds has two full lists as ends. So these vectors are cut into blocks inside their components; two
    blocks are compared, exactly and in double precision, unless the angles of their centres and radii rule out every link.
    """
    rows = distinct.join(full.withColumnRenamed("rep", "_full"), F.col("rep") == F.col("_full"), "left_semi").join(parts, F.col("rep") == F.col("id"))
    sized = rows.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(sized, F.col("component") == F.col("_c")).withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / BLOCK)))
    blocks = stage(rows.groupBy("component", "block").agg(F.collect_list(F.struct("rep", "vector")).alias("rows")), "full")

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mids, radii = [], []
            for n in range(batch.num_rows):
                x = units(matrix(batch.column("rows")[n].values.field(1)))
                mid = x.sum(0)
                norm = np.sqrt((mid * mid).sum())
                mid = mid / norm if norm > 1e-9 else x[0]
                mids.append(mid.tolist())
                radii.append(float(np.arccos(np.clip(x @ mid, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("block"), pa.array(mids, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                                             ["component", "block", "mid", "radius"])

    spread = blocks.mapInArrow(outline, "component long, block long, mid array<double>, radius double")
    packs = spread.withColumn("pack", F.pmod(F.xxhash64("component", "block"), F.lit(max(1, blocks.count() // 1024))))
    packs = stage(packs.groupBy("pack").agg(F.collect_list(F.struct("component", "block", "mid", "radius")).alias("all")), "packs")
    wide = math.acos(max(-1.0, min(1.0, least))) + 1e-6

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                p, q = (batch.column(c)[n].values for c in ("p", "q"))
                gap = np.arccos(np.clip(matrix(p.field(2)) @ matrix(q.field(2)).T, -1, 1))
                c, d = p.field(0).to_numpy(), q.field(0).to_numpy()
                i, j = np.nonzero((gap <= wide + p.field(3).to_numpy()[:, None] + q.field(3).to_numpy()) & (c[:, None] < d))
                yield pa.RecordBatch.from_arrays([pa.array(c[i]), p.field(1).take(pa.array(i)), pa.array(d[j]), q.field(1).take(pa.array(j))], ["c", "i", "d", "j"])

    pairs = packs.select(F.col("all").alias("p")).crossJoin(packs.select(F.col("all").alias("q"))).mapInArrow(close, "c long, i long, d long, j long")
    left = blocks.select(F.col("component").alias("c"), F.col("block").alias("i"), F.col("rows").alias("a"))
    right = blocks.select(F.col("component").alias("d"), F.col("block").alias("j"), F.col("rows").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_ids, b_ids = [], []
            for n in range(batch.num_rows):
                a, b = (batch.column(c)[n].values for c in ("a", "b"))
                near = units(matrix(a.field(1))) @ units(matrix(b.field(1))).T >= least
                if near.any():
                    x, y = np.unravel_index(near.argmax(), near.shape)
                    a_ids.append(a.field(0)[int(x)].as_py())
                    b_ids.append(b.field(0)[int(y)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])

    return pairs.join(left, ["c", "i"]).join(right, ["d", "j"]).select("a", "b").mapInArrow(compare, "a long, b long")


def link_counts(distinct: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(rep, others): how many vectors of its component each representative links with, exactly, in double precision.

    This enlarges the lists of the saturated at once: after ``cross_links`` whatever links lies in one component, and a
    component is compared with itself in blocks, of which only counts come back. Copies count by their number.
    """
    sized = parts.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    rows = parts.join(sized, F.col("component") == F.col("_c")).join(distinct, F.col("id") == F.col("rep"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("_n") / BLOCK)))
    blocks = stage(rows.groupBy("component", "block").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("rows")), "blocks")
    left = blocks.select("component", F.col("block").alias("i"), F.col("rows").alias("a"))
    right = blocks.select(F.col("component").alias("_c"), F.col("block").alias("j"), F.col("rows").alias("b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (batch.column(c)[n].values for c in ("a", "b"))
                x, y = (units(matrix(z.field(2))) for z in (a, b))
                near = x @ y.T >= least
                ids = a.field(0).to_numpy()
                near &= ids[:, None] != b.field(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ b.field(1).to_numpy())], ["rep", "others"])

    pairs = left.join(right, F.col("component") == F.col("_c")).select("a", "b")
    return pairs.mapInArrow(count, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def near_vectors(df: DataFrame, least: float = LEAST, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept (it is that id).

    Two vectors link if their cosine in double precision is ``least`` or more. Equal vectors are one node with a number of
    copies. NN-descent finds the neighbour graph, its edges near the threshold are confirmed on the original vectors,
    vectors with full lists are compared across components, and the links inside each component are counted exactly.

    Vectors that are NULL, zero, or hold NULL or non-finite components link with nothing and are kept. Rows without an id
    link with nothing and are not kept. Rows that repeat an id and a vector count as copies. An empty table gives no rows.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    distinct = stage(distinct_vectors(rows, "vec_id", "vector"), "distinct", "lz4")
    found, full = candidate_edges(distinct, least, k)
    edges = found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    one, two = (distinct.select(F.col("rep").alias(c), F.col("vector").alias(f"vec_{c}")) for c in ("a", "b"))

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = units(matrix(x)), units(matrix(y))
        return pa.array((p * q).sum(1) >= least) if len(x) else pa.array([], pa.bool_())

    sure = edges.join(one, "a").join(two, "b").where(linked("vec_a", "vec_b")).select("a", "b")
    sure = stage(sure, "sure")
    parts = stage(components(sure), "parts")
    parts = stage(components(sure.unionByName(cross_links(distinct, parts, full, least))), "parts")
    counts = link_counts(distinct, parts, least)
    known = distinct.join(parts, F.col("rep") == F.col("id"), "left").join(counts.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left")
    known = known.select(F.col("vector").alias("_vector"), F.coalesce("component", "rep").alias("_component"),
                         (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    able = rows.where("vec_id is not null").join(known, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("_component", "vec_id")
    out = able.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
    return out.unionByName(rows.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(False).alias("kept")))
