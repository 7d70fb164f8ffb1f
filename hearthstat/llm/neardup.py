"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from hearthstat.llm.common import among, boxed, dealt, drop, stage, stage_dealt
from hearthstat.llm.graph import components
from hearthstat.llm.words import chunks, minwise, mixed, shingles

WORDS = 5
PERCENT = 80
TOKENS = 64
TREES = 16
RECALL = 0.99
SMALL = 2_048
HOPS = 3
THIN = 16
ROOM = 2_000_000  # shingles that a task compares at once
COLUMNS = 1 << 22  # cells of the matrix it compares them in
CHUNK = 1_000_000
SALTS = np.random.default_rng(5).integers(1, 2**63, 2, dtype=np.uint64)
SKETCH = "doc_id long, n_shingles long, key binary, tokens array<int>"


def sketches(docs: DataFrame, words: int = WORDS, tokens: int = TOKENS) -> DataFrame:
    """doc_id, number of shingles, a strong digest of the shingle set, and its minwise tokens (none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text"), CHUNK):
                sets = shingles(texts, words)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                least = [minwise(s, tokens).view(np.int32) if len(s) else np.empty(0, np.int32) for s in sets]
                ends = np.cumsum([0, *map(len, least)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(least), pa.int32()))], ["doc_id", "n_shingles", "key", "tokens"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _shingle_set(text: Column, words: int) -> Column:
    @F.arrow_udf("array<long>")
    def to_set(texts: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for part in chunks(texts, CHUNK) for s in shingles(part, words)], pa.list_(pa.int64()))

    return to_set(text)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt as the buckets of ``stage_dealt`` are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Full shingle sets (doc_id, set) of the documents named, written once, in buckets of the id, for all confirmations."""
    ids = stage(ids.select("doc_id").distinct(), "involved")
    some = _spread(among(docs, ids, "doc_id"), "doc_id").join(ids, "doc_id", "left_semi")
    sets = stage_dealt(some.select("doc_id", _shingle_set(F.col("text"), words).alias("set")), "sets", "doc_id", "lz4")
    drop(ids)
    return sets


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each given once, whose full shingle sets are similar enough. Only sets of a pair are moved."""
    some = sets.join(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), "doc_id", "left_semi")
    left, right = (some.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("_both", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("_both")
    return both.where(F.col("_both") * 100 >= union * percent).select("a", "b").distinct()


def _matches(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches that hold all rows of their keys, from rows in the order of the key."""
    held = None
    for batch in batches:
        if batch.num_rows:
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = held.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield held.slice(0, last)
                held = held.slice(last)
    if held is not None:
        yield held


@F.arrow_udf(BinaryType())
def _low_bytes(tokens: pa.Array) -> pa.Array:
    return pa.array([t.values.to_numpy().astype(np.uint8).tobytes() for t in tokens], pa.binary())


def _candidates(node: np.ndarray, sig: np.ndarray, size: np.ndarray, cls: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of a node and of different classes that may be similar, by sizes and tokens; the first is the smaller."""
    left, right, at, d = [], [], np.arange(len(node)), 0
    while len(at):
        d += 1
        at = at[:np.searchsorted(at, len(node) - d)]
        at = at[node[at + d] == node[at]]
        x, y = size[at], size[at + d]
        some = at[(cls[at] != cls[at + d]) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent)]
        some = some[np.count_nonzero(sig[some] == sig[some + d], axis=1) >= least]
        left.append(some.astype(np.int32))
        right.append(some.astype(np.int32) + np.int32(d))
    return np.concatenate(left), np.concatenate(right)


def _families(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number that each of ``n`` rows reaches over pairs."""
    found = np.arange(n)
    while True:
        now = found.copy()
        np.minimum.at(now, left, found[right])
        np.minimum.at(now, right, found[left])
        now = now[now]
        if (now == found).all():
            return found
        found = now


def _clusters(nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """What small nodes hold together by candidate pairs, once however many trees have it: a row per cluster and member.

    (c1, c2) names a cluster by its members, ``partner`` is the smallest member that this one forms a candidate pair with,
    if that is smaller. Rows of ``nodes``: node, rep, cls, n_shingles, sig.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, "node"):
            node, rep, cls, size = (batch.column(c).to_numpy() for c in ("node", "rep", "cls", "n_shingles"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
            left, right = _candidates(node, sig, size, cls, least, percent)
            family, partner = _families(len(node), left, right), np.full(len(node), len(node))
            np.minimum.at(partner, right, left)
            names = np.zeros((2, len(node)), np.uint64)
            for k in (0, 1):
                np.add.at(names[k], family, mixed(rep.view(np.uint64) + SALTS[k]))
            at = np.flatnonzero(np.bincount(family, minlength=len(node))[family] > 1)
            smaller = partner[at] < len(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[k][family[at]].view(np.int64)) for k in (0, 1)] + [pa.array(rep[at]), pa.array(size[at]), pa.array(
                    rep[np.minimum(partner[at], len(node) - 1)], mask=~smaller)], ["c1", "c2", "rep", "n_shingles", "partner"])

    rows = nodes.repartition("node").sortWithinPartitions("node", "rep")
    return rows.mapInArrow(run, "c1 long, c2 long, rep long, n_shingles long, partner long").groupBy("c1", "c2", "rep").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("partner").alias("partner"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of some sets share, by matrix product over the hashes that occur in more than one."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width = np.zeros((len(sets), len(sets)), np.float32), max(1, COLUMNS // len(sets))
    for first in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        cells = np.zeros((len(sets), int(column[b - 1]) - first + 1), np.float32)
        cells[owner[a:b], column[a:b] - first] = 1
        both += cells @ cells.T
    return both


def _spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect whatever the links of a square matrix connect, one less than what they connect."""
    todo, left, right = np.ones(len(linked), bool), [], []
    for first in range(len(linked)):
        stack = [first] if todo[first] else []
        todo[first] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & todo)
            todo[new] = False
            left += [x] * len(new)
            right += new.tolist()
            stack += new.tolist()
    return left, right


def _settle(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect members of different classes (c1, c2, rep, n_shingles, cls), all pairs compared on full sets.

    A cluster of more than ``ROOM`` shingles is dealt into blocks of half of that, and each two blocks are compared apart, so
    that what a task holds is bounded whatever the texts' lengths.
    """
    totals = clusters.groupBy(F.col("c1").alias("_c1"), F.col("c2").alias("_c2")).agg(
        F.sum("n_shingles").alias("_total"), F.min("cls").alias("_low"), F.max("cls").alias("_high")).where("_low < _high")
    blocks = F.when(F.col("_total") <= ROOM, 1).otherwise(F.ceil(F.col("_total") * 2 / ROOM)).cast("int")
    rows = clusters.join(totals, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))).withColumn("_m", blocks)
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("rep"), "_m").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    rows = rows.select(F.xxhash64("c1", "c2", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("part"), "rep", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, "part"):
            part, rep, cls = (batch.column(c).to_numpy() for c in ("part", "rep", "cls"))
            lists = batch.column("set")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
            a, b = [], []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (cls[low:high] == cls[low]).all():
                    continue
                both = _common([values[ends[i]:ends[i + 1]] for i in range(low, high)])
                size = np.diff(ends[low:high + 1])
                linked = (both * 100 >= (size[:, None] + size - both) * percent) & (cls[low:high, None] != cls[low:high])
                x, y = _spanning(linked)
                a += rep[low:high][x].tolist()
                b += rep[low:high][y].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.join(dealt(sets).withColumnRenamed("doc_id", "rep"), "rep").repartition("part").sortWithinPartitions("part", "rep")
    return rows.select("part", "rep", "cls", "set").mapInArrow(run, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fresh_tokens(sets: DataFrame, ids: DataFrame, tokens: int, turn: int) -> DataFrame:
    """(rep, tokens): minwise tokens of the sets named, by hash functions of this round alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [minwise(s.values.to_numpy().view(np.uint64), tokens, turn).view(np.int32) for s in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(least, pa.list_(pa.int32()))], ["rep", "tokens"])

    some = sets.where(F.size("set") > 0).join(ids, F.col("doc_id") == F.col("rep"), "left_semi")
    return some.mapInArrow(run, "rep long, tokens array<int>").distinct()


def missed(share: float, tokens: int, least: int, picks: list[int], depth: int) -> float:
    """The chance that a pair as similar as ``share`` meets in no tree of a round, if its nodes branch ``depth`` times at most.

    ``picks`` says how many positions each root picked. The tokens of a pair agree in a binomial number of positions, the
    same in all trees of the round; given that, trees are independent branching processes.
    """
    agree = range(tokens + 1)
    chance = np.array([math.comb(tokens, m) * share**m * (1 - share) ** (tokens - m) for m in agree])
    pick, lost = min(1.0, 1 / (share * tokens)), np.zeros(tokens + 1)
    for _ in range(depth):
        lost = (1 - pick + pick * lost) ** np.arange(tokens + 1)
    none = np.ones(tokens + 1)
    for k in picks:
        none *= sum(np.array([math.comb(m, j) * math.comb(tokens - m, k - j) / math.comb(tokens, k) for m in agree]) * lost**j for j in range(k + 1))
    none[:least] = 1
    return float((chance * none).sum())


def links(reps: DataFrame, docs: DataFrame, words: int, percent: int, tokens: int = TOKENS, trees: int = TREES,
          small: int = SMALL, thin: int = THIN, recall: float = RECALL) -> DataFrame:
    """Confirmed links that connect what is similar: (a, b) from representatives (rep, tokens).

    Every tree branches from its root, which picks one token position or more: a node picks positions, each with probability
    1 / (similarity x positions), and a document goes to one child per picked position, named by its token there. A pair as
    similar as the threshold keeps one common child on average at each step. Nodes of up to ``small`` documents compare all
    their pairs by sizes and tokens; what hangs together by such candidate pairs is a cluster, which all trees share. First
    every member is confirmed against its smallest partner, then clusters that still hold several classes compare all their
    pairs on full sets where they are. Only links that connect something leave a task, so rows grow with the documents, not with
    their pairs. In a larger node all compare with one random member. After each step the components of all links so far are known, and pairs inside a component need no comparison any
    more, in any tree. A node with up to ``thin`` documents outside its largest component compares those with all; any other
    node that holds two components or more branches on, ``HOPS`` times at once. So a large group of near copies costs a few comparisons for each of
    its documents, and nothing is capped.

    The chance that a pair at the threshold meets nowhere grows with the depth of its nodes. It is computed for the depth
    that each document has seen; documents for which it exceeds 1 - ``recall`` get another round of ``trees`` trees with
    fresh tokens, until it does for none. ``trees`` grows in the first round if small nodes need it.
    """
    share = percent / 100
    least = max(1, math.floor(tokens * share - 4 * math.sqrt(tokens * share * (1 - share))))
    linked = sets = parts = seen = fresh = None
    rounds, deepest = [], 0
    if (1 - share) ** tokens >= 1 - recall:
        raise ValueError(f"{tokens} tokens cannot reach a recall of {recall}")
    while True:
        rng = np.random.default_rng(11 + len(rounds))
        roots = []
        while len(roots) < trees or not rounds and missed(share, tokens, 0, [len(r) for r in roots], 0) > 1 - recall:
            roots.append(rng.choice(tokens, min(tokens, int(1 / share + rng.random())), replace=False).tolist())
        rounds.append([len(r) for r in roots])
        linked, sets, parts, depths = _round(reps, docs, words, percent, tokens, len(rounds) - 1, roots, small, thin, least, linked, sets, parts)
        deepest = max(deepest, len(depths))
        if not depths:
            drop(sets, parts, fresh)
            return linked
        steps = [d.select("rep", F.lit(i + 1).alias("depth")) for i, d in enumerate(depths)] + ([] if seen is None else [seen])
        seen = stage(reduce(DataFrame.unionByName, steps).groupBy("rep").agg(F.max("depth").alias("depth")), "depths")
        drop(fresh)
        enough = next((d for d in range(deepest, 0, -1) if math.prod(missed(share, tokens, least, r, d) for r in rounds) <= 1 - recall), 0)
        if enough == deepest:
            drop(sets, parts)
            return linked
        again = fresh_tokens(sets, seen.where(F.col("depth") > enough), tokens, len(rounds))
        reps = fresh = stage_dealt(_spread(again, "rep"), "reps", "rep")


def _round(reps: DataFrame, docs: DataFrame, words: int, percent: int, tokens: int, turn: int, roots: list[list[int]], small: int, thin: int,
           least: int, linked: DataFrame | None, sets: DataFrame | None, parts: DataFrame | None) -> tuple:
    """One round of trees: all links so far, the sets, components, and who was in a node that branched, step by step."""
    picks = F.explode(F.array(*[F.xxhash64(F.lit(turn), F.lit(t), F.lit(i), F.col("tokens")[i]) for t, r in enumerate(roots) for i in r]))
    level = _with_classes(reps.select(picks.alias("node"), "rep"), parts)
    size = F.col("n_shingles") if "n_shingles" in reps.columns else F.lit(0)
    heads = dealt(reps).select(F.col("rep").alias("_rep"), F.col("tokens").alias("_tokens"))
    short = dealt(reps).select(F.col("rep").alias("_rep"), size.cast("long").alias("n_shingles"), _low_bytes("tokens").alias("sig"))
    depths, written = [], None
    while True:
        classes = level.groupBy("node", "cls").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node", "rep"), "rep")).alias("l"))
        sizes = classes.groupBy(F.col("node").alias("_node")).agg(
            F.sum("c").alias("n"), F.max(F.struct("c", "cls")).alias("_top"), F.min(F.struct("l", "cls")).alias("_lead"), F.count(F.lit(1)).alias("_k"))
        wide = sizes.where("_k > 1").select("_node", "n", F.col("_top.cls").alias("top"), (F.col("n") - F.col("_top.c")).alias("other"),
                                            F.col("_lead.l.rep").alias("lead"), F.col("_lead.cls").alias("lead_cls"))
        wide = stage(level.join(wide, F.col("node") == F.col("_node")).drop("_node"), "nodes")
        drop(written)
        few = wide.where(F.col("n") <= small).select("node", "rep", "cls")
        few = few.join(short, F.col("rep") == F.col("_rep")).select("node", "rep", "cls", "n_shingles", "sig")
        clusters = stage(_clusters(few, least, percent), "clusters")
        apart = wide.where((F.col("n") > small) & (F.col("other") <= thin))
        large = wide.where((F.col("n") > small) & (F.col("other") > thin))
        pairs = clusters.where("partner is not null").select(F.col("partner").alias("a"), F.col("rep").alias("b"))
        deep, leads = not wide.where(F.col("n") > small).isEmpty(), None
        if deep:
            ends = [F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b")]
            alike = _matches(F.col("tokens"), F.col("_tokens")) >= least
            signed = apart.join(heads.withColumnsRenamed({"_rep": "_r", "_tokens": "tokens"}), F.col("rep") == F.col("_r"))
            rest = signed.where("cls != top").select(F.col("node").alias("_node"), F.col("rep").alias("_rep"), F.col("cls").alias("_cls"), F.col("tokens").alias("_tokens"))
            rest = signed.join(rest, (F.col("node") == F.col("_node")) & (F.col("cls") != F.col("_cls")) & alike).select(*ends)
            star = large.where("cls != lead_cls").select("lead", "rep").distinct().join(
                heads.withColumnsRenamed({"_rep": "_r", "_tokens": "tokens"}), F.col("rep") == F.col("_r"))
            leads = stage(heads.join(large.select("lead").distinct(), F.col("_rep") == F.col("lead"), "left_semi"), "leads")
            star = star.join(leads, (F.col("lead") == F.col("_rep")) & alike).select(*ends)
            pairs = pairs.unionByName(rest).unionByName(star)
        pairs = stage(pairs.distinct(), "pairs")
        if sets is None:
            involved = clusters.select(F.col("rep").alias("doc_id")).unionByName(wide.where(F.col("n") > small).select(F.col("rep").alias("doc_id")))
            sets = shingle_sets(docs, involved, words)
        sure = stage(confirm(pairs, sets, percent), "confirmed")
        linked = sure if linked is None else linked.unionByName(sure)
        parts = _joined_up(parts, sure)
        more = stage(_settle(_with_classes(clusters.select("c1", "c2", "rep", "n_shingles"), parts), sets, percent), "confirmed")
        linked = linked.unionByName(more)
        parts = _joined_up(parts, more)
        drop(pairs, clusters, leads)
        if not deep or large.isEmpty():
            drop(wide)
            return linked, sets, parts, depths
        depths += [stage(large.select("rep").distinct(), "deep")] * HOPS
        chance = int(2**20 * 100 / (percent * tokens))
        kids = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.when(
            F.pmod(F.xxhash64(F.lit("pick"), F.col("node"), i), F.lit(2**20)) < chance, F.xxhash64(F.col("node"), i, F.get("_tokens", i)))),
            lambda x: x.isNotNull())
        below = large.select("node", "rep").join(heads, F.col("rep") == F.col("_rep"))
        for _ in range(HOPS):
            below = below.select(F.explode(kids).alias("node"), "rep", "_tokens")
        level = written = stage(_with_classes(below.select("node", "rep"), parts), "level")
        drop(wide)


def _joined_up(parts: DataFrame | None, new: DataFrame) -> DataFrame:
    """The components of what was linked before and of new links (a, b)."""
    if parts is None:
        return components(new)
    if new.isEmpty():
        return parts
    found = components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
    drop(parts)
    return found


def _with_classes(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows with the class of each ``rep``: its component, or itself."""
    if parts is None:
        return rows.withColumn("cls", F.col("rep"))
    return rows.join(parts, F.col("rep") == F.col("id"), "left").select(*rows.columns, F.coalesce("component", "rep").alias("cls"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tokens: int = TOKENS, trees: int = TREES,
                    doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is that id).

    Documents are linked if 100 x common shingles >= percent x all shingles of both; shingles are runs of ``words`` words,
    lower-cased in A-Z, and fewer words are one shingle. Equal sets are one representative, so copies cost nothing after
    one grouping. Links are confirmed on full sets; trees are added until a pair at the threshold is missed with a computed
    chance of 1 - ``recall`` or less.

    NULL and empty texts have no shingles, link with nothing and are kept. Rows that repeat an id count as one document in
    the links. Rows without an id link with nothing but equal sets: they get the component of those, and are not kept. An
    empty table gives no rows.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = stage(sketches(plain, words, tokens), "sketches")
    reps = known.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    reps = stage_dealt(_spread(reps.where("rep is not null"), "rep"), "reps", "rep")
    both, known = known, stage(known.drop("tokens"), "sketches")
    drop(both)
    linked = links(reps, plain, words, percent, tokens, trees, recall=recall)
    parts = components(linked)
    named = reps.select(F.col("key").alias("_key"), "rep").join(parts, F.col("rep") == F.col("id"), "left")
    named = named.select("_key", F.coalesce("component", "rep").alias("_component"))
    joined = known.join(named, (F.col("key") == F.col("_key")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("_component", "doc_id")
    found = stage(joined.select("doc_id", "n_shingles", component.alias("component_id"),
                                F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near-duplicates")
    drop(known, reps, parts)
    return found


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group: the row of its smallest id. Rows without an id stay."""
    found = near_duplicates(docs, words, percent, doc_id=doc_id, text=text).where("kept").select(F.col("doc_id").alias("_kept"))
    rows = boxed(docs, id=doc_id).withColumn("id", F.col("id").cast("long"))
    kept = rows.join(found.distinct(), F.col("id") == F.col("_kept"), "left_semi").dropDuplicates(["id"])
    return kept.unionByName(rows.where("id is null")).select("row.*")
