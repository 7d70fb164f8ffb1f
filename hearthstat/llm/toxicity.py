"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.llm.common import boxed, stage
from hearthstat.llm.words import chunks, word_terms

EXAMPLES = 1_500
TERMS = 1_500
LEAST_CHI2 = 25.0
LEAST_DOCS = 4
NEIGHBOURS = 15
BLOCK = 64
PRIOR_WEIGHT = 0.25
PREFIXES = (4, 5)
REJECT = 0.7
CHUNK = 1_000_000
RESULT = "struct<score:double,evidence:array<struct<doc_id:long,toxic:int,similarity:double>>>"


@dataclass
class Index:
    """What the scorer needs: sorted terms, their idf, examples in blocks, votes and calibration."""

    terms: np.ndarray
    idf: np.ndarray
    weights: np.ndarray  # terms x examples: the posting list of a term is its row
    highest: np.ndarray  # terms x blocks: the largest weight of a term in a block of examples
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # of an example, so that both classes count as in the population
    base: float
    slope: float = 1.0
    shift: float = 0.0


def _counted(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term number and count of the index's terms in texts, in the order of texts."""
    found, owner = word_terms(texts, PREFIXES)
    at = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
    hit = terms[at] == found if len(terms) else np.zeros(len(found), bool)
    key, count = np.unique(owner[hit] * len(terms) + at[hit], return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), count


def _vector(index: Index, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * index.idf[terms]
    return w / np.sqrt((w * w).sum())


def nearest(index: Index, terms: np.ndarray, query: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The k examples of highest cosine above 0, nearest first, ties in the order of examples.

    A block's bound is the query times the largest weights in it. Blocks are opened by falling bound until the next bound
    is below the k-th cosine found; no other example can be nearer, so the result is exact.
    """
    bounds = query @ index.highest[terms]
    best, at = np.empty(0), np.empty(0, np.int64)
    for b in np.argsort(-bounds, kind="stable"):
        if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
            break
        first = b * BLOCK
        sims = query @ index.weights[terms, first:first + BLOCK]
        here = np.arange(first, first + len(sims))
        take = (sims > 0) & (here != without)
        best, at = np.concatenate((best, sims[take])), np.concatenate((at, here[take]))
        order = np.lexsort((at, -best))[:k]
        best, at = best[order], at[order]
    return at, best


def _share(index: Index, at: np.ndarray, sims: np.ndarray) -> float:
    """The share of toxic votes: an example's vote falls with the square of its distance; the base rate votes too."""
    weight = index.votes[at] * np.square(sims)
    return float(((weight * index.labels[at]).sum() + PRIOR_WEIGHT * index.base) / (weight.sum() + PRIOR_WEIGHT))


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrate(index: Index, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Fit score = sigmoid(slope x logit(share) + shift) on the examples, each without its own vote."""
    x = np.array([_logit(_share(index, *nearest(index, t, _vector(index, t, c), without=i)) if len(t) else index.base)
                  for i, (t, c) in enumerate(vectors)])
    n1, n0 = index.labels.sum(), (1 - index.labels).sum()
    y = np.where(index.labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, a, b = index.votes, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * (a - 1), (w * (p - y)).sum()])
        h = w * p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = max(float(a), 0.0), float(b)


def _score(index: Index, texts: list[str]) -> list[dict]:
    owner, terms, counts = _counted(texts, index.terms)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at, sims = nearest(index, terms[a:b], _vector(index, terms[a:b], counts[a:b])) if b > a else (np.empty(0, np.int64), np.empty(0))
        value = 1 / (1 + np.exp(-(index.slope * _logit(_share(index, at, sims)) + index.shift)))
        out.append({"score": float(value), "evidence": [
            {"doc_id": i, "toxic": y, "similarity": s}
            for i, y, s in zip(index.ids[at].tolist(), index.labels[at].tolist(), sims.tolist(), strict=True)]})
    return out


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """The index of labelled examples, with idf from all documents.

    Examples are up to ``examples`` labelled documents of each class that are not held out, chosen by a hash of their id;
    equal texts count once. Terms are words and word beginnings; of those in ``LEAST_DOCS`` examples or more the up to
    ``terms`` that tell the classes apart best are indexed, by the chi-square of their counts, of at least ``LEAST_CHI2``.
    Both bounds are what makes the index fit each task. Labels other than 0 and 1 are ignored; the highest label of an id counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    docs = docs.select("doc_id", "text")  # other columns may have the names used here
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(examples) for y in (0, 1)]
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    body = F.coalesce("text", F.lit(""))
    texts = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy(F.sha2(body, 256)).agg(F.min("_id").alias("id"), F.max("toxic").alias("toxic"), F.first(body).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("text"), CHUNK):
                found, owner = word_terms(part, PREFIXES)
                order = np.lexsort((found, owner))
                found, owner = found[order], owner[order]
                new = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))) if len(found) else np.empty(0, np.int64)
                rows = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)).take(rows), batch.column("toxic").slice(at, len(part)).take(rows),
                     pa.array(found[new].view(np.int64)), pa.array(np.diff(np.append(new, len(found))))], ["id", "toxic", "term", "n"])
                at += len(part)

    rows = stage(texts.select("id", "toxic", "text").mapInArrow(count, "id long, toxic int, term long, n long"), "example-terms")
    classes = {r[0]: (r[1], r[2]) for r in rows.select("id", "toxic").distinct().groupBy("toxic").agg(F.count(F.lit(1)), F.min("id")).collect()}
    n1, n0 = classes.get(1, (0,))[0], classes.get(0, (0,))[0]
    with1, every = F.sum("toxic").cast("double"), F.count(F.lit(1)).cast("double")
    both = rows.groupBy("term").agg(with1.alias("p"), every.alias("d"))
    q, n = F.col("d") - F.col("p"), n1 + n0
    off = F.greatest(F.lit(0.0), F.abs(F.col("p") * (n0 - q) - q * (n1 - F.col("p"))) - n / 2)
    chi2 = n * off * off / (F.greatest(F.lit(1.0), n1 * F.lit(float(n0))) * F.col("d") * F.greatest(F.lit(1.0), n - F.col("d")))
    picked = both.where(F.col("d") >= LEAST_DOCS).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(terms)
    picked = picked.select("term")
    names = np.sort(np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64))
    place = {int(t): i for i, t in enumerate(names.view(np.int64))}

    entries = rows.join(F.broadcast(picked), "term", "left_semi").toPandas()
    heads = rows.select("id", "toxic").distinct().toPandas().sort_values(["id"])
    ids, y = heads["id"].to_numpy(np.int64), heads["toxic"].to_numpy(np.int64)
    where = {int(i): k for k, i in enumerate(ids)}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names), np.int64)
        total = 0
        for batch in batches:
            for part in chunks(batch.column("text"), CHUNK):
                seen += np.bincount(_counted(part, names)[1], minlength=len(names))
                total += len(part)
        terms_seen = np.append(np.arange(len(names)), -1)
        yield pa.RecordBatch.from_arrays([pa.array(terms_seen), pa.array(np.append(seen, total))], ["term", "n"])

    df = {r[0]: r[1] for r in docs.select("text").mapInArrow(per_batch, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(names))], float))) + 1
    share1 = n1 / max(1, n1 + n0)
    votes = np.where(y == 1, base / max(share1, 1e-9), (1 - base) / max(1 - share1, 1e-9))
    weights = np.zeros((len(names), -(-max(len(ids), 1) // BLOCK) * BLOCK))
    index = Index(names, idf, weights, np.zeros((len(names), weights.shape[1] // BLOCK)), ids, y, votes, base)
    vectors = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
    for i, group in entries.groupby("id"):
        t = np.array([place[int(x)] for x in group["term"]], np.int64)
        c = group["n"].to_numpy(float)
        vectors[where[int(i)]] = (t, c)
        weights[t, where[int(i)]] = _vector(index, t, c)
    index.highest = weights.reshape(len(names), weights.shape[1] // BLOCK, BLOCK).max(2)
    if n1 and n0:
        _calibrate(index, vectors)
    index.ids, index.labels = (np.append(x, np.zeros(weights.shape[1] - len(x), np.int64)) for x in (ids, y))
    index.votes = np.append(votes, np.zeros(weights.shape[1] - len(votes)))
    return index


def score(text: Column, index: Index) -> Column:
    """Score (0 to 1) and evidence (the nearest examples, their labels and cosines) of a text column.

    A text without any indexed term, such as a NULL or empty one, gets the calibrated base rate and no evidence. Texts are
    scored whole and where they are; the index travels with the tasks, its size bounded by examples and terms.
    """
    data = pickle.dumps(index)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        known = pickle.loads(data)
        rows = [row for part in chunks(texts, CHUNK) for row in _score(known, part)]
        kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct(
            [("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])))])
        return pa.array(rows, kind)

    return run(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``reject`` on) and evidence of every document.

    Without labels of both classes the score is the base rate of what is labelled, 0 if nothing is. Rows without an id are
    scored and not held out; repeated rows are scored each; an empty table gives no rows.
    """
    index = fit(docs, labels, examples, terms)
    scored = docs.select("doc_id", score(F.col("text"), index).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"),
                         (F.col("s.score") >= reject).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents whose score stays below ``reject``, as they are."""
    index = fit(docs, labels)
    return boxed(docs, text="text").withColumn("found", score(F.col("text"), index)).where(F.col("found.score") < reject).select("row.*")
