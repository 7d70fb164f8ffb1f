"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.llm.common import WORD, boxed, ranks, stage

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7


def words(text: str) -> Column:
    """How many runs of anything but ASCII blanks a text column has."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One slim row per document: id, source and number of words; a NULL or empty text has none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size and its target.

    Sources in code point order, NULL last, weigh ``weights`` in turn. All targets add up to the size of all documents; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight, in rounds, until none is
    above. Each round is one aggregate over the sources; only its two sums come to the driver.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranks(found, [], ["source"], "_place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.lit(most) * F.col("source_size"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    full, level, before = F.lit(False), 0.0, -1
    while True:
        caps, free, stopped = placed.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight"))),
                                         F.count_if(full)).first()
        if stopped == before or not free:
            break
        level, before = (total - (caps or 0)) / free, stopped
        full = F.lit(level) * F.col("_weight") > F.col("_cap")
    target = F.least(F.lit(level) * F.col("_weight"), F.col("_cap").cast("double"))
    return placed.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> Column:
    """A source's random offset in [0, 1) from its name: 16 bits, so that adding it to a whole number is exact."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / 65536


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id",
         text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Within a source the documents stand in the order of size and id, each with ``target / source_size`` expected copies.
    Their running total starts at one random offset; a document is emitted once per whole number that its stretch crosses.
    The order by size makes neighbours alike, so the words taken miss the target by about one long document at most. The
    running total is a rank times a constant, and the rank comes from range-dealt stretches: a hot source is split over
    tasks, and no text is shuffled. Reruns agree.

    NULL or empty texts have size 0 and their copies take no words; a source without words has target 0 and no copies. A
    NULL source is a source of its own, last in order. NULL ids come last in the order. Repeated rows count each; they
    stand next to each other. An empty table gives an empty plan.
    """
    sized = stage(sizes(docs, doc_id, text, source), "mix-sizes")
    goals = targets(sized, weights, most)
    placed = ranks(sized, ["source"], ["size", "doc_id"], "_rank", "mix-order")
    goals = goals.withColumn("_step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("_from", offset(seed)).withColumnRenamed("source", "_source")
    joined = placed.join(goals, placed["source"].eqNullSafe(goals["_source"]))
    crossed = F.floor(F.col("_from") + (F.col("_rank") + 1) * F.col("_step")) - F.floor(F.col("_from") + F.col("_rank") * F.col("_step"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: every row as often as the plan says, with its own columns.

    Rows that repeat id, source and size get the larger number of copies each.
    """
    chosen = plan(docs, weights, most, seed, doc_id, text, source).where("copies > 0")
    chosen = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("copies").alias("copies"))
    rows = boxed(docs, doc_id=doc_id, source=source, text=text).withColumn("size", words("text")).drop("text")
    joined = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
