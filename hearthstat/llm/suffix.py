"""Repeated byte strings across texts: suffix arrays by two-stage sorting over the places that can repeat at all."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hearthstat.llm.common import stage

GRAM = 40
PIECE_BITS = 20
PART_BYTES = 1 << 20
GROUP_ROWS = 2_000
SPANS = "array<struct<start:long,stop:long>>"
# Odd multipliers of the rolling hashes; any would do.
BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


# Sorting


def _ahead(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first highest; zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= padded[k:k + len(text)]
    return word


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix from each position is smaller than the next one; the last is not, as the empty one is smallest."""
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    turn = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 0)[turn] > 0, False)


def _sorted_directly(place: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first ``depth`` bytes: eight bytes a round, only where still tied."""
    order = place[np.argsort(ahead[place], kind="stable")]
    if not len(order):
        return order
    key = ahead[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    for shift in range(8, depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        mine = order[at]
        beyond = mine + shift < len(ahead)
        key = np.where(beyond, ahead[np.where(beyond, mine + shift, 0)], 0)
        group = np.cumsum(fresh[at])
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        some = mixed[group]  # groups whose next bytes are all the same stay as they are
        at, mine, key, group = at[some], mine[some], key[some], group[some]
        by = np.lexsort((key, group))
        order[at] = mine[by]
        key, group = key[by], group[by]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte string in the order of at least their first ``depth`` bytes (zeros after the end), by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. The rest are induced by one scan over the buckets of
    first bytes, from the smallest on: in a bucket they come before the sorted ones, in the order of their successors,
    which lie in earlier buckets or, for runs of one byte, in the same bucket a wave before.
    """
    if not len(text):
        return np.empty(0, np.int64)
    rising = _rising(text)
    direct = _sorted_directly(np.flatnonzero(rising), _ahead(text), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        wave = np.concatenate(queue[c]) if queue[c] else np.empty(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket = np.concatenate([*parts, direct[cut[c]:cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        lead = text[before]
        before = before[np.argsort(lead, kind="stable")]
        ends = np.cumsum(np.bincount(lead, minlength=256))
        for d in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            queue[d].append(before[ends[d - 1] if d else 0:ends[d]])
    return np.concatenate(out)


def repeated(text: np.ndarray, room: np.ndarray, least: int) -> np.ndarray:
    """Whether each position starts a string of ``least`` bytes that also starts elsewhere; ``room`` says how many bytes
    of its own text a position has. Neighbours in the suffix array are held against each other by their common prefix.
    """
    order = suffix_array(text, least)
    order = order[room[order] >= least]
    ahead = _ahead(text)
    x, y = order[:-1], order[1:]
    for shift in range(0, least - 7, 8):
        same = ahead[x + shift] == ahead[y + shift]
        x, y = x[same], y[same]
    if least % 8:
        shift = max(least - 8, 0)
        drop = np.uint64(8 * max(8 - least, 0))
        same = (ahead[x + shift] >> drop) == (ahead[y + shift] >> drop)
        x, y = x[same], y[same]
    out = np.zeros(len(text), bool)
    out[x] = out[y] = True
    return out


# Places


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def anchors(text: np.ndarray, valid: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Stretches of neighbouring windows of ``least`` bytes that share an anchor: (first, last, anchor, anchor's hash).

    The anchor of a window is its substring of ``GRAM`` bytes (fewer for short windows) of smallest hash, the leftmost of
    equals. It depends on the window's bytes alone, so equal windows have equal anchors at equal distance.
    """
    gram = min(GRAM, least)
    windows = least - gram + 1
    n = len(text)
    power, inverse = _powers((1 << PIECE_BITS) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
    value = (total[gram:] - total[:-gram]) * inverse[:n - gram + 1]
    value ^= value >> np.uint64(32)
    value *= np.uint64(MIX)
    value ^= value >> np.uint64(29)
    bits = np.uint64(PIECE_BITS)
    low = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64)
    span = 1
    while 2 * span <= windows:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < windows:
        low = np.minimum(low[:len(low) - (windows - span)], low[windows - span:])
    start = np.flatnonzero(valid[:len(low)])
    place = (low[start] & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(start) != 1) | (np.diff(place) != 0)))) if len(start) else start
    first, last, place = start[heads], start[np.append(heads[1:], len(start)) - 1] if len(start) else start, place[heads]
    return first, last, place, value[place].view(np.int64)


MEMBERS = "anchor long, digest binary, key binary, start long, windows int, away int"


def _members(least: int):
    """Anchored stretches of all texts of a task; long texts in pieces that overlap by a window less one byte."""
    most = 1 << PIECE_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for i, body in enumerate(batch.column("body")):
                size = len(body.as_buffer())
                pieces += [(i, a, min(size, a + most)) for a in range(0, max(size - least, 0) + 1, most - least + 1)]
            a = 0
            while a < len(pieces):
                b, size = a, 0
                while b < len(pieces) and (b == a or size + pieces[b][2] - pieces[b][1] <= most):
                    size += pieces[b][2] - pieces[b][1]
                    b += 1
                part = pieces[a:b]
                data = b"".join(memoryview(batch.column("body")[i].as_buffer())[s:e] for i, s, e in part)
                sizes = np.array([e - s for _, s, e in part])
                ends = np.cumsum(sizes)
                valid = np.ones(len(data), bool)
                for e, s in zip(ends.tolist(), (ends - sizes).tolist()):
                    valid[max(s, e - least + 1):e] = False
                first, last, place, value = anchors(np.frombuffer(data, np.uint8), valid, least)
                owner = np.searchsorted(ends, first, "right")
                shift = np.array([s for _, s, _ in part]) - (ends - sizes)
                digest = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), (last + least).tolist())]
                rows = pa.array(np.array([i for i, _, _ in part])[owner])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), pa.array(digest, pa.binary()), batch.column("key").take(rows), pa.array(first + shift[owner]),
                     pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32))],
                    ["anchor", "digest", "key", "start", "windows", "away"])
                a = b

    return scan


INTERVALS = "key binary, start long, stop long"


def _compare(least: int):
    """Repeated windows among the stretches of whole groups, as byte intervals of the stretches that have no equal."""
    def intervals(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        segs = [s.as_py() for s in table.column("seg")]
        sizes = np.array([len(s) for s in segs])
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(segs), np.uint8)
        room = np.repeat(ends, sizes) - np.arange(len(text))
        again = repeated(text, room, least) & np.repeat(table.column("n").to_numpy() == 1, sizes)
        at = np.flatnonzero(again)
        owner = np.searchsorted(ends, at, "right")
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0)))) if len(at) else at
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else at
        own = owner[heads]
        shift = table.column("start").to_numpy()[own] - (ends - sizes)[own]
        keys = table.column("key").take(pa.array(own)).combine_chunks()
        return pa.RecordBatch.from_arrays([keys, pa.array(at[heads] + shift), pa.array(at[tails] + shift + least)], ["key", "start", "stop"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            group, done = batch.column("g").to_numpy(), 0
            for cut in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
                part = batch.slice(done, cut - done)
                if held and size >= PART_BYTES and group[done] != last:
                    yield intervals(held)
                    held, size = [], 0
                held.append(part)
                size += sum(len(s.as_buffer()) for s in part.column("seg"))
                last, done = group[cut - 1], cut
        if held:
            yield intervals(held)

    return scan


def _split(segs: DataFrame, least: int) -> DataFrame:
    """Stretches of oversized groups under two finer keys.

    All windows of a group hold the same ``common`` bytes at ``away``. A window lacks ``least - common`` bytes: it holds
    at least half of them on the left or more than half on the right, so its stretch is cut in two, and each part's key
    takes in the neighbouring bytes that all its windows hold. Equal windows go the same way.
    """
    slack = F.lit(least) - F.col("common")
    half = F.ceil(slack / 2).cast("int")
    edge = F.col("away") - half  # the last window that holds the left half
    windows = F.length("seg") - (least - 1)
    first = F.greatest(F.lit(0), edge + 1)
    keep = F.least(windows, edge + 1)
    left = F.when(edge >= 0, F.struct(
        F.lit(0).alias("side"), F.col("start"), edge.alias("away"), (F.col("common") + half).alias("common"),
        F.substr(F.col("seg"), F.lit(1), keep + (least - 1)).alias("seg")))
    right = F.when(first < windows, F.struct(
        F.lit(1).alias("side"), (F.col("start") + first).alias("start"), (F.col("away") - first).alias("away"),
        (F.col("common") + slack - half + 1).alias("common"), F.substr(F.col("seg"), first + 1, F.length("seg")).alias("seg")))
    parts = segs.select("g", "key", "n", F.explode(F.array_compact(F.array(left, right))).alias("p")).select("g", "key", "n", "p.*")
    shared = F.substr(F.col("seg"), F.col("away") + 1, F.least(F.col("common"), F.lit(least)))
    return parts.withColumn("g", F.xxhash64("g", "side", shared)).withColumn("common", F.least(F.col("common"), F.lit(least))).drop("side")


def _matches(segs: DataFrame, least: int, group_rows: int) -> DataFrame:
    """Intervals of the windows that repeat among stretches of one group; groups too large for a task are cut finer."""
    found, small = [], []
    while True:
        sizes = segs.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.min(F.md5("seg")).alias("lo"), F.max(F.md5("seg")).alias("hi"))
        large = stage(sizes.where(F.col("rows") > group_rows).select("g", (F.col("lo") == F.col("hi")).alias("equal")), "suffix-large")
        none = large.isEmpty()
        small.append((segs if none else segs.join(large, "g", "left_anti")).select("g", "key", "start", "n", "seg"))
        if none:
            break
        rest = segs.join(large, "g")
        found.append(rest.where(F.col("equal") & (F.col("n") == 1)).select("key", "start", (F.col("start") + F.length("seg")).alias("stop")))
        segs = stage(_split(rest.where(~F.col("equal")), least), "suffix-split")
    fitting = reduce(DataFrame.unionByName, small).repartition("g").sortWithinPartitions("g")
    return reduce(DataFrame.unionByName, found, fitting.mapInArrow(_compare(least), INTERVALS))


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals of each key that touch or overlap, joined: (key, spans)."""
    order = W.partitionBy("key").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = intervals.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    each = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def kept_bytes(body: Column, spans: Column) -> Column:
    """The bytes outside the spans, side by side, in time linear in text and spans."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(body).cast("long")))
    gaps = F.zip_with(starts, stops, lambda a, b: F.hex(F.substr(body, (a + 1).cast("int"), (b - a).cast("int"))))
    return F.when(F.size(spans) == 0, body).otherwise(F.unhex(F.array_join(gaps, "")))


def remove_repeats(df: DataFrame, text: str = "text", least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each row's other columns in ``row``, its ``n_bytes``, the ``spans`` covered by repeated strings, and the bytes ``kept``.

    A byte goes if a string of ``least`` bytes of the same text covers it that also starts anywhere else, in this text
    or another one; overlaps count, and all is judged on the input. Matches never cross texts.

    1. Equal texts are kept once with their number; a copied one of ``least`` bytes or more goes whole.
    2. Every window has an anchor (``anchors``). Stretches of windows with one anchor are rows of a few bytes; only
       those whose anchor occurs again go on. Equal stretches (by 128-bit digest) are one class; a class of two or more
       covers its members.
    3. One stretch of each class whose anchor has other classes goes into the suffix array of its group. Groups beyond
       ``group_rows`` are cut by further bytes of context until they fit or hold equal strings only, so a passage that
       stands in a third of all texts fills no task.
    4. Intervals are joined per text.

    Distinct texts lie in a table bucketed by their digest, so that texts are shuffled once. A NULL text is an empty one;
    shorter texts are kept whole; each repeated row is a text of its own, so repeats of long ones go; very long texts are
    worked through in pieces; other columns stay in ``row``; an empty table gives no rows.
    """
    spark = df.sparkSession
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.struct(*others).alias("row"), body.alias("body"))
    nothing = F.array().cast(SPANS)
    size = F.length("body").cast("long").alias("n_bytes")
    short = rows.where(F.length("body") < least).select("row", size, nothing.alias("spans"), F.col("body").alias("kept"))
    long = rows.where(F.length("body") >= least).withColumn("key", F.substr(F.unhex(F.sha2("body", 256)), F.lit(1), F.lit(16)))

    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"suffix_texts_{uuid.uuid4().hex}"
    distinct = long.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("row").alias("row"), F.first("body").alias("body"))
    distinct.write.option("compression", "zstd").bucketBy(buckets, "key").format("parquet").saveAsTable(name)
    texts = spark.table(name)

    members = stage(texts.select("key", "body").mapInArrow(_members(least), MEMBERS), "suffix-members")
    again = stage(members.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "suffix-anchors")
    hits = stage(members.join(again, "anchor"), "suffix-hits")
    one = F.min(F.struct("key", "start", "windows", "away")).alias("one")
    classes = stage(hits.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), one), "suffix-classes")
    whole = hits.join(classes.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    whole = whole.select("key", "start", (F.col("start") + F.col("windows") + (least - 1)).alias("stop"))

    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    picked = classes.join(several, "anchor").select(F.col("anchor").alias("g"), "n", "one.*")
    cut = F.substr(F.col("body"), (F.col("start") + 1).cast("int"), F.col("windows") + (least - 1))
    segs = texts.select("key", "body").join(picked, "key").select(
        "g", "key", "start", "n", "away", F.lit(min(GRAM, least)).alias("common"), cut.alias("seg"))
    parts = _matches(stage(segs, "suffix-segments"), least, group_rows)

    spans = merged(whole.unionByName(parts))
    single = texts.where("copies = 1").join(spans, "key", "left").withColumn("spans", F.coalesce("spans", nothing))
    single = single.select("row", size, "spans", kept_bytes(F.col("body"), F.col("spans")).alias("kept"))
    copied = long.select("row", "key", size).join(texts.where("copies > 1").select("key"), "key", "left_semi")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copied = copied.select("row", "n_bytes", all_of_it.alias("spans"), F.lit(b"").alias("kept"))
    return short.unionByName(single).unionByName(copied)
