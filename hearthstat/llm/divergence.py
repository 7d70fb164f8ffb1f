"""How far the sources of a language differ in their terms, from exact counts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthstat.llm.common import stage

PART_BYTES = 8 << 20
WIDEST = 256
SCALE = 1_000_000_000


def _letters() -> np.ndarray:
    """Each byte as it counts in a term, 0 where none does: ASCII letters in lower case, all bytes from 0x80."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    table[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


LETTERS = _letters()


def radix_order(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned keys, the last one first: a counting pass per 16-bit digit that differs at all."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Terms of at most 16 bytes as one or two words of 8 bytes, padded with zeros, the first byte highest."""
    out = []
    for base in range(0, int(size.max(initial=1)), 8):
        word = np.zeros(len(start), np.uint64)
        for k in range(base, base + 8):
            word <<= np.uint64(8)
            some = size > k
            word[some] |= data[start[some] + k]
        out.append(word)
    return out


def _runs(order: np.ndarray, keys: Sequence[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, number of rows and of documents of each run of equal keys in the order; documents ascend within a run."""
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    heads = np.flatnonzero(fresh)
    new_doc = fresh.copy()
    new_doc[1:] |= doc[order[1:]] != doc[order[:-1]]
    many = np.diff(np.append(heads, len(order)))
    return order[heads], many, np.add.reduceat(new_doc.astype(np.int64), heads) if len(heads) else many


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Counts and documents of every (group, term), bucket by bucket: (group, count, docs) rows and their terms.

    Terms of up to 8 bytes are packed into one unsigned word, of up to 16 into two, radix-sorted and run-counted. Longer
    ones lie in buckets by width (up to 32, 64, ... bytes), sorted as byte strings; the longest are sorted one by one.
    """
    low = LETTERS[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    owner = np.searchsorted(ends, start, "right")
    size, owned = stop - start, group[owner]
    widths = [0, 8, 16]
    while widths[-1] < WIDEST:
        widths.append(2 * widths[-1])
    for least, most in zip(widths, [*widths[1:], None]):
        some = np.flatnonzero((size > least) & (size <= most) if most else size > least)
        if not len(some):
            continue
        s, n, g, d = start[some], size[some], owned[some].astype(np.uint32), owner[some]
        if most is None:
            terms = [low[a:a + b].tobytes() for a, b in zip(s.tolist(), n.tolist())]
            place = {t: i for i, t in enumerate(sorted(set(terms)))}
            keys = [np.array([place[t] for t in terms], np.uint64)]
            order = radix_order([*keys, g])
        elif most <= 16:
            keys = _words(low, s, n)
            order = radix_order([*reversed(keys), g])
        else:
            at = np.arange(most)
            cell = np.where(at < n[:, None], low[np.minimum(s[:, None] + at, len(low) - 1)], 0).astype(np.uint8)
            keys = [np.ascontiguousarray(cell).view(f"S{most}").ravel()]
            order = np.argsort(keys[0], kind="stable")
            order = order[radix_order([g[order]])]
        first, many, docs = _runs(order, [*keys, g], d)
        yield np.column_stack([g[first], many, docs]).astype(np.int64), [
            low[a:a + b].tobytes() for a, b in zip(s[first].tolist(), n[first].tolist())]


COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(pairs: list, group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        at = pa.array(group)
        named = [pa.array([p[k] for p in pairs], pa.string()).take(at) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*named, terms, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    seen: set[tuple[str, str]] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs: dict[tuple[str, str], int] = {}
        group = np.array([pairs.setdefault(p, len(pairs)) for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
        names = list(pairs)
        if fresh := [i for i, p in enumerate(names) if p not in seen]:
            seen.update(names)
            none = np.zeros(len(fresh), np.int64)
            yield rows(names, np.array(fresh), pa.array([""] * len(fresh)), none, none)
        texts = batch.column(2)
        lens = np.array([len(t.as_buffer()) for t in texts], np.int64) + 1  # a zero byte parts the texts
        total = np.cumsum(lens)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(total, total[a] - lens[a] + PART_BYTES, "right")))
            data = np.frombuffer(b"\0".join(t.as_py() for t in texts[a:b]) + b"\0", np.uint8)
            for counted, terms in count_terms(data, total[a:b] - (total[a] - lens[a]), group[a:b]):
                yield rows(names, counted[:, 0], pa.array(terms, pa.binary()).cast(pa.string()), counted[:, 1], counted[:, 2])
            a = b


def _share(n: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * terms)) in whole numbers: three digits of base 1000, without overflow."""
    d = f"({total} + 2 * {terms})"
    first, second = f"(({n} + 2) * 1000 % {d})", f"((({n} + 2) * 1000 % {d}) * 1000 % {d})"
    return f"(1 + (({n} + 2) * 1000 div {d}) * 1000000 + ({first} * 1000 div {d}) * 1000 + ({second} * 1000 div {d}))"


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    d = total + 2 * terms
    rest, out = n + 2, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest %= d
    return 1 + out


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task over its terms, for each language a square of its sources."""
    sums: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros((0, 0), np.int64))
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            part = batch.filter(pa.array(code == k))
            n = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            total = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)[0]
            p = _shares(n, total[None, :], part.column(3)[0].as_py())
            if sums[lang].shape[0] != n.shape[1]:
                sums[lang] = np.zeros((n.shape[1], n.shape[1]), np.int64)
            for i in range(n.shape[1]):
                q = p[:, i:i + 1]
                sums[lang][i] += ((p - q) * (p - q) // (p + q)).sum(0)
    for lang, square in sums.items():
        a, b = np.indices(square.shape)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * square.size, pa.string()), pa.array(a.ravel()), pa.array(b.ravel()), pa.array(square.ravel())],
                                         ["lang", "i", "j", "value"])


def audit(df: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source: (lang, source, part, item, value, rank).

    Terms are runs of ASCII letters, lower-cased, and characters from U+0080 on. A language keeps those in at least
    ``least_docs`` of its documents. The arithmetic is in whole numbers throughout. Part ``pair`` has a row for every
    other source of the language, part ``term`` the ``top`` kept terms of a source that are commoner in it than in the
    language.

    Texts are counted in numpy where they lie; Spark adds the partial counts by (lang, source, term), then by (lang, term),
    with map-side combine, so a source or language with most rows is no hot key. The row of a kept term holds its counts
    by source, at most as many as the result has rows for one source. NULL text, lang and source count as ''; an empty
    text counts as a document of its group; each repeated row is a document; doc_id and other columns are not looked at;
    an empty table gives no rows.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = df.select(*said).withColumn("text", F.col("text").cast("binary"))
    partial = texts.mapInArrow(_count, COUNTS)
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = stage(by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")), "divergence-terms")
    terms, groups = kept.where("term <> ''"), kept.where("term = ''").select("lang", F.inline("by")).drop("n")  # '' marks the groups
    sizes = terms.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["size"])
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all"))
    named = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("s")).join(langs, "lang", "left")
    named = stage(named.select("lang", F.col("s.source").alias("names"), F.col("s.size").alias("sizes"), F.coalesce("kept", F.lit(0)).alias("kept"),
                               F.coalesce("all", F.lit(0)).alias("all")), "divergence-sources")

    found = F.map_from_entries("by")
    wide = terms.join(named, "lang").select(
        "lang", F.transform("names", lambda s: F.coalesce(F.element_at(found, s), F.lit(0))).alias("n"), "sizes", "kept")
    sums = wide.mapInArrow(_gaps, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    each = named.select("lang", F.posexplode("names").alias("i", "source"), "names")
    each = each.select("lang", "source", "i", F.posexplode("names").alias("j", "item")).where("i <> j")
    pairs = each.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    rows = terms.select("lang", "term", "total", F.inline("by")).join(
        named.select("lang", "kept", "all", F.inline(F.arrays_zip("names", "sizes"))).withColumnsRenamed({"names": "source", "sizes": "size"}), ["lang", "source"])
    p, q = F.expr(_share("n", "size", "kept")), F.expr(_share("total", "`all`", "kept"))
    marks = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    marks = marks.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(marks)
