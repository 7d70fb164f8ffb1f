"""Periodic runs of words, from a dictionary of basic factors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthstat.llm.words import chunks

RUNS = "array<struct<start:long,length:long,period:long>>"
STRIDE = 32


def _groups(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal names together, positions ascending in each, and where the same name goes on."""
    order = np.argsort(name, kind="stable")
    same = np.zeros(len(name), bool)
    same[1:] = name[order[1:]] == name[order[:-1]]
    return order, same


def _reach(word: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words in a row, from ``at`` on in steps of +1 or -1, equal the word one period later."""
    out = np.zeros(len(at), np.int64)
    some = np.arange(len(at))
    ahead = np.arange(STRIDE) * step
    while len(some):
        x = (at[some] + out[some] * step)[:, None] + ahead
        y = x + period[some][:, None]
        inside = (x >= 0) & (y < len(word))
        differ = ~inside | (word[np.where(inside, x, 0)] != word[np.where(inside, y, 0)])
        stops = differ.any(1)
        out[some] += np.where(stops, differ.argmax(1), STRIDE)
        some = some[~stops]
    return out


def find_runs(word: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least four periods and six words, by start, then period.

    ``word`` numbers the words of many texts side by side such that words of different texts differ; ``longest`` is the
    length of the longest text. A run's words repeat after ``period``, its smallest one, and no neighbour goes on with it.

    Factors of 1, 2, 4, ... words get a name each, from the names of their halves. Where a factor occurs again within
    twice its length, and once more after as much again, the three places form an arithmetic progression whose step is
    proposed as a period; neighbouring proposals of one period are one stretch, which is extended to its ends. A period q
    shows at the level of length q to 2q - 1 at the latest. Stretches found on several levels are kept once. Factors that
    occur once in their text are left out from then on, as all longer ones around them do.
    """
    at, size, found = np.arange(len(word)), 1, []
    name = np.unique(word, return_inverse=True)[1].astype(np.int64) if len(word) else word
    flat, label = name, np.empty(len(word), np.int64)
    while len(at) and 2 * size <= max(longest, 2):
        order, same = _groups(name)
        place = at[order]
        gap = np.zeros(len(place) + 1, np.int64)
        gap[:-2] = np.where(same[1:], place[1:] - place[:-1], 0)  # from each place to the next of its name
        steady = np.flatnonzero((gap[:-1] > 0) & (gap[:-1] <= 2 * size) & (gap[:-1] == gap[1:]))
        first, period = place[steady], gap[steady]
        if len(first):
            by = np.lexsort((first, period))
            first, period = first[by], period[by]
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(first) != 1) | (np.diff(period) != 0))))
            tails = np.append(heads[1:], len(first)) - 1
            step = period[heads]
            start, stop = first[heads], first[tails] + size + np.where(size < step, 0, step)  # up to stop, words equal the one a period later
            start = start - _reach(flat, start - 1, step, -1)
            stop = stop + _reach(flat, stop, step, 1)
            length = stop + step - start
            long = length >= np.maximum(6, 4 * step)
            found.append(np.column_stack([start, length, step])[long])
        again = same.copy()
        again[:-1] |= same[1:]
        stay = np.sort(order[again])
        at, name = at[stay], name[stay]
        label[:] = -1
        label[at] = name
        right = at + size
        both = right < len(word)
        both[both] = label[right[both]] >= 0
        at, left, right = at[both], name[both], label[right[both]]
        pair = left * (len(word) + 1) + right
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    runs = np.unique(np.concatenate([np.empty((0, 3), np.int64), *found]), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _texts(rows: pa.RecordBatch) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Words of the texts in parts of bounded size, with the numbers of their words and where each text ends."""
    for part in chunks(rows.column("text")):
        words = [t.encode("utf-8", "surrogatepass").split() for t in part]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, total)
        yield words, ids + np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)) * max(len(known), 1), ends


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for rows in batches:
        if not rows.num_rows:
            continue
        done = 0
        for words, ids, ends in _texts(rows):
            runs = find_runs(ids, max(map(len, words)))
            owner = np.searchsorted(ends, runs[:, 0], "right")
            begins = ends - np.array([len(w) for w in words])
            cut = np.searchsorted(owner, np.arange(len(words) + 1))
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            stays = np.cumsum(gone)[:-1] == 0
            found, kept = [], []
            for i, w in enumerate(words):
                mine = runs[cut[i]:cut[i + 1]]
                found.append([{"start": a - int(begins[i]), "length": b, "period": c} for a, b, c in mine.tolist()])
                kept.append(b" ".join(w if not len(mine) else [w[k] for k in np.flatnonzero(stays[begins[i]:ends[i]])]))
            row = rows.column("row").slice(done, len(words))
            done += len(words)
            yield pa.RecordBatch.from_arrays([row, pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its other columns in ``row``, its periodic ``runs`` (start, length, period) and the ``collapsed`` text.

    Words are what stands between spaces and the controls 0x09 to 0x0D, numbered from 0. A run is a longest stretch with
    smallest period q of at least 4q and at least 6 words; runs come by start, then period. ``collapsed`` joins by one
    space the words that no run holds beyond its first period. Rows are worked on where they lie: no shuffle, and texts
    are taken in parts of bounded size, a longer one alone. A NULL or empty text has no runs and collapses to an empty
    one; repeated rows are each answered; other columns, whatever their names, stay in ``row``; an empty table gives none.
    """
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = boxed.schema["row"].dataType.simpleString()
    return boxed.mapInArrow(_scan, f"row {kind}, runs {RUNS}, collapsed string")
