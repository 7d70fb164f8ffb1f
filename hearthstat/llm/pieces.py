"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from hearthstat.llm.words import Cutter, WordIds, chunks

SPACE = "▁"
NORMAL, BYTE = 1, 6
NONE = np.iinfo(np.int32).max
#: Ids that are decoded at once, and characters that a round trip works through at once.
DECODED = 100_000
ROUND_CHARS = 250_000


def read_model(path: str) -> bytes:
    """The bytes of a model file on the driver; they travel with the tasks, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message: number, and bytes or an integer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield number, data[at:at + size]
        at += size


def _utf8_byte(cp: np.ndarray, k: int) -> np.ndarray:
    """Byte ``k`` of the UTF-8 form of code points that have more than ``k`` bytes."""
    size = _utf8_size(cp)
    lead = np.where(size == 1, cp, (cp >> (6 * (size - 1))) | np.choose(size - 1, [0, 0xC0, 0xE0, 0xF0]))
    return lead if k == 0 else (cp >> (6 * np.maximum(size - 1 - k, 0))) & 0x3F | 0x80


def _utf8_size(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


class PieceModel:
    """A BPE model with byte fallback, a dummy prefix and no normalisation.

    A text is cut wherever two neighbouring characters stand side by side in no piece: no merge can cross such a place, so
    the parts are encoded apart and equal parts only once.
    """

    def __init__(self, data: bytes):
        top = list(_fields(data))
        rows = [dict(_fields(v)) for n, v in top if n == 1]
        trainer = dict(_fields(next(v for n, v in top if n == 2)))
        rules = dict(_fields(next((v for n, v in top if n == 3), b"")))
        kinds = [r.get(3, NORMAL) for r in rows]
        if (trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or rules.get(2) or rules.get(3, 1) != 1
                or rules.get(4, 1) != 0 or rules.get(5, 1) != 1 or {4, 5} & set(kinds)):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and plain normalisation are supported")
        pieces = [r[1].decode() for r in rows]
        scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        self.size = len(pieces)
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        ids = {p: i for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL}
        longer = [p for p in ids if len(p) > 1]
        # Characters that only longer pieces hold get symbols above the pieces.
        chars = sorted({c for p in longer for c in p} - ids.keys())
        self.extra = np.array([ord(c) for c in chars], np.int64)
        symbols = ids | {c: self.size + k for k, c in enumerate(chars)}
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # Rank 0 is the best score; equal scores share a rank.
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {p: order[scores[i]] for p, i in ids.items()}
        times = np.bincount(list(rank.values()), minlength=len(order))
        # Merges of one rank go side by side unless a merge can bring up a pair that is as good or better.
        self.alone = times > 1
        keys, ranks, merged = [], [], []
        self.width = self.size + len(chars)
        for p in longer:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(rank[p])
                    merged.append(ids[p])
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and rank.get(p[i:j], -1) >= rank[p]:
                        self.alone[rank[p[i:j]]] = True
        order_of = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order_of]
        self.ranks = np.array(ranks, np.int32)[order_of]
        self.merged = np.array(merged, np.int32)[order_of]
        # Decoding: the bytes of every id, one after another.
        said = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind == NORMAL else b"" if kind == 3
                else " ⁇ ".encode() for p, kind in zip(pieces, kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(said), np.uint8)
        self.long = np.array([len(x) for x in said], np.int64)
        self.first = np.cumsum(self.long) - self.long
        self.spaced = np.array([kind == NORMAL and p.startswith(SPACE) for p, kind in zip(pieces, kinds, strict=True)])
        self.byte = np.array([kind == BYTE for kind in kinds])
        # A text can be cut wherever two neighbouring characters stand side by side in no piece.
        inner = sorted({c for p in longer for c in p})
        kind = {c: k for k, c in enumerate(inner, 1)}
        kinds = np.zeros(0x110000, np.int32)
        kinds[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in longer:
            for c, d in zip(p, p[1:], strict=False):
                joined[kind[c], kind[d]] = True
        self.cut, self.words = Cutter(kinds, joined), WordIds(self.encode_words)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of neighbouring symbols, NONE where they don't merge, and their places in the merge table."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.width + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not empty, one after another, and how many each has.

        A round takes the best pair rank of every word, merges all its pairs from the left that don't overlap, and closes
        the gaps; words without a pair leave. Ranks are looked up again only beside merged symbols.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sym, word = self.symbol[points], np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self._pairs(sym[inner], sym[inner + 1])[0]
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = (x[~over] for x in (sym, word, rank, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            index = np.arange(len(at))
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
            taken = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            leads = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            at = at[np.where(self.alone[rank[at]], leads, taken)]
            sym[at] = self.merged[self._pairs(sym[at], sym[at + 1])[1]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            new = at - np.arange(len(at))
            for left in (new, new[new > 0] - 1):
                joined = left + 1 < len(sym)
                joined[joined] = word[left[joined]] == word[left[joined] + 1]
                rank[left[~joined]] = NONE
                left = left[joined]
                rank[left] = self._pairs(sym[left], sym[left + 1])[0]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return self._bytes(sym[order], word[order], len(words))

    def _bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the ids of their UTF-8 bytes."""
        point = np.where(sym < 0, -1 - sym.astype(np.int64), 0)
        if len(self.extra):
            high = sym >= self.size
            point[high] = self.extra[sym[high] - self.size]
            unknown = (sym < 0) | high
        else:
            unknown = sym < 0
        many = np.where(unknown, _utf8_size(point), 1)
        first = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int32)
        out[first[~unknown]] = sym[~unknown]
        for k in range(4):
            some = unknown & (many > k)
            out[first[some] + k] = self.byte_id[_utf8_byte(point[some], k)]
        return out, np.bincount(word, weights=many, minlength=n).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has."""
        return self.words.lookup(*self.cut([SPACE + t.replace(" ", SPACE) if t else "" for t in texts]))

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The texts again: pieces side by side, the dummy prefix removed, every byte that is no UTF-8 replaced."""
        ends = np.cumsum(lens)
        firsts = ends - lens
        many = self.long[ids]
        start = np.cumsum(many) - many
        out = self.bytes[np.repeat(self.first[ids] - start, many) + np.arange(int(many.sum()))].tobytes()
        cut = np.append(start, len(out))
        texts = []
        for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
            skip = 0
            if a < b and not self.byte[ids[a]] and self.spaced[ids[a]]:
                skip = 1
            texts.append(out[cut[a] + skip:cut[b]].decode("utf-8", "each_byte"))
        return texts


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)

_MODELS: dict[int, PieceModel] = {}


def _loaded(data: bytes) -> PieceModel:
    """The model of this worker, built once from its bytes."""
    key = hash(data)
    if key not in _MODELS:
        codecs.register_error("each_byte", _each_byte)
        _MODELS.clear()
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode(text: Column, model: bytes) -> Column:
    """Token ids of a text column as an array, exactly as the sentencepiece library encodes it, without begin or end ids.

    A NULL text counts as empty, and an empty text has no ids. Texts of any length are encoded whole; a batch is worked
    through in chunks of bounded size. Rows are encoded where they are, without a shuffle.
    """
    @F.arrow_udf("array<int>")
    def to_ids(texts: pa.Array) -> pa.Array:
        known = _loaded(model)
        flat, lens = [], []
        for part in chunks(texts):
            ids, many = known.encode(part)
            flat.append(ids)
            lens.append(many)
        ends = np.cumsum(np.concatenate([[0], *lens])).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *flat]), pa.int32()))

    return to_ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, model: bytes) -> Column:
    """The text of an array of token ids, as the library's decode gives it; NULL or no ids give an empty text.

    Control ids vanish, the unknown id becomes a marked gap, and a byte that belongs to no valid character becomes U+FFFD.
    """
    @F.arrow_udf("string")
    def to_text(rows: pa.Array) -> pa.Array:
        known = _loaded(model)
        ends = rows.offsets.to_numpy()
        flat = rows.values.to_numpy(zero_copy_only=False)
        said, a = [], 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + DECODED, "right")) - 1)
            said.append(pa.array(known.decode(flat[ends[a]:ends[b]], np.diff(ends[a:b + 1]).astype(np.int64)), pa.string()))
            a = b
        return pa.concat_arrays(said) if said else pa.array([], pa.string())

    return to_text(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of a text column, and the text that they decode to, in place of that column.

    The same ids and texts as ``encode`` and ``decode`` give, from one pass: a batch is worked through, and handed back, in
    chunks of bounded size, so that a task holds one batch of texts and never the ids and texts of a whole batch.
    """
    kept = [f for f in docs.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(model)
        for batch in batches:
            at = 0
            for part in chunks(batch.column(len(kept)), ROUND_CHARS):
                flat, lens = known.encode(part)
                ends = np.concatenate([[0], np.cumsum(lens)])
                said, a = [], 0
                while a < len(part):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + DECODED, "right")) - 1)
                    said += known.decode(flat[ends[a]:ends[b]], lens[a:b])
                    a = b
                found = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat, pa.int32()))
                rows = batch.slice(at, len(part)).columns[:len(kept)]
                yield pa.RecordBatch.from_arrays([*rows, found, pa.array(said, pa.string())], types.names)
                at += len(part)

    given = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    types = StructType([*kept, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
    return given.mapInArrow(run, types)
