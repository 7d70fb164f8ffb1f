"""Token files: ids ranked by frequency, coded in whole bytes with the sizes in separate control bytes."""

from __future__ import annotations

import os
import string
import struct
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthstat.llm.common import positions, stage, stage_path
from hearthstat.llm.words import Cutter, WordIds, chunks, lists

END_ID = 2
BLOCK_TOKENS = 4_000_000
LOOKED_UP = 4_000_000  # characters whose words are looked up at once
SEPARATOR = ","
JOINED = 512
BLANKS = " \t\n\r"
LATIN = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
MAGIC = b"TKF1"
HEAD = "<4s6q"  # magic, part, number in the part, documents, ids, control bytes, data bytes
BLOCK = ("part int, seq int, n_docs long, n_tokens long, doc_ids binary, known binary, lens binary, ids binary, "
         "seen array<int>, times array<long>")
#: Which of a number's four bytes stay if it has 1 to 4 of them, as one number each; the same for the four numbers of a control byte.
KEPT = np.tril(np.ones((4, 4), bool)).view(np.uint32).reshape(-1)
KEPT_FOUR = np.array([[KEPT[c >> 2 * k & 3] for k in range(4)] for c in range(256)], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2**32: one to four bytes each, two bits of control."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros((-(-len(values) // 4), 4), np.uint8)
    codes.reshape(-1)[:len(values)] = extra
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), values.view(np.uint8)[KEPT[extra].view(bool)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: every control byte looks up which bytes of its four numbers are there, the others are 0."""
    there = KEPT_FOUR[np.frombuffer(control, np.uint8)].reshape(-1)[:n].view(bool)
    values = np.zeros(4 * n, np.uint8)
    values[there] = np.frombuffer(data, np.uint8)
    return values.view("<u4")


class Words:
    """Ids of texts by the tokenizers library, which sees each distinct part of the texts once.

    Texts are cut where the tokenizer's own rules end a word: before white space, and between a Latin letter and an ASCII
    punctuation mark other than the apostrophe. It lower-cases in any case, so A-Z become a-z first. A text that could hold
    an added token goes to the library whole.

    Where the rules before the model do no more to words of Latin letters than to lower-case them and to spell them in bytes,
    such words go through the model with just that before it. Its tokens say which of them end a word.
    """

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer.decode())
        self.marks = {t.content[:2] for t in self.library.get_added_tokens_decoder().values()}
        kinds = np.zeros(0x110000, np.int8)
        kinds[[ord(c) for c in LATIN]] = 1
        kinds[[ord(c) for c in string.punctuation if c != "'"]] = 2
        kinds[[ord(c) for c in BLANKS]] = 3
        joined = np.ones((4, 4), bool)
        joined[1, 2] = joined[2, 1] = joined[0, 3] = joined[1, 3] = joined[2, 3] = False
        comma = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = comma[0] if len(comma) == 1 else None
        self._bare_model()
        self.cut, self.words = Cutter(kinds, joined, lower=True), WordIds(self._encode)

    def _bare_model(self) -> None:
        """Set the model up with lower-cased bytes only, and hold it against the library on all pairs of Latin letters."""
        from tokenizers import Tokenizer, pre_tokenizers as pre

        model = self.library.model
        self.bare = Tokenizer(model)
        self.bare.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.library.get_vocab(with_added_tokens=False), getattr(model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True
        lower = sorted(set(LATIN.lower()))
        some = [*map("".join, product(["", *BLANKS], LATIN)), *map("".join, product(lower, lower)), LATIN]
        self.letters = bool(self.ends.any()) and all(np.array_equal(x, y) for x, y in zip(self._by_model(some), self._one_by_one(some), strict=True))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters go to the bare model; many others are one text, a comma between each two; the rest go by themselves."""
        rest = ~pc.match_substring_regex(pa.array(words, pa.string()), rf"\A[{BLANKS}]*[{LATIN}]+\z").to_numpy(zero_copy_only=False)
        route = rest.astype(np.int8) if self.letters else np.ones(len(words), np.int8)
        for i in np.flatnonzero(route).tolist():
            route[i] += self.separator is None or SEPARATOR in words[i]
        found = [encode([words[i] for i in np.flatnonzero(route == k).tolist()])
                 for k, encode in enumerate((self._by_model, self._joined, self._one_by_one))]
        many = np.empty(len(words), np.int64)
        for k, (_, lens) in enumerate(found):
            many[route == k] = lens
        out, route = np.empty(int(many.sum()), np.int32), np.repeat(route, many)
        for k, (ids, _) in enumerate(found):
            out[route == k] = ids
        return out, many

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(words[a:a + JOINED]).lower() for a in range(0, len(words), JOINED)]
        found = [np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, np.int32), *found])
        ends = np.flatnonzero(self.ends[flat])
        if len(ends) != len(words):  # a letter that the model does not know
            return self._one_by_one(words)
        return flat, np.diff(ends, prepend=-1)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [f" {SEPARATOR} ".join(words[a:a + JOINED]) for a in range(0, len(words), JOINED)]
        found = [np.array([*e.ids, self.separator], np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, np.int32), *found])
        ends = np.flatnonzero(flat == self.separator)
        return flat[flat != self.separator], np.diff(np.concatenate(([-1], ends))) - 1

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(many.sum())), many

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has."""
        odd = np.fromiter((any(m in t for m in self.marks) for t in texts), bool, len(texts))
        if not odd.any():
            return self._looked_up(texts)
        flat, many = self._looked_up(["" if whole else t for t, whole in zip(texts, odd.tolist(), strict=True)])
        ids, many[odd] = self._one_by_one([texts[i] for i in np.flatnonzero(odd).tolist()])
        out, whole = np.empty(len(flat) + len(ids), np.int32), np.repeat(odd, many)
        out[whole], out[~whole] = ids, flat
        return out, many

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut and put together in lists of bounded length, the words of all of them are looked up at once."""
        parts = [self.cut(part) for part in lists(texts)]
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        at = self.words.places(pa.concat_arrays([words for words, _ in parts]))
        stops = np.cumsum([len(words) for words, _ in parts]).tolist()
        found = [self.words.gather(at[b - len(words):b], counts) for b, (words, counts) in zip(stops, parts, strict=True)]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([many for _, many in found])


_WORDS: dict[int, Words] = {}


def _loaded(tokenizer: bytes) -> Words:
    key = hash(tokenizer)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(tokenizer)
    return _WORDS[key]


def cell(values: np.ndarray) -> pa.Array:
    """The bytes of an array as one binary value, which are not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(values)])


def blocks(docs: DataFrame, tokenizer: bytes, end: int = END_ID, most: int = BLOCK_TOKENS) -> DataFrame:
    """Documents in ascending order of id as blocks of about ``most`` ids, written down once.

    The texts are dealt by ranges of the id and sorted; each range is cut into blocks of whole documents. A block also has
    how often it holds each id. Its ids take two bytes each where all are below 2**16, else four.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = _loaded(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            names, known, lens, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
            top = int(ids.max()) + 1
            counts = sum(np.bincount(h[3], minlength=top) for h in held)
            seen = np.flatnonzero(counts)
            times = counts[seen]
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(lens)], pa.int64()),
                   "n_tokens": pa.array([len(ids)], pa.int64()), "doc_ids": cell(names.astype("<i8")), "known": cell(known.astype(np.uint8)),
                   "lens": cell(lens.astype("<i8")), "ids": cell(ids.astype("<u2" if top <= 1 << 16 else "<u4", copy=False)), "seen": pa.array([seen], pa.list_(pa.int32())),
                   "times": pa.array([times], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text"), LOOKED_UP):
                flat, many = words.encode(texts)
                lens = many + 1
                stops = np.cumsum(lens)
                ids, inside = np.full(int(stops[-1]), end, np.uint32), np.ones(int(stops[-1]), bool)
                inside[stops - 1] = False
                ids[inside] = flat
                rows = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                names, known = rows.fill_null(0).to_numpy(), rows.is_valid().to_numpy(zero_copy_only=False)
                a = 0
                while a < len(texts):
                    before = stops[a] - lens[a]
                    b = max(a + 1, int(np.searchsorted(stops, before + most - size, "right")))
                    held.append((names[a:b], known[a:b], lens[a:b], ids[before:stops[b - 1]]))
                    size += int(stops[b - 1] - before)
                    a = b
                    if size >= most or a < len(texts):
                        yield block()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    spark = docs.sparkSession
    order = F.col("doc_id").asc_nulls_last()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    return stage(ordered.mapInArrow(run, BLOCK), "token-blocks")


def frequency_order(found: DataFrame) -> np.ndarray:
    """All ids of the blocks, the most frequent first, equal ones by id. Its size is bounded by the vocabulary."""
    counted = found.select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n"))
    rows = counted.toArrow()
    ids, n = rows.column("seen").to_numpy(), rows.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: bytes, end: int = END_ID, most: int = BLOCK_TOKENS) -> None:
    """Tokenize documents (doc_id, text), append ``end`` to each, and write them in ascending order of id under ``path``.

    ``ids`` holds the token files, one folder per range of ids (part=0, part=1, ...), each a run of blocks: head, document
    ids, whether they are known, numbers of ids, control bytes, data bytes, line end. Data are ranks; ``ranks`` holds the id
    of each rank. ``manifest`` says how many ids stand before each block. All files come from Spark's own writers, so a lost
    executor leaves no half file and any store will do.

    NULL texts are empty and have the end id only; documents without an id come last; repeated rows are documents each. An
    empty table gives an empty file set.
    """
    found = blocks(docs, tokenizer, end, most)
    order = frequency_order(found)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, n, total, *cells in zip(*batch.columns, strict=True):
                doc_ids, known, lens, ids = (c.as_buffer() for c in cells)
                control, data = pack(rank[np.frombuffer(ids, f"<u{len(ids) // total.as_py()}")])
                head = struct.pack(HEAD, MAGIC, part.as_py(), seq.as_py(), n.as_py(), total.as_py(), len(control), len(data))
                whole = np.frombuffer(b"".join((head, doc_ids, known, lens, control, data)), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), cell(whole)], ["part", "block"])

    spark = docs.sparkSession
    coded = found.select("part", "seq", "n_docs", "n_tokens", "doc_ids", "known", "lens", "ids").sortWithinPartitions("part", "seq")
    coded = coded.mapInArrow(code, "part int, block binary").select("part", F.col("block").cast("string").alias("value"))
    coded.write.partitionBy("part").text(f"{path}/ids")
    placed = positions(found.select("part", "seq", "n_docs", "n_tokens"), [], ["part", "seq"], {"start": "n_tokens"}, "token-starts")
    placed.write.parquet(f"{path}/manifest")
    spark.createDataFrame([(bytearray(order.tobytes()),)], "ids binary").write.parquet(f"{path}/ranks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit).

    Files are read by Spark and decoded block by block; the manifest's starts join by block.
    """
    order = bytes(spark.read.parquet(f"{path}/ranks").first()[0])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = np.frombuffer(order, np.uint32)
        for batch in batches:
            for content in batch.column("content"):
                raw, at = memoryview(content.as_buffer()), 0
                while at < len(raw):
                    magic, part, seq, n, total, n_control, n_data = struct.unpack_from(HEAD, raw, at)
                    if magic != MAGIC:
                        raise ValueError("this is no token file")
                    ends = np.cumsum([at + struct.calcsize(HEAD), 8 * n, n, 8 * n, n_control, n_data]).tolist()
                    names, known, lens, control, data = (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))
                    ids = id_of[unpack(control, data, total)].astype("<u4", copy=False)
                    lens = np.frombuffer(lens, "<i8")
                    stops = np.cumsum(lens)
                    offsets = pa.py_buffer(np.concatenate(([0], stops * 4)).astype(np.int32))
                    cells = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids)])
                    absent = np.frombuffer(known, np.uint8) == 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.frombuffer(names, "<i8"), mask=absent),
                         pa.array(stops - lens), pa.array(lens), cells], ["part", "seq", "doc_id", "before", "n_tokens", "ids"])
                    at = ends[-1] + 1

    files = spark.read.format("binaryFile").load(f"{path}/ids").select("content")
    docs = files.mapInArrow(decode, "part int, seq int, doc_id long, before long, n_tokens long, ids binary")
    starts = spark.read.parquet(f"{path}/manifest").select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "start")
    joined = docs.join(starts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: bytes, end: int = END_ID, most: int = BLOCK_TOKENS) -> DataFrame:
    """Write token files in the shared folder and read them back."""
    path = stage_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end, most)
    return read(docs.sparkSession, path)
