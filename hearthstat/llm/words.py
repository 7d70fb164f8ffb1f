"""Words inside tasks: ids by word with a bounded memory, and hashed word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1_000_000
WORDS_KEPT = 400_000


def chunks(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts of a batch in lists of bounded total length; a longer text is a list of its own."""
    return lists((value.as_py() or "" for value in texts), most)


def lists(texts: Iterable[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Texts in lists as ``chunks`` makes them."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


class WordIds:
    """Ids of words, found once per distinct word while it is remembered.

    ``encode`` gives for a list of non-empty words their ids one after another and how many each has. When more than
    ``kept`` words are known, those seen in one chunk only are forgotten first: memory stays bounded and results don't
    depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = WORDS_KEPT):
        self.encode, self.kept = encode, kept
        self.at = {"": 0}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.many, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _forget(self) -> None:
        n, least = len(self.at), 1
        while (self.seen[1:n] > least).sum() > self.kept // 2:
            least *= 2
        stay = np.concatenate(([0], np.flatnonzero(self.seen[1:n] > least) + 1))
        known = list(self.at)
        self.at = {known[i]: k for k, i in enumerate(stay.tolist())}
        many, first = self.many[stay], self.first[stay]
        ends = np.cumsum(many)
        self.used = int(ends[-1])
        self.flat = self.flat[np.repeat(first - (ends - many), many) + np.arange(self.used)]
        self.first, self.many, self.seen = ends - many, many, np.zeros(len(stay), np.int64)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[:len(old)] = old
            setattr(self, name, new)

    def _learn(self, words: list[str]) -> None:
        ids, many = self.encode(words)
        n = len(self.at)
        for name, need in (("flat", self.used + len(ids)), *((x, n + len(words)) for x in ("first", "many", "seen"))):
            self._room(name, need)
        self.flat[self.used:self.used + len(ids)] = ids
        self.many[n:n + len(words)] = many
        self.first[n:n + len(words)] = self.used + np.cumsum(many) - many
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where each word is remembered; places change with the next call."""
        if len(self.at) > self.kept:
            self._forget()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = len(self.at) + np.arange(len(missing))
            self._learn([distinct[i] for i in missing.tolist()])
        self.seen[place] += 1
        return place[coded.indices.to_numpy()]

    def gather(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after another, and how many each has, from the words' places and how many each document has."""
        many = self.many[at]
        ends = np.cumsum(many)
        flat = self.flat[np.repeat(self.first[at] - (ends - many), many) + np.arange(int(many.sum()))]
        stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return flat, np.diff(stops)

    def lookup(self, words: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the words themselves."""
        return self.gather(self.places(words), counts)


class Cutter:
    """Cuts texts between neighbouring characters whose kinds don't join; ``kinds`` has the kind of every code point.

    With ``lower``, A-Z become a-z in the parts.
    """

    def __init__(self, kinds: np.ndarray, joined: np.ndarray, lower: bool = False):
        self.kinds, self.width, self.cuts, self.lower = kinds, len(joined), ~joined.reshape(-1), lower

    def __call__(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of all texts in turn, and how many each text has; an empty text has none."""
        whole = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = self.kinds[points]
        cut = np.zeros(len(points) + 1, bool)
        cut[1:-1] = self.cuts[kinds[:-1] * self.width + kinds[1:]]
        cut[ends] = True
        cut[0] = len(points) == 0
        bounds = np.flatnonzero(cut)
        if not len(points):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        wide = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(wide, dtype=np.int32)[bounds - 1])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(bounds), pa.py_buffer(offsets), pa.py_buffer(whole.encode().lower() if self.lower else whole.encode()))
        return words, np.diff(np.concatenate(([0], np.searchsorted(bounds, ends, "right") * (ends > 0))))


def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_CODES = _seeds(256, 1)
PLACE_CODES = _seeds(64, 2)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _values(texts: list[str], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A code for every byte from what it is and its place in its word, 0 in gaps; places; word begins; each text's words."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer((b" ".join(raw) + b" ").lower(), np.uint8)
    inside = ~blank[data]
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    begin = np.zeros(len(data), np.int64)
    begin[first] = first
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    longest = int((place * inside).max()) + 1
    codes = PLACE_CODES if longest <= len(PLACE_CODES) else _seeds(longest, 2)
    value = mixed(BYTE_CODES[data] + codes[np.minimum(place, len(codes) - 1)]) * inside
    return value, place, first, np.concatenate(([0], np.searchsorted(first, ends)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more than texts).

    Words are runs of anything but ASCII blanks; A-Z count as a-z.
    """
    value, _, first, bounds = _values(texts, BLANK)
    return (mixed(np.add.reduceat(value, first)) if len(first) else np.empty(0, np.uint64)), bounds


def word_terms(texts: list[str], prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts and the number of the text of each: every word, and its first bytes if it is longer.

    Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z.
    """
    value, place, first, bounds = _values(texts, GAP)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    terms, owners = [mixed(np.add.reduceat(value, first))], [text]
    size = np.add.reduceat((value != 0).astype(np.int64), first)
    for k in prefixes:
        longer = size > k
        terms.append(mixed(np.add.reduceat(value * (place < k), first)[longer] + np.uint64(k)))
        owners.append(text[longer])
    return np.concatenate(terms), np.concatenate(owners)


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's set of hashed shingles of so many words, sorted; fewer words are one shingle, none are no shingle."""
    hashes, first = word_hashes(texts)
    factors = _seeds(words, 3)
    n = len(hashes)
    whole = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        whole += hashes[k:k + len(whole)] * factors[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            short = np.uint64(b - a) + (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minwise(found: np.ndarray, size: int, turn: int = 0) -> np.ndarray:
    """``size`` minimum hash values of a set that is not empty, 32 bits each; every ``turn`` has hash functions of its own."""
    masks, factors = _seeds(size, 4 + 2 * turn), _seeds(size, 5 + 2 * turn)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 4096):
        least = np.minimum(least, ((found[a:a + 4096, None] ^ masks) * factors).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)
