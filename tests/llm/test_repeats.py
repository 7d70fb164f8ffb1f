"""Repeated strings, periodic runs and source distances against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.llm import divergence, periodic, queries, suffix

COLUMNS = "doc_id long, text string, lang string, source string, key string, row string, g long, n long, spans int, runs int, term string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
SAME = "the quick brown fox jumps over the lazy dog again and again until night falls"
ODD = [(1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, SAME, None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, "  \n\t ", "de", None),
       (6, LONG, "en", "a"), (7, LONG + " end", "en", "c"), (None, SAME, "en", "a"), (None, None, None, None), (8, "a" * 3000, "de", "c"),
       (9, "ab " * 900 + "x", "de", "c"), (10, "déjà vu 漢字 😀 " * 40, "fr", "c"), (11, "x y z " * 300, "fr", "d"), (12, "a" * 250, "de", "c")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "r", 1, 2, 3, 4, "t") for r in rows], COLUMNS).coalesce(2)


def some_texts(seed, n):
    """Texts that share passages, hold repeats of their own and come in copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé漢", k=rng.randint(1, 8))) for _ in range(60)]
    shared = [" ".join(rng.choices(words, k=rng.randint(10, 70))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 3):]
                 for _ in range(rng.randint(0, 6))]
        out.append(rng.choice(["", " ", "\n"]).join(parts))
    return out + rng.choices(out, k=n // 5)


# Repeated strings


def removed(texts, least):
    """(bytes, removed, spans, kept) per text from a count of all its strings."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + least] for b in bodies for i in range(len(b) - least + 1))
    out = []
    for b in bodies:
        gone, spans, kept = 0, [], bytearray()
        for i in range(len(b)):
            if i + least <= len(b) and seen[b[i:i + least]] > 1:
                spans = spans + [[i, i + least]] if not spans or i > spans[-1][1] else [*spans[:-1], [spans[-1][0], i + least]]
            if not spans or i >= spans[-1][1]:
                kept.append(b[i])
        gone = sum(y - x for x, y in spans)
        out.append((len(b), gone, [tuple(s) for s in spans], bytes(kept)))
    return out


def test_suffix_array_by_two_stages():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 256])
        text = np.array([rng.randrange(letters) for _ in range(rng.randint(1, 150))], np.uint8)
        depth, data = rng.choice([8, 24, 200]), text.tobytes()
        order = suffix.suffix_array(text, depth).tolist()
        keys = [data[i:i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order) == list(range(len(text))) and keys == sorted(keys)
        least = rng.choice([3, 8, 11, 20])
        seen = Counter(data[i:i + least] for i in range(len(data) - least + 1))
        want = [i + least <= len(data) and seen[data[i:i + least]] > 1 for i in range(len(data))]
        assert suffix.repeated(text, len(text) - np.arange(len(text)), least).tolist() == want
    assert suffix.suffix_array(np.empty(0, np.uint8), 8).tolist() == []


@pytest.mark.parametrize("least, group_rows", [(60, 2000), (60, 3), (41, 2), (24, 4)])
def test_repeats_are_removed_as_by_a_full_count(spark, least, group_rows):
    texts = some_texts(least + group_rows, 60)
    # A passage in many contexts: all windows around it share an anchor.
    texts += [f"{'%x' % (i * 7919)}{'q' * (i % 3)} one passage that everybody quotes, word for word {i * 104729:x}{'z' * (i % 5)}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, sum(b - a for a, b in r.spans), [tuple(s) for s in r.spans], bytes(r.kept)) for r in
           suffix.remove_repeats(df, least=least, group_rows=group_rows).select("row.doc_id", "n_bytes", "spans", "kept").collect()}
    assert got == dict(enumerate(removed(texts, least)))


def test_repeats_of_odd_rows(spark):
    got = suffix.remove_repeats(frame(spark, ODD), least=50).select("row.doc_id", "row.n", "n_bytes", "spans", "kept").collect()
    want = [(r[0], 2, *w) for r, w in zip(ODD, removed([r[1] for r in ODD], 50), strict=True)]
    assert sorted(map(repr, ((r[0], r[1], r[2], sum(b - a for a, b in r[3]), [tuple(s) for s in r[3]], bytes(r[4])) for r in got))) == sorted(map(repr, want))
    assert suffix.remove_repeats(frame(spark, []).where("false")).count() == 0


def test_pieces_of_a_text_longer_than_a_piece(spark):
    rng = random.Random(5)
    body = "".join(rng.choices("abcdefgh", k=2_300_000))
    texts = [body, "start " + body[1_048_000:1_050_000] + " end", body[2_097_100:2_097_500]]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix.remove_repeats(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "spans").collect()}
    assert got == {0: [(1_048_000, 1_050_000), (2_097_100, 2_097_500)], 1: [(6, 2006)], 2: [(0, 400)]}


def test_suffix_query_equals_a_full_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    want = removed([r.text for r in docs], 200)
    assert got == {(d.doc_id, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in zip(docs, want, strict=True)}


# Periodic runs


def all_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            long = j + q - i
            if long >= max(6, 4 * q) and all(any(words[x] != words[x + r] for x in range(i, i + long - r)) for r in range(1, q)):
                out.append((i, long, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(words, runs):
    gone = {i for a, long, q in runs for i in range(a + q, a + long)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(seed, n):
    rng = random.Random(seed)
    words = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a, p = rng.randrange(n - 4), rng.randint(1, n // 4)
            b = rng.randint(a, n)
            words[a:b] = [words[a + (i - a) % p] if a + (i - a) % p < n else "0" for i in range(a, b)]
    return words


def test_runs_equal_brute_force():
    for seed in range(400):
        texts = [periodic_words(seed * 5 + k, random.Random(seed * 5 + k).randint(0, 70)) for k in range(3)]
        flat = np.array([int(w) + 1000 * k for k, words in enumerate(texts) for w in words], np.int64)
        shift, want = 0, []
        for words in texts:
            want += [(a + shift, b, c) for a, b, c in all_runs(words)]
            shift += len(words)
        assert [tuple(r) for r in periodic.find_runs(flat, max(map(len, texts))).tolist()] == want


def test_runs_of_odd_rows(spark):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 10_000]
    got = periodic.periodic_runs(frame(spark, rows)).select("row.doc_id", "row.runs", "runs", "collapsed").collect()
    want = [(r[0], 4, found := all_runs((r[1] or "").encode().split()), without((r[1] or "").split(), found)) for r in rows]
    assert sorted(map(repr, ((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got))) == sorted(map(repr, want))
    assert periodic.periodic_runs(frame(spark, []).where("false")).count() == 0
    long = frame(spark, [(6, LONG + " again" * 50, None, None)])
    assert [tuple(x) for x in periodic.periodic_runs(long).first().runs] == [(60_000, 50, 1)]


def test_periodic_query_equals_brute_force(spark):
    import zlib

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 4000]
    want, planted = {}, 0
    for d in docs:
        words = d.text.encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        joined = without([w.decode() for w in words], runs)
        want[d.doc_id] = (len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(said.encode()).hexdigest(),
                          hashlib.sha256(joined.encode()).hexdigest())
    assert planted > 5
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert {k: got[k] for k in want} == want


# Source distances


def held_against_sql(spark, rows, least_docs, top):
    got = divergence.audit(frame(spark, rows), least_docs=least_docs, top=top)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = queries.ORACLES["op13_source_divergence"].replace(">= 10)", f">= {least_docs})").replace("count(DISTINCT r) >= 10", f"count(DISTINCT r) >= {least_docs}")
    want = con.execute(sql.replace("rank <= 10", f"rank <= {top}")).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_divergence_of_odd_rows(spark):
    rows = [r for r in ODD if r[1] != LONG and r[1] != LONG + " end"]
    rng = random.Random(8)
    words = ["a", "be", "Übermut", "seventeen-letters", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOP", "abcdefghijklmnopq", "w" * 33, "W" * 300, "é" * 200, "z" * 17]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de"]), rng.choice("abcd")) for i in range(80)]
    rows += [(300, SAME, "xx", "lonely"), (301, "no such", "yy", "p"), (302, "words", "yy", "q")]
    want = held_against_sql(spark, rows, 3, 4)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[3] == "w" * 300 for r in want)
    assert divergence.audit(frame(spark, []).where("false")).count() == 0


def test_shares_are_exact_beyond_double_precision(spark):
    rng = random.Random(4)
    cases = [(rng.randrange(10**15), rng.randrange(10**15, 2 * 10**15), rng.randrange(1, 10**6)) for _ in range(200)] + [(5, 5, 1), (0, 0, 1)]
    want = [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]
    assert [int(divergence._shares(np.array([n]), np.array([t]), v)[0]) for n, t, v in cases] == want
    df = spark.createDataFrame(cases, "n long, t long, v long").coalesce(1)
    assert [r[0] for r in df.select(F.expr(divergence._share("n", "t", "v"))).collect()] == want
