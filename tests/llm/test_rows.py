"""Archive, chat, vector and component operators on small frames."""

import numpy as np
import pytest

from hearthstat.llm import ann, chat, graph, nndescent, warc
from hearthstat.llm.common import stage_path


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3), (300, None)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1200)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [(3, "http://a/\r\nx", "é" * 60, 1), (1, "http://b", "é" * 60, 1), (1, "http://b", "é" * 60, 1), (2, None, "short", 1), (4, "u", "short", 1),
         (5, "u", None, 1), (None, "u", "é" * 60, 1), (6, "", "a\r\n\r\nb" * 40, 1), (7, "u", "x" * 300_000, 1), (None, None, None, None)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")


def test_archive_gives_the_pages_back(pages):
    got = warc.archive(pages).collect()
    assert sorted((str(r.page_id), r.payload.decode()) for r in got) == sorted((str(p[0]), p[2] or "") for p in PAGES)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("1", "response", None)] * 2 + [("2", "response", None), ("3", "revisit", 1), ("4", "response", None), ("5", "response", None),
                                                     ("6", "response", None), ("7", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert {r.url for r in got if r.page_id == 3} == {"http://a/%0D%0Ax"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_files_hold_exact_records(spark, pages):
    found = warc.archive(pages)
    path = stage_path(spark, "warc")
    warc.write_warc(found, path)
    back = warc.read_warc(spark, path).collect()
    want = [(bytes(r.header), bytes(r.payload) if r.record_type == "response" else b"") for r in found.collect()]
    assert sorted((bytes(r.header), bytes(r.payload)) for r in back) == sorted(want)
    whole = warc.full_records(found).where("page_id = 2").first().record
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith(b"\r\n\r\nshort\r\n\r\n")


def test_a_changed_payload_fails_the_read(spark, pages):
    path = stage_path(spark, "broken")
    warc.write_archive(pages, path)
    rows = [(r.digest, bytes(r.payload) + b"!") for r in spark.read.parquet(f"{path}/payloads").collect()]
    spark.createDataFrame(rows, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archive(spark, path).collect()


def test_rotation_masks_the_perspective(spark):
    rows = [(1, 0, "system", "Be kind.", "x"), (1, 1, "ann", "Hi <|end|>", "x"), (1, 2, "bob", "Hello", "x"), (1, 3, "ann", None, "x"), (1, None, "", "late", "x"),
            (2, 0, "system", "alone", "x"), (None, 0, "ann", "lost", "x"), (None, 0, "ann", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    found = chat.rotate(turns)
    assert found.count() == 3 * 5 + 1 + 2
    whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(found).collect()}
    ann = whole[1, "ann"]
    assert ann.text == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |end|><|end|>\n<|user:bob|>\nHello<|end|>\n<|assistant|>\n<|end|>\n"
                        "<|user:unknown|>\nlate<|end|>\n")
    assert [ann.text[m.start:m.stop] for m in ann.masks] == ["Hi < |end|><|end|>\n", "<|end|>\n"]
    assert whole[2, None].masks == [] and len(whole[None, "ann"].masks) == 2
    assert chat.rotate(turns.limit(0)).count() == 0


SIZE = 16
ODD = [(900, None), (901, [0.0] * SIZE), (902, [float("nan")] + [1.0] * (SIZE - 1)), (903, [None] + [1.0] * (SIZE - 1)),
       (904, [float("inf")] + [1.0] * (SIZE - 1)), (None, [1.0] * SIZE)]


def clustered(spark, seed, extra=()):
    """Random vectors, groups of near copies of many sizes, exact and scaled copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((150, SIZE)))
    for many in (2, 3, 40, 120):
        centre = rng.standard_normal(SIZE)
        rows += [centre + 0.12 * rng.standard_normal(SIZE) for _ in range(many)]
    rows += [rows[0], rows[0] * 2, rows[0]] + [rows[-1]] * 30
    ids = rng.permutation(len(rows)) * 2
    data = [(int(i), [float(x) for x in r.astype(np.float32)], 1) for i, r in zip(ids, rows, strict=True)] + [(i, v, 0) for i, v in ODD] + list(extra)
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, rep int"), {i: np.array(v) for i, v, k in data if k}


def test_nn_descent_finds_all_links(spark):
    df, vecs = clustered(spark, 3)
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in nndescent.near_vectors(df).collect()}
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(1).tolist(), strict=True))
    part = {i: i for i in ids}
    for _ in ids:
        part = {i: min([part[i], *(part[ids[j]] for j in np.flatnonzero(near[n]))]) for n, i in enumerate(ids)}
    assert {i: got[i].component_id for i in ids} == part
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904)) and not got[None].kept
    assert nndescent.near_vectors(df.limit(0)).count() == 0


def linked_pairs(x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def test_links_between_saturated_families(spark):
    """Two families whose members all have nearer neighbours of their own than those of the other family."""
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    aside = rng.standard_normal(64)
    aside -= one * (aside @ one) / (one @ one)
    two = 0.905 * one + np.sqrt(1 - 0.905**2) * aside * np.linalg.norm(one) / np.linalg.norm(aside)
    rows = np.array([c + 0.2 * rng.standard_normal(64) for c in (one, two) for _ in range(200)]).astype(np.float32).astype(float)
    near = linked_pairs(rows)
    assert near[:200, 200:].any()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in nndescent.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(400)] == near.sum(1).tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_rare_links_are_found(spark):
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((6_000, 64))
    aside = rng.standard_normal((60, 64))
    rows[:60] = 0.92 * rows[60:120] + np.sqrt(1 - 0.92**2) * aside
    rows = rows.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    want = int(linked_pairs(rows).sum())
    assert nndescent.near_vectors(df).agg({"n_links": "sum"}).first()[0] >= 0.95 * want > 50


def test_search_recall_ties_and_odd_rows(spark):
    df, vecs = clustered(spark, 4)
    got = ann.search(df, df.where("vec_id % 10 = 0")).toPandas()
    hits = total = 0
    for q in [i for i in vecs if i % 10 == 0]:
        score = {i: float(v @ vecs[q] / np.sqrt((v @ v) * (vecs[q] @ vecs[q]))) for i, v in vecs.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine.vec_id.is_unique
        assert all(abs(score[i] - s) < 1e-9 for i, s in zip(mine.vec_id, mine.score, strict=True))
        hits, total = hits + len({*want} & {*mine.vec_id}), total + 5
    assert hits >= 0.95 * total
    few = df.where("vec_id in (0, 2, 4)")
    assert len(ann.search(few, few.where("vec_id = 0")).collect()) == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.where("vec_id = 901")).count() == 0


def test_scan_keeps_what_is_near():
    rng = np.random.default_rng(8)
    lost = 0
    for _ in range(50):
        rows = rng.standard_normal((300, 64)).astype(np.float32)
        query = rng.standard_normal(64).astype(np.float32)
        gap = ((rows - query) ** 2).sum(1)
        limit = float(np.sort(gap)[20])
        left, _ = ann.scan(query, [np.ascontiguousarray(rows.T[a:a + 16]) for a in range(0, 64, 16)], limit, 6)
        lost += len({*np.argsort(gap)[:6].tolist()} - {*left.tolist()})
    assert lost <= 3


def brute_nearest(rows, queries, k):
    """Nearest by cosine in double precision, summed from the first component on; ties to the smaller id."""
    def dot(x, y):
        total = 0.0
        for p, q in zip(x, y, strict=True):
            total += p * q
        return total

    out = []
    for q, v in queries.items():
        best = {}
        for i, w in rows:
            if i != q:
                score = dot(v, w) / (np.sqrt(dot(v, v)) * np.sqrt(dot(w, w)))
                best[i] = max(best.get(i, -2.0), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return sorted(out)


def test_search_with_a_repeated_id_and_with_scaled_copies(spark):
    rng = np.random.default_rng(21)
    base = [(i, rng.standard_normal(16).astype(np.float32).astype(float).tolist()) for i in range(300)]
    vec = base[50][1]
    rows = [r for r in base if not 51 <= r[0] <= 55] + [(50, vec)] * 20 + [(i, vec) for i in range(51, 56)]
    one = base[120][1]
    rows += [(1000 + i, [float(np.float32(x * (1 + i / 64))) for x in one]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, df.where("vec_id in (50, 120, 1007)")).select("query_id", "rank", "vec_id", "score").collect()
    want = brute_nearest(rows, {50: vec, 120: one, 1007: dict(rows)[1007]}, 5)
    assert [r[:3] for r in want] == sorted(tuple(r)[:3] for r in got)
    assert [r.vec_id for r in sorted(got) if r.query_id == 50] == [51, 52, 53, 54, 55]
    assert np.allclose([r[3] for r in want], [r.score for r in sorted(got)], atol=1e-15)
