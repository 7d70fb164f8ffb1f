"""Invariants and small fixtures of the operators."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.operators import allocate as al
from hearthstat.operators import cluster as cl
from hearthstat.operators import household as hh
from hearthstat.operators import metrics, ml, panel, quality, reshape, spatial, standardize
from hearthstat.operators import profile as pf
from hearthstat.operators import thresholds as th
from hearthstat.operators.scale import literal_table
from hearthstat.plans import households, tracts


# Thresholds

def test_threshold_golden_values(spark):
    raw, final = households.thresholds(spark)
    got = {(r.year, r.hh_comp_key): (r.raw_threshold, r.calibrated_threshold) for r in th.spot_check(raw, final).collect()}
    key = "1_adult_0_child"
    assert got[2019, key] == (28838.68, 33838.68)
    assert got[2021, key] == (29992.23, 37492.23)
    assert got[2022, key] == (31879.85, 39379.85)
    assert got[2023, key] == (33348.0, 33348.0)
    row = final.where("year = 2019 and hh_comp_key = '1_adult_0_child'").first()
    assert row.monthly_budget == round(33838.68 / 12, 2) and row.notes.endswith("+5000 for dominant childless buckets")


# Households

def persons(spark):
    rows = [("a", 20, 20, 2, 15, 3), ("a", 17, 21, 1, None, 0), ("a", 25, 21, 3, 16, 1),
            ("b", 18, 20, 3, 16, 6), ("b", 24, 20, 2, 15, 6), ("c", 10, 20, 1, None, 6)]
    return literal_table(spark, rows, "serialno string, agep int, relshipp int, sch int, schg int, esr int")


def test_roll_up(spark):
    got = {r.serialno: r for r in hh.roll_up(hh.person_flags(persons(spark))).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.person_count, a.adult_count, a.likely_college_student_count, a.employed_count) == (3, 2, 1, 1)
    assert a.student_heavy_flag_rule_a == 1 and a.student_heavy_flag_rule_b == 0
    assert b.reference_person_count == 2 and b.student_heavy_flag_rule_b == 1
    assert c.student_share_of_adults is None and c.student_heavy_flag_rule_a == 0


@pytest.mark.parametrize("adults, children, key", [
    (1, 0, "1_adult_0_child"), (1, 3, "1_adult_2plus_child"), (2, 1, "2_adult_1_child"), (4, 0, "3plus_adult_0_child"),
    (3, 2, "3plus_adult_1plus_child"), (0, 0, "other"), (2, None, "other"), (None, 1, "other")])
def test_composition(spark, adults, children, key):
    df = literal_table(spark, [(adults, children)], "adult_count int, noc int")
    assert df.select(hh.composition_key()).first()[0] == key


@pytest.mark.parametrize("income, limit, calibrated, raw", [
    (1.0, 2.0, 1, 1), (2.0, 2.0, 0, 0), (None, 2.0, 0, 0), (1.0, None, None, 0), (-5.0, 2.0, 1, 1)])
def test_below_flag(spark, income, limit, calibrated, raw):
    df = literal_table(spark, [(income, limit)], "hincp_adj_real double, annual_threshold double")
    assert tuple(df.select(hh.below_flag(), hh.below_flag_raw()).first()) == (calibrated, raw)


def test_update_from_keeps_unmatched(spark):
    df = literal_table(spark, [(1, 5.0), (2, 6.0), (3, 7.0)], "k int, v double")
    source = literal_table(spark, [(1, 9.0), (2, None)], "k int, n double")
    assert {r.k: r.v for r in hh.update_from(df, source, ["k"], {"v": "n"}).collect()} == {1: 9.0, 2: None, 3: 7.0}


# Reshaping and profiles

def test_long_and_wide_are_inverse(spark):
    df = literal_table(spark, [(1, 1.0, 2.0), (2, 3.0, 4.0)], "id int, a double, b double")
    back = reshape.to_wide(reshape.to_long(df, ["id"], ["a", "b"]), ["id"], "metric_name", ["a", "b"], F.first("metric_value"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_compare_keeps_one_sided_rows(spark):
    ddl = "year int, metric_group string, metric_name string, metric_value double, pct_of_households double, sort_order int"
    base = literal_table(spark, [(2019, "g", "a", 4.0, 50.0, 10)], ddl)
    other = literal_table(spark, [(2019, "g", "b", 2.0, None, 20)], ddl)
    got = {r.metric_name: r for r in pf.compare_profiles(base, other).collect()}
    assert got["a"].value_diff == -4.0 and got["a"].other_as_pct_of_base == 0.0 and got["a"].sort_order == 10
    assert got["b"].value_diff == 2.0 and got["b"].other_as_pct_of_base is None


def test_auto_cast(spark):
    df = literal_table(spark, [("1", "x"), ("2", "3"), ("4", None), ("5", "y")], "a string, b string")
    assert dict(pf.auto_cast(df, ["a", "b"]).dtypes) == {"a": "double", "b": "string"}


def test_missing_combinations(spark):
    rows = [("t", 2019, "x"), ("t", 2019, "y"), ("t", 2020, "x"), ("u", 1999, "x")]
    got = quality.missing_combinations(literal_table(spark, rows, "t string, y int, c string"), "t", "y", "c", [2019, 2020], ["x", "y"])
    assert {(r.t, r.y): (r.status, r.missing_components) for r in got.collect()} == {
        ("t", 2020): ("year_present_but_missing_components", "y"),
        ("u", 2019): ("missing_year_entirely", "x,y"), ("u", 2020): ("missing_year_entirely", "x,y")}


# Scaling and panel

def test_constant_and_single_groups(spark):
    df = literal_table(spark, [(1, 5.0), (1, 5.0), (2, 7.0), (3, 1.0), (3, 3.0), (3, None)], "y int, v double")
    z = sorted((r.y, r.v, r.z_v) for r in standardize.zscores(df, ["y"], ["v"]).where("v is not null").collect())
    assert [t[2] for t in z] == pytest.approx([0, 0, 0, -2 ** -0.5, 2 ** -0.5])
    m = sorted((r.y, r.v, r.m) for r in standardize.minmax(df, ["y"], "v", "m").where("v is not null").collect())
    assert [t[2] for t in m] == [0.5, 0.5, 0.5, 0.0, 1.0]


def test_dimension_of_an_unbalanced_panel(spark):
    rows = [("a", 2019, "n1", "1"), ("a", 2021, "n2", None), ("b", 2021, "m", "2")]
    got = {r.t: r for r in panel.entity_dimension(
        literal_table(spark, rows, "t string, year int, name string, num string"), "t", "year", ["name", "num"], ["num"], 2).collect()}
    assert (got["a"].name, got["a"].num, got["a"].is_stable) == ("n2", "1", 1)
    assert (got["b"].first_year_seen, got["b"].is_stable) == (2021, 0)


# Allocation

def panel_rows(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(y, f"t{i}", *map(float, rng.normal(50, 10, 3)), float(rng.integers(0, 500))) for y in (2019, 2021) for i in range(n)]
    return literal_table(spark, rows, "year int, area string, a double, b double, proxy double, cap double")


@pytest.mark.parametrize("capacity", [None, "cap"])
def test_allocation_adds_up(spark, capacity):
    totals = literal_table(spark, [(2019, 1234.0), (2021, 99.5)], "year int, control_total double")
    spec = [al.ScoreMetric("a", 1, 1.0), al.ScoreMetric("b", -1, 0.5), al.ScoreMetric("absent", 1, 1.0)]
    out = al.allocate_totals(panel_rows(spark), totals, ["year"], spec, "proxy", capacity)
    check = al.allocation_check(out, ["year"], "area").collect()
    assert all(r.sum_diff_abs < 1e-9 for r in check)
    assert out.where("student_adjustment_multiplier < 0.65 or student_adjustment_multiplier > 1 or area_capacity < 1").count() == 0


def test_allocation_needs_every_total(spark):
    totals = literal_table(spark, [(2019, 1.0)], "year int, control_total double")
    with pytest.raises(ValueError, match="2021"):
        al.allocate_totals(panel_rows(spark), totals, ["year"], [al.ScoreMetric("a", 1, 1.0)])


def test_shares_of_a_zero_total_are_equal(spark):
    df = literal_table(spark, [(1, 0.0), (1, 0.0), (2, 3.0), (2, 1.0)], "y int, v double")
    assert sorted(r.s for r in standardize.share_of_total(df, ["y"], "v", "s").collect()) == [0.25, 0.5, 0.5, 0.75]


# Clusters

def labelled_points(spark, n=60):
    rng = np.random.default_rng(8)
    rows = []
    for y in (1, 2):
        for i in range(n):
            c = i % 3
            rows.append((y, i, c, *map(float, rng.normal([c * 4, -c], 1.0))))
    rows.append((2, n, 9, 100.0, 100.0))  # a cluster of one
    return rows, literal_table(spark, rows, "year int, id int, cluster_id int, p double, q double")


def test_silhouette_by_brute_force(spark):
    rows, df = labelled_points(spark)
    got = {(r.year, r.id): r.silhouette for r in cl.silhouette(df, "year", ["p", "q"]).collect()}
    for y in (1, 2):
        part = [r for r in rows if r[0] == y]
        x, c = np.array([r[3:] for r in part]), np.array([r[2] for r in part])
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        for i, r in enumerate(part):
            own = c == c[i]
            if own.sum() == 1:
                want = 0.0
            else:
                a = d[i, own].sum() / (own.sum() - 1)
                b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
                want = (b - a) / max(a, b)
            assert got[y, r[1]] == pytest.approx(want, abs=1e-9)


def test_matching():
    cost = {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "x"): 1.5, ("b", "y"): 9.0}
    assert sorted(cl.match_one_to_one(cost, ["a", "b"], ["x", "y"])) == [("a", "y"), ("b", "x")]
    assert cl.match_one_to_one(cost, ["a", "b"], ["x"]) == [("a", "x")]


def test_matching_of_many_clusters_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (4, 6), (6, 3)):
        table = rng.integers(0, 6, (n, m)).astype(float)
        left, right = [f"l{i}" for i in range(n)], [f"r{j}" for j in range(m)]
        pairs = cl.match_one_to_one({(left[i], right[j]): table[i, j] for i in range(n) for j in range(m)}, left, right)
        short = table if n <= m else table.T
        want = min(sum(short[i, j] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert len(pairs) == min(n, m) and sum(table[left.index(a), right.index(b)] for a, b in pairs) == want
    big = rng.random((9, 9))
    names = list(range(9))
    assert len(cl.match_one_to_one({(i, j): big[i, j] for i in names for j in names}, names, names)) == 9


def test_equal_totals_go_to_the_first_in_order():
    rng = np.random.default_rng(12)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        table = rng.integers(0, 3, (n, m)).astype(float)
        every = [p for p in permutations(range(m), n)]
        best = min(sum(table[i, j] for i, j in enumerate(p)) for p in every)
        assert cl.assignment(table) == list(min(p for p in every if sum(table[i, j] for i, j in enumerate(p)) == best))


def test_five_hundred_clusters_a_period(spark):
    rng = np.random.default_rng(13)
    places = rng.uniform(0, 100, (500, 2))
    rows, want = [], {}
    for year in (2019, 2021, 2022):
        order = rng.permutation(500)
        for c, k in enumerate(order):
            rows.append((year, c, *map(float, places[k] + rng.normal(0, 1e-3, 2))))
            want[year, c] = int(k)
    rows += [(2022, 500 + i, 1e4 + i, 1e4) for i in range(3)]
    got = cl.align_clusters(literal_table(spark, rows, "year int, cluster_id int, f double, g double"), "year", "cluster_id", ["f", "g"]).collect()
    first = {want[2019, r.cluster_id]: r.aligned_cluster_id for r in got if r.year == 2019}
    assert len(got) == 1503 and sorted(first.values()) == list(range(500))
    assert all(r.aligned_cluster_id == first[want[r.year, r.cluster_id]] for r in got if (r.year, r.cluster_id) in want)
    assert {(r.aligned_cluster_id, r.match_type, r.distance_to_previous) for r in got if r.cluster_id >= 500} == {
        (500 + i, "new_unmatched_cluster", None) for i in range(3)}


def test_clusters_of_many_periods_and_of_the_null_period(spark):
    rng = np.random.default_rng(9)
    rows = [(y, i, *map(float, rng.normal([(i % 3) * 20, -(i % 3) * 20], 1.0))) for y in [*range(150), None] for i in range(9)]
    df = literal_table(spark, rows, "year int, id int, s_p double, s_q double")
    assigned, diagnostics, picks = cl.kmeans_by_period(df, "year", ["p", "q"], ks=[2, 3], restarts=4)
    got = assigned.toPandas()
    assert len(got) == len(rows) and {r.selected_k for r in picks.collect()} == {3} and diagnostics.count() == 302
    assert got[got.year.isna()].cluster_id.nunique() == 3
    assert got.groupby(got.year.fillna(-1)).apply(lambda g: g.groupby(g.id % 3).cluster_id.nunique().max()).max() == 1
    points = cl.pca_points(df, "year", ["p", "q"]).toPandas()
    assert len(points) == len(rows) and points[["pc1", "pc2"]].notna().all().all()


def test_area_under_the_curve_of_very_large_counts(spark):
    df = spark.range(4).selectExpr("'m' AS model", "id % 2 AS actual", "id / 4 AS predicted_probability")
    assert ml.roc_auc(df).first().roc_auc == 0.75


def test_alignment_with_a_new_cluster(spark):
    rows = [(2019, 0, 0.0), (2019, 1, 10.0), (2021, 0, 9.5), (2021, 1, 0.5), (2021, 2, 99.0), (2022, 0, 98.0), (2022, 1, 9.0)]
    got = {(r.year, r.cluster_id): (r.aligned_cluster_id, r.match_type) for r in cl.align_clusters(
        literal_table(spark, rows, "year int, cluster_id int, f double"), "year", "cluster_id", ["f"]).collect()}
    assert got[2021, 0] == (1, "matched_to_previous") and got[2021, 1] == (0, "matched_to_previous")
    assert got[2021, 2] == (2, "new_unmatched_cluster")
    assert got[2022, 0] == (2, "matched_to_previous") and got[2022, 1] == (1, "matched_to_previous")


def test_kmeans_finds_separated_groups(spark):
    rows = [(y, f"{i}", float(i % 2) * 50 + (i % 5) * 0.1, float(i % 2) * 30 + (i % 7) * 0.1)
            for y in (2019, 2021) for i in range(40)]
    df = literal_table(spark, rows, "year int, area string, a double, b double")
    assigned, diagnostics, picks = cl.kmeans_by_period(cl.prepare(df, "year", ["a", "b"]), "year", ["a", "b"], restarts=2)
    assert {r.selected_k for r in picks.collect()} == {2}
    assert {(r.year, r.selected_k) for r in cl.choose_k(diagnostics, "year").collect()} == {(2019, 2), (2021, 2)}
    parts = {(r.year, int(r.area) % 2): set() for r in assigned.collect()}
    for r in assigned.collect():
        parts[r.year, int(r.area) % 2].add(r.cluster_id)
    assert all(len(s) == 1 for s in parts.values()) and parts[2019, 0] != parts[2019, 1]


def test_transitions_balance(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "x"), ("c", 2, "x")]
    paths = cl.label_paths(literal_table(spark, rows, "e string, y int, l string"), "e", "y", "l", [1, 2])
    summary = cl.transition_summary(cl.transition_edges(paths, [1, 2])).first()
    assert (summary.entities_compared, summary.stayed_same_count, summary.changed_count) == (2, 1, 1)
    assert tuple(cl.first_to_last(paths, [1, 2]).first()) == (2, 1, 1, 50.0)


# Models

def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [3, -2, 1]
    y = x @ [1.0, -0.5, 4.0] + rng.normal(size=60)
    rows = [(i, 1 if i < 45 else 2, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = literal_table(spark, rows, "id int, year int, a double, b double, c double, t double")
    train, test = ml.split(df, "year", [1], [2], "t")
    got, importance = ml.fit_regression(train, test, ["a", "b", "c"], "t", ["id"], models=["ridge"])
    xs = (x - x[:45].mean(0)) / x[:45].std(0)
    w = np.linalg.solve(xs[:45].T @ xs[:45] + np.eye(3), xs[:45].T @ (y[:45] - y[:45].mean()))
    want = xs[45:] @ w + y[:45].mean()
    assert np.allclose([r.predicted_target for r in got.orderBy("id").collect()], want, atol=1e-6)
    assert np.allclose([r.signed_value for r in importance.orderBy("feature").collect()], w, atol=1e-6)


def test_logistic_regression_is_at_its_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=200) > 0).astype(int)
    rows = [(i, 1, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = literal_table(spark, rows, "id int, year int, a double, b double, t int")
    got, importance = ml.fit_classification(df, df, ["a", "b"], "t", ["id"], models=["logistic_regression"])
    w = np.array([r.signed_value for r in importance.orderBy("feature").collect()])
    p = np.array([r.predicted_probability for r in got.orderBy("id").collect()])
    xs = (x - x.mean(0)) / x.std(0)
    assert np.allclose(xs.T @ (y - p) - w, 0, atol=0.02)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_auc_with_ties(spark, limit):
    rng = np.random.default_rng(4)
    rows = [("m", int(rng.integers(0, 2)), float(rng.integers(0, 12)) / 12) for _ in range(300)]
    df = literal_table(spark, rows, "model string, actual int, predicted_probability double")
    pos, neg = [s for _, a, s in rows if a], [s for _, a, s in rows if not a]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert ml.roc_auc(df, group_rows=limit).first().roc_auc == pytest.approx(want, abs=1e-12)


def test_no_predicted_positive_gives_zero(spark):
    df = literal_table(spark, [("m", 1, 0, 0.2), ("m", 0, 0, 0.1)],
                       "model string, actual int, predicted_class int, predicted_probability double")
    r = ml.classification_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy, r.roc_auc) == (0.0, 0.0, 0.0, 0.5, 1.0)


# Space

def test_locate_by_brute_force(spark):
    rng = np.random.default_rng(6)
    squares = {f"s{i}": (float(x), float(y), 0.3 + 0.6 * float(rng.random())) for i, (x, y) in enumerate(rng.integers(0, 12, (15, 2)))}
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    vertices = [(k, 0, i, x + dx * s, y + dy * s) for k, (x, y, s) in squares.items() for i, (dx, dy) in enumerate(corners)]
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-30, 40, (80, 2)))]
    shapes = spatial.shapes(literal_table(spark, vertices, "poly_id string, ring int, seq int, x double, y double"))
    got = {r.id: (r.poly_id, r.distance) for r in spatial.locate(
        literal_table(spark, pts, "id int, x double, y double"), shapes, "id").collect()}
    assert len(got) == len(pts)
    for i, px, py in pts:
        gaps = {k: np.hypot(max(x - px, 0, px - x - s), max(y - py, 0, py - y - s)) for k, (x, y, s) in squares.items()}
        assert got[i][1] == pytest.approx(min(gaps.values()), abs=1e-9)
        assert gaps[got[i][0]] == pytest.approx(min(gaps.values()), abs=1e-9)


def test_one_large_polygon_among_many_small_ones(spark):
    rng = np.random.default_rng(2)
    squares = {i: (float(x), float(y), 0.01) for i, (x, y) in enumerate(rng.uniform(0, 100, (2000, 2)))} | {2000: (0.0, 0.0, 100.0)}
    vertices = [(k, 0, i, x + dx * s, y + dy * s) for k, (x, y, s) in squares.items() for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    shapes = spatial.shapes(literal_table(spark, vertices, "poly_id int, ring int, seq int, x double, y double")).cache()
    assert spatial.cells(shapes).count() <= 10 * 2001
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-5000, 5000, (40, 2)))] + [(99, 50.0, 50.0)]
    got = {r.id: (r.poly_id, r.match_type) for r in spatial.locate(literal_table(spark, pts, "id int, x double, y double"), shapes, "id").collect()}
    assert len(got) == 41 and got[99][1] == "within"
    assert spatial.within(literal_table(spark, [(1.0, 1.0)], "x double, y double"), shapes.limit(0)).collect()[0].poly_id is None


def boxes(spark, rows):
    """Shapes of axis-parallel boxes (id, x, y, width, height)."""
    vertices = [(k, 0, i, x + dx * w, y + dy * h) for k, x, y, w, h in rows for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    return spatial.shapes(literal_table(spark, vertices, "poly_id int, ring int, seq int, x double, y double")).cache()


def test_candidates_follow_each_polygons_own_extent(spark):
    rng = np.random.default_rng(9)
    unit = [(i, float(x), float(y), 1.0, 1.0) for i, (x, y) in enumerate(rng.uniform(0, 200, (2000, 2)))]
    pts = literal_table(spark, [tuple(map(float, p)) for p in rng.uniform(0, 200, (500, 2))], "x double, y double")

    def most(shapes):
        rows = spatial.candidates(pts, shapes).groupBy("x", "y").count().agg({"count": "max"}).first()[0]
        found = {(r.x, r.y, r.poly_id) for r in spatial.within(pts, shapes).where("poly_id is not null").collect()}
        return rows, found

    rows, found = most(boxes(spark, [*unit, (9999, -4e5, -4e5, 1e6, 1e6)]))
    assert rows <= 20
    assert found == {(*p, k) for p in pts.collect() for k, x, y, w, h in [*unit, (9999, -4e5, -4e5, 1e6, 1e6)]
                     if x <= p[0] < x + w and y <= p[1] < y + h}
    strips = [(i, 0.0, i * 0.1, 200.0, 0.1) for i in range(2000)]  # as wide as the whole, a point lies in one or two
    assert most(boxes(spark, strips))[0] <= 20
    heap = [(i, 190 + 1e-4 * i, 190 + 1e-4 * i, 9.0, 9.0) for i in range(400)]  # all in one corner of the same cells
    rows, found = most(boxes(spark, heap))
    far = {(x, y) for x, y, _ in found}
    held = spatial.candidates(pts, boxes(spark, heap)).groupBy("x", "y").count().collect()
    assert sum(r["count"] for r in held if (r.x, r.y) not in far) <= 2 * 400


def test_nearest_among_crowds_and_far_outliers(spark):
    rng = np.random.default_rng(10)
    crowd = [(i, float(x), float(y), 1e-3, 1e-3) for i, (x, y) in enumerate(rng.normal(0, 1e-2, (600, 2)))]
    same = [(1000 + i, 5.0, 5.0, 0.5, 0.5) for i in range(20)]
    rows = [*crowd, *same, (2000, 1e6, 1e6, 1.0, 1.0), (2001, -3.0, -3.0, 0.0, 0.0)]
    nodes, leaves, depth = spatial.tree(boxes(spark, rows))
    sizes = {r["count"] for r in leaves.groupBy("_l", "_cx", "_cy").count().collect()}
    assert leaves.count() == len(rows) and max(sizes - {20}) <= 8 and 20 in sizes and depth == spatial.DEPTH
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(-10, 10, (60, 2)), *rng.normal(0, 1e-2, (40, 2)), (9e5, 9e5), (-3.0, -3.0)])]
    got = {r.id: (r.poly_id, r.distance) for r in spatial.nearest(literal_table(spark, pts, "id int, x double, y double"), boxes(spark, rows), "id").collect()}
    for i, px, py in pts:
        gaps = {k: np.hypot(max(x - px, 0, px - x - w), max(y - py, 0, py - y - h)) for k, x, y, w, h in rows}
        assert got[i][1] == pytest.approx(min(gaps.values()), abs=1e-9) and gaps[got[i][0]] == pytest.approx(min(gaps.values()), abs=1e-9)


def test_points_without_coordinates_keep_their_row(spark):
    ring = [("p", 0, i, *c) for i, c in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])]
    shapes = spatial.shapes(literal_table(spark, ring, "poly_id string, ring int, seq int, x double, y double"))
    pts = literal_table(spark, [(1, 9.0, 9.0), (2, None, 1.0)], "id int, x double, y double")
    assert {r.id: r.poly_id for r in spatial.locate(pts, shapes, "id").collect()} == {1: "p", 2: None}


def test_hole_is_outside(spark):
    ring = [("p", 0, i, *c) for i, c in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])]
    hole = [("p", 1, i, *c) for i, c in enumerate([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)])]
    shapes = spatial.shapes(literal_table(spark, ring + hole, "poly_id string, ring int, seq int, x double, y double"))
    pts = literal_table(spark, [(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 9.0, 9.0)], "id int, x double, y double")
    assert {r.id: r.poly_id for r in spatial.within(pts, shapes).collect()} == {1: "p", 2: None, 3: None}


def test_outline_text(spark):
    rows = [("p", 0, i, *c) for i, c in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])] + [
        ("p", 1, i, *c) for i, c in enumerate([(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)])]
    df = literal_table(spark, rows, "poly_id string, ring int, seq int, x double, y double")
    assert spatial.outline_text(df).first().geometry_wkt == (
        "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 1.0 1.0))")


# Metrics as data

def test_lineage_and_inventory(spark):
    lines = {r.metric: r for r in metrics.lineage(spark, tracts.V2_METRICS).collect()}
    assert len(lines) == 45 and lines["pct_hh_income_25k_50k"].sources == "s1901_c01_005e, s1901_c01_006e"
    df = literal_table(spark, [(1.0,)], "poverty_rate double")
    found = {r.final_column_name for r in metrics.inventory(df, tracts.metric_sheet(spark)).where("exists_in_table").collect()}
    assert found == {"poverty_rate"}
