import itertools
import math

import numpy as np
import pytest

from silvaspark.functions import retention as RT
from silvaspark.operators import registration as R
from silvaspark.operators import sampling, spatial, stems, terrain
from silvaspark.operators.components import connected_components


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, 8), (8, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    alone = {x for x in up if sum(root(y) == root(x) for y in up) == 1}
    assert got == {x: root(x) for x in up if x not in alone}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        c = rng.random((n, m))
        g = R.hungarian(c)
        assert len(set(g)) == n
        assert math.isclose(sum(c[i, g[i]] for i in range(n)), min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)))
    assert len(R.match_positions(np.array([[0, 0], [0.4, 0]]), np.array([[0.3, 0], [-0.45, 0]]), 0.5)) == 2
    assert R.match_positions(np.zeros((0, 2)), np.zeros((2, 2)), 1) == []


def test_kabsch():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 3))
    t = math.radians(137)
    rot = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    b = a @ rot.T + [3, -2, 0.5]
    r, s = R.kabsch(a, b)
    assert np.allclose(r, rot) and np.allclose(s, [3, -2, 0.5])
    b[:3] += 4
    r, s, ok = R.kabsch_ransac(a, b)
    assert np.allclose(r, rot) and ok.sum() == 9
    assert R.kabsch(np.outer(np.arange(4), [1, 1, 1.0]), np.outer(np.arange(4), [1, 1, 1.0])) is None
    assert R.kabsch(a[:2], b[:2]) is None


def test_uniforms_do_not_depend_on_order():
    p = np.random.default_rng(2).uniform(-20, 20, (500, 3))
    u = RT.uniforms(7, *p.T)
    assert np.array_equal(u[::-1], RT.uniforms(7, *p[::-1].T)) and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    with pytest.raises(ValueError):
        RT.Retention("other")


def test_budget(spark):
    rng = np.random.default_rng(5)
    a = rng.random(3000)
    df = spark.createDataFrame([(float(1 + 25 * x * x), float(u)) for x, u in zip(a, rng.random(3000), strict=True)], "d double, u double").cache()
    for kind in ("linear_a", "physical"):
        m = sampling.budget_by_rank(df, RT.model(kind), 2000)
        assert sampling.count_kept(df, m) == 2000
        b, kept, n, ok = sampling.budget_by_bisection(df, RT.model(kind), 2000)
        assert ok and abs(kept - 2000) <= 2
    with pytest.raises(ValueError):
        sampling.budget_by_rank(df, RT.model("step"), 10)


def test_range_join_is_a_theta_join(spark):
    rng = np.random.default_rng(4)
    p = [(k, *map(float, v)) for k, v in enumerate(rng.uniform(-2, 2, (200, 3)))]
    df = spark.createDataFrame(p, "pid long, x double, y double, z double")
    want = {a[0]: sum(math.dist(a[1:], b[1:]) <= 0.5 for b in p) for a in p}
    assert {r.pid: r.n for r in spatial.neighbour_counts(df, "pid", ["x", "y", "z"], 0.5).collect()} == want


def test_terrain_of_a_slope(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(-6, 6, (20000, 2))
    z = -1.5 + 0.2 * xy[:, 0] + 0.1 * xy[:, 1] + rng.uniform(-0.0015, 0.0015, len(xy))
    hole = np.hypot(xy[:, 0] - 3, xy[:, 1] + 3) < 1.0
    df = spark.createDataFrame([tuple(map(float, (*p, h))) for p, h in zip(xy[~hole], z[~hole], strict=True)], "x double, y double, z double")
    pl, stats = terrain.build(df)
    at = spark.createDataFrame([(3.0, -3.0, 0.0), (0.1, 0.2, 0.0), (100.0, 0.0, 0.0)], "x double, y double, z double")
    got = {r.x: r.ground for r in terrain.with_terrain(at, pl).collect()}
    assert abs(got[3.0] - (-1.5 + 0.6 - 0.3)) < 0.01 and abs(got[0.1] - (-1.5 + 0.02 + 0.02)) < 0.01 and got[100.0] is None
    assert stats.first()["filled"] > 0


def test_cylinder_checks():
    rng = np.random.default_rng(1)
    a, h = rng.uniform(0, 2 * math.pi, 1500), rng.uniform(0, 3, 1500)
    r = 0.2 + rng.uniform(-0.002, 0.002, 1500)
    p = np.stack([r * np.cos(a) + 5, r * np.sin(a) + 3, h], 1)
    n = np.stack([np.cos(a), np.sin(a), 0 * a], 1)
    f = stems.fit_cylinder(p, n)
    assert f["fail"] == 0 and abs(f["radius"] - 0.2) < 0.01 and f["tilt_deg"] < 1 and f["arc_deg"] == 360
    again = stems.fit_cylinder(p[::-1], n[::-1])
    assert again["radius"] == f["radius"]
    strip = np.abs(a) < math.radians(40)
    g = stems.fit_cylinder(p[strip], n[strip])
    assert g["fail"] == 7 and g["fail_mask"] >> 7 & 1
    off = stems.fit_cylinder(p[strip], n[strip], stems.CylinderParams(check_arc_coverage=False))
    assert off["fail"] == 0 and off["arc_deg"] == g["arc_deg"]
    assert stems.fit_cylinder(p[:5], n[:5])["fail"] == 1


def test_axis_meets_terrain():
    for bx, by in ((0.3, -0.2), (1.5, 0.0), (0.0, 0.0)):
        p = stems.axis_meets_terrain(np.array([1.0, 2.0, 1.4]), np.array([0.1, -0.05, 1.0]), lambda x, y, bx=bx, by=by: bx * x + by * y)
        assert p is not None and abs(p[2] - bx * p[0] - by * p[1]) <= 1e-3
    assert stems.axis_meets_terrain(np.zeros(3), np.array([1.0, 0, 0]), lambda x, y: 0.0) is None
    assert stems.axis_meets_terrain(np.zeros(3), np.array([0, 0, 1.0]), lambda x, y: None) is None


def test_heights_of_many_places():
    rng = np.random.default_rng(11)
    rows = [(i, j, *map(float, rng.normal(size=3))) for i in range(-4, 5) for j in range(-3, 6) if rng.random() < 0.7]
    h = stems.Planes(rows, 0.5)
    x, y = rng.uniform(-3, 3.5, 500), rng.uniform(-2.5, 4, 500)
    want = [h.height(a, b) for a, b in zip(x, y, strict=True)]
    got = h.heights(x, y)
    assert [None if np.isnan(g) else round(float(g), 9) for g in got] == [None if w is None else round(w, 9) for w in want] and None in want
    assert np.isnan(stems.Planes((), 0.5).heights(x, y)).all()


def test_experiment_keeps_all_references(spark):
    from silvaspark.plans import pipeline

    fits = spark.createDataFrame([("step", 1), ("step", 1), ("physical", 2)], "label string, seed int")
    refs = spark.range(1_000_100).selectExpr("id AS ref_id", "0.0D AS rx", "0.0D AS ry")
    got = {(r.label, r.seed): r["count"] for r in pipeline.per_run(fits, refs).groupBy("label", "seed").count().collect()}
    assert got == {("step", 1): 1_000_100, ("physical", 2): 1_000_100}


def test_sparse_assignment_is_the_dense_one():
    """Random sparse graphs: as many pairs and the same total as the dense solver; and one part of 5,000 by 5,000."""
    rng = np.random.default_rng(8)
    for _ in range(150):
        n, m = (int(x) for x in rng.integers(1, 9, 2))
        c = np.where(rng.random((n, m)) < 0.5, rng.integers(0, 6, (n, m)) / 4 if n % 2 else rng.random((n, m)), np.inf)
        got = R.sparse_assignment([[(j, float(c[i, j])) for j in range(m) if np.isfinite(c[i, j])] for i in range(n)], 100.0)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len({j for _, j in pairs}) == len(pairs) and all(np.isfinite(c[i, j]) for i, j in pairs)
        dense = np.hstack([np.where(np.isfinite(c), c, 1e4), np.full((n, n), 100.0)])
        want = R.hungarian(dense)
        assert math.isclose(sum(c[i, j] for i, j in pairs) + 100.0 * (n - len(pairs)), sum(dense[i, j] for i, j in enumerate(want)))
    # a chain in which every row wants its right neighbour's column, so that one late row moves all others
    n = 5000
    edges = [[(i, 1.0 + 1e-4 * i), (i + 1, 0.5)] for i in range(n - 1)] + [[(n - 1, 1.0)]]
    got = R.sparse_assignment(edges, 1e5)
    assert sorted(got) == list(range(n))


@pytest.mark.parametrize("radius,slope", [(5.0, 0.5), (2.0, 0.1), (1.0, 2.0)])
def test_slope_filter_by_tiles(spark, radius, slope):
    rng = np.random.default_rng(9)
    p = terrain.Params(cell=0.5, slope_radius=radius, max_slope=slope, slope_tol=0.3)
    cells = [(i, j) for i in range(-14, 14) for j in range(-10, 10) if rng.random() < 0.7]
    rows = [(i, j, (i + float(rng.random())) * 0.5, (j + float(rng.random())) * 0.5) for i, j in cells]
    rows = [(i, j, x, y, 0.3 * x + (float(rng.random()) * 2 if rng.random() < 0.1 else 0.0), 3) for i, j, x, y in rows]
    df = spark.createDataFrame(rows, "ix int, iy int, x double, y double, z double, n long")
    keep = {(a[0], a[1]) for a in rows if not any(a[:2] != b[:2] and (d := (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= radius * radius and a[4] - b[4] > slope * math.sqrt(d) + 0.3 for b in rows)}
    assert {(r.ix, r.iy) for r in terrain.slope_filter(df, p).collect()} == keep and len(keep) < len(rows)


def test_uniforms_of_columns(spark):
    p = np.concatenate([np.random.default_rng(1).normal(0, 30, (300, 3)), [[0.00005, -0.00005, 0], [1e5, -1e5, 3]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in p], "x double, y double, z double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    rows = RT.with_uniform(df, {"u": RT.start(7), "w": RT.start(2**63 + 5)}).collect()
    x = np.array([[r.x, r.y, r.z] for r in rows])
    assert np.array_equal([r.u for r in rows], RT.uniforms(7, *x.T)) and np.array_equal([r.w for r in rows], RT.uniforms(2**63 + 5, *x.T))
    assert {(r.seed, r.u) for r in RT.each_seed(df, [7, 8]).where("x = 1e5").collect()} == {(s, float(RT.uniforms(s, *np.array([[1e5], [-1e5], [3]]))[0])) for s in (7, 8)}
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    plan = RT.with_uniform(df, {"u": RT.start(7)}).where("u < 0.5")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clusters_of_runs(spark):
    """The clusters of every run are those that its points have alone, dense and sparse, in more runs than one mark holds."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.06, (60, 3)) for c in ((0, 0, 0), (0.5, 0, 0), (1, 1, 1))] + [rng.uniform(0, 2, (80, 3))])
    runs = [sorted({int(r) for r in rng.integers(0, 3, 2)} | ({64 + k % 3} if k % 2 else set())) for k in range(len(x))]
    df = spark.createDataFrame([(k + 5, *map(float, p), r) for k, (p, r) in enumerate(zip(x, runs, strict=True))], "pid long, x double, y double, z double, runs array<int>")
    got = {}
    for r in spatial.clusters_of_runs(df, "pid", 0.15, min_points=3).collect():
        got.setdefault(r.run, set()).add((r.pid, r.cluster))
    from test_selection import linked

    for run in {r for some in runs for r in some}:
        own = [k for k, some in enumerate(runs) if run in some]
        up = [own[i] for i in linked(x[own], 0.15)]
        assert got.get(run, set()) == {(k + 5, c + 5) for k, c in zip(own, up, strict=True) if up.count(c) >= 3}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from silvaspark.operators import components

    steps = []
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or df.localCheckpoint())
    stars = spark.createDataFrame([(2, 1), (3, 1), (9, 5), (7, 5)], "u long, v long")
    found = {tuple(r) for r in components.connected_components(stars).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 5)} and len(steps) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 40), (40, 35)], "u long, v long")
    found = {tuple(r) for r in components.connected_components(chain).collect()}
    assert found == {(k, 0) for k in range(21)} | {(30, 30), (35, 30), (40, 30)}
    assert components.connected_components(stars.limit(0)).count() == 0


def test_bisection_looks_up_where_a_point_is_kept_first(spark, monkeypatch):
    """Counts at a thousand places equal the model's own at each, also for points at a place itself; two passes serve a search."""
    import random

    rnd = random.Random(8)
    rows = [(rnd.uniform(0, 30), rnd.random()) for _ in range(3000)] + [(0.0, 0.5), (0.0, 0.05), (8.0, 0.65), (10.0, 0.1), (10.0, 1.0 - 2.0**-53)]
    df = spark.createDataFrame(rows, "d double, u double").cache()
    asked = []
    take = sampling.Halving.take
    monkeypatch.setattr(sampling.Halving, "take", lambda h, counts: (asked.append((h, list(h.wanted), counts)), take(h, counts))[1])
    for kind in ("linear_a", "physical"):
        asked.clear()
        sampling.budget_by_bisection(df, RT.model(kind), 2000)
        assert 1 <= len(asked) <= 2 and len(asked[0][1]) == 1025
        for h, places, counts in asked:
            for k in range(0, len(places), 41):
                v = h.value(places[k])
                p = lambda d: max(0.1, (d / v) * (d / v)) if kind == "physical" else v + 0.05 * d  # noqa: B023, E731
                assert counts[k] == sum(u < min(max(p(d), 0.0), 1.0) for d, u in rows)
    # no count lies within the tolerance: places come as close as numbers do
    same = spark.createDataFrame([(4.0, 0.5)] * 50, "d double, u double")
    m, kept, n, ok = sampling.budget_by_bisection(same, RT.model("linear_a"), 20)
    assert (kept, n, ok) == (0, 60, False)
