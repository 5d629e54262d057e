"""Order statistics of groups, ground samples and clusters against brute force, with groups that hold most rows."""

import math

import numpy as np
import pytest

from silvaspark.operators import reports, selection, spatial, terrain


@pytest.fixture
def narrow(monkeypatch):
    """So few rows and steps that small tables go through every branch."""
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "STEPS", 4)


def test_ranked_rows_of_many_groups(spark, narrow):
    rng = np.random.default_rng(1)
    rows = [(0, float(rng.integers(0, 9)), float(rng.integers(0, 4)), float(k % 3)) for k in range(300)]
    rows += [(1, 7.0, 1.0, 2.0)] * 40 + [(2, 1e300, 0.0, 0.0), (2, -1e300, 0.0, 0.0), (2, 0.0, 0.0, 0.0)] + [(3, float(rng.random()), 0.0, 0.0) for _ in range(200)]
    df = spark.createDataFrame([*rows, (4, None, 1.0, 1.0), (4, float("nan"), 1.0, 1.0)], "g int, a double, b double, c double")
    wanted = [(0, r) for r in (0, 7, 150, 298, 299, 300)] + [(1, 0), (1, 39), (1, 40), (2, 0), (2, 1), (2, 2), (3, 10), (3, 199), (4, 0), (5, 0), (3, -1)]
    got = {(r.g, r["rank"]): (r.a, r.b, r.c) for r in selection.ranked(df, ["g"], ["a", "b", "c"], spark.createDataFrame(wanted, "g int, rank long")).collect()}
    by = {g: sorted(r[1:] for r in rows if r[0] == g) for g in range(6)}
    assert got == {(g, r): by[g][r] for g, r in wanted if 0 <= r < len(by[g])}


def test_percentiles_and_spread(spark, narrow):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.choice([0, 0, 0, 1], 400), rng.random(400).round(2))] + [(7, 1.5)]
    df = spark.createDataFrame([*rows, (8, None)], "g int, v double")
    want = {g: sorted(v for k, v in rows if k == g) for g in (0, 1, 7)}
    got = {r.g: r for r in selection.percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert {g: (r.n, r.m, r.p) for g, r in got.items()} == {g: (len(v), v[math.floor(0.5 * (len(v) - 1))], v[math.floor(0.9 * (len(v) - 1))]) for g, v in want.items()}
    got = {r.g: r for r in selection.percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}, between=True).collect()}
    for g, v in want.items():
        assert math.isclose(got[g].m, np.percentile(v, 50)) and math.isclose(got[g].p, np.percentile(v, 90))
    s = {r.g: r for r in reports.spread(df.where("v is not null"), ["g"], "v", (0.25,)).collect()}
    assert all(math.isclose(s[g].share_0, np.mean(np.array(v) < 0.25)) for g, v in want.items())
    assert selection.percentiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def sample(cell, p):
    """By definition: the lowest element with enough later ones within the distance, else the percentile element."""
    o = sorted(cell, key=lambda q: (q[2], q[0], q[1]))
    if len(o) < p.min_points:
        return None
    if p.ground_select == "supported_lowest":
        for k, q in enumerate(o):
            if sum(r[2] <= q[2] + p.support_dz for r in o[k + 1 :]) >= p.support_count:
                return q
    return o[math.floor(p.percentile / 100 * (len(o) - 1))]


@pytest.mark.parametrize("mode", ["supported_lowest", "percentile"])
@pytest.mark.parametrize("seed", range(3))
def test_ground_samples(spark, narrow, mode, seed):
    rng = np.random.default_rng(seed)
    p = terrain.Params(cell=1.0, ground_select=mode, percentile=30.0, support_count=2, support_dz=0.25)
    pts = []
    for cell in range(40):
        n = int(rng.integers(1, 12))
        z = rng.integers(0, 60, n) / 10 if cell % 2 else rng.normal(0, 1, n)
        pts += [(cell + float(rng.integers(1, 9)) / 10, 0.5, float(v)) for v in z]
    pts += [(50.5, 0.5, 3.0)] * 200 + [(50.25, 0.5, 3.0)] * 30 + [(50.5, 0.5, float(v)) for v in (-9, -8.9, -8.0, -1, 2.9, 2.95)]
    pts += [(60.0 + float(rng.random()) * 0.9, 0.5, float(rng.normal(0, 2))) for _ in range(300)]
    got = {(r.ix, r.iy): ((r.x, r.y, r.z), r.n) for r in terrain.ground_samples(spark.createDataFrame(pts, "x double, y double, z double"), p).collect()}
    cells = {}
    for q in pts:
        cells.setdefault((math.floor(q[0]), math.floor(q[1])), []).append(q)
    assert got == {k: (sample(v, p), len(v)) for k, v in cells.items() if sample(v, p) is not None}


def linked(x, eps, strict=False):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    near = d < eps * eps if strict else d <= eps * eps
    up = list(range(len(x)))
    for i in range(len(x)):  # smallest member of what is reached
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        up[i] = min(seen)
    return up


@pytest.mark.parametrize("few", [1024, 3])
def test_clusters_by_boxes_of_cells(spark, monkeypatch, few):
    """Dense blobs, two faces whose points are just within reach, and repeated points; small ``few`` cuts cells up."""
    monkeypatch.setattr(spatial, "FEW", few)
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(c, 0.05, (80, 3)) for c in ((0, 0, 0), (0.42, 0, 0), (1, 1, 1))])
    face = lambda a, b: np.c_[rng.uniform(a, b, 80), rng.uniform(0, 0.5, 80), rng.uniform(0, 0.5, 80)]
    faces = np.concatenate([face(0, 0.05), face(0.149, 0.2)]) + [5, 0, 0]
    x = np.concatenate([blobs, faces, np.repeat(rng.uniform(8, 9, (10, 3)).round(1), 12, axis=0)])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "pid long, x double, y double, z double")
    rows = spatial.clusters(df, "pid", 0.1, min_points=2, max_points=150).collect()
    want = linked(x, 0.1)
    size = {c: want.count(c) for c in set(want)}
    assert {(r.pid, r.cluster, r.size) for r in rows} == {(k, c, size[c]) for k, c in enumerate(want) if 2 <= size[c] <= 150}
    assert spatial.clusters(df.limit(0), "pid", 0.1).count() == 0


def test_merged_points_strictly_within(spark):
    x = np.array([(0, 0), (1, 0), (2.5, 0), (2.5, 0.5), (9, 9)], float)
    df = spark.createDataFrame([(k, 0, *map(float, r), float(k)) for k, r in enumerate(x)], "pid long, scan int, x double, y double, z double")
    got = {(r.pid, r.n, r.x, r.z) for r in spatial.merge_points(df, "pid", 1.0, ["scan"]).collect()}
    assert got == {(0, 1, 0.0, 0.0), (1, 1, 1.0, 1.0), (2, 2, 2.5, 2.5), (4, 1, 9.0, 4.0)}
