"""What keeps joins small: nothing that is copied to cells is broadcast, and what coincides is one row."""

import math
import random

from silvaspark.operators import spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_sorts_and_sends_only_where_points_can_be(spark):
    rnd = random.Random(5)
    a = [(k, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for k in range(150)]
    b = [(k, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for k in range(150)] + [(150 + k, float(k % 3), -1.0, 0.5) for k in range(6)]
    left, right = spark.createDataFrame(a, "i long, ax double, ay double, az double"), spark.createDataFrame(b, "j long, bx double, by double, bz double")
    got = spatial.range_join(left, right, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.5)
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, *p in a for j, *q in b if math.dist(p, q) <= 0.5)


def test_neighbour_counts_shuffle_points_only(spark):
    """Copies carry no id and counts go through no exchange of their own: two exchanges, one for each side of the join."""
    rnd = random.Random(2)
    pts = [(k % 2, k, rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for k in range(120)]
    got = spatial.neighbour_counts(spark.createDataFrame(pts, "scan int, pid long, x double, y double, z double"), "pid", ["x", "y", "z"], 0.5, ["scan"])
    assert plan(got).count("Exchange hashpartitioning") == 2 and "pid_b" not in plan(got)
    a, b = (spark.createDataFrame(pts, "scan int, " + ", ".join(f"{x}{c} double" if c != "pid" else f"{x}id long" for c in ("pid", "x", "y", "z"))) for x in "ab")
    of = lambda wide: sorted((r.aid, r.bid) for r in spatial.range_join(a, b, ["ax", "ay", "az"], ["bx", "by", "bz"], 0.25, ["scan"], wide=wide).collect())
    assert of(1) == of(2) == of(3) and len(of(2)) > 120
    assert {(r.scan, r.pid): r.n for r in got.collect()} == {(s, k): sum(s == t and math.dist(p, q) <= 0.5 for t, _, *q in pts) for s, k, *p in pts}


def test_local_ground_counts_coinciding_points_and_copies_trees(spark):
    trees = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 3.0, 0.0, 1.2)], "kp long, tx double, ty double, tz double")
    pts = [(0.5, 0.5, 1.0)] * 7 + [(-0.9, 0.1, 3.0)] * 2 + [(3.0, 0.9, 0.5)] * 4 + [(3.2, 0.0, 0.9)]
    g = spatial.local_ground(trees, spark.createDataFrame(pts, "gx double, gy double, gz double"), "kp", 1.0, p=0.75)
    assert [line for line in plan(g).splitlines() if "Generate" in line and "gx" in line] == []
    got = {r.kp: (r.n, round(r.ground_z, 9), r.flagged) for r in g.collect()}
    assert got == {1: (9, 1.0, True), 2: (5, 0.5, False)}


def test_local_ground_counts_pairs_by_height(spark):
    """Percentiles equal numpy's, heights that are unknown count as points only; pairs do not go into a percentile's own buffers."""
    import numpy as np

    rnd = random.Random(8)
    trees = [(k, rnd.uniform(-3, 3), rnd.uniform(-3, 3), 2.0) for k in range(200)]
    pts = [(rnd.uniform(-3, 3), rnd.uniform(-3, 3), None if k % 11 == 0 else rnd.randint(0, 9) / 4) for k in range(400)]
    g = spatial.local_ground(spark.createDataFrame(trees, "kp long, tx double, ty double, tz double"), spark.createDataFrame(pts, "gx double, gy double, gz double"), "kp", 1.0, p=0.3)
    assert "ObjectHashAggregate" not in plan(g)
    want = {}
    for k, x, y, _ in trees:
        near = [z for u, v, z in pts if (x - u) ** 2 + (y - v) ** 2 <= 1]
        if len(near) >= 5:
            want[k] = (len(near), np.quantile([z for z in near if z is not None], 0.3))
    got = {r.kp: (r.n, r.ground_z) for r in g.collect()}
    assert len(want) > 150 and got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - q) < 1e-12 for k, (n, q) in want.items())


def test_descriptors_by_blocks_equal_brute_force(spark, monkeypatch):
    """Scans of one and of many blocks, keypoints that coincide, ties, neighbours in line; no pair is shuffled."""
    from silvaspark.operators import keypoints as K

    monkeypatch.setattr(K, "BLOCK", 6)
    rnd = random.Random(3)
    rows = [(s, 100 * s + k, float(rnd.randint(-4, 4)), float(rnd.randint(-4, 4))) for s, n in ((0, 30), (1, 4), (2, 3), (3, 1)) for k in range(n)]
    kps = spark.createDataFrame(rows, "scan long, kp long, x double, y double")
    prm = K.Params(n=11)
    got = K.feature_matrix(kps, prm)
    assert "MapInArrow" in plan(got) and "Window" not in plan(got)
    want, same = {}, {}
    for s, p, x, y in rows:
        others = sorted((math.sqrt((u - x) ** 2 + (v - y) ** 2), q, u - x, v - y) for t, q, u, v in rows if t == s and q != p)
        far = [o for o in others if o[0] >= 1e-9]
        if len(far) < 3:
            continue
        same[s] = same.get(s, 0) + len(others) - len(far)
        for e in range(3):
            ax, ay = far[e][2:]
            for d, q, vx, vy in far:
                t = math.atan2(ax * vy - ay * vx, ax * vx + ay * vy)
                k = min(max(math.floor((t + 2 * math.pi if t < 0 else t) / (2 * math.pi / prm.sectors)), 0), prm.sectors - 1)
                want.setdefault((s, p, e + 1, k), (q, d))
    assert {(r.scan, r.kp, r.encode, r.sector): (r.q, r.d) for r in got.collect()} == want
    first = {}
    for (s, p, e, k), (q, d) in sorted(want.items()):
        first.setdefault((s, p, k + 3), (d, q))
    d = {(r.scan, r.kp, r.dim): (r.val, r.nb) for r in K.descriptors(kps, prm).collect()}
    assert {k: v for k, v in d.items() if k[2] >= 3} == first
    assert {r.scan: r.coincident for r in K.descriptor_stats(kps, prm).collect()} == same


def test_assignment_streams_parts(spark):
    """Small connected parts, many of them, go through a task as a stream of rows; totals equal the dense solver's."""
    import numpy as np

    from silvaspark.operators import registration as R

    rnd = random.Random(9)
    side = lambda n: [(k, i, rnd.uniform(0, 6), rnd.uniform(0, 6)) for k in (0, 1) for i in range(n)]
    det, ref = side(40), side(30)
    d = spark.createDataFrame(det, "scan long, det_id long, dx double, dy double")
    r = spark.createDataFrame(ref, "scan long, ref_id long, rx double, ry double")
    got = R.assign_positions(d, r, 0.7, ["scan"])
    assert "FlatMapGroupsInPandas" not in plan(got)
    got = got.collect()
    for k in (0, 1):
        a, b = (np.array([p[2:] for p in x if p[0] == k]) for x in (det, ref))
        want = R.match_positions(a, b, 0.7)
        mine = [x for x in got if x.scan == k]
        assert len({x.det_id for x in mine}) == len({x.ref_id for x in mine}) == len(mine) == len(want)
        assert abs(sum(x.d for x in mine) - sum(x[2] for x in want)) < 1e-9
        assert all(abs(math.dist(a[x.det_id], b[x.ref_id]) - x.d) < 1e-12 for x in mine)


def test_descriptors_are_compared_by_blocks(spark, monkeypatch):
    """Gates, scores and agreements of all pairs equal brute force, over scans of one and of many blocks; pairs are not shuffled."""
    from silvaspark.operators import keypoints as K

    monkeypatch.setattr(K, "BLOCK", 6)
    rnd = random.Random(4)
    rows = [(s, 100 * s + k, rnd.uniform(-4, 4), rnd.uniform(-4, 4)) for s, n in ((0, 30), (1, 5), (2, 3)) for k in range(n)]
    moved = [(s, k, x + 0.01, y) for s, k, x, y in rows if k % 3]
    prm = K.Params(n=11)
    sides = [spark.createDataFrame(r, "scan long, kp long, x double, y double") for r in (rows, moved)]
    a, b = (K.packed(k, prm) for k in sides)
    one, two = ({}, {})
    for k, into in zip(sides, (one, two), strict=True):
        for r in K.descriptors(k, prm).collect():
            into.setdefault((r.scan, r.kp), {})[r.dim] = (r.val, r.nb)
    agree, dc = set(), {}
    for (s, i), v in one.items():
        for (t, j), w in two.items():
            same = [d for d in v if d in w and abs(v[d][0] - w[d][0]) < 0.3] if s == t else []
            agree |= {(s, i, j, d, v[d][1], w[d][1]) for d in same if d > 2}
            if any(d < 3 for d in same):
                dc[s, i, j] = sum(d > 2 for d in same)
    got = K.dc_scores(a, b, 0.3)
    assert "MapInArrow" in plan(got) and "HashAggregate(keys=[scan#" not in plan(got).split("MapInArrow")[0]
    assert {(r.scan, r.i, r.j): r.dc for r in got.collect()} == dc and 0 in dc.values()
    assert {tuple(r) for r in K.gatekeeper(a, b, 0.3).collect()} == set(dc)
    names = ["scan", "i", "j", "dim", "na", "nb"]
    assert {tuple(r[c] for c in names) for r in K.agreeing(a, b, 0.3).collect()} == agree
    best = K.best_pairs(got, 1, ["scan"])
    pairs = {(r.scan, r.i, r.j) for r in best.collect()}
    assert {tuple(r[c] for c in names) for r in K.agreeing_of(best, a, b, 0.3).collect()} == {x for x in agree if x[:3] in pairs}
    told = {r.scan: (r.n, r.enc2_first, r.enc3_first) for r in K.descriptor_stats(sides[0], prm).collect()}
    mine = {}
    for r in a.collect():
        mine[r.scan] = tuple(x + y for x, y in zip(mine.get(r.scan, (0, 0, 0)), (r.n, r.enc2_first, r.enc3_first), strict=True))
    assert mine == told


def test_point_errors_meet_in_blocks(spark, monkeypatch):
    """Every job's mean equals brute force, points without a coordinate are counted only; no row for each point and job."""
    from silvaspark.operators import registration as R

    monkeypatch.setattr(R, "POINTS", 7)
    monkeypatch.setattr(R, "TRANSFORMS", 2)
    rnd = random.Random(6)
    pts = [tuple(rnd.uniform(-9, 9) for _ in "xyz") for _ in range(40)]
    cols = [*R.R_COLS, *R.T_COLS]
    jobs = [(f"job {k}", k % 3, *[rnd.uniform(-1, 1) for _ in range(24)]) for k in range(9)]
    t = spark.createDataFrame(jobs, "job string, kind int, " + ", ".join(f"{c} double" for c in [*cols, *[f"g{c}" for c in cols]]))
    got = R.point_errors(spark.createDataFrame([*pts, (1.0, None, 2.0)], "x double, y double, z double"), t, ["job", "kind"])
    assert plan(got).count("MapInArrow") == 2
    got = {(r.job, r.kind): (r.e_p, r.n) for r in got.collect()}
    assert len(got) == len(jobs)
    for name, kind, *v in jobs:
        e = [a - b for a, b in zip(v[:12], v[12:], strict=True)]
        want = sum(math.hypot(*[e[9 + i] + sum(e[3 * i + k] * p[k] for k in range(3)) for i in range(3)]) for p in pts) / len(pts)
        assert abs(got[name, kind][0] - want) < 1e-12 and got[name, kind][1] == 41


def test_assignment_keeps_the_types_of_its_keys(spark):
    """Keys of an experiment's runs, a label and a seed, which is no long."""
    from silvaspark.operators import registration as R

    det = spark.createDataFrame([("a", 1, 7, 0.0, 0.0), ("a", 2, 8, 0.0, 0.1), ("a", 2, 9, 0.0, 0.3)], "label string, seed int, det_id long, dx double, dy double")
    ref = spark.createDataFrame([("a", s, k, 0.0, 0.2 * k) for s in (1, 2) for k in (0, 1)], "label string, seed int, ref_id long, rx double, ry double")
    m = R.assign_positions(det, ref, 0.15, ["label", "seed"])
    assert [t for _, t in m.dtypes[:2]] == ["string", "int"]
    assert sorted((r.label, r.seed, r.det_id, r.ref_id) for r in m.collect()) == [("a", 1, 7, 0), ("a", 2, 8, 0), ("a", 2, 9, 1)]
    assert {r.seed: r.n_match for r in R.assignment_scores(det, ref, m, ["label", "seed"]).collect()} == {1: 1, 2: 2}


def test_joins_of_the_extraction_go_by_true_sizes(spark):
    """A table of few bytes in its file is not sent through the driver for them, and what is sent is counted first."""
    from silvaspark import runtime
    from silvaspark.plans import pipeline

    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        cloud = spark.createDataFrame([(0.1 * (k % 40), 0.1 * (k // 40), 0.001 * k) for k in range(1600)], "x double, y double, z double")
        pipeline.preprocess(cloud)
        flat = runtime.written(spark.range(400_000).selectExpr("id", "0 as a", "id div 400000 as b"), "flat")
        got = flat.join(flat.select("id", "b"), "id")
        assert "BroadcastHashJoin" not in plan(got) and spark.conf.get(keys[1]) in ("10MB", "10485760b", before[keys[0]])
        assert got.count() == 400_000
        few = flat.where("id < 10").select("id", "b")
        assert "BroadcastHashJoin" in plan(flat.join(runtime.sent_if_few(few, 10), "id")) and "BroadcastHashJoin" not in plan(flat.join(runtime.sent_if_few(few, 9), "id"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
