"""Queries against DuckDB on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = ["retention_bins_step", "budget_physical_rank", "sanity_report", "voxel_nearest", "ground_supported_lowest", "ground_slope_filter", "terrain_planes", "merge_keypoints", "cn_descriptor", "mutual_nn", "nearest_classify", "point_error", "pair_set_success", "sign_test"]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: float(v) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    import duckdb

    from silvaspark.plans import registry

    c = duckdb.connect()
    for t in ("lineitem", "customer", "orders", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = c.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(r.columns)
    assert rows(got.columns, got.collect()) == rows(r.columns, r.fetchall())


def test_scene_end_to_end(spark):
    from silvaspark.plans import pipeline
    from silvaspark.sources import synthetic
    from silvaspark.sources.config import Config

    scene = synthetic.Scene(ground_density=300.0, stem_density=6000.0, half_size=7.0, stems=synthetic.Scene().stems[:2], offset=(1000.0, 2000.0, 50.0))
    cloud = synthetic.make(spark, scene)
    trees, _ = pipeline.extract(cloud, Config.load("", ["--voxel.leaf=0.02", "--dtm.support_count=1"]), origin=scene.offset)
    got, want = trees.collect(), synthetic.truth(spark, scene).collect()
    assert len(got) == 2
    for t in got:
        near = min(want, key=lambda w: (w.x - t.x) ** 2 + (w.y - t.y) ** 2)
        assert abs(near.x - t.x) < 0.02 and abs(near.y - t.y) < 0.02 and abs(near.radius - t.radius) < 0.01
    with pytest.raises(ValueError, match="scanner position"):
        pipeline.extract(cloud.selectExpr("x + 1e6 as x", "y", "z"))


def test_triangle_votes_of_all_named_keypoints(spark):
    """Brute force over the keypoints that the best pair names, wherever they stand in their scan."""
    import collections
    import itertools

    import numpy as np

    from silvaspark.operators import keypoints as K
    from silvaspark.plans import registry as R

    a, b = R._described(spark, DATA)
    agree = K.agreeing(a, b, 0.05, ["scan"])
    cand = K.scored(K.best_pairs(K.dc_scores(a, b, 0.05, ["scan"]), 3, ["scan"]), agree, 10.0, ["scan"]).collect()
    best = {}
    for r in sorted(cand, key=lambda r: (-r.score, -r.dc, r.i)):
        best.setdefault(r.scan, (r.i, r.j))
    named = [r for r in agree.collect() if best.get(r.scan) == (r.i, r.j)]
    kps = R.V.keypoints(spark, DATA)
    src = {(r.scan, r.kp): (r.x, r.y) for r in kps.collect()}
    tgt = {(r.scan, r.tp): (r.tx, r.ty) for r in R.V.target(kps).collect()}

    def sides(at, scan, tri):
        p = [np.array(at[scan, k]) for k in tri]
        return [float(np.hypot(*(p[x] - p[y]))) for x, y in ((0, 1), (1, 2), (2, 0))]

    want = collections.Counter()
    for scan in best:
        s = list(itertools.combinations(sorted({r.na for r in named if r.scan == scan}), 3))
        t = list(itertools.combinations(sorted({r.nb for r in named if r.scan == scan}), 3))
        ss = np.array([sides(src, scan, x) for x in s])
        taken = np.zeros((len(s), len(t)), bool)
        for turn in itertools.permutations(range(3)):
            turned = [tuple(x[k] for k in turn) for x in t]
            ts = np.array([sides(tgt, scan, x) for x in turned])
            fit = (np.abs(ss[:, None] - ts) < 0.05).all(axis=2) & ~taken
            taken |= fit
            for i, j in zip(*np.nonzero(fit), strict=True):
                want.update((scan, u, v) for u, v in zip(s[i], turned[j], strict=True))
    got = {(r.scan, r.s, r.t): r.votes for r in R.QUERIES["triangle_votes"](spark, DATA).collect()}
    assert got == dict(want) and any(s % 500 >= 25 for _, s, _ in got)
