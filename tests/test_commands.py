"""The commands extract, compare, run_all and synth on small files, and the readers of small tables."""

import math

import pytest

from silvaspark import cli
from silvaspark.runtime import StageLog, peak_memory_mb
from silvaspark.sources import points as S
from silvaspark.sources import tables

STEMS = [(12.0, 1.0, 0.3), (16.0, -3.0, 0.35)]
SETTINGS = ["--dtm.cell=1.0", "--dtm.support_count=1", "--normals.radius=0.2", "--cluster.tolerance=0.3", "--cylinder.dist_threshold=0.03", "--scanner.x0=100", "--scanner.y0=0", "--scanner.z0=0"]


@pytest.fixture(scope="module")
def cloud(tmp_path_factory):
    """Two stems on level ground around (115, 0, -1.5), seen from (100, 0, 0)."""
    at = tmp_path_factory.mktemp("cloud") / "s1.xyz"
    rows = [(108 + 12 * (k * 0.754877666 % 1), -8 + 14 * (k * 0.569840291 % 1), -1.5 + 0.001 * (k % 3)) for k in range(2500)]
    for x, y, r in STEMS:
        for k in range(500):
            t = 2 * math.pi * (k * 0.754877666 % 1)
            rows.append((100 + x + r * math.cos(t), y + r * math.sin(t), -1.45 + 2 * (k * 0.569840291 % 1)))
    at.write_text("\n".join(" ".join(map(repr, r)) for r in rows) + "\nnot a point\n")
    return at


def test_extract_compare_and_run_all(spark, tmp_path, cloud, capsys):
    p = lambda x: str(tmp_path / x)
    cli.main(["extract", "--input", str(cloud), "--out", p("one"), *SETTINGS])
    trees = sorted((float(r["x"]), float(r["y"]), float(r["radius"])) for r in spark.read.csv(p("one/trees"), header=True).collect())
    assert len(trees) == 2 and all(math.dist(a, (100 + b[0], b[1], b[2])) < 0.02 for a, b in zip(trees, STEMS, strict=True))
    stages = {r.stage: r for r in tables.read_stage_table(spark, p("one/run_log")).collect()}
    assert stages["input"].points == 3500 and stages["trees"].points == 2 and stages["cylinder fits"].points == 2 and stages["voxels"].ms > 0 and stages["height slice"].ms is None
    assert stages["input"].points >= stages["height slice"].points >= stages["voxels"].points >= stages["normals"].points > stages["verticality"].points >= stages["retention"].points > 800
    log = {r.key: r.value for r in tables.read_run_log(spark, p("one/run_log")).collect()}
    assert log["clusters"] == log["trees"] == log["ok"] == 2 and spark.read.csv(p("one/skipped"), header=True).first()["n"] == "1"
    (tmp_path / "refs").write_text("# reference\n112,1\n116 -3 0.5\n")
    (tmp_path / "stations.csv").write_text(f"scan,path,x0,y0,z0,source\ns1,{cloud},100,0,0,notes\ns2,{p('none.xyz')},1,2,3,notes\ns3,x,,0,0,\n")
    extra = [x for x in SETTINGS if "scanner" not in x]
    cli.main(["run_all", "--stations", p("stations.csv"), "--out", p("all"), "--ref", p("refs"), "--experiment.n_seeds=1", *extra])
    status = {r["scan"]: r for r in spark.read.csv(p("all/run_status"), header=True).collect()}
    assert status["s1"]["status"] == "ok" and status["s1"]["exit_code"] == "0" and float(status["s1"]["peak_memory_mb"]) > 0
    assert status["s2"]["status"] == "failed" and status["s2"]["note"] and status["s3"]["status"] == "skipped" and status["s3"]["note"] == "missing x0 source"
    runs = {(r["profile"], r["label"], r["metric"]): float(r["value"]) for r in spark.read.csv(p("all/s1/runs"), header=True).collect() if r["value"]}
    assert len({k[1] for k in runs}) == 6 and all(runs[q, m, "recall"] == 1 and runs[q, m, "trees"] == 2 for q in ("baseline", "improved") for m in ("step", "physical*"))
    assert spark.read.csv(p("all/s1/retention_bins_step"), header=True).columns == tables.BIN_COLUMNS
    assert {r["metric"]: r for r in tables.read_summary(spark, p("all/s1/summary_improved")).collect() if r["label"] == "step"}["recall"]["mean"] == 1.0
    assert "### improved" in capsys.readouterr().out and {r["stage"] for r in spark.read.csv(p("all/s1/stages"), header=True).collect()} >= {"input", "terrain", "retention", "clustering", "trees"}


def test_synth(spark, tmp_path):
    out, truth = str(tmp_path / "scene"), str(tmp_path / "truth")
    cli.main(["synth", "--out", out, "--truth", truth, "--offset", "10,0,0"])
    got, skipped = S.read_ascii(spark, out)
    assert spark.read.csv(truth, header=True).count() == 5 and got.count() > 10_000 and skipped.count() == 0


def test_stages_are_counted_while_others_are_written(spark):
    log = StageLog()
    df = log.seen(spark.range(100).where("id % 3 = 0"), "thirds")
    out = log.written(log.seen(df.where("id % 2 = 0"), "marked", df["id"] > 50), "t", "sixths")
    assert out.count() == 17 and [(n, c) for n, c, _ in log.stages] == [("thirds", 34), ("marked", 8), ("sixths", 17)]
    assert log.stages[2][2] > 0 and log.stages[0][2] is None and log.lines()[2] == "| thirds | 34 |  |" and log.table(spark).count() == 3
    spark.range(1000).groupBy("id").count().collect()
    assert peak_memory_mb(spark) > 0


def test_small_tables(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    refs = S.reference_positions(spark, file("refs", "# x y\n1 2\n3;4;5.5\nword 1\n/ no\n\n")).collect()
    assert [(r.x, r.y, r.z) for r in refs] == [(1.0, 2.0, None), (3.0, 4.0, 5.5)]
    with pytest.raises(S.PointFormatError, match="no positions"):
        S.reference_positions(spark, file("empty", "# nothing\n"))
    ok, left = tables.read_stations(spark, file("st", "scan,x0,y0,z0,source\n# note\na,1,2,3,log\nb,1,,3,log\nc,1,2,3, \n"))
    assert [(r.scan, r.x0, r.z0) for r in ok.collect()] == [("a", 1.0, 3.0)] and sorted(r.scan for r in left.collect()) == ["b", "c"]
    got = {(r.metric, r.label): (r["mean"], r["std"]) for r in tables.read_summary(spark, file("sum", "metric,step_mean,step_std,linear*_mean,linear*_std\ntrees,3,0.5,4,\n")).collect()}
    assert got == {("trees", "step"): (3.0, 0.5), ("trees", "linear*"): (4.0, None)}
    rows = tables.read_stage_table(spark, file("log", "| stage | points | ms |\n|---|---|---|\n| voxel 1 cm | 39 | 4.5 |\n| slice | 7 |  |\n")).collect()
    assert [tuple(r) for r in rows] == [("voxel 1 cm", 39, 4.5), ("slice", 7, None)]
    assert tables.read_transform(spark, file("ok.tfm", " ".join("1 0 0 5 0 1 0 6 0 0 1 7 0 0 0 1".split()))).first()["t1"] == 6.0
    with pytest.raises(Exception, match="16 numbers"):
        tables.read_transform(spark, file("short.tfm", "1 0 0 5\n0 1 0")).collect()
    assert tables.file_label("linear*") == "linear"


def test_tree_files_of_a_batch(spark, tmp_path):
    """Files of different headers, line ends and odd names in one scan; a file without coordinates is an error."""
    (tmp_path / "a b").mkdir()
    one, two, bad = str(tmp_path / "a b" / "one.csv"), str(tmp_path / "two.csv"), str(tmp_path / "bad.csv")
    for path, text in ((one, "x,y,z\n1.0,2.0,3.0\n4,5,6\n"), (two, 'id,"z",y,x\r\n9,3.0,2.0,1.0\r\n\r\n8,,1,1\r\n'), (bad, "x,y\n1,2\n")):
        with open(path, "w", newline="") as f:
            f.write(text)
    rows = tables.read_trees_of(spark, [one, two, one]).collect()
    assert {(r.file, r.kp, r.x, r.y, r.z) for r in rows} == {(tables.qualified(spark, one), 1, 1.0, 2.0, 3.0), (tables.qualified(spark, "file://" + one), 2, 4.0, 5.0, 6.0), (tables.qualified(spark, two), 1, 1.0, 2.0, 3.0)}
    with pytest.raises(Exception, match="are missing"):
        tables.read_trees_of(spark, [bad]).collect()


def test_header_check(spark, tmp_path):
    f = tmp_path / "a.ply"
    f.write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\nnan 2 3\n4 5 6\n")
    points, skipped = S.read_points(spark, str(f), strict=False)
    r = S.header_check(spark, str(f), points, skipped).first()
    assert (r.header, r.found, r.matches) == (4, 3, False)
    with pytest.raises(Exception, match="header says 4"):
        S.read_points(spark, str(f))[0].collect()
    assert S.header_check(spark, "a.xyz", points, skipped).count() == 0


def test_coincident_keypoints(spark):
    from silvaspark.operators import keypoints as K

    kps = [(0, 0, 0.0), (1, 1, 0.0), (2, 1, 0.0), (3, 5, 1.0), (4, 2, 3.0)]
    df = spark.createDataFrame([("s", k, float(x), y) for k, x, y in kps], "scan string, kp long, x double, y double")
    assert K.descriptor_stats(df, K.Params(n=33)).first()["coincident"] == 2
