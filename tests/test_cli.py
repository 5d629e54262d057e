"""The commands, end to end on small files."""

import math

import pytest

from silvaspark import cli


def test_register_and_inspect(spark, tmp_path, capsys):
    pts = [(10 * math.cos(k * 1.7) + k % 7, 9 * math.sin(k * 2.3) + k % 5, 0.1 * (k % 3)) for k in range(40)]
    turn = math.radians(30)
    moved = [(math.cos(turn) * x - math.sin(turn) * y + 2, math.sin(turn) * x + math.cos(turn) * y - 1, z) for x, y, z in pts]
    for name, rows in (("a", pts), ("b", moved)):
        (tmp_path / f"{name}.csv").write_text("x,y,z\n" + "\n".join(f"{x!r},{y!r},{z!r}" for x, y, z in rows) + "\n")
    (tmp_path / "none.csv").write_text("x,y,z\n1.0,1.0,0.0\n")
    (tmp_path / "a.xyz").write_text("\n".join(f"{x} {y} {z}" for x, y, z in pts) + "\n")
    (tmp_path / "gt.tfm").write_text(f"{math.cos(turn)!r} {-math.sin(turn)!r} 0 2\n{math.sin(turn)!r} {math.cos(turn)!r} 0 -1\n0 0 1 0\n0 0 0 1\n")
    p = lambda x: str(tmp_path / x)
    (tmp_path / "jobs").write_text(f"{p('a.csv')} {p('b.csv')} {p('a.xyz')} {p('gt.tfm')} out good\n{p('a.csv')} {p('none.csv')} {p('a.xyz')} {p('gt.tfm')} out bad\n")
    cli.main(["register", "--batch", p("jobs"), "--out", p("reg"), "--thresholds", "0.05", "--N", "33", "--ransac_iters", "200"])
    rows = {(r["label"], r["solver"]): r for r in spark.read.csv(p("reg/a.xyz.registration"), header=True, inferSchema=True).collect()}
    assert set(rows) == {(x, s) for x in ("good", "bad") for s in ("svd", "svd+ransac")}
    good, bad = rows["good", "svd+ransac"], rows["bad", "svd"]
    assert good["success"] == 1 and good["transform_ok"] == 1 and good["rot_err_deg"] < 1e-4 and good["ransac_inliers"] == good["n_matches"] == good["n_correct_matches"]
    assert rows["good", "svd"]["ransac_inliers"] == 0 and good["n_src_kp"] == 40 and good["setting"] == "paper"
    assert bad["success"] == 0 and bad["transform_ok"] == 0 and math.isnan(float(bad["e_p_m"])) and bad["n_matches"] == 0 and bad["r00"] == 1.0
    cli.main(["inspect", "--input", p("a.xyz"), "--stride", "1"])
    assert "centroid" in capsys.readouterr().out


def test_every_setting_has_its_name():
    from silvaspark.sources.config import Config

    text = "[dtm]\nground_select = percentile # how\n[cylinder]\ncheck_inlier_ratio = no\ncheck_normal_consistency = 0\ncheck_arc_coverage = false\n[normals]\noctree_res = 0.1\n[budget]\nrel_tol = 0.01\n"
    c = Config.load(text)
    assert c.dtm.ground_select == "percentile" and not (c.cylinder.check_inlier_ratio or c.cylinder.check_normal_consistency or c.cylinder.check_arc_coverage)
    assert c.normals.octree_res == 0.1 and c.budget.rel_tol == 0.01 and Config.load(c.dump()) == c
    with pytest.raises(ValueError, match="unknown setting"):
        Config.load("", ["--scanner.position_given=true"])
