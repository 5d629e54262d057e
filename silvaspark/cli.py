"""Command line: ``python -m silvaspark.cli extract|compare|run_all|register|inspect|synth``.

Settings are given as ``--section.key=value`` and by ``--config file.ini``.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from silvaspark.functions.retention import KINDS
from silvaspark.operators import points as P
from silvaspark.operators import reports
from silvaspark.operators.keypoints import Params
from silvaspark.operators.points import ORIGINS
from silvaspark.plans import pipeline
from silvaspark.runtime import StageLog, peak_memory_mb, written
from silvaspark.sources import points as S
from silvaspark.sources import synthetic, tables
from silvaspark.sources.config import Config


def _config(a: argparse.Namespace, rest: list[str]) -> Config:
    text = open(a.config).read() if a.config else ""
    extra = [f"--retention.version={a.version}"] if getattr(a, "version", None) else []
    return Config.load(text, [*extra, *rest])


def _save(df, out: str, name: str) -> None:
    tables.write_csv(df, os.path.join(out, name))


def _say(spark: SparkSession, text: str, out: str, name: str) -> None:
    """Show a text and keep it beside the results."""
    print(text)
    tables.write_text(spark, text, os.path.join(out, name))


def extract(spark: SparkSession, a, cfg: Config) -> None:
    cloud, skipped = S.read_points(spark, a.input)
    log = StageLog()
    trees, fits = pipeline.extract(cloud, cfg, a.seed, log=log)
    _save(trees, a.out, "trees")
    _save(tables.clusters_table(fits), a.out, "clusters")
    _save(skipped, a.out, "skipped")
    r = reports.success_rate(fits, []).first()
    fails = fits.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()
    lines = [f"seed: {a.seed}", f"clusters: {r['clusters'] if r else 0}", f"trees: {r['trees'] if r else 0}", *[f"{f['status']}: {f['n']}" for f in fails], "", *log.lines()]
    _say(spark, "\n".join(lines), a.out, "run_log")
    tables.write_text(spark, cfg.dump(), os.path.join(a.out, "config"))


def compare(spark: SparkSession, a, cfg: Config) -> None:
    cloud, _ = S.read_points(spark, a.input)
    s = cfg.scanner
    log = StageLog()
    vert, planes, _ = pipeline.preprocess(P.localise(cloud, (s.x0, s.y0, s.z0)), cfg, log=log)
    refs = S.reference_positions(spark, a.ref) if a.ref else None
    if refs is not None:
        refs = refs.select((F.col("x") - s.x0).alias("x"), (F.col("y") - s.y0).alias("y"))
    got = pipeline.experiment_tables(vert, planes, refs, cfg, log)
    _save(got["runs"], a.out, "runs")
    _save(got["stages"], a.out, "stages")
    bins = written(got["bins"], "bins")
    for label in pipeline.RAW:
        _save(tables.bins_table(bins.where(F.col("label") == label)), a.out, f"retention_bins_{tables.file_label(label)}")
    o = (s.x0, s.y0, s.z0)
    at = [(F.col(f"p{c}") + F.lit(v)).alias(c) for c, v in zip("xyz", o, strict=True)]
    _save(got["fits"].where("fail = 0").select("label", "seed", F.col("cluster").alias("cluster_id"), *at, "radius", "tilt_deg", "n_points", "n_inliers"), a.out, "trees")
    text = []
    for profile in sorted(r["profile"] for r in got["summary"].select("profile").distinct().collect()):
        stats = got["summary"].where(F.col("profile") == profile)
        labels = sorted(r["label"] for r in stats.select("label").distinct().collect())
        table = reports.summary_table(stats, labels)
        _save(table, a.out, f"summary_{profile}")
        text += [f"### {profile}", "", reports.summary_markdown(table, labels), ""]
    _say(spark, "\n".join(text), a.out, "summary_markdown")
    tables.write_text(spark, cfg.dump(), os.path.join(a.out, "config"))


def register(spark: SparkSession, a, cfg: Config) -> None:
    jobs = tables.read_jobs(spark, a.batch).collect() if a.batch else [argparse.Namespace(src_trees=a.src_trees, tgt_trees=a.tgt_trees, cloud=a.src_cloud, gt=a.gt, out=a.out, label=a.label)]
    # jobs of one source cloud share its scan; the small files of all its jobs are one scan each for trees and transforms
    for cloud in sorted({j.cloud for j in jobs}):
        own = [x for x in jobs if x.cloud == cloud]
        at = {p: tables.qualified(spark, p) for j in own for p in (j.src_trees, j.tgt_trees, j.gt)}
        names = spark.createDataFrame([(j.label or str(k), at[j.src_trees], at[j.tgt_trees], at[j.gt]) for k, j in enumerate(own)], "job string, src string, tgt string, gt string")
        trees = written(tables.read_trees_of(spark, [p for j in own for p in (j.src_trees, j.tgt_trees)]), "trees")
        src, tgt = (names.select("job", F.col(side).alias("file")).join(trees, "file").drop("file") for side in ("src", "tgt"))
        gt = names.select("job", F.col("gt").alias("file")).join(tables.read_transform(spark, sorted({j.gt for j in own})), "file").drop("file")
        points, _ = S.read_points(spark, cloud)
        rows = pipeline.register(src, tgt, gt, points, tuple(float(t) for t in a.thresholds.split(",")), a.merge_radius, a.gt_match, Params(n=a.N, w=a.w, th_score=a.th_score, min_dc=a.min_dc), None, a.ransac_iters, a.ransac_inlier, a.ransac_seed)
        _save(rows.withColumnRenamed("job", "label"), a.out, os.path.basename(cloud) + ".registration")


def run_all(spark: SparkSession, a, cfg: Config) -> None:
    """The comparison for every scan of a station table that has a position, and a status row for each scan."""
    ok, left = tables.read_stations(spark, a.stations)
    rows = []
    for r in left.collect():
        lacking = [c for c in ("x0", "y0", "z0", "source") if not (r[c] or "").strip()]
        rows.append((r["scan"], "skipped", None, None, None, r["x0"], r["y0"], r["z0"], r["source"], "", "missing " + " ".join(lacking)))
    for r in ok.collect():  # a list of scans, each of which is a run of its own
        out = os.path.join(a.out, r["scan"])
        extra = [f"--scanner.{c}={r[c]!r}" for c in ("x0", "y0", "z0")]
        command = " ".join(["compare", f"--input={r['path']}", f"--out={out}", *a.settings, *extra])
        began, note = time.time(), ""
        try:
            compare(spark, argparse.Namespace(input=r["path"], out=out, ref=a.ref), _config(a, [*a.settings, *extra]))
        except Exception as e:  # noqa: BLE001 - a scan that fails has its row, and the others go on
            note = " | ".join(str(e).strip().splitlines()[-3:])[:300] or type(e).__name__
        rows.append((r["scan"], "failed" if note else "ok", 1 if note else 0, round(time.time() - began, 1), peak_memory_mb(spark), *[str(r[c]) for c in ("x0", "y0", "z0")], r["source"], command, note))
    status = spark.createDataFrame(rows, "scan string, status string, exit_code int, wall_s double, peak_memory_mb double, x0 string, y0 string, z0 string, source string, command string, note string")
    status.coalesce(1).write.mode("append").csv(os.path.join(a.out, "run_status"), header=True)


def inspect(spark: SparkSession, a, cfg: Config) -> None:
    cloud, skipped = S.read_points(spark, a.input, strict=False)
    for r in S.header_check(spark, a.input, cloud, skipped).collect():
        print(f"header: {r['header']} points, found {r['found']}: {'matches' if r['matches'] else 'MISMATCH'}")
    local = cloud.select(*[(F.col(c) - float(v)).alias(c) for c, v in zip("xyz", a.origin.split(","), strict=True)])
    print(P.report_text(P.sanity(local, near=cfg.scanner.nearest_warn)))
    o = [float(x) for x in a.origin.split(",")]
    p = cloud.where(F.pmod("pid", F.lit(a.stride)) == 0).select(*[(F.col(c) - v).alias(c) for c, v in zip("xyz", o, strict=True)])
    p = p.withColumn("r", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 3))
    P.range_stats(p, []).show(truncate=False)
    centre = cloud.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
    around = [*ORIGINS, ("centroid", *(centre[c] - v for c, v in zip("xyz", o, strict=True)))]
    P.lattice_score(p, spark.createDataFrame(around, "origin string, ox double, oy double, oz double"), a.bin_deg).orderBy(F.desc("score")).show(50, truncate=False)
    skipped.show(truncate=False)


def synth(spark: SparkSession, a, cfg: Config) -> None:
    scene = synthetic.Scene(seed=a.seed, offset=tuple(float(x) for x in a.offset.split(",")))
    synthetic.write_xyz(synthetic.make(spark, scene), a.out)
    if a.truth:
        tables.write_csv(synthetic.truth(spark, scene), a.truth)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="silvaspark")
    sub = top.add_subparsers(dest="what", required=True)
    for name, args in {
        "extract": [("--input", {"required": True}), ("--out", {"required": True}), ("--version", {"choices": KINDS}), ("--seed", {"type": int, "default": 1})],
        "compare": [("--input", {"required": True}), ("--out", {"required": True}), ("--ref", {})],
        "run_all": [("--stations", {"required": True}), ("--out", {"required": True}), ("--ref", {})],
        "register": [("--src_trees", {}), ("--tgt_trees", {}), ("--src_cloud", {}), ("--gt", {}), ("--label", {"default": ""}), ("--batch", {}), ("--out", {"required": True}), ("--thresholds", {"default": "0.05"}), ("--merge_radius", {"type": float, "default": 0.0}), ("--gt_match", {"type": float, "default": 0.3}), ("--N", {"type": int, "default": 183}), ("--w", {"type": float, "default": 10.0}), ("--th_score", {"type": float, "default": 40.0}), ("--min_dc", {"type": int, "default": 3}), ("--ransac_iters", {"type": int, "default": 1000}), ("--ransac_inlier", {"type": float, "default": 0.3}), ("--ransac_seed", {"type": int, "default": 1})],
        "inspect": [("--input", {"required": True}), ("--origin", {"default": "0,0,0"}), ("--stride", {"type": int, "default": 10}), ("--bin_deg", {"type": float, "default": 0.002})],
        "synth": [("--out", {"required": True}), ("--truth", {}), ("--offset", {"default": "0,0,0"}), ("--seed", {"type": int, "default": 42})],
    }.items():
        p = sub.add_parser(name)
        p.add_argument("--config")
        for flag, kw in args:
            p.add_argument(flag, **kw)
    a, rest = top.parse_known_args(argv)
    spark = SparkSession.builder.appName(f"silvaspark {a.what}").getOrCreate()
    a.settings = rest
    globals()[a.what](spark, a, _config(a, rest))


if __name__ == "__main__":
    main()
