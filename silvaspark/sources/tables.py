"""Small tables: trees, transforms, job lists, stations, summaries; and the writers of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE_COLUMNS = ["cluster_id", "x", "y", "z", "radius", "tilt_deg", "n_points", "n_inliers"]
CLUSTER_COLUMNS = ["cluster_id", "status", "fail_mask", "n_points", "n_inliers", "n_inliers_sac", "n_normal_ok", "arc_deg", "radius", "tilt_deg", *[f"{n}_{a}" for n in ("centroid", "axis", "dir") for a in "xyz"], "ransac_seed"]
BIN_COLUMNS = ["d_lo", "d_hi", "n", "kept", "empirical_rate", "mean_P"]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) by header name from a trees file."""
    t = spark.read.csv(path, header=True)
    missing = {"x", "y", "z"} - set(t.columns)
    if missing:
        raise ValueError(f"{path}: columns {', '.join(sorted(missing))} are missing")
    return t.select(*[F.expr(f"try_cast({c} as double)").alias(c) for c in "xyz"]).where("x is not null and y is not null and z is not null")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as readers here name it in ``file``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def _file() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file")


def read_trees_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, kp, x, y, z) of many trees files in one scan; ``kp`` is the line, columns go by each file's own header."""
    t = spark.read.text(sorted(set(paths)), wholetext=True).select(_file(), F.split(F.rtrim(F.regexp_replace("value", "\r", ""), F.lit("\n")), "\n").alias("lines"))
    names = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    t = t.select("file", names.alias("names"), F.posexplode("lines").alias("kp", "line")).where("kp > 0 and trim(line) <> ''")
    cell = lambda c: F.get(F.split("line", ","), (F.array_position("names", c) - 1).cast("int")).try_cast("double")
    missing = F.raise_error(F.concat("file", F.lit(": columns x, y, z are missing")))
    known = F.array_contains("names", "x") & F.array_contains("names", "y") & F.array_contains("names", "z")
    at = [F.when(known, cell(c)).otherwise(missing.cast("double")).alias(c) for c in "xyz"]
    return t.select("file", F.col("kp").cast("long").alias("kp"), *at).where("x is not null and y is not null and z is not null")


def read_transform(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, r00..r22, t0..t2): the upper three rows of a 4x4 matrix given by 16 numbers; fewer are an error."""
    t = spark.read.text(path, wholetext=True).select(_file(), F.filter(F.split("value", r"[\s,;]+"), lambda x: x != "").alias("w"))
    n = F.transform("w", lambda x: x.try_cast("double"))
    short = F.raise_error(F.concat("file", F.lit(": a transform has 16 numbers, there are "), F.size("w").cast("string")))
    t = t.select("file", F.when(F.size("w") < 16, short.cast("array<double>")).otherwise(n).alias("m"))
    return t.select("file", *[F.col("m")[4 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.col("m")[4 * i + 3].alias(f"t{i}") for i in range(3)])


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(src_trees, tgt_trees, cloud, gt, out, label); lines with fewer than five words are left out."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'").select(F.split("v", r"\s+").alias("w")).where(F.size("w") >= 5)
    names = ["src_trees", "tgt_trees", "cloud", "gt", "out"]
    return t.select(*[F.col("w")[k].alias(n) for k, n in enumerate(names)], F.coalesce(F.try_element_at("w", F.lit(6)), F.lit("")).alias("label"))


def read_stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stations, left out): scans lacking a position or a source are left out."""
    t = spark.read.csv(path, header=True, comment="#")
    need = ["x0", "y0", "z0", "source"]
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull() & (F.trim(c) != "")
    typed = t.where(ok).withColumns({c: F.expr(f"try_cast({c} as double)") for c in need[:3]})
    return typed, t.where(~ok)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(metric, label, mean, std) from a wide summary with <label>_mean and <label>_std columns."""
    t = spark.read.csv(path, header=True)
    labels = [c[:-5] for c in t.columns if c.endswith("_mean")]
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.expr(f"try_cast(`{x}_mean` as double)").alias("mean"), F.expr(f"try_cast(`{x}_std` as double)").alias("std")) for x in labels])
    return t.select("metric", F.inline(each))


def read_stage_table(spark: SparkSession, path: str) -> DataFrame:
    """(stage, points, ms) from the markdown rows ``| stage | points | ms |`` of a run log; ms is null where it is left empty."""
    row = r"^\|\s*([^|]+?)\s*\|\s*([0-9]+)\s*\|\s*([0-9.]*)\s*\|"
    t = spark.read.text(path).where(F.col("value").rlike(row))
    return t.select(F.regexp_extract("value", row, 1).alias("stage"), F.regexp_extract("value", row, 2).cast("long").alias("points"), F.expr(f"try_cast(regexp_extract(value, r'{row}', 3) as double)").alias("ms"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``name: number`` lines of a run log."""
    row = r"^\s*([A-Za-z0-9 _]+?)\s*:\s*([0-9.]+)"
    t = spark.read.text(path).where(F.col("value").rlike(row))
    return t.select(F.regexp_extract("value", row, 1).alias("key"), F.regexp_extract("value", row, 2).cast("double").alias("value"))


def trees_table(fits: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), cluster: str = "cluster") -> DataFrame:
    """Passing fits as trees in original coordinates."""
    at = [(F.col(f"p{a}") + F.lit(o)).alias(a) for a, o in zip("xyz", origin, strict=True)]
    return fits.where("fail = 0").select(F.col(cluster).alias("cluster_id"), *at, "radius", "tilt_deg", "n_points", "n_inliers")


def clusters_table(fits: DataFrame, cluster: str = "cluster") -> DataFrame:
    return fits.withColumnRenamed(cluster, "cluster_id").select(*CLUSTER_COLUMNS)


def file_label(label: str) -> str:
    """A label in a file's name: without the stars of matched models."""
    return label.replace("*", "")


def bins_table(bins: DataFrame) -> DataFrame:
    return bins.withColumnRenamed("mean_p", "mean_P").select(*BIN_COLUMNS)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text as a folder of one file, on any file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; results keep the partitions of their query."""
    df.write.mode("overwrite").csv(path, header=True)
