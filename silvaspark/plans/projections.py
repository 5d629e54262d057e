"""Point-cloud views of general tables, in integers of 0.1 mm and in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.functions.retention import distance, start, with_uniform
from silvaspark.runtime import sent_if_few, table

#: The same views in SQL, for comparison.
PTS = """
  SELECT xi, yi, zi, xi / 1e4 AS x, yi / 1e4 AS y, zi / 1e4 AS z, scan FROM (
    SELECT CAST(round(l_extendedprice * 100) AS BIGINT) % 400000 - 200000 AS xi, (l_partkey * 791900) % 400000 - 200000 AS yi,
           CAST(round(l_quantity * 1000) AS BIGINT) - 15000 AS zi, l_suppkey % 6 AS scan FROM lineitem)
"""
KP = """
  SELECT c_custkey AS kp, c_custkey // 500 AS scan, x, y, c_custkey % 100 / 100.0::DOUBLE AS z FROM (
    SELECT c_custkey, ((CAST(round(c_acctbal * 100) AS BIGINT) % 8000) + 8000) % 8000 / 1e2 - 40 AS x, (c_custkey * 7919) % 8000 / 1e2 - 40 AS y FROM customer)
"""


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(xi, yi, zi, x, y, z, scan) from lineitem: 40 x 40 x 5 m."""
    t = table(spark, sf_dir, "lineitem")
    i = t.select(
        (F.round(F.col("l_extendedprice") * 100).cast("long") % 400000 - 200000).alias("xi"),
        (F.col("l_partkey") * 791900 % 400000 - 200000).alias("yi"),
        (F.round(F.col("l_quantity") * 1000).cast("long") - 15000).alias("zi"),
        (F.col("l_suppkey") % 6).alias("scan"),
    )
    return i.select("xi", "yi", "zi", *[(F.col(f"{c}i") / F.lit(1e4)).alias(c) for c in "xyz"], "scan")


def sampled(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """``pts`` with the distance d and a uniform u<seed> for each seed."""
    p = pts(spark, sf_dir).select("x", "y", "z")
    return with_uniform(p.withColumn("d", distance(F.col("x"), F.col("y"))), {f"u{s}": start(s) for s in seeds})


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kp, scan, x, y, z) from customer: 80 x 80 m, 500 to a scan."""
    c = table(spark, sf_dir, "customer")
    x = F.pmod(F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(8000)) / F.lit(1e2) - 40
    y = F.col("c_custkey") * 7919 % 8000 / F.lit(1e2) - 40
    return c.select(F.col("c_custkey").alias("kp"), F.floor(F.col("c_custkey") / 500).alias("scan"), x.alias("x"), y.alias("y"), (F.col("c_custkey") % 100 / F.lit(100.0)).alias("z"))


#: Keypoints seen from another place: every keypoint of ``kp`` moved by a few centimetres.
TARGET = """
  SELECT kp AS tp, scan, x + (kp * 37 % 21 - 10) / 1e3 AS tx, y + (kp * 53 % 21 - 10) / 1e3 AS ty, z + (kp * 11 % 9 - 4) / 1e3 AS tz FROM kp WHERE kp % 5 <> 0
"""


def target(kps: DataFrame) -> DataFrame:
    k = F.col("kp")
    return kps.where(k % 5 != 0).select(k.alias("tp"), "scan", (F.col("x") + (k * 37 % 21 - 10) / F.lit(1e3)).alias("tx"), (F.col("y") + (k * 53 % 21 - 10) / F.lit(1e3)).alias("ty"), (F.col("z") + (k * 11 % 9 - 4) / F.lit(1e3)).alias("tz"))


#: Registration runs from orders: 10 seeds, 3 models, 15 pairs.
RUNS = """
  SELECT o_orderkey % 10 + 1 AS seed, CASE o_orderkey % 3 WHEN 0 THEN 'step' WHEN 1 THEN 'linear_a' ELSE 'physical' END AS model, o_custkey % 15 AS pair,
         bool_or(o_totalprice > 100000) AS success, CASE WHEN min(o_totalprice) > 20000 THEN NULL ELSE round(min(o_totalprice) / 1e5, 7) END AS e_p, count(*) AS n
  FROM orders GROUP BY ALL
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.when(F.col("o_orderkey") % 3 == 0, "step").when(F.col("o_orderkey") % 3 == 1, "linear_a").otherwise("physical")
    low = F.min("o_totalprice")
    return o.groupBy((F.col("o_orderkey") % 10 + 1).alias("seed"), m.alias("model"), (F.col("o_custkey") % 15).alias("pair")).agg(
        F.bool_or(F.col("o_totalprice") > 100000).alias("success"), F.when(~(low > 20000), F.round(low / 1e5, 7)).alias("e_p"), F.count("*").alias("n")
    )


#: Stems of a stand, one a supplier: on a grid of 4 m, a little beside its places, 12 m and more from the scanner.
STEMS = """
  SELECT s_suppkey AS stem, 14 + 4 * (s_suppkey % side) + (s_suppkey * 37 % 21 - 10) / 20.0::DOUBLE AS x, 4 * (s_suppkey // side - side // 2) + (s_suppkey * 53 % 21 - 10) / 20.0::DOUBLE AS y,
         0.25 + s_suppkey % 11 / 50.0::DOUBLE AS radius
  FROM supplier, (SELECT ceil(sqrt(count(*)))::BIGINT AS side FROM supplier)
"""


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, x, y, z, radius): where the stems of ``stand`` stand on its ground, a plane."""
    s = table(spark, sf_dir, "supplier")
    side = s.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("side"))  # one row
    k = F.col("s_suppkey")
    beside = lambda f: (k * f % 21 - 10) / F.lit(20.0)
    at = s.crossJoin(F.broadcast(side)).select(k.alias("stem"), (14 + 4 * (k % F.col("side")) + beside(37)).alias("x"), (4 * (F.floor(k / F.col("side")) - F.floor(F.col("side") / 2)) + beside(53)).alias("y"), (0.25 + k % 11 / F.lit(50.0)).alias("radius"))
    return at.select("stem", "x", "y", _plane(F.col("x"), F.col("y")).alias("z"), "radius")


def _plane(x: Column, y: Column) -> Column:
    return F.lit(0.1) * x + F.lit(0.05) * y - 1.5


def stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z) of a stand with a point for each row of lineitem, the supplier's part being a third ground around its stem and
    two thirds the stem's surface up to 2 m. Area and points grow together with the tables."""
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    part = lambda f: n * f % 1000003 / F.lit(1000003.0)
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stem"), n.alias("n"), part(569840).alias("a"), part(754877).alias("b"))
    p = own.join(sent_if_few(stems(spark, sf_dir).withColumnRenamed("z", "foot")), "stem")
    noise = (F.col("n") * 31 % 7 - 3) / F.lit(1000.0)
    turn = F.col("a") * F.lit(2 * math.pi)
    on_stem = F.col("n") % 3 != 0
    r = F.col("radius") + noise
    x = F.when(on_stem, F.col("x") + r * F.cos(turn)).otherwise(F.col("x") + 4 * F.col("a") - 2)
    y = F.when(on_stem, F.col("y") + r * F.sin(turn)).otherwise(F.col("y") + 4 * F.col("b") - 2)
    p = p.select(x.alias("x"), y.alias("y"), on_stem.alias("on"), (F.col("foot") + F.lit(0.05) + F.lit(1.95) * F.col("b")).alias("up"), noise.alias("noise"))
    return p.select("x", "y", F.when(F.col("on"), F.col("up")).otherwise(_plane(F.col("x"), F.col("y")) + F.col("noise")).alias("z"))
