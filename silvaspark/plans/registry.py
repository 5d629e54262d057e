"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.functions.retention import Retention, distance, mix, model, probability
from silvaspark.operators import keypoints as K
from silvaspark.operators import points as P
from silvaspark.operators import registration as R
from silvaspark.operators import reports, sampling, spatial, terrain
from silvaspark.plans import projections as V
from silvaspark.runtime import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def r6(c, n: int = 6):
    return F.round(c, n)


MODELS = [model(k) for k in ("step", "linear_a", "linear_mid", "physical", "none")]
P_SQL = {
    "step": "CASE WHEN d < 5 THEN 0.5 WHEN d < 10 THEN 0.75 ELSE 1.0 END",
    "linear_a": "least(greatest(0.5::DOUBLE + 0.05::DOUBLE * d, 0), 1)",
    "linear_mid": "least(greatest(0.375::DOUBLE + 0.05::DOUBLE * d, 0), 1)",
    "physical": "least(greatest(greatest(0.1::DOUBLE, (d / 10) * (d / 10)), 0), 1)",
    "none": "1.0",
}
MOD = "18446744073709551616::UHUGEINT"


def uniform_sql(seed: int, name: str = "u") -> str:
    """CTEs that end in ``name``(xi, yi, zi, d, u): the hash chain in 128-bit arithmetic."""
    h0 = int(mix(np.full(1, seed, np.uint64))[0])
    out, at = [], "base"
    out.append(f"base{name} AS (SELECT xi, yi, zi, sqrt(x * x + y * y) AS d, {h0}::UHUGEINT AS h FROM pts)")
    at = f"base{name}"
    step = 0
    for c in ("xi", "yi", "zi"):
        q = f"(CASE WHEN {c} < 0 THEN ({MOD} - (-{c})::UHUGEINT) ELSE {c}::UHUGEINT END)"
        for expr in (
            f"(xor(h, {q}) + 11400714819323198485::UHUGEINT) % {MOD}",
            f"(xor(h, h // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {MOD}",
            f"(xor(h, h // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {MOD}",
            "xor(h, h // 2147483648::UHUGEINT)",
        ):
            nxt = f"{name}{step}"
            out.append(f"{nxt} AS (SELECT xi, yi, zi, d, {expr} AS h FROM {at})")
            at, step = nxt, step + 1
    out.append(f"{name} AS (SELECT xi, yi, zi, d, (h // 2048::UHUGEINT)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM {at})")
    return ",\n".join(out)


U1 = f"WITH pts AS ({V.PTS}),\n{uniform_sql(1)}"


@query(f"""{U1}, b AS (
  SELECT floor(d)::INT AS bin, count(*) AS n, count(*) FILTER (u < {P_SQL['step']}) AS kept, avg({P_SQL['step']}) AS p FROM u GROUP BY 1
)
SELECT g::DOUBLE AS d_lo, (g + 1)::DOUBLE AS d_hi, coalesce(n, 0)::BIGINT AS n, coalesce(kept, 0)::BIGINT AS kept,
       round(CASE WHEN n > 0 THEN kept::DOUBLE / n ELSE 0 END, 6) AS empirical_rate, round(coalesce(p, 0)::DOUBLE, 6) AS mean_p
FROM range(0, (SELECT max(bin) + 1 FROM b)) AS r(g) LEFT JOIN b ON bin = g""")
def retention_bins_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sampling.bins(sampling.with_kept(V.sampled(spark, sf_dir), model("step"), u="u1"))
    return b.withColumns({"empirical_rate": r6("empirical_rate"), "mean_p": r6("mean_p")})


@query(f"WITH pts AS ({V.PTS}),\n{uniform_sql(1, 'u1')},\n{uniform_sql(2, 'u2')},\n{uniform_sql(3, 'u3')},\na AS (SELECT 'u1' AS u_column, * FROM u1 UNION ALL SELECT 'u2', * FROM u2 UNION ALL SELECT 'u3', * FROM u3)\n"
       + "\nUNION ALL ".join(f"SELECT '{k}' AS label, u_column, count(*) FILTER (u < {P_SQL[k]}) AS kept FROM a GROUP BY u_column" for k in P_SQL))
def retention_versions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.kept_counts(V.sampled(spark, sf_dir, (1, 2, 3)), MODELS, us=["u1", "u2", "u3"])


def _budget(spark: SparkSession, sf_dir: str, base: Retention) -> DataFrame:
    p = V.sampled(spark, sf_dir).select("d", F.col("u1").alias("u"))
    target = sampling.count_kept(p, model("step"))
    m = sampling.budget_by_rank(p, base, target)
    value = m.d0 if base.kind == "physical" else m.intercept
    return p.agg(F.count_if(F.col("u") < probability(m, F.col("d"))).alias("kept")).select(F.lit(m.label).alias("label"), F.lit(target).cast("long").alias("target"), r6(F.lit(float(value)), 8).alias("value"), "kept")


@query(f"""{U1}, t AS (SELECT count(*) FILTER (u < {P_SQL['step']}) AS target FROM u),
k AS (SELECT u - 0.05::DOUBLE * d AS k, row_number() OVER (ORDER BY u - 0.05::DOUBLE * d) AS r FROM u),
v AS (SELECT (max(CASE WHEN r = target THEN k END) + max(CASE WHEN r = target + 1 THEN k END)) / 2 AS value FROM k, t)
SELECT 'linear*' AS label, target, round(value, 8) AS value, (SELECT count(*) FROM u WHERE u < least(greatest(value + 0.05::DOUBLE * d, 0), 1)) AS kept FROM t, v""")
def budget_linear_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, model("linear_a"))


@query(f"""{U1}, t AS (SELECT count(*) FILTER (u < {P_SQL['step']}) AS target, count(*) FILTER (u < 0.1::DOUBLE) AS sure FROM u),
k AS (SELECT d / sqrt(u) AS k, row_number() OVER (ORDER BY d / sqrt(u) DESC) AS r FROM u WHERE u >= 0.1::DOUBLE),
v AS (SELECT (max(CASE WHEN r = target - sure THEN k END) + max(CASE WHEN r = target - sure + 1 THEN k END)) / 2 AS value FROM k, t)
SELECT 'physical*' AS label, target, round(value, 8) AS value, (SELECT count(*) FROM u WHERE u < least(greatest(0.1::DOUBLE, (d / value) * (d / value)), 1)) AS kept FROM t, v""")
def budget_physical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, model("physical"))


def _halving_sql(name: str, label: str, few: str, many: str, p: str) -> str:
    """CTEs that end in ``name``: bisection until the count is within the tolerance, at most 60 times, the nearest of all tried places."""
    n = f"(SELECT count(*) FROM once WHERE u < least(greatest({p}, 0), 1))"
    at = lambda v: n.replace("$", v)
    # three rows of {name}r: both ends, then a row for each halving, which knows the ends it leaves
    return f"""{name}e AS (SELECT target, greatest(1.0, 0.001 * target) AS tol, {at(few)} AS c0, {at(many)} AS c1 FROM t),
{name}r AS (SELECT 0 AS i, {few} AS few, {many} AS many, CASE WHEN abs(c0 - target) <= abs(c1 - target) THEN c0 ELSE c1 END AS kept, target, tol FROM {name}e
  UNION ALL SELECT i + 1, CASE WHEN c < target THEN mid ELSE few END, CASE WHEN c < target THEN many ELSE mid END, CASE WHEN abs(c - target) < abs(kept - target) THEN c ELSE kept END, target, tol
  FROM (SELECT *, {at('q.mid')} AS c FROM (SELECT *, (few + many) / 2 AS mid FROM {name}r WHERE i < 60 AND abs(kept - target) > tol) AS q)),
{name} AS (SELECT '{label}' AS label, target, last(kept ORDER BY i) AS kept, max(i)::INT AS iterations, bool_or(abs(kept - target) <= tol) AS converged FROM {name}r GROUP BY target)"""


@query(f"""{U1.replace("WITH", "WITH RECURSIVE", 1)}, once AS MATERIALIZED (SELECT d, u FROM u), t AS (SELECT count(*) FILTER (u < {P_SQL['step']}) AS target FROM u),
{_halving_sql('lin', 'linear*', '(-0.5::DOUBLE)', '1.0::DOUBLE', '$ + 0.05::DOUBLE * d')},
{_halving_sql('phy', 'physical*', 'ln(1000.0::DOUBLE)', 'ln(0.1::DOUBLE)', 'greatest(0.1::DOUBLE, (d / exp($)) * (d / exp($)))')}
SELECT * FROM lin UNION ALL SELECT * FROM phy""")
def budget_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pts(spark, sf_dir).select("x", "y", "z").withColumn("d", distance(F.col("x"), F.col("y")))
    target = sampling.each_run(p, [(model("step"), 1)]).agg(F.count_if("kept")).first()[0]
    found = sampling.budgets_by_bisection(p, [(model(k), 1) for k in ("linear_a", "physical")], {1: target})
    return spark.createDataFrame([(m.label, target, kept, n, ok) for m, kept, n, ok in found], "label string, target long, kept long, iterations int, converged boolean")


_KEYS = [("linear*", "u - 0.05::DOUBLE * d", "least(greatest(value + 0.05::DOUBLE * d, 0), 1)", ""), ("physical*", "-(d / sqrt(u))", "least(greatest(0.1::DOUBLE, (d / value) * (d / value)), 1)", "WHERE u >= 0.1::DOUBLE")]


@query(f"WITH pts AS ({V.PTS}),\n" + ",\n".join(uniform_sql(s, f"u{s}") for s in (1, 2, 3)) + f""",
a AS (SELECT 1 AS seed, * FROM u1 UNION ALL SELECT 2, * FROM u2 UNION ALL SELECT 3, * FROM u3),
t AS (SELECT seed, count(*) FILTER (u < {P_SQL['step']}) AS target, count(*) FILTER (u < 0.1::DOUBLE) AS sure FROM a GROUP BY seed), """ + ", ".join(f"""
k{n} AS (SELECT seed, {key} AS k, row_number() OVER (PARTITION BY seed ORDER BY {key}) AS r FROM a {only}),
v{n} AS (SELECT seed, target, {"-" if n else ""}(max(CASE WHEN r = target{" - sure" if n else ""} THEN k END) + max(CASE WHEN r = target{" - sure" if n else ""} + 1 THEN k END)) / 2 AS value FROM k{n} JOIN t USING (seed) GROUP BY seed, target)""" for n, (_, key, _, only) in enumerate(_KEYS)) + "\n" + " UNION ALL ".join(f"SELECT seed, '{label}' AS label, target, round(value, 8) AS value, (SELECT count(*) FROM a WHERE a.seed = v{n}.seed AND u < {p}) AS kept FROM v{n}" for n, (label, _, p, _) in enumerate(_KEYS)))
def budgets_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and physical models with the step model's number of points, for three seeds in the same passes."""
    seeds = (1, 2, 3)
    p = written(V.sampled(spark, sf_dir, seeds).drop("x", "y", "z"), "sampled")
    targets = {r["u_column"]: r["kept"] for r in sampling.kept_counts(p, [model("step")], us=[f"u{s}" for s in seeds]).collect()}
    wanted = [(model(k), f"u{s}", targets[f"u{s}"]) for s in seeds for k in ("linear_a", "physical")]
    found = sampling.budgets_by_rank(p, wanted)
    rows = [(int(u[1:]), m.label, t, float(m.d0 if m.kind == "physical" else m.intercept)) for m, (_, u, t) in zip(found, wanted, strict=True)]
    kept = p.agg(*[F.count_if(F.col(u) < probability(m, F.col("d"))).alias(f"k{n}") for n, (m, (_, u, _)) in enumerate(zip(found, wanted, strict=True))]).first()
    told = spark.createDataFrame([(*r, kept[f"k{n}"]) for n, r in enumerate(rows)], "seed int, label string, target long, value double, kept long")
    return told.withColumn("value", r6("value", 8))


@query(f"""WITH d AS (SELECT DISTINCT round(sqrt(x * x + y * y), 2) AS d FROM ({V.PTS}))
""" + "\nUNION ALL ".join(f"SELECT '{k}' AS label, d, round(({e})::DOUBLE, 9) AS p FROM d" for k, e in P_SQL.items()))
def retention_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(d) of every model at every distance of the cloud, in centimetres."""
    d = V.pts(spark, sf_dir).select(F.round(distance(F.col("x"), F.col("y")), 2).alias("d")).distinct()
    return d.select("d", F.inline(F.array(*[F.struct(F.lit(m.label).alias("label"), r6(probability(m, F.col("d")), 9).alias("p")) for m in MODELS])))


@query(f"""WITH pts AS ({V.PTS}), b AS (SELECT floor(d)::INT AS bin, count(*) AS n, count(*) FILTER (u < {P_SQL['step']}) AS kept FROM u GROUP BY 1), {uniform_sql(1)}
SELECT CASE WHEN bin < 10 THEN 'near' ELSE 'far' END AS part, sum(n)::BIGINT AS n, sum(kept)::BIGINT AS kept, round(sum(kept)::DOUBLE / sum(n), 6) AS rate FROM b GROUP BY 1""".replace(", b AS (SELECT floor(d)::INT AS bin, count(*) AS n, count(*) FILTER (u < " + P_SQL["step"] + ") AS kept FROM u GROUP BY 1), " + uniform_sql(1), ", " + uniform_sql(1) + ", b AS (SELECT floor(d)::INT AS bin, count(*) AS n, count(*) FILTER (u < " + P_SQL["step"] + ") AS kept FROM u GROUP BY 1)"))
def retention_near_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sampling.bins(sampling.with_kept(V.sampled(spark, sf_dir), model("step"), u="u1"))
    return reports.near_far(b, []).withColumn("rate", r6("rate"))


@query(f"""WITH pts AS ({V.PTS}), g AS (
  SELECT scan, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
         min(sqrt(x * x + y * y)) AS nearest, max(greatest(abs(x), abs(y), abs(z))) AS max_abs FROM pts GROUP BY scan)
SELECT scan, n, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y, round(max_y, 6) AS max_y, round(min_z, 6) AS min_z, round(max_z, 6) AS max_z,
       round(nearest, 6) AS nearest, round(max_abs, 6) AS max_abs,
       ((nearest > 3)::INT + (greatest(max_x - min_x, max_y - min_y) < 1)::INT + (greatest(max_x - min_x, max_y - min_y) > 5000)::INT + (max_z - min_z > 200)::INT) AS n_warnings FROM g""")
def sanity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.sanity(V.pts(spark, sf_dir), ["scan"])
    cols = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "nearest", "max_abs"]
    return s.select("scan", "n", *[r6(c).alias(c) for c in cols], F.size("warnings").alias("n_warnings"))


@query(f"""WITH pts AS ({V.PTS}), a AS (SELECT scan, round(sqrt(x * x + y * y + z * z), 3) AS r FROM pts), o AS (
  SELECT scan, r, row_number() OVER (PARTITION BY scan ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY scan) AS n FROM a)
SELECT scan, count(*) AS n, min(r) AS r_min, max(r) AS r_max, max(CASE WHEN k = floor(0.01::DOUBLE * (n - 1)) THEN r END) AS r_p1,
       max(CASE WHEN k = floor(0.5::DOUBLE * (n - 1)) THEN r END) AS r_median, max(CASE WHEN k = floor(0.99::DOUBLE * (n - 1)) THEN r END) AS r_p99,
       count(*) FILTER (r <= 0.5) AS n_half, count(*) FILTER (r <= 1) AS n_one, count(*) FILTER (r <= 2) AS n_two,
       count(*) FILTER (r BETWEEN 49.5 AND 50) AS n_edge, count(*) FILTER (r > 50) AS n_beyond FROM o GROUP BY scan""")
def inspect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pts(spark, sf_dir).select("scan", F.round(distance(F.col("x"), F.col("y"), F.col("z")), 3).alias("r"))
    return P.range_stats(p, ["scan"])


@query(f"""WITH pts AS ({V.PTS}), o(origin, ox, oy, oz) AS (VALUES {', '.join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for n, x, y, z in P.ORIGINS)}),
d AS (SELECT origin, x - ox AS dx, y - oy AS dy, z - oz AS dz FROM pts, o),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS h FROM d), f AS (SELECT * FROM e WHERE sqrt(h * h + dz * dz) BETWEEN 2 AND 30),
b AS (SELECT origin, floor(degrees(atan2(dy, dx)) / 0.5::DOUBLE) AS a, floor(degrees(atan2(dz, h)) / 0.5::DOUBLE) AS e, count(*) AS c FROM f GROUP BY ALL),
k AS (SELECT origin, c, row_number() OVER (PARTITION BY origin ORDER BY c DESC) AS r, count(*) OVER (PARTITION BY origin) AS occupied FROM b)
SELECT origin, sum(c)::BIGINT AS n, max(occupied)::BIGINT AS occupied, round(sum(CASE WHEN r <= greatest(1, floor(0.1::DOUBLE * occupied)) THEN c ELSE 0 END)::DOUBLE / sum(c), 6) AS score FROM k GROUP BY origin""")
def lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.createDataFrame(P.ORIGINS, "origin string, ox double, oy double, oz double")
    return P.lattice_score(V.pts(spark, sf_dir), o, bin_deg=0.5).withColumn("score", r6("score"))


@query(f"""WITH pts AS ({V.PTS}), c AS (
  SELECT *, floor(xi / 10000.0)::BIGINT AS vxi, floor(yi / 10000.0)::BIGINT AS vyi, floor(zi / 10000.0)::BIGINT AS vzi FROM pts),
s AS (SELECT vxi, vyi, vzi, count(*) AS n, sum(xi)::BIGINT AS sx, sum(yi)::BIGINT AS sy, sum(zi)::BIGINT AS sz FROM c GROUP BY ALL),
r AS (SELECT c.*, n, row_number() OVER (PARTITION BY vxi, vyi, vzi ORDER BY (n * xi - sx) * (n * xi - sx) + (n * yi - sy) * (n * yi - sy) + (n * zi - sz) * (n * zi - sz), xi, yi, zi) AS k
      FROM c JOIN s USING (vxi, vyi, vzi))
SELECT vxi, vyi, vzi, n, xi, yi, zi FROM r WHERE k = 1""")
def voxel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.voxel_nearest(V.pts(spark, sf_dir), 10000)


TERRAIN = terrain.Params(cell=1.0, support_dz=0.4, support_count=2)
GROUND = f"""pts AS ({V.PTS}), c AS (SELECT floor(x)::INT AS ix, floor(y)::INT AS iy, x, y, z FROM pts),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY z, x, y) AS r, count(*) OVER (PARTITION BY ix, iy) AS n,
             count(*) OVER (PARTITION BY ix, iy ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND 0.4::DOUBLE FOLLOWING) AS upto FROM c),
w AS (SELECT ix, iy, n, coalesce(min(CASE WHEN upto - r >= 2 THEN r END), min(CASE WHEN r = floor(0.05::DOUBLE * (n - 1)) + 1 THEN r END)) AS r FROM k WHERE n >= 3 GROUP BY ix, iy, n),
g AS (SELECT w.ix, w.iy, x, y, z, w.n FROM w JOIN k USING (ix, iy, r))"""


@query(f"WITH {GROUND} SELECT * FROM g")
def ground_supported_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.ground_samples(V.pts(spark, sf_dir), TERRAIN)


@query(f"""WITH pts AS ({V.PTS}), c AS (SELECT floor(x)::INT AS ix, floor(y)::INT AS iy, x, y, z FROM pts),
k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY z, x, y) AS r, count(*) OVER (PARTITION BY ix, iy) AS n FROM c)
SELECT ix, iy, x, y, z, n FROM k WHERE n >= 3 AND r = floor(0.05::DOUBLE * (n - 1)) + 1""")
def ground_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.ground_samples(V.pts(spark, sf_dir), terrain.Params(cell=1.0, ground_select="percentile"))


SLOPED = f"""{GROUND}, s AS (SELECT * FROM g a WHERE NOT EXISTS (
  SELECT 1 FROM g b WHERE (a.ix <> b.ix OR a.iy <> b.iy) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25
    AND a.z - b.z > 0.5::DOUBLE * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 0.3::DOUBLE))"""


@query(f"WITH {SLOPED} SELECT ix, iy, x, y, z, n FROM s")
def ground_slope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.slope_filter(terrain.ground_samples(V.pts(spark, sf_dir), TERRAIN), TERRAIN)


def _plane_sql(source: str) -> str:
    return f"""SELECT *, (sz - b * sx - c * sy) / m AS a FROM (SELECT *, (cxz * cyy - cyz * cxy) / det AS b, (cyz * cxx - cxz * cxy) / det AS c FROM (
      SELECT *, cxx * cyy - cxy * cxy AS det FROM (SELECT *, sxx - sx * sx / m AS cxx, sxy - sx * sy / m AS cxy, syy - sy * sy / m AS cyy, sxz - sx * sz / m AS cxz, syz - sy * sz / m AS cyz
      FROM ({source}))) WHERE m >= 3 AND det > 1e-12 * (cxx + cyy) * (cxx + cyy) AND det > 0)"""


def _sum_sql(dx: str, dy: str) -> str:
    return f"count(*) AS m, sum({dx}) AS sx, sum({dy}) AS sy, sum(z) AS sz, sum(({dx}) * ({dx})) AS sxx, sum(({dx}) * ({dy})) AS sxy, sum(({dy}) * ({dy})) AS syy, sum(({dx}) * z) AS sxz, sum(({dy}) * z) AS syz"


PLANES = f"""{SLOPED}, nb AS (SELECT a.ix AS tx, a.iy AS ty, a.z AS z0, a.x AS x0, a.y AS y0, b.x, b.y, b.z FROM s a JOIN s b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 AND (a.ix <> b.ix OR a.iy <> b.iy)),
o AS ({_plane_sql(f"SELECT tx, ty, z0, {_sum_sql('x - x0', 'y - y0')} FROM nb GROUP BY tx, ty, z0")}),
s2 AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE tx = s.ix AND ty = s.iy AND z0 - a > 0.5)),
box AS (SELECT min(ix) AS i0, max(ix) AS i1, min(iy) AS j0, max(iy) AS j1 FROM c),
cells AS (SELECT i.i AS tx, j.j AS ty FROM box, range(i0, i1 + 1) AS i(i), range(j0, j1 + 1) AS j(j)),
win AS (SELECT tx, ty, r.r, s2.x - (tx + 0.5) AS dx, s2.y - (ty + 0.5) AS dy, s2.z FROM cells JOIN s2 ON abs(ix - tx) <= 5 AND abs(iy - ty) <= 5 JOIN range(2, 6) AS r(r) ON greatest(abs(ix - tx), abs(iy - ty)) <= r.r),
fit AS ({_plane_sql(f"SELECT tx, ty, r, {_sum_sql('dx', 'dy')} FROM win GROUP BY tx, ty, r")}),
pl AS (SELECT tx AS ix, ty AS iy, a, b, c, r FROM fit f WHERE r = (SELECT min(r) FROM fit e WHERE e.tx = f.tx AND e.ty = f.ty))"""


@query(f"WITH {PLANES} SELECT ix::INT AS ix, iy::INT AS iy, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, r::INT AS r FROM pl")
def terrain_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pl, _ = terrain.build(V.pts(spark, sf_dir), TERRAIN)
    return pl.select("ix", "iy", r6("a", 5).alias("a"), r6("b", 5).alias("b"), r6("c", 5).alias("c"), F.col("r").cast("int").alias("r"))


@query(f"""WITH {PLANES} SELECT (i1 - i0 + 1)::BIGINT AS nx, (j1 - j0 + 1)::BIGINT AS ny, (SELECT count(*) FROM g) AS with_sample, (SELECT count(*) FROM g) - (SELECT count(*) FROM s) AS rejected_slope,
       (SELECT count(*) FROM s) - (SELECT count(*) FROM s2) AS rejected, (SELECT count(*) FROM pl) AS valid, (SELECT count(*) FROM pl ANTI JOIN s2 USING (ix, iy)) AS filled FROM box""")
def terrain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, st = terrain.build(V.pts(spark, sf_dir), TERRAIN)
    return st.select(F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"), "with_sample", "rejected_slope", "rejected", "valid", "filled")


@query(f"""WITH {PLANES}, q AS (SELECT x, y, z, floor(x)::INT AS ci, floor(y)::INT AS cj, floor(x - 0.5) AS i0, floor(y - 0.5) AS j0, row_number() OVER () AS id FROM pts),
own AS (SELECT q.* FROM q JOIN pl ON pl.ix = ci AND pl.iy = cj),
t AS (SELECT id, own.x, own.y, own.z, CASE WHEN di = 1 THEN x - 0.5 - i0 ELSE 1 - (x - 0.5 - i0) END * CASE WHEN dj = 1 THEN y - 0.5 - j0 ELSE 1 - (y - 0.5 - j0) END AS w,
             a + b * (x - (pl.ix + 0.5)) + c * (y - (pl.iy + 0.5)) AS h FROM own, range(0, 2) AS di(di), range(0, 2) AS dj(dj), pl WHERE pl.ix = i0 + di AND pl.iy = j0 + dj),
hh AS (SELECT id, x, y, z, sum(w * h) / sum(w) AS ground FROM t GROUP BY ALL)
SELECT x, y, z, round(ground, 5) AS ground, count(*) AS n FROM hh WHERE z - ground BETWEEN -0.05 AND 3 GROUP BY x, y, z, round(ground, 5)""")
def height_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.pts(spark, sf_dir).select("x", "y", "z")
    pl, _ = terrain.build(p, TERRAIN)
    s, _ = terrain.height_slice(p, pl, TERRAIN)
    return s.groupBy("x", "y", "z", r6("ground", 5).alias("ground")).agg(F.count("*").alias("n"))


THIN = f"SELECT DISTINCT xi * 1000000000000 + (yi + 200000) * 1000000 + zi + 15000 AS pid, x, y, z FROM ({V.PTS})"


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct by the integers, which pack better than coordinates; written, since joins ask for both sides
    p = V.pts(spark, sf_dir).select("xi", "yi", "zi").distinct()
    pid = F.col("xi") * 1000000000000 + (F.col("yi") + 200000) * 1000000 + F.col("zi") + 15000
    return written(p.select(pid.alias("pid"), *[(F.col(f"{c}i") / F.lit(1e4)).alias(c) for c in "xyz"]), "thinned")


NEAR = f"""WITH p AS ({THIN}), e AS (SELECT a.pid, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON floor(b.x / 0.4::DOUBLE) BETWEEN floor(a.x / 0.4::DOUBLE) - 1 AND floor(a.x / 0.4::DOUBLE) + 1
  AND b.y BETWEEN a.y - 0.41 AND a.y + 0.41 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.4::DOUBLE * 0.4::DOUBLE)"""


@query(f"{NEAR} SELECT pid, count(*) AS n FROM e GROUP BY pid")
def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbour_counts(_thin(spark, sf_dir), "pid", ["x", "y", "z"], 0.4)


@query(f"""{NEAR} SELECT pid, count(*) AS n, {', '.join(f'round(count(*) * sum(d{a} * d{b}) - sum(d{a}) * sum(d{b}), 9) + 0.0 AS c{a}{b}' for a, b in (('x', 'x'), ('x', 'y'), ('x', 'z'), ('y', 'y'), ('y', 'z'), ('z', 'z')))} FROM e GROUP BY pid HAVING count(*) >= 5""")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.moments(_thin(spark, sf_dir), "pid", 0.4)
    # times n*n the entries are multiples of 1e-8, so rounding cannot split ties
    return m.select("pid", "n", *[(r6(F.col(c) * F.col("n") * F.col("n"), 9) + F.lit(0.0)).alias(c) for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")])


@query()
def pca_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.normals(_thin(spark, sf_dir), "pid", 0.4)


@query(f"{NEAR} SELECT pid, count(*) AS n, true AS unit, true AS up, true AS eigen, true AS least FROM e GROUP BY pid HAVING count(*) >= 5")
def pca_normal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether normals are unit eigenvectors, turned up, of an eigenvalue that no axis's variance is below."""
    p = _thin(spark, sf_dir)
    j = spatial.normals(p, "pid", 0.4).join(spatial.moments(p, "pid", 0.4).drop("n"), "pid")
    v = {c: F.col(f"n{c}") for c in "xyz"}
    cov = lambda a, b: F.col("c" + "".join(sorted(a + b)))
    cn = {a: cov(a, "x") * v["x"] + cov(a, "y") * v["y"] + cov(a, "z") * v["z"] for a in "xyz"}
    lam = cn["x"] * v["x"] + cn["y"] * v["y"] + cn["z"] * v["z"]
    off = sum((F.abs(cn[a] - lam * v[a]) for a in "yz"), F.abs(cn["x"] - lam * v["x"]))
    unit = F.abs(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"] - 1) < 1e-9
    return j.select("pid", "n", unit.alias("unit"), (v["z"] >= 0).alias("up"), (off < 1e-9).alias("eigen"), (lam <= F.least("cxx", "cyy", "czz") + 1e-12).alias("least"))


@query(f"""WITH RECURSIVE p AS ({THIN}), e AS (SELECT a.pid AS u, b.pid AS v FROM p a JOIN p b ON b.x BETWEEN a.x - 0.16 AND a.x + 0.16 AND floor(b.y) BETWEEN floor(a.y) - 1 AND floor(a.y) + 1
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.15::DOUBLE * 0.15::DOUBLE AND a.pid <> b.pid),
r AS (SELECT pid AS u, pid AS v FROM p UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), m AS (SELECT u AS pid, min(v) AS cluster FROM r GROUP BY u)
SELECT cluster, pid, count(*) OVER (PARTITION BY cluster) AS size FROM m QUALIFY size >= 2""")
def clusters_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(_thin(spark, sf_dir), "pid", 0.15, min_points=2)


@query(f"""WITH RECURSIVE kp AS ({V.KP}), e AS (SELECT a.scan, a.kp AS u, b.kp AS v FROM kp a JOIN kp b USING (scan) WHERE a.kp <> b.kp AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1.5::DOUBLE * 1.5::DOUBLE),
r AS (SELECT kp AS u, kp AS v FROM kp UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), m AS (SELECT u AS kp, min(v) AS g FROM r GROUP BY u)
SELECT scan, g AS kp, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM kp JOIN m USING (kp) GROUP BY scan, g""")
def merge_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.merge_points(V.keypoints(spark, sf_dir), "kp", 1.5, ["scan"])
    return m.select("scan", "kp", *[r6(c).alias(c) for c in "xyz"], "n")


@query(f"""WITH RECURSIVE kp AS ({V.KP}), e AS (SELECT a.kp AS u, b.kp AS v FROM kp a JOIN kp b USING (scan) WHERE a.kp <> b.kp AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.5::DOUBLE * 0.5::DOUBLE),
r AS (SELECT kp AS u, kp AS v FROM kp UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), m AS (SELECT u AS kp, min(v) AS g FROM r GROUP BY u)
SELECT scan, count(*) AS trees, count(DISTINCT g) AS groups FROM kp JOIN m USING (kp) GROUP BY scan""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.merge_points(V.keypoints(spark, sf_dir), "kp", 0.5, ["scan"])
    return m.groupBy("scan").agg(F.sum("n").alias("trees"), F.count("*").alias("groups"))


# keypoint descriptors; 30 sectors, so that many sectors of many keypoints are taken
CN = K.Params(n=33)
PAIRS = f"""kp AS ({V.KP}), pr AS (SELECT * FROM (SELECT a.scan, a.kp, b.kp AS q, b.x - a.x AS vx, b.y - a.y AS vy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM kp a JOIN kp b USING (scan) WHERE a.kp <> b.kp) WHERE d >= 1e-9),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan, kp ORDER BY d, q) AS rank FROM pr) WHERE rank <= 3)"""
MATRIX = f"""{PAIRS}, an AS (SELECT p.scan, p.kp, n.rank AS encode, p.q, p.d, atan2(n.vx * p.vy - n.vy * p.vx, n.vx * p.vx + n.vy * p.vy) AS t FROM pr p JOIN nn n USING (scan, kp)),
se AS (SELECT *, least(greatest(floor(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END / (2 * pi() / 30)), 0), 29)::INT AS sector FROM an),
fm AS (SELECT scan, kp, encode, sector, q, d FROM (SELECT *, row_number() OVER (PARTITION BY scan, kp, encode, sector ORDER BY d, q) AS k FROM se) WHERE k = 1)"""
DESC = f"""{MATRIX}, de AS (SELECT scan, kp, (rank - 1)::INT AS dim, d AS val, q AS nb FROM nn
  UNION ALL SELECT scan, kp, (sector + 3)::INT, d, q FROM (SELECT *, row_number() OVER (PARTITION BY scan, kp, sector ORDER BY encode) AS k FROM fm) WHERE k = 1)"""


@query(f"WITH {PAIRS} SELECT scan, kp, rank::INT AS rank, q, round(d, 8) AS d FROM nn")
def knn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nearest_three(K.pairs(V.keypoints(spark, sf_dir))).select("scan", "kp", "rank", "q", r6("d", 8).alias("d"))


@query(f"WITH {MATRIX} SELECT scan, kp, encode::INT AS encode, sector, q, round(d, 8) AS d FROM fm")
def cn_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.feature_matrix(V.keypoints(spark, sf_dir), CN).withColumn("d", r6("d", 8))


@query(f"WITH {DESC} SELECT scan, kp, dim, round(val, 8) AS val, nb FROM de")
def cn_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.descriptors(V.keypoints(spark, sf_dir), CN).withColumn("val", r6("val", 8))


@query(f"""WITH {MATRIX}, n3 AS (SELECT scan, kp, max(CASE WHEN rank = 1 THEN q END) AS n1, max(CASE WHEN rank = 2 THEN q END) AS n2 FROM nn GROUP BY scan, kp),
z AS (SELECT scan, kp, max(CASE WHEN encode = 2 THEN q END) AS e2, max(CASE WHEN encode = 3 THEN q END) AS e3 FROM fm WHERE sector = 0 GROUP BY scan, kp)
SELECT scan, count(*) AS n, count(*) FILTER (e2 = n1) AS enc2_first, count(*) FILTER (e3 = n1 OR e3 = n2) AS enc3_first,
  sum((SELECT count(*) FROM kp a JOIN kp b ON a.scan = b.scan AND a.kp <> b.kp WHERE a.kp = n3.kp AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1e-9))::BIGINT AS coincident
FROM n3 LEFT JOIN z USING (scan, kp) GROUP BY scan""")
def cn_descriptor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.descriptor_stats(V.keypoints(spark, sf_dir), CN)


def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kps = V.keypoints(spark, sf_dir)
    t = V.target(kps).select(F.col("tp").alias("kp"), "scan", F.col("tx").alias("x"), F.col("ty").alias("y"))
    # written, since scores and agreements both ask for them
    return written(K.packed(kps, CN), "descriptors"), written(K.packed(t, CN), "descriptors")


def _again(sql: str) -> str:
    """The descriptor CTEs once more for the moved keypoints, all names with a 2."""
    import re

    body = sql.replace(f"kp AS ({V.KP})", f"kp2src AS ({V.TARGET}), kp AS (SELECT tp AS kp, scan, tx AS x, ty AS y FROM kp2src)")
    head, rest = body.split(", pr AS (", 1)
    rest = "pr AS (" + rest
    for name in ("pr", "nn", "an", "se", "fm", "de"):
        rest = re.sub(rf"\b{name}\b(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{name}2", rest)
    rest = rest.replace("FROM kp a JOIN kp b", "FROM kpt a JOIN kpt b")
    return f"kpt AS (SELECT tp AS kp, scan, tx AS x, ty AS y FROM ({V.TARGET})), {rest}"


GATE = f"""WITH {DESC}, {_again(DESC)}, gate AS (SELECT DISTINCT a.scan, a.kp AS i, b.kp AS j FROM de a JOIN de2 b ON a.scan = b.scan AND a.dim = b.dim AND a.dim < 3 AND abs(a.val - b.val) < 0.05::DOUBLE)"""
AGREE = f"""{GATE}, agree AS (SELECT a.scan, a.kp AS i, b.kp AS j, a.dim, a.nb AS na, b.nb AS nb FROM de a JOIN de2 b ON a.scan = b.scan AND a.dim = b.dim AND a.dim >= 3 AND abs(a.val - b.val) < 0.05::DOUBLE),
dc AS (SELECT gate.scan, gate.i, gate.j, count(agree.dim) AS dc FROM gate LEFT JOIN agree ON agree.scan = gate.scan AND agree.i = gate.i AND agree.j = gate.j GROUP BY ALL)"""
BEST = f"""{AGREE}, one AS (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY scan, i ORDER BY dc DESC, j) = 1),
best AS (SELECT * FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY scan, j ORDER BY dc DESC, i) = 1) WHERE dc >= 3)"""


@query(f"{GATE} SELECT * FROM gate")
def cn_gatekeeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gatekeeper(*_described(spark, sf_dir), 0.05, ["scan"])


@query(f"{AGREE} SELECT * FROM dc")
def cn_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dc_scores(*_described(spark, sf_dir), 0.05, ["scan"])


@query(f"{BEST} SELECT scan, i, j, dc FROM best")
def cn_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_pairs(K.dc_scores(*_described(spark, sf_dir), 0.05, ["scan"]), 3, ["scan"])


@query(f"""{BEST}, fq AS (SELECT agree.scan, na AS i, nb AS j, count(*) AS fm FROM agree JOIN best USING (scan, i, j) GROUP BY agree.scan, na, nb)
SELECT best.scan, best.i, best.j, dc, coalesce(fm, 0) AS fm, 10.0::DOUBLE * coalesce(fm, 0) + dc AS score FROM best LEFT JOIN fq ON fq.scan = best.scan AND fq.i = best.i AND fq.j = best.j""")
def cn_fm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.candidates(*_described(spark, sf_dir), 0.05)[0]


@query()
def cn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kps = V.keypoints(spark, sf_dir)
    t = V.target(kps).select(F.col("tp").alias("kp"), "scan", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return K.match(kps, t, CN, ["scan"])


_SIDES = """SELECT a.scan, a.kp AS a, b.kp AS b, c.kp AS c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS ab, sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)) AS bc,
  sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) AS ca FROM {0} a JOIN {0} b ON a.scan = b.scan AND a.kp < b.kp JOIN {0} c ON b.scan = c.scan AND b.kp < c.kp"""
_TURNS = [("a", "b", "c", "ab", "bc", "ca"), ("a", "c", "b", "ca", "bc", "ab"), ("b", "a", "c", "ab", "ca", "bc"), ("b", "c", "a", "bc", "ca", "ab"), ("c", "a", "b", "ca", "ab", "bc"), ("c", "b", "a", "bc", "ab", "ca")]


NAMED = f"""{BEST}, fq AS (SELECT agree.scan, na AS i, nb AS j, count(*) AS fm FROM agree JOIN best USING (scan, i, j) GROUP BY agree.scan, na, nb),
sc AS (SELECT best.scan, best.i, best.j, dc, coalesce(fm, 0) AS fm, 10.0::DOUBLE * coalesce(fm, 0) + dc AS score FROM best LEFT JOIN fq ON fq.scan = best.scan AND fq.i = best.i AND fq.j = best.j),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY scan ORDER BY score DESC, dc DESC, i) = 1),
named AS (SELECT agree.scan, na, nb FROM agree JOIN top USING (scan, i, j)),
ss AS (SELECT scan, kp, x, y FROM kp SEMI JOIN named ON named.scan = kp.scan AND na = kp), tt AS (SELECT scan, kp, x, y FROM kpt SEMI JOIN named ON named.scan = kpt.scan AND nb = kp)"""


@query(f"""{NAMED}, s AS ({_SIDES.format('ss')}), t0 AS ({_SIDES.format('tt')}),
t AS ({' UNION ALL '.join(f'SELECT scan, a, b, c, {k} AS k, {p} AS ta, {q} AS tb, {r} AS tc, {x} AS t1, {y} AS t2, {z} AS t3 FROM t0' for k, (p, q, r, x, y, z) in enumerate(_TURNS))}),
tb AS (SELECT t.*, floor(t1 / 0.05::DOUBLE)::BIGINT + o AS bucket FROM t, range(-1, 2) AS r(o)),
fit AS (SELECT s.scan, s.a, s.b, s.c, ta, t.tb, tc FROM s JOIN tb t ON s.scan = t.scan AND floor(s.ab / 0.05::DOUBLE)::BIGINT = bucket AND abs(s.ab - t1) < 0.05::DOUBLE AND abs(s.bc - t2) < 0.05::DOUBLE AND abs(s.ca - t3) < 0.05::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY s.scan, s.a, s.b, s.c, t.a, t.b, t.c ORDER BY k) = 1)
SELECT scan, s, t, count(*) AS votes FROM (SELECT scan, a AS s, ta AS t FROM fit UNION ALL SELECT scan, b, tb FROM fit UNION ALL SELECT scan, c, tc FROM fit) GROUP BY ALL""")
def triangle_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes over all keypoints that the dimensions of each scan's best pair name, as in ``match``."""
    kps = V.keypoints(spark, sf_dir)
    a, b = _described(spark, sf_dir)
    named = written(K.named_by_best(K.candidates(a, b, 0.05)[0], a, b, 0.05), "named")
    t = V.target(kps).select(F.col("tp").alias("kp"), "scan", F.col("tx").alias("x"), F.col("ty").alias("y"))
    s = K.triangle_sides(kps, named.select("scan", F.col("na").alias("kp")), ["scan"])
    return K.triangle_votes(s, K.triangle_sides(t, named.select("scan", F.col("nb").alias("kp")), ["scan"]), 0.05, ["scan"])


def _registered(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...]) -> DataFrame:
    """Scans against their moved selves; the last scan has no keypoint on the target's side, so its rows hold no transform."""
    from silvaspark.plans import pipeline

    kps = V.keypoints(spark, sf_dir)
    t = V.target(kps).where(F.col("scan") > 0).select(F.col("tp").alias("kp"), "scan", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    truth = kps.select("scan").distinct().select("scan", *[F.lit(_IDENT.get(c, 0.0)).alias(c) for c in R.R_COLS + R.T_COLS])
    return pipeline.register(kps, t, truth, V.pts(spark, sf_dir).select("x", "y", "z"), thresholds, prm=CN, keys=["scan"], iterations=200)


@query(f"""{NAMED}, jobs AS (SELECT scan, count(*) AS n_src_kp FROM kp GROUP BY scan), tk AS (SELECT scan, count(*) AS n FROM kpt WHERE scan > 0 GROUP BY scan),
de1 AS (SELECT scan, count(DISTINCT kp) AS n FROM nn GROUP BY scan), dt1 AS (SELECT scan, count(DISTINCT kp) AS n FROM nn2 WHERE scan > 0 GROUP BY scan),
ga AS (SELECT scan, count(*) AS n FROM gate WHERE scan > 0 GROUP BY scan), ca AS (SELECT scan, count(*) AS n, count(*) FILTER (score > 40) AS over FROM sc WHERE scan > 0 GROUP BY scan),
tp AS (SELECT * FROM top WHERE scan > 0), nm AS (SELECT scan, count(DISTINCT na) AS a, count(DISTINCT nb) AS b FROM named JOIN tp USING (scan) WHERE score < 40 GROUP BY scan)
SELECT scan, solver, 0.05::DOUBLE AS threshold, 'paper' AS setting, n_src_kp, coalesce(tk.n, 0) AS n_tgt_kp, coalesce(de1.n, 0) AS descriptors_src, coalesce(dt1.n, 0) AS descriptors_tgt, coalesce(ga.n, 0) AS gate_passed,
  coalesce(ca.n, 0) AS candidates, coalesce(tp.score, 0.0)::DOUBLE AS best_score, coalesce(tp.dc, 0) AS best_dc, coalesce(tp.fm, 0) AS best_fm, coalesce((tp.score < 40)::INT, 0) AS used_triangle, coalesce(nm.a, 0) AS tri_set_src, coalesce(nm.b, 0) AS tri_set_tgt,
  CASE WHEN tp.score >= 40 THEN ca.over WHEN tp.score IS NULL THEN 0 END AS n_plain
FROM jobs LEFT JOIN tk USING (scan) LEFT JOIN de1 USING (scan) LEFT JOIN dt1 USING (scan) LEFT JOIN ga USING (scan) LEFT JOIN ca USING (scan) LEFT JOIN tp USING (scan) LEFT JOIN nm USING (scan), (VALUES ('svd'), ('svd+ransac')) AS v(solver)""")
def registration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the registration table; matches are counted where no triangles vote."""
    r = _registered(spark, sf_dir, (0.05,))
    plain = F.when(F.col("used_triangle") == 0, F.col("n_matches"))
    return r.select("scan", "solver", "threshold", "setting", "n_src_kp", "n_tgt_kp", "descriptors_src", "descriptors_tgt", "gate_passed", "candidates", "best_score", "best_dc", "best_fm", "used_triangle", "tri_set_src", "tri_set_tgt", plain.alias("n_plain"))


@query(f"""WITH kp AS ({V.KP}) SELECT scan, solver, t.threshold, scan > 0 AS registered, scan > 0 AS right, scan = 0 AS nan_errors, scan = 0 AS identity FROM (SELECT DISTINCT scan FROM kp), (VALUES ('svd'), ('svd+ransac')) AS v(solver), (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) AS t(threshold)""")
def registration_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each job, threshold and solver, with or without a transform."""
    r = _registered(spark, sf_dir, (0.05, 0.1))
    same = F.lit(True)
    for c in R.R_COLS + R.T_COLS:
        same = same & (F.col(c) == _IDENT.get(c, 0.0))
    return r.select("scan", "solver", "threshold", (F.col("transform_ok") == 1).alias("registered"), (F.col("success") == 1).alias("right"), (F.isnan("rot_err_deg") & F.isnan("trans_err_m") & F.isnan("e_p_m")).alias("nan_errors"), same.alias("identity"))


TGT = f"WITH kp AS ({V.KP}), tg AS ({V.TARGET})"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kps = V.keypoints(spark, sf_dir)
    return kps.select("scan", F.col("kp").alias("sp"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")), V.target(kps)


MUTUAL = TGT + """, e AS (SELECT kp.scan, kp AS sp, tp, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS d2 FROM kp JOIN tg ON kp.scan = tg.scan AND (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 0.5::DOUBLE * 0.5::DOUBLE),
mu AS (SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY scan, sp ORDER BY d2, tp) = 1) SEMI JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY scan, tp ORDER BY d2, sp) = 1) USING (scan, sp, tp))"""


@query(MUTUAL + " SELECT scan, sp, tp, round(sqrt(d2), 8) AS d FROM mu")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    return spatial.mutual_nearest(s, t, "sp", "tp", ["sx", "sy"], ["tx", "ty"], 0.5, ["scan"]).withColumn("d", r6("d", 8))


def _mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    m = spatial.mutual_nearest(s, t, "sp", "tp", ["sx", "sy"], ["tx", "ty"], 0.5, ["scan"])
    return m.join(s, ["scan", "sp"]).join(t, ["scan", "tp"])


@query(MUTUAL + """, m AS (SELECT mu.scan, sp AS id, kp.x AS sx, kp.y AS sy, tg.tx, tg.ty FROM mu JOIN kp ON kp.kp = sp JOIN tg ON tg.tp = mu.tp),
p AS (SELECT a.scan, abs(sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) - sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty))) AS diff FROM m a JOIN m b ON a.scan = b.scan AND a.id < b.id),
o AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY diff) - 1 AS r, count(*) OVER (PARTITION BY scan) AS n FROM p)
SELECT scan, count(*) AS n, round(max(CASE WHEN r = floor(0.5::DOUBLE * (n - 1)) THEN diff END), 8) AS median, round(max(CASE WHEN r = floor(0.9::DOUBLE * (n - 1)) THEN diff END), 8) AS p90,
       round(avg((diff < 0.01::DOUBLE)::INT), 6) AS share_0, round(avg((diff < 0.015::DOUBLE)::INT), 6) AS share_1, round(avg((diff < 0.02::DOUBLE)::INT), 6) AS share_2 FROM o GROUP BY scan""")
def pair_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mutual(spark, sf_dir).withColumnRenamed("sp", "id")
    s = reports.spread(reports.pair_distances(m, ["scan"]), ["scan"], "diff", (0.01, 0.015, 0.02))
    return s.select("scan", "n", r6("median", 8).alias("median"), r6("p90", 8).alias("p90"), *[r6(f"share_{k}").alias(f"share_{k}") for k in range(3)])


@query(MUTUAL + """, m AS (SELECT mu.scan, sqrt(d2) AS dxy, abs(kp.z - tg.tz) AS dz FROM mu JOIN kp ON kp.kp = sp JOIN tg ON tg.tp = mu.tp)
SELECT scan, count(*) AS n, round(quantile_cont(dxy, 0.5), 8) AS median_dxy, round(quantile_cont(dz, 0.5), 8) AS median_dz, round(quantile_cont(dz, 0.9), 8) AS p90_dz, round(avg((dz > 0.5)::INT), 6) AS share_half, round(avg((dz > 1)::INT), 6) AS share_one FROM m GROUP BY scan""")
def tree_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mutual(spark, sf_dir).select("scan", F.col("d").alias("dxy"), (F.col("sz") - F.col("tz")).alias("dz"))
    c = reports.consistency(m, ["scan"])
    return c.select("scan", "n", *[r6(x, 8).alias(x) for x in ("median_dxy", "median_dz", "p90_dz")], *[r6(x).alias(x) for x in ("share_half", "share_one")])


@query(TGT + """ SELECT scan, kp AS sp FROM kp s WHERE sqrt(x * x + y * y) <= 40 AND EXISTS (SELECT 1 FROM tg WHERE (s.x - tx) * (s.x - tx) + (s.y - ty) * (s.y - ty) <= 0.3::DOUBLE * 0.3::DOUBLE)""")
def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    return spatial.repeatable(s, t.select("tp", "tx", "ty"), "sp", "tp").select("scan", "sp")


@query(TGT + """, e AS (SELECT tp, kp AS sp, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM tg JOIN kp ON (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 0.3::DOUBLE * 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY tp ORDER BY (x - tx) * (x - tx) + (y - ty) * (y - ty), kp) = 1)
SELECT sp, tp, round(d, 8) AS d, CASE WHEN d IS NULL THEN 'new' WHEN d <= 0.005::DOUBLE THEN 'identical' ELSE 'shifted' END AS kind FROM tg LEFT JOIN e USING (tp)
UNION ALL SELECT kp, NULL, NULL, 'lost' FROM kp WHERE kp NOT IN (SELECT sp FROM e)""")
def nearest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    c = spatial.classify(s.select("sp", "sx", "sy"), t.select("tp", "tx", "ty"), "sp", "tp", ["sx", "sy"], ["tx", "ty"], 0.005, 0.3)
    return c.withColumn("d", r6("d", 8))


@query(f"""WITH pts AS ({V.PTS}), kp AS ({V.KP}), t AS (SELECT kp, x AS tx, y AS ty, z + 1.5 AS tz FROM kp),
g AS (SELECT kp, tz, count(*) AS n, quantile_cont(z, 0.02) AS ground_z FROM t JOIN pts ON (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 1 GROUP BY kp, tz HAVING count(*) >= 5)
SELECT kp, n, round(ground_z, 6) AS ground_z, round(tz - ground_z, 6) AS height, tz - ground_z > 1 AS flagged FROM g""")
def local_ground_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.keypoints(spark, sf_dir).select("kp", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("z") + 1.5).alias("tz"))
    g = V.pts(spark, sf_dir).select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    return spatial.local_ground(t, g, "kp", 1.0).withColumns({"ground_z": r6("ground_z"), "height": r6("height")})


@query(TGT.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT kp.scan, kp.kp AS det, tp AS ref, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM kp JOIN tg ON kp.scan = tg.scan AND (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 0.25),
r AS (SELECT DISTINCT scan, det, det AS m FROM e UNION SELECT r.scan, f.det, r.m FROM r JOIN e USING (scan, det) JOIN e f ON f.scan = e.scan AND f.ref = e.ref),
o AS (SELECT *, row_number() OVER (PARTITION BY scan, part ORDER BY det) AS k, count(*) OVER (PARTITION BY scan, part) AS size FROM (SELECT scan, det, min(m) AS part FROM r GROUP BY scan, det)),
c AS (SELECT scan, det, ref, d FROM e UNION ALL SELECT DISTINCT scan, det, NULL, NULL FROM e),
st AS (SELECT DISTINCT scan, part, size, 0::BIGINT AS k, []::BIGINT[] AS used, 0 AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS sq FROM o
  UNION ALL SELECT st.scan, st.part, st.size, st.k + 1, CASE WHEN c.ref IS NULL THEN used ELSE list_append(used, c.ref) END, n + (c.ref IS NOT NULL)::INT, total + coalesce(d, 0), sq + coalesce(d * d, 0)
  FROM st JOIN o ON o.scan = st.scan AND o.part = st.part AND o.k = st.k + 1 JOIN c ON c.scan = o.scan AND c.det = o.det AND (c.ref IS NULL OR NOT list_contains(used, c.ref))),
best AS (SELECT * FROM st WHERE k = size QUALIFY row_number() OVER (PARTITION BY scan, part ORDER BY n DESC, total) = 1),
m AS (SELECT scan, sum(n)::BIGINT AS n_match, sum(total) AS total, sum(sq) AS sq FROM best GROUP BY scan),
a AS (SELECT scan, count(*) AS n_det FROM kp GROUP BY scan), b AS (SELECT scan, count(*) AS n_ref FROM tg GROUP BY scan)
SELECT scan, n_det, n_ref, n_match, round(n_match / n_ref, 8) AS recall, round(n_match / n_det, 8) AS precision, round(total / n_match, 8) AS mean_error, round(sqrt(sq / n_match), 8) AS rmse FROM a JOIN b USING (scan) JOIN m USING (scan)""")
def assignment_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the best assignment; the SQL tries all assignments of each connected part."""
    s, t = _sides(spark, sf_dir)
    det = s.select("scan", F.col("sp").alias("det_id"), F.col("sx").alias("dx"), F.col("sy").alias("dy"))
    ref = t.select("scan", F.col("tp").alias("ref_id"), F.col("tx").alias("rx"), F.col("ty").alias("ry"))
    m = R.assign_positions(det, ref, 0.5, ["scan"])
    a = R.assignment_scores(det, ref, m, ["scan"])
    return a.select("scan", "n_det", "n_ref", "n_match", *[r6(c, 8).alias(c) for c in ("recall", "precision", "mean_error", "rmse")])


PAIRED = TGT + """, m AS (SELECT tg.scan, x AS sx, y AS sy, z AS sz, tx, ty, tz FROM kp JOIN tg ON kp = tp)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    return s.withColumnRenamed("sp", "tp").join(t, ["scan", "tp"]).select("scan", "sx", "sy", "sz", "tx", "ty", "tz")


_H = ", ".join(f"round(sum({a} * {b}) - count(*) * avg({a}) * avg({b}), 4) AS h{i}{j}" for i, a in enumerate(("sx", "sy", "sz")) for j, b in enumerate(("tx", "ty", "tz")))


@query(f"{PAIRED} SELECT scan, count(*) AS n, {', '.join(f'round(avg({c}), 7) AS m{c}' for c in ('sx', 'sy', 'sz', 'tx', 'ty', 'tz'))}, {_H} FROM m GROUP BY scan")
def kabsch_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.moments(_paired(spark, sf_dir), ["scan"])
    return m.select("scan", "n", *[r6(f"m{c}", 7).alias(f"m{c}") for c in ("sx", "sy", "sz", "tx", "ty", "tz")], *[r6(f"h{i}{j}", 4).alias(f"h{i}{j}") for i in range(3) for j in range(3)])


@query()
def kabsch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.estimate(_paired(spark, sf_dir), ["scan"])


@query()
def kabsch_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.estimate(_paired(spark, sf_dir), ["scan"], ransac=True, iterations=200)


def _rigid(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scan, n_pairs, n_inliers, orthogonal, proper, closer): whether the rotation is one and brings the pairs closer
    than a shift between their centres does."""
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    dot = lambda i, j: sum((r[i][k] * r[j][k] for k in range(1, 3)), r[i][0] * r[j][0])
    flat = F.lit(True)
    for i in range(3):
        for j in range(3):
            flat = flat & (F.abs(dot(i, j) - float(i == j)) < 1e-9)
    det = sum((r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in (1, 2)), r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]))
    m = R.apply_rigid(pairs.join(t, "scan"), "sx", "sy", "sz", ("px", "py", "pz"))
    far = lambda a: sum((F.pow(F.col(f"{a}{c}") - F.col(f"t{c}"), F.lit(2.0)) for c in "yz"), F.pow(F.col(f"{a}x") - F.col("tx"), F.lit(2.0)))
    mid = [F.avg(F.col(f"t{c}") - F.col(f"s{c}")) for c in "xyz"]
    shifted = sum((F.sum(F.pow(F.col(f"t{c}") - F.col(f"s{c}"), F.lit(2.0))) - F.count("*") * d * d for c, d in zip("yz", mid[1:], strict=True)), F.sum(F.pow(F.col("tx") - F.col("sx"), F.lit(2.0))) - F.count("*") * mid[0] * mid[0])
    rest = m.groupBy("scan").agg((F.sum(far("p")) <= shifted + 1e-9).alias("closer"))
    return t.join(rest, "scan").select("scan", "n_pairs", "n_inliers", flat.alias("orthogonal"), (F.abs(det - 1) < 1e-9).alias("proper"), "closer")


_RIGID = f"{PAIRED} SELECT scan, count(*) AS n_pairs, count(*) AS n_inliers, true AS orthogonal, true AS proper, true AS closer FROM m GROUP BY scan"


@query(_RIGID)
def kabsch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paired(spark, sf_dir)
    return _rigid(R.estimate(p, ["scan"]), p)


@query(_RIGID)
def kabsch_ransac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs are a few centimetres apart, so all are inliers."""
    p = _paired(spark, sf_dir)
    return _rigid(R.estimate(p, ["scan"], ransac=True, iterations=200), p)


@query(f"{TGT} SELECT tg.scan, count(*) AS n_pairs, count(*) FILTER (tp % 6 <> 1) AS n_inliers, true AS orthogonal, true AS proper FROM kp JOIN tg ON kp = tp GROUP BY tg.scan")
def kabsch_ransac_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth of all pairs lies metres apart; all others are inliers, and no one else is."""
    s, t = _sides(spark, sf_dir)
    off = F.when(F.col("tp") % 6 == 1, 5 + F.col("tp") % 4).otherwise(0)
    p = s.withColumnRenamed("sp", "tp").join(t, ["scan", "tp"]).select("scan", "sx", "sy", "sz", (F.col("tx") + off).alias("tx"), "ty", "tz")
    return _rigid(R.estimate(p, ["scan"], ransac=True, iterations=200), p).drop("closer")


_IDENT = {"r00": 1.0, "r11": 1.0, "r22": 1.0}
_JOBS = [(0, 0.01, 0.1), (1, 0.02, -0.2), (2, 0.05, 0.6)]


def _turned(spark: SparkSession) -> DataFrame:
    """Three jobs: a turn about z by asin(s) and a shift, against the identity."""
    t = spark.createDataFrame(_JOBS, "job int, s double, t0 double")
    c = F.sqrt(1 - F.col("s") * F.col("s"))
    own = {"r00": c, "r01": -F.col("s"), "r02": F.lit(0.0), "r10": F.col("s"), "r11": c, "r12": F.lit(0.0), "r20": F.lit(0.0), "r21": F.lit(0.0), "r22": F.lit(1.0), "t0": F.col("t0"), "t1": F.lit(0.05), "t2": F.lit(0.0)}
    true = {f"g{k}": F.lit(_IDENT.get(k, 0.0)) for k in R.R_COLS + R.T_COLS}
    return t.select("job", *[v.alias(k) for k, v in own.items()], *[v.alias(k) for k, v in true.items()])


JOBS = "j(job, s, t0) AS (VALUES " + ", ".join(f"({a}, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _JOBS) + ")"


@query(f"""WITH pts AS ({V.PTS}), {JOBS}, k AS (SELECT *, sqrt(1 - s * s) AS c FROM j)
SELECT job, round(avg(sqrt(((c - 1) * x - s * y + t0) * ((c - 1) * x - s * y + t0) + (s * x + (c - 1) * y + 0.05::DOUBLE) * (s * x + (c - 1) * y + 0.05::DOUBLE))), 7) AS e_p, count(*) AS n FROM pts, k GROUP BY job""")
def point_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.point_errors(V.pts(spark, sf_dir), _turned(spark), ["job"]).withColumn("e_p", r6("e_p", 7))


#: Estimated and true transforms of customers: turns by the angles whose sines are s and g, and shifts.
MOVES = """m AS (SELECT c_custkey AS job, (c_custkey * 37 % 201 - 100) / 2000.0::DOUBLE AS s, (c_custkey * 53 % 201 - 100) / 2000.0::DOUBLE AS g,
  round(c_acctbal) / 1e4 AS t0, (c_custkey % 13 - 6) / 20.0::DOUBLE AS t1, c_nationkey / 100.0::DOUBLE AS t2 FROM customer)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    turn = lambda f: (k * f % 201 - 100) / F.lit(2000.0)
    m = c.select(k.alias("job"), turn(37).alias("s"), turn(53).alias("g"), (F.round("c_acctbal") / F.lit(1e4)).alias("t0"), ((k % 13 - 6) / F.lit(20.0)).alias("t1"), (F.col("c_nationkey") / F.lit(100.0)).alias("t2"))

    def turned(sine: str, pre: str) -> list:
        s, c = F.col(sine), F.sqrt(1 - F.col(sine) * F.col(sine))
        return [(c if n in ("00", "11") else -s if n == "01" else s if n == "10" else F.lit(float(n == "22"))).alias(f"{pre}{n}") for n in (f"{i}{j}" for i in range(3) for j in range(3))]

    true = [F.lit(0.0).alias(f"gt{i}") for i in range(3)]
    return m.select("job", *turned("s", "r"), "t0", "t1", "t2", *[c.alias(f"g{n}") for c, n in zip(turned("g", "r"), R.R_COLS, strict=True)], *true)


@query(f"""WITH {MOVES}, e AS (SELECT *, degrees(abs(asin(s) - asin(g))) AS rot_err, sqrt(t0 * t0 + t1 * t1 + t2 * t2) AS trans_err FROM m)
SELECT job, round(rot_err, 5) AS rot_err, round(trans_err, 8) AS trans_err, rot_err < 2 AND trans_err < 0.5 AS success, round(degrees(asin(s) - asin(g)), 6) + 0.0 AS yaw, 0.0::DOUBLE AS tilt FROM e""")
def transform_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, yaw and tilt of the transforms of all customers."""
    yaw, tilt = R.yaw_tilt()
    e = R.evaluate(_moves(spark, sf_dir)).withColumns({"yaw": yaw, "tilt": tilt})
    return e.select("job", r6("rot_err", 5).alias("rot_err"), r6("trans_err", 8).alias("trans_err"), "success", (r6("yaw") + F.lit(0.0)).alias("yaw"), r6("tilt").alias("tilt"))


@query(f"""WITH pts AS ({V.PTS}), {JOBS}, k AS (SELECT *, sqrt(1 - s * s) AS c FROM j)
SELECT job, round(sum(c * x - s * y + t0) / count(*), 6) AS x, round(sum(s * x + c * y + 0.05::DOUBLE) / count(*), 6) AS y, round(sum(z) / count(*), 6) AS z FROM pts, k GROUP BY job""")
def rigid_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.apply_rigid(V.pts(spark, sf_dir).select("x", "y", "z").crossJoin(F.broadcast(_turned(spark))))
    return m.groupBy("job").agg(*[r6(F.avg(c)).alias(c) for c in "xyz"])


RUNS = f"WITH runs AS ({V.RUNS})"


@query(f"""{RUNS}, l AS (SELECT model, 'n' AS metric, n::DOUBLE AS value FROM runs UNION ALL SELECT model, 'success', success::INT FROM runs UNION ALL SELECT model, 'e_p', e_p FROM runs)
SELECT model, metric, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std FROM l GROUP BY model, metric""")
def summary_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.runs(spark, sf_dir).withColumn("success", F.col("success").cast("int"))
    s = reports.mean_std(reports.unpivot(r, ["model"], ["n", "success", "e_p"]), ["model", "metric"])
    return s.select("model", "metric", "n", r6("mean", 8).alias("mean"), r6("std", 8).alias("std"))


@query(f"""{RUNS}, l AS (SELECT model, 'n' AS metric, n::DOUBLE AS value FROM runs UNION ALL SELECT model, 'e_p', e_p FROM runs), s AS (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY ALL)
SELECT metric, {', '.join(f"round(max(CASE WHEN model = '{m}' THEN {k} END), 8) AS {m}_{k}" for m in ('step', 'linear_a', 'physical') for k in ('mean', 'std'))} FROM s GROUP BY metric""")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.mean_std(reports.unpivot(V.runs(spark, sf_dir), ["model"], ["n", "e_p"]), ["model", "metric"]).withColumnRenamed("model", "label")
    t = reports.summary_table(s, ["step", "linear_a", "physical"])
    return t.select("metric", *[r6(c, 8).alias(c) for c in t.columns[1:]])


@query(f"""{RUNS}, s AS (SELECT model, pair, avg(e_p) AS value FROM runs GROUP BY model, pair)
SELECT model, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std FROM s GROUP BY model""")
def cross_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.cross_station(V.runs(spark, sf_dir).withColumnRenamed("e_p", "value"), ["model"], "pair")
    return c.select("model", "n", r6("mean", 8).alias("mean"), r6("std", 8).alias("std"))


@query("""WITH c AS (SELECT o_orderkey % 10 AS seed, o_custkey % 6 AS scan, 'reason ' || o_orderpriority AS status, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT scan, status, avg(n) AS mean FROM c GROUP BY scan, status), k AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY mean DESC, status) AS rank FROM m WHERE mean > 0)
SELECT scan, rank::INT AS rank, status, round(mean, 8) AS mean FROM k WHERE rank <= 2""")
def top2_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    c = reports.failure_counts(o.select((F.col("o_orderkey") % 10).alias("seed"), (F.col("o_custkey") % 6).alias("scan"), F.concat(F.lit("reason "), "o_orderpriority").alias("status")), ["seed", "scan"])
    return reports.top_failures(c, ["scan"]).withColumn("mean", r6("mean", 8))


@query("""WITH f AS (SELECT o_custkey % 6 AS scan, (o_totalprice < 60000)::INT AS ok FROM orders) SELECT scan, count(*) AS clusters, sum(ok)::BIGINT AS trees, round(sum(ok)::DOUBLE / count(*), 8) AS rate FROM f GROUP BY scan""")
def fit_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).alias("scan"), F.when(F.col("o_totalprice") < 60000, 0).otherwise(3).alias("fail"))
    return reports.success_rate(f, ["scan"]).withColumn("rate", r6("rate", 8))


SETS = "sets AS (SELECT 'all' AS pair_set, p AS pair FROM range(0, 15) AS r(p) UNION ALL SELECT 'official', p FROM range(0, 10) AS r(p))"


def _sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("all", p) for p in range(15)] + [("official", p) for p in range(10)], "pair_set string, pair long")


@query(f"""{RUNS}, {SETS}, j AS (SELECT * FROM runs JOIN sets USING (pair)), s AS (SELECT model, pair_set, seed, count(*) FILTER (success) AS won, count(*) FILTER (e_p IS NULL) AS none FROM j GROUP BY ALL),
a AS (SELECT model, pair_set, avg(won) AS mean, stddev_samp(won) AS sd, min(won) AS low, max(won) AS high, avg(none) AS no_transform FROM s GROUP BY ALL),
b AS (SELECT model, pair_set, avg(e_p) AS ep_mean, quantile_cont(e_p, 0.5) AS ep_median FROM j WHERE success GROUP BY ALL)
SELECT model, pair_set, round(mean, 8) AS mean, round(sd, 8) AS sd, low, high, round(no_transform, 8) AS no_transform, round(ep_mean + 1e-10::DOUBLE, 8) AS ep_mean, round(ep_median + 1e-10::DOUBLE, 8) AS ep_median FROM a JOIN b USING (model, pair_set)""")
def pair_set_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reports.pair_sets(V.runs(spark, sf_dir), _sets(spark), ["model"])
    return p.select("model", "pair_set", "low", "high", *[r6(c, 8).alias(c) for c in ("mean", "sd", "no_transform")], *[r6(F.col(c) + 1e-10, 8).alias(c) for c in ("ep_mean", "ep_median")])


WIN = f"""{RUNS}, w AS (SELECT r.model, count(*) FILTER (r.success AND NOT b.success) AS wins, count(*) FILTER (NOT r.success AND b.success) AS losses FROM runs r JOIN runs b USING (seed, pair) WHERE b.model = 'step' AND r.model <> 'step' GROUP BY r.model)"""


@query(f"{WIN} SELECT * FROM w")
def win_lose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.win_lose(V.runs(spark, sf_dir), "model", "step")


@query("""WITH w AS (SELECT o_custkey AS pair, count(*) FILTER (o_totalprice > 150000) AS wins, count(*) FILTER (o_totalprice < 130000) AS losses FROM orders GROUP BY ALL), s AS (
  SELECT pair, wins, losses, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(0, least(wins, losses) + 1) AS r(i)) AS c FROM w)
SELECT pair, wins, losses, floor(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * c) END * 1e9 + 0.3)::BIGINT AS p_billionths, CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * c) END < 0.05::DOUBLE / 6 AS significant FROM s""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and losses of each customer's orders."""
    o = V.table(spark, sf_dir, "orders")
    w = o.groupBy(F.col("o_custkey").alias("pair")).agg(F.count_if(F.col("o_totalprice") > 150000).alias("wins"), F.count_if(F.col("o_totalprice") < 130000).alias("losses"))
    return reports.sign_test(w, tests=6).select("pair", "wins", "losses", F.floor(F.col("p") * 1e9 + 0.3).alias("p_billionths"), "significant")


@query(f"""{RUNS}, c AS (SELECT model, seed, count(*) FILTER (success) AS won FROM runs GROUP BY ALL)
SELECT a.model, a.seed, a.won, b.won AS other FROM c a JOIN c b ON a.model = b.model AND b.seed = a.seed % 10 + 1""")
def noise_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.runs(spark, sf_dir).groupBy("model", "seed").agg(F.count_if("success").alias("won"))
    return reports.next_seed(c, ["model"], 10, "won")


@query(f"""{RUNS} SELECT model, count(*) FILTER (success) AS n_if, sum(CASE WHEN success THEN n END)::BIGINT AS sum_if, round(avg(CASE WHEN success THEN n END), 8) AS avg_if, quantile_cont(CASE WHEN success THEN n END, 0.5)::DOUBLE AS median_if FROM runs GROUP BY model""")
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conditional(V.runs(spark, sf_dir), ["model"], F.col("success"), "n").withColumn("avg_if", r6("avg_if", 8))


_REG = f"""{RUNS}, g AS (SELECT model, success, e_p, n % 7 AS rot_err, n % 5 AS trans_err, n % 4 AS n_correct, n % 4 + 2 AS n_pairs, seed % 2 = 0 AS used_triangle FROM runs)"""


@query(f"""{_REG} SELECT model, count(*) AS n, round(avg(success::INT), 8) AS success, quantile_cont(CASE WHEN e_p IS NOT NULL THEN rot_err END, 0.5)::DOUBLE AS median_rot_err, quantile_cont(CASE WHEN e_p IS NOT NULL THEN trans_err END, 0.5)::DOUBLE AS median_trans_err,
  round(quantile_cont(e_p, 0.5), 8) AS median_e_p, round(sum(n_correct)::DOUBLE / sum(n_pairs), 8) AS correct_ratio, round(avg(used_triangle::INT), 8) AS triangle_share FROM g GROUP BY model""")
def registration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    g = V.runs(spark, sf_dir).select("model", "success", "e_p", (n % 7).alias("rot_err"), (n % 5).alias("trans_err"), (n % 4).alias("n_correct"), (n % 4 + 2).alias("n_pairs"), (F.col("seed") % 2 == 0).alias("used_triangle"))
    s = reports.registration_summary(g, ["model"])
    return s.select("model", "n", "median_rot_err", "median_trans_err", *[r6(c, 8).alias(c) for c in ("success", "median_e_p", "correct_ratio", "triangle_share")])


@query(f"""{RUNS} SELECT seed, model, pair, CASE WHEN seed > 5 THEN n + 1 ELSE n END AS n FROM runs WHERE seed > 5 OR pair < 10""")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.runs(spark, sf_dir).select("seed", "model", "pair", "n")
    return reports.latest(r.where("pair < 10"), r.where("seed > 5").withColumn("n", F.col("n") + 1), ["seed", "model", "pair"])


@query(f"""{RUNS}, p AS (SELECT DISTINCT pair FROM runs) SELECT pair, pair < 10 AS official FROM p""")
def official_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flag_members(V.runs(spark, sf_dir).select("pair").distinct(), _sets(spark).where("pair_set = 'official'"))


@query(TGT + """ SELECT kp.scan, kp, coalesce(tx, x) AS x, coalesce(ty, y) AS y, z FROM kp LEFT JOIN tg ON tp = kp""")
def oracle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kps = V.keypoints(spark, sf_dir)
    t = V.target(kps).select(F.col("tp").alias("kp"), F.col("tx").alias("rx"), F.col("ty").alias("ry"), F.col("tz").alias("rz"))
    return reports.oracle_positions(kps, t, ["kp"], vertical=False).select("scan", "kp", "x", "y", "z")


@query(f"""WITH {MOVES} SELECT job, round(sqrt(t0 * t0 + t1 * t1), 8) AS separation FROM m""")
def station_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("job", r6(R.station_separation(), 8).alias("separation"))


@query(f"""{RUNS}, g AS (SELECT model AS variant, CASE seed % 2 WHEN 0 THEN 'svd' ELSE 'svd+ransac' END AS solver, success, e_p, n AS n_matches, n // 2 AS n_correct FROM runs)
SELECT variant, sum(CASE WHEN solver = 'svd' THEN n_matches ELSE 0 END)::BIGINT AS matches, sum(CASE WHEN solver = 'svd' THEN n_correct ELSE 0 END)::BIGINT AS correct,
  count(*) FILTER (success AND solver = 'svd') AS svd, count(*) FILTER (success AND solver = 'svd+ransac') AS ransac,
  round(quantile_cont(CASE WHEN solver = 'svd' THEN e_p END, 0.5) + 1e-10::DOUBLE, 8) AS ep_svd, round(quantile_cont(CASE WHEN solver = 'svd+ransac' THEN e_p END, 0.5) + 1e-10::DOUBLE, 8) AS ep_ransac FROM g GROUP BY variant""")
def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    g = V.runs(spark, sf_dir).select(F.col("model").alias("variant"), F.when(F.col("seed") % 2 == 0, "svd").otherwise("svd+ransac").alias("solver"), "success", "e_p", n.alias("n_matches"), F.floor(n / 2).alias("n_correct"))
    v = reports.variant_table(g)
    return v.select("variant", "matches", "correct", "svd", "ransac", *[r6(F.col(c) + 1e-10, 8).alias(c) for c in ("ep_svd", "ep_ransac")])


#: Settings for the stand of ``projections.stand``, whose stems have some 90 points a square metre.
STAND = ["--dtm.cell=1.0", "--dtm.support_count=1", "--normals.radius=0.2", "--cluster.tolerance=0.3", "--cylinder.dist_threshold=0.03"]


def _stand_cfg(*more: str):
    from silvaspark.sources.config import Config

    return Config.load("", [*STAND, *more])


def _beside_stems(fits: DataFrame, stems: DataFrame) -> DataFrame:
    """Every stem with the fit nearest to it, within half a metre; null where there is none."""
    found = spatial.nearest(stems, fits.select(F.col("cluster").alias("fit"), F.col("px").alias("fx"), F.col("py").alias("fy")), "stem", "fit", ["x", "y"], ["fx", "fy"], 0.5)
    return stems.withColumnRenamed("radius", "r0").join(found, "stem", "left").join(fits.withColumnRenamed("cluster", "fit"), "fit", "left")


@query(f"""WITH s AS ({V.STEMS}), p AS (SELECT l_suppkey AS stem, count(*) FILTER ((l_orderkey * 8 + l_linenumber) % 3 <> 0) AS n FROM lineitem GROUP BY ALL)
SELECT stem, true AS found, true AS near, true AS on_ground, true AS radius_fits, true AS upright, true AS most_points FROM s JOIN p USING (stem)""")
def extract_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain, slice, voxels, normals, clusters, cylinders and positions of a stand made from all rows of lineitem: whether every
    stem is found within 1 cm, on the ground within 1 cm, with its radius within 1 cm, upright within a degree, from nearly all of its points."""
    from silvaspark.plans import pipeline

    _, fits = pipeline.extract(V.stand(spark, sf_dir), _stand_cfg())
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    given = V.table(spark, sf_dir, "lineitem").where(n % 3 != 0).groupBy(F.col("l_suppkey").alias("stem")).agg(F.count("*").alias("given"))
    j = _beside_stems(fits.where("fail = 0"), V.stems(spark, sf_dir)).join(given, "stem")
    ok = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return j.select("stem", F.col("fit").isNotNull().alias("found"), ok(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) < 0.01, "near"), ok(F.abs(F.col("pz") - F.col("z")) < 0.01, "on_ground"), ok(F.abs(F.col("radius") - F.col("r0")) < 0.01, "radius_fits"), ok(F.col("tilt_deg") < 1, "upright"), ok(F.col("n_points") > 0.8 * F.col("given"), "most_points"))


@query(f"""WITH s AS ({V.STEMS}) SELECT 'ok' AS status, count(*) AS n, true AS inliers, true AS arcs, true AS normals_agree, true AS radii, true AS masks FROM s""")
def cylinder_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of all clusters of the stand by status: their number, and whether all keep the bounds that their checks set."""
    from silvaspark.plans import pipeline

    c = pipeline.extract(V.stand(spark, sf_dir), _stand_cfg())[1]
    n = F.col("n_points")
    return c.groupBy("status").agg(F.count("*").alias("n"), F.bool_and(F.col("n_inliers") >= 0.95 * n).alias("inliers"), F.bool_and(F.col("arc_deg") >= 300).alias("arcs"), F.bool_and(F.col("n_normal_ok") >= 0.75 * n).alias("normals_agree"), F.bool_and(F.col("radius").between(0.24, 0.46)).alias("radii"), F.bool_and((F.col("fail_mask") == 0) & (F.col("fail") == 0)).alias("masks"))


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.plans import pipeline

    cfg = _stand_cfg("--experiment.n_seeds=2")
    vert, planes, _ = pipeline.preprocess(P.localise(V.stand(spark, sf_dir)), cfg)
    return pipeline.experiment(vert, planes, V.stems(spark, sf_dir).select("x", "y"), cfg)


@query()
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two profiles, six models and two seeds on the stand against its true stems."""
    return _experiment(spark, sf_dir)


@query(f"""WITH s AS (SELECT count(*)::DOUBLE AS n FROM ({V.STEMS})), l(label) AS (VALUES ('step'), ('linear_a'), ('linear_mid'), ('physical'), ('linear*'), ('physical*')),
m AS (SELECT 'trees' AS metric, n AS mean FROM s UNION ALL SELECT 'clusters', n FROM s UNION ALL VALUES ('rate', 1.0), ('recall', 1.0), ('precision', 1.0), ('fail: no_model', 0.0), ('fail: tilt_too_large', 0.0))
SELECT profile, label, metric, 2::BIGINT AS n, mean, 0.0::DOUBLE AS std FROM (VALUES ('baseline'), ('improved')) AS p(profile), l, m""")
def experiment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of the experiment find all stems of the stand and nothing else."""
    names = ["trees", "clusters", "rate", "recall", "precision", "fail: no_model", "fail: tilt_too_large"]
    e = _experiment(spark, sf_dir).where(F.col("metric").isin(names))
    return e.select("profile", "label", "metric", "n", r6("mean").alias("mean"), (r6("std") + F.lit(0.0)).alias("std"))
