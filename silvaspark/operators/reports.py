"""Run metrics and the statistics over seeds, stations and pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.operators.selection import percentiles
from silvaspark.runtime import written


def finite(c: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide run metrics to (keys, metric, value)."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def mean_std(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, std): over finite values; the sample deviation needs two."""
    v = finite(F.col(value))
    return long.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def failure_counts(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, n)."""
    return fits.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def success_rate(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clusters, trees, rate)."""
    g = fits.groupBy(*keys).agg(F.count("*").alias("clusters"), F.count_if(F.col("fail") == 0).alias("trees"))
    return g.withColumn("rate", F.when(F.col("clusters") > 0, F.col("trees") / F.col("clusters")).otherwise(0.0))


def cross_station(long: DataFrame, keys: list[str], station: str, value: str = "value") -> DataFrame:
    """Mean and deviation over stations of each station's mean over seeds."""
    v = finite(F.col(value))
    each = long.groupBy(*keys, station).agg(F.avg(v).alias("value"))
    return mean_std(each, keys)


def top_failures(counts: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """(keys, rank, status, mean): the reasons with the highest positive mean count, ties by name."""
    m = counts.groupBy(*keys, "status").agg(F.avg("n").alias("mean")).where("mean > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("mean"), "status")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "rank", "status", "mean")


def near_far(bins: DataFrame, keys: list[str], split: float = 10.0) -> DataFrame:
    """(keys, part, n, kept, rate): retention bins below and from ``split``."""
    part = F.when(F.col("d_lo") < split, "near").otherwise("far")
    g = bins.groupBy(*keys, part.alias("part")).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    return g.withColumn("rate", F.when(F.col("n") > 0, F.col("kept") / F.col("n")).otherwise(0.0))


def pair_distances(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, diff): by how much the distance between two matched trees differs between scans.

    matched(keys, id, sx, sy, tx, ty)."""
    def side(n: str) -> DataFrame:
        return matched.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in ("id", "sx", "sy", "tx", "ty")])

    p = side("a").join(side("b"), keys).where("id_a < id_b")
    d = lambda u: F.sqrt((F.col(f"{u}x_a") - F.col(f"{u}x_b")) * (F.col(f"{u}x_a") - F.col(f"{u}x_b")) + (F.col(f"{u}y_a") - F.col(f"{u}y_b")) * (F.col(f"{u}y_a") - F.col(f"{u}y_b")))
    return p.select(*keys, F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.abs(d("s") - d("t")).alias("diff"))


def spread(values: DataFrame, keys: list[str], value: str, limits: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """(keys, n, median, p90, share_k): lower-index percentiles and shares below each limit. Percentiles of all groups
    are found by narrowing histograms, so that no group is sorted in one task."""
    v = written(values.select(*keys, F.col(value).cast("double").alias("v")), "spread")
    shares = v.groupBy(*keys).agg(*[F.avg((F.col("v") < x).cast("double")).alias(f"share_{k}") for k, x in enumerate(limits)])
    p = percentiles(v, keys, "v", {"median": 0.5, "p90": 0.9})
    return p.join(shares, keys) if keys else p.crossJoin(shares)


def pair_sets(runs: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pair_set, mean, sd, low, high, ep_mean, ep_median, no_transform): success per seed over the
    pairs of each set.

    runs(keys, seed, pair, success, e_p) with null e_p where there is no transform; sets(pair_set, pair).
    """
    j = runs.join(sets, "pair")
    seed = j.groupBy(*keys, "pair_set", "seed").agg(F.count_if("success").alias("won"), F.count_if(F.col("e_p").isNull()).alias("none"))
    a = seed.groupBy(*keys, "pair_set").agg(F.avg("won").alias("mean"), F.stddev_samp("won").alias("sd"), F.min("won").alias("low"), F.max("won").alias("high"), F.avg("none").alias("no_transform"))
    b = j.groupBy(*keys, "pair_set").agg(F.avg(F.when(F.col("success"), F.col("e_p"))).alias("ep_mean"), F.percentile(F.when(F.col("success"), F.col("e_p")), F.lit(0.5)).alias("ep_median"))
    return a.join(b, [*keys, "pair_set"])


def win_lose(runs: DataFrame, label: str, base: str, keys: tuple[str, ...] = ("seed", "pair")) -> DataFrame:
    """(label, wins, losses): runs that succeed where the base model's run of the same keys fails, and
    the other way round."""
    b = runs.where(F.col(label) == base).select(*keys, F.col("success").alias("__base"))
    j = runs.where(F.col(label) != base).join(b, list(keys))
    return j.groupBy(label).agg(F.count_if(F.col("success") & ~F.col("__base")).alias("wins"), F.count_if(~F.col("success") & F.col("__base")).alias("losses"))


def sign_test(df: DataFrame, wins: str = "wins", losses: str = "losses", tests: int = 1, level: float = 0.05) -> DataFrame:
    """Add the two-sided p value of the sign test, min(1, 2 P(X <= min)), and the Bonferroni verdict.

    The binomial sum is an aggregate over a sequence, each term from the one before."""
    n = F.col(wins) + F.col(losses)
    k = F.least(F.col(wins), F.col(losses))
    start = F.struct(F.exp(-n.cast("double") * F.lit(math.log(2))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (n - i).cast("double") / (i + 1).cast("double")).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    p = F.least(F.lit(1.0), F.lit(2.0) * F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda a: a["sum"]))
    return df.withColumn("p", F.when(n > 0, p).otherwise(1.0)).withColumn("significant", F.col("p") < level / tests)


def registration_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Success share, medians over runs with a transform, ratio of correct matches and use of triangles."""
    has = F.col("e_p").isNotNull()
    med = lambda c: F.percentile(F.when(has, F.col(c)), F.lit(0.5)).alias(f"median_{c}")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success"), med("rot_err"), med("trans_err"), med("e_p"),
        (F.sum("n_correct") / F.sum("n_pairs")).alias("correct_ratio"), F.avg(F.col("used_triangle").cast("double")).alias("triangle_share"),
    )


def variant_table(rows: DataFrame, variant: str = "variant") -> DataFrame:
    """(variant, matches, correct, svd, ransac, ep_svd, ep_ransac) of registration rows (variant, solver, success, e_p,
    n_matches, n_correct): matches are counted once, successes and the median error by solver, over runs with a transform."""
    of = lambda s, c: F.when(F.col("solver") == s, c)
    med = lambda s: F.percentile(of(s, finite(F.col("e_p"))), F.lit(0.5))
    return rows.groupBy(variant).agg(
        F.sum(of("svd", F.col("n_matches")).otherwise(0)).alias("matches"), F.sum(of("svd", F.col("n_correct")).otherwise(0)).alias("correct"),
        F.count_if((F.col("solver") == "svd") & F.col("success")).alias("svd"), F.count_if((F.col("solver") == "svd+ransac") & F.col("success")).alias("ransac"),
        med("svd").alias("ep_svd"), med("svd+ransac").alias("ep_ransac"),
    )


def consistency(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median_dxy, median_dz, p90_dz, share_half, share_one) of mutually nearest trees.

    ``n`` counts all rows; medians and the percentile lie between two elements and are those of the rows with a value."""
    dz = F.abs("dz")
    matched = written(matched.select(*keys, "dxy", "dz"), "matched")
    shares = matched.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((dz > 0.5).cast("double")).alias("share_half"), F.avg((dz > 1.0).cast("double")).alias("share_one"))
    xy = percentiles(matched, keys, "dxy", {"median_dxy": 0.5}, between=True).drop("n")
    z = percentiles(matched.withColumn("dz", dz), keys, "dz", {"median_dz": 0.5, "p90_dz": 0.9}, between=True).drop("n")
    out = shares.join(xy, keys, "left").join(z, keys, "left")
    return out.select(*keys, "n", "median_dxy", "median_dz", "p90_dz", "share_half", "share_one")


def next_seed(df: DataFrame, keys: list[str], n_seeds: int, value: str) -> DataFrame:
    """(keys, seed, value, other): each seed's value beside that of the next seed, cyclic."""
    other = df.select(*keys, (F.pmod(F.col("seed") - 2, F.lit(n_seeds)) + 1).alias("seed"), F.col(value).alias("other"))
    return df.select(*keys, "seed", value).join(other, [*keys, "seed"])


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys are not in it."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def oracle_positions(trees: DataFrame, truth: DataFrame, key: list[str], vertical: bool = True) -> DataFrame:
    """Trees with the coordinates of their match in ``truth(key, rx, ry, rz)`` where there is one."""
    j = trees.join(truth, key, "left")
    cols = {"x": "rx", "y": "ry"} | ({"z": "rz"} if vertical else {})
    return j.withColumns({c: F.coalesce(r, c) for c, r in cols.items()}).drop("rx", "ry", "rz")


def flag_members(pairs: DataFrame, official: DataFrame, key: str = "pair") -> DataFrame:
    """Add ``official``: whether the pair is in the list."""
    return pairs.join(official.select(key).distinct().withColumn("official", F.lit(True)), key, "left").withColumn("official", F.coalesce("official", F.lit(False)))


def conditional(df: DataFrame, keys: list[str], where: Column, value: str) -> DataFrame:
    """(keys, n_if, sum_if, avg_if, median_if) of the rows that meet a condition."""
    v = F.when(where, F.col(value))
    return df.groupBy(*keys).agg(F.count_if(where).alias("n_if"), F.sum(v).alias("sum_if"), F.avg(v).alias("avg_if"), F.percentile(v, F.lit(0.5)).alias("median_if"))


def summary_table(stats: DataFrame, labels: list[str]) -> DataFrame:
    """(metric, <label>_mean, <label>_std ...) from (metric, label, mean, std)."""
    wide = stats.groupBy("metric").pivot("label", labels).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.select("metric", *[c for x in labels for c in (f"{x}_mean", f"{x}_std")])


def summary_markdown(table: DataFrame, labels: list[str]) -> str:
    head = ["| metric | " + " | ".join(labels) + " |", "|" + "---|" * (len(labels) + 1)]
    show = lambda m, s: "-" if m is None else f"{m:.4g}" if s is None else f"{m:.4g} ± {s:.3g}"
    return "\n".join([*head, *["| " + " | ".join([r["metric"], *[show(r[f"{x}_mean"], r[f"{x}_std"]) for x in labels]]) + " |" for r in table.orderBy("metric").collect()]])
