"""Order statistics of many groups at once, without sorting a group.

Histograms narrow the range in which each wanted rank lies: one pass over the rows counts, for every group and rank that
is still open, the rows in a few hundred equal steps of its range; the step that holds the rank, cut down to its least
and greatest value, is the next range. Counts are partial sums, so a group of any size is spread over all tasks, and
groups of few rows are never narrowed: at most one row in ``FEW`` names an open group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.runtime import written

#: Rows of a group that are put in order as they are, and steps of a histogram.
FEW, STEPS = 1000, 512


def ranked(rows: DataFrame, keys: list[str], order: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, rank, order): the rows of ``wanted(keys, rank)``, ranks from 0 in the order of the columns ``order``.

    Ranks beyond a group's rows and groups without rows give none; rows with a null or NaN in the first of ``order``
    are left out. The columns of ``order`` are numbers. Rows that are equal in all of them are one as good as another.
    """
    keys, first = list(keys), order[0]
    rows = rows.select(*keys, *order).where(F.col(first).isNotNull() & ~F.isnan(F.col(first).cast("double")))
    v = F.col(first).cast("double")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    base = wanted.select(*keys, "rank").distinct()
    met = base.join(sizes, keys) if keys else base.crossJoin(sizes)
    state = written(met.where("rank between 0 and __n - 1").select(*keys, "rank", "__lo", "__hi", F.lit(0).cast("long").alias("__from"), "__n"), "ranks")
    open_ = (F.col("__n") > FEW) & (F.col("__lo") < F.col("__hi"))
    while state.where(open_).limit(1).count():
        step = F.least(F.floor((v - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / F.lit(STEPS))), F.lit(STEPS - 1))
        asked = state.where(open_).select(*keys, "rank", "__lo", "__hi", "__from")
        inside = _met(rows, asked, keys).where(v.between(F.col("__lo"), F.col("__hi")))
        counts = inside.groupBy(*keys, "rank", "__from", step.alias("__b")).agg(F.count("*").alias("__c"), F.min(v).alias("__l"), F.max(v).alias("__h"))
        w = Window.partitionBy(*keys, "rank").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        at = counts.withColumn("__at", F.col("__from") + F.coalesce(F.sum("__c").over(w), F.lit(0)))
        hit = at.where((F.col("rank") >= F.col("__at")) & (F.col("rank") < F.col("__at") + F.col("__c")))
        next_ = hit.select(*keys, "rank", F.col("__l").alias("__lo"), F.col("__h").alias("__hi"), F.col("__at").alias("__from"), F.col("__c").alias("__n"))
        state = written(state.where(~open_).unionByName(next_), "ranks")
    return _settled(rows, keys, order, state)


def _met(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    # without keys there is one group, so ``asked`` is one row a rank that the caller listed
    return rows.join(asked, keys) if keys else rows.crossJoin(F.broadcast(asked))


def _settled(rows: DataFrame, keys: list[str], order: list[str], state: DataFrame) -> DataFrame:
    """Rows of the ranks whose range holds few rows, or one value only."""
    first, rest = order[0], order[1:]
    v = F.col(first).cast("double")
    if not rest:
        alike = F.col("__lo") == F.col("__hi")
        one = state.where(alike).select(*keys, "rank", F.col("__lo").cast(rows.schema[first].dataType).alias(first))
    else:
        alike = (F.col("__lo") == F.col("__hi")) & (F.col("__n") > FEW)
    few = _met(rows, state.where(~alike), keys).where(v.between(F.col("__lo"), F.col("__hi")))
    w = Window.partitionBy(*keys, "rank").orderBy(*order)
    got = few.withColumn("__r", F.row_number().over(w) - 1 + F.col("__from")).where("__r = rank").select(*keys, "rank", *order)
    if not rest:
        return one.unionByName(got)
    many = state.where(alike)
    if not many.limit(1).count():
        return got
    # more than FEW rows with the wanted first value: the rank among them goes by the other columns
    among = many.select(*keys, F.col("rank").alias("__rank"), F.col("__lo").cast(rows.schema[first].dataType).alias(first), (F.col("rank") - F.col("__from")).alias("rank"))
    below = ranked(_met(rows, among.select(*keys, first).distinct(), keys) if not keys else rows.join(among.select(*keys, first).distinct(), [*keys, first]), [*keys, first], rest, among)
    return got.unionByName(below.join(among, [*keys, first, "rank"]).select(*keys, F.col("__rank").alias("rank"), *order))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], between: bool = False) -> DataFrame:
    """(keys, n, <name> ...): the element at ``share * (n - 1)`` of every group, rounded down, or with ``between`` the
    value between the two elements around it. ``n`` counts the rows with a value."""
    v = F.col(value).cast("double")
    # written, since every pass reads the values again
    rows = written(rows.select(*keys, v.alias("v")).where("v is not null and not isnan(v)"), "values")
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    place = {k: F.lit(float(q)) * (F.col("n") - 1) for k, q in shares.items()}
    low = {k: F.floor(p) for k, p in place.items()}
    ranks = [low[k] for k in shares] + ([F.ceil(place[k]) for k in shares] if between else [])
    found = ranked(rows, keys, ["v"], sizes.select(*keys, F.explode(F.array(*ranks)).alias("rank")))
    j = sizes.join(found, keys) if keys else sizes.crossJoin(found)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    part = lambda k: F.max(place[k] - low[k])
    one = lambda k: at(low[k]) if not between else at(low[k]) + (at(F.ceil(place[k])) - at(low[k])) * part(k)
    return j.groupBy(*keys, "n").agg(*[one(k).alias(k) for k in shares])


def top_of(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group; every task keeps no more than ``n`` rows of a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
