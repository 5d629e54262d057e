"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and an index maps each segment's value to
the codes that have it; segments have about as many bits as it takes to count the codes, so that
buckets do not grow with the table. A query first probes its own segment values, then all values one bit
away, then two, and so on. After radius r every code within m * (r + 1) - 1 bits of m segments has
been met in some segment; a query is done once its k-th verified distance is within that bound.
Only queries that are not done go into the next round.

Equal codes are one entry of the index with its k + 1 smallest ids, since no more of them can be
among a query's k nearest; a code that a third of all rows share thus is one row.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.runtime import written

BITS = 64


def segments_for(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments for ``n`` codes."""
    m = min(8, max(3, round(BITS / math.log2(max(n, 4)))))
    ends = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def sign_codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit i says whether element i is above 0; missing or null elements
    are not. Rows with a null id or vector are left out; a vector of more than ``BITS`` elements is an error."""
    v = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} elements"))).otherwise(F.col(vector))
    bit = F.transform(v, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), code.alias("code"))


def _segment(code, at: tuple[int, int]):
    return F.shiftrightunsigned(code, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1)).cast("int")


def _masks(spark, width: int, radius: int) -> DataFrame:
    """All values of ``radius`` set bits in a segment; segments have 22 bits at most. None if there are fewer bits."""
    values = [(sum(1 << b for b in bits),) for bits in combinations(range(width), radius)]
    return spark.createDataFrame(values, "mask int")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of every query, by distance and id.

    rows(id, code), queries(id, code). A row is not its own neighbour: rows with the query's id
    are left out. Rows repeated whole count once. With fewer than k other rows all are returned;
    empty inputs give an empty result.
    """
    spark = rows.sparkSession
    w = Window.partitionBy("code").orderBy("id")
    entries = written(
        rows.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "codes",
    )
    cuts = segments_for(entries.count())
    index = None
    for s, at in enumerate(cuts):
        part = entries.select(F.lit(s).alias("seg"), _segment(F.col("code"), at).alias("key"), "code", "ids")
        index = part if index is None else index.unionAll(part)
    index = written(index, "code-index")
    open_ = written(queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct(), "code-queries")
    best = None
    done = None
    widest = max(width for _, width in cuts)
    for radius in range(widest + 1):
        masks = {width: _masks(spark, width, radius) for _, width in cuts}
        probes = None
        for s, at in enumerate(cuts):
            part = open_.crossJoin(F.broadcast(masks[at[1]])).select("query_id", "q", F.lit(s).alias("seg"), _segment(F.col("q"), at).bitwiseXOR(F.col("mask")).alias("key"))
            probes = part if probes is None else probes.unionAll(part)
        # a code is met in its first segment of least distance only, so candidates are not repeated
        dist = [F.bit_count(_segment(F.col("q"), at).bitwiseXOR(_segment(F.col("code"), at))) for at in cuts]
        first = F.lit(True)
        for s in range(len(cuts)):
            first = first & ((F.col("seg") <= s) | (dist[s] > radius))
        exact = F.least(*dist) == radius
        met = probes.join(index, ["seg", "key"]).where(exact & first)
        met = met.select("query_id", "q", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int").alias("distance"), F.explode("ids").alias("id")).where("id <> query_id")
        if best is not None:
            met = best.unionAll(met)
        rank = Window.partitionBy("query_id").orderBy("distance", "id")
        best = written(met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "q", "distance", "id"), "code-best")
        bound = len(cuts) * (radius + 1) - 1
        state = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        closed = state.where((F.col("n") >= k) & (F.col("far") <= bound)).select("query_id")
        now = best.join(closed, "query_id")
        done = now if done is None else done.unionAll(now)
        open_ = written(open_.join(closed, "query_id", "left_anti"), "code-queries")
        if open_.isEmpty():
            break
        best = best.join(closed, "query_id", "left_anti")
    else:
        done = done.unionAll(best)
    rank = Window.partitionBy("query_id").orderBy("distance", "id")
    return done.select("query_id", "id", "distance", F.row_number().over(rank).alias("rank"))
