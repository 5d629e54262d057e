"""What each of several document filters removes in every order in which they can be applied (DataFrame functions only).

Every document is reduced to a mask of the filters it fails, and documents to *cells*: how many of a part have a mask.
There are at most 32 cells a part, whatever the number of documents. Cells are unpivoted against the steps of all
orders; a running bit-or over the earlier steps of an order tells whether a cell was removed before, conditional sums
give the counts of a step, and a window over all orders the total of each filter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the filters; filter k has bit k of a mask. ``E`` (an exact copy) is found across documents.
FILTERS = "ABCDE"
COPY = FILTERS.index("E")


def failures(text: Column, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> Column:
    """Mask of the failures that a text (never null) alone decides: A too few words, B too few distinct
    words, C too many capitals, D a forbidden sign. An empty text fails A only."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.split(bare, "[\\x20\\x09-\\x0D]+")  # one empty word in a text without words
    n = F.size(words).cast("long") - (bare == "").cast("int")
    distinct = F.size(F.array_distinct(words)).cast("long") - (bare == "").cast("int")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < least_words, 100 * distinct < distinct_percent * n, 100 * capitals > capital_percent * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail.

    Copies are told by SHA-256. The smallest id of each text is found from rows that are already counted by
    (text, part, labels), so the copies of one text, however many, are summed up where they are and no row is
    joined back. Rows of equal ids do not make each other copies, and a row without an id has no smaller one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failures(t).alias("mask"), F.sha2(t, 256).alias("sha"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    of = ["sha", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("id", *of).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = by_id.groupBy(*of).agg(first.alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("lone"))
    least = F.min("first.id").over(Window.partitionBy("sha"))
    split = by_text.withColumn("least", least).withColumn("own", F.col("lone") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    of_mask = F.inline(F.array(F.struct(F.col("mask").alias("m"), F.col("own").alias("k")), F.struct((F.col("mask") + (1 << COPY)).alias("m"), (F.col("n") + F.col("lone") - F.col("own")).alias("k"))))
    each = split.select("part", "good", "toxic", of_mask)
    k = F.col("k")
    return each.groupBy("part", F.col("m").alias("mask")).agg(F.sum(k).alias("n"), F.sum(F.when(F.col("good"), k).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), k).otherwise(0)).alias("toxic"))


def steps(filters: str = FILTERS) -> Column:
    """Array of struct(filter_order, step, bit): every step of every order of the filters."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    bit = lambda order, step: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substr(order, step, F.lit(1))) - 1)
    places = F.sequence(F.lit(1), F.lit(len(filters)))
    return F.flatten(F.transform(orders, lambda o: F.transform(places, lambda s: F.struct(o.alias("filter_order"), s.alias("step"), bit(o, s).alias("bit")))))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Long form of every order and step of every part, from ``cells`` (part, mask, n, good, toxic)."""
    long = cells.select("*", F.inline(steps(filters)))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda cond, n="n": F.sum(F.when(cond, F.col(n)).otherwise(0))
    by_step = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Null texts count as empty, a null part as the empty string; a document with several label rows is good (toxic)
    if any says so; rows without a label are neither; repeated rows are counted each; an empty table gives no row;
    further columns are ignored.
    """
    return audit(cells(docs, labels))
