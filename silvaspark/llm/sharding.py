"""Sharding by a hierarchical weighted hash tree (native DataFrame functions only).

The tree has three levels: regions hold racks, racks hold shards. Every shard has a weight, and a rack or
region that of what hangs below it. A row descends level by level: at each node every child draws an
exponential variate of its weight from a hash of the row's key and the child's name, and the least
draw wins, so each child wins in proportion to its weight. A row makes one draw a child on its path,
not one a shard.

A change of weights changes draws only of the nodes whose weight it changes. At each level rows thus
move only into a child whose weight grew or out of one whose weight fell; below nodes whose weights stay
nothing moves, and no row moves between two such nodes.

A new shard that is hung under a region of its own takes rows only into itself, and ``tree`` hangs all
shards beyond the planned ones that way. One that joins an old rack makes the region and rack heavier, so rows
enter these from elsewhere and may land in a sister shard in the same rack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_011


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, shards_per_rack: int = 5, racks_per_region: int = 4, weights: dict[int, float] | None = None, planned: int = 40) -> list[Leaf]:
    """Shards 0..n-1: the first ``planned`` hung in order below racks and regions, each further one below a
    region of its own."""
    per_region = shards_per_rack * racks_per_region
    w = weights or {}
    out = [Leaf(s // per_region, s // shards_per_rack, s, float(w.get(s, 1.0))) for s in range(min(n_shards, planned))]
    return out + [Leaf(planned + s, planned + s, s, float(w.get(s, 1.0))) for s in range(planned, n_shards)]


def _draw(key: Column, level: str, name: Column, weight: Column) -> Column:
    """Exp(weight) from the upper 53 bits of a hash of key and child; strictly positive and finite."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), name, F.lit(SEED)), 11).cast("double")
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def _choose(key: Column, level: str, children: list[list[tuple[int, float]]], parent: Column | None) -> Column:
    """struct(draw, at, name) of the child that wins below the node number ``parent`` of ``children``; ``at`` counts
    all children of the level. Children of weight 0 never win."""
    first = [sum(map(len, children[:k])) for k in range(len(children))]
    of = lambda xs: F.lit(xs[0]) if parent is None else F.element_at(F.array(*map(F.lit, xs)), parent + 1)
    draws = []
    for j in range(max(map(len, children))):
        weight = of([c[j][1] if j < len(c) else 0.0 for c in children])
        name = of([c[j][0] if j < len(c) else -1 for c in children])
        draw = F.when(weight > 0, _draw(key, level, name, F.greatest(weight, F.lit(1e-300)))).otherwise(F.lit(float("inf")))
        draws.append(F.struct(draw.alias("draw"), (of(first) + j).alias("at"), name.alias("name")))
    return draws[0] if len(draws) == 1 else F.least(*draws)


def _levels(leaves: list[Leaf]) -> tuple[list, list, list]:
    """Children (name, weight) of the root, of each region and of each rack, in the order of their parents."""
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        raise ValueError("no leaf has a positive weight")
    weight = lambda rack: sum(x.weight for x in rack)
    top = [[(r, sum(map(weight, racks.values()))) for r, racks in regions.items()]]
    middle = [[(k, weight(rack)) for k, rack in racks.items()] for racks in regions.values()]
    low = [[(x.shard, x.weight) for x in rack] for racks in regions.values() for rack in racks.values()]
    return top, middle, low


def assign(df: DataFrame, key: str, leaves: list[Leaf], grown: list[Leaf] | None = None, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """Add the shard of every row under ``leaves`` (and under ``grown``). A null key counts as one more key."""
    out = df
    for name, of in ((shard_col, leaves), (grown_col, grown)):
        if of is not None:
            top, middle, low = _levels(of)
            out = out.withColumn(name, _descent(F.coalesce(F.col(key).cast("string"), F.lit("\0null")), top, middle, low))
    return out


def _bound(x: Column, f) -> Column:
    """f(x) with x as a variable, so that the optimiser cannot write x out at each of its places in f."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _descent(key: Column, top: list, middle: list, low: list) -> Column:
    return _bound(key, lambda k: _bound(_choose(k, "region", top, None)["at"], lambda r: _bound(_choose(k, "rack", middle, r)["at"], lambda c: _choose(k, "shard", low, c)["name"])))


def number_slots(rows: DataFrame, shard: str, order: list[str], n: int, rows_per_run: int = 500_000) -> DataFrame:
    """Rows with equal ``shard`` and ``order`` columns and their number ``n_rows``, to one row each with a gapless
    ``slot`` from 0 in every shard.

    Each shard is cut by a hash of the ordering columns into runs, whose number grows with the ``n`` rows in all;
    runs are summed up to offsets (one row per run) and rows are numbered inside their run, so no
    shard comes into one task, and neither do rows that are all equal.
    """
    runs = 64 * (n // (64 * rows_per_run) + 1)
    cut = rows.withColumn("__run", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(runs)).cast("int"))
    counts = cut.groupBy(F.col(shard).alias("__s"), F.col("__run").alias("__r")).agg(F.sum("n_rows").alias("__n"))
    w = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__s", "__r", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(shard, "__run").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("__at", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
    joined = numbered.join(offsets, (F.col(shard) == F.col("__s")) & (F.col("__run") == F.col("__r"))).withColumn("__from", F.col("__from") + F.col("__at"))
    slot = F.sequence(F.col("__from").cast("long"), (F.col("__from") + F.col("n_rows") - 1).cast("long"))
    return joined.withColumn("slot", F.explode(slot)).drop("__s", "__r", "__run", "__from", "__at", "n_rows")


def shard_documents(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Law ``key``: ``doc_id`` and the shard count decide.

    Null text has size 16 and crc 0 of no bytes; a null id is a key of its own; repeated rows
    share a shard and get different slots (equal ones are counted where they are read); an empty table gives an
    empty result; further columns of ``docs`` are ignored.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "part").agg(F.count("*").alias("n_rows"))
    placed = assign(rows.withColumn("law", F.lit("key")), "doc_id", tree(n_shards), tree(n_shards + 1))
    out = number_slots(placed, "shard", ["doc_id", "size", "text_crc32", "part"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
