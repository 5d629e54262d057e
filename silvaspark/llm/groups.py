"""Groups of rows that are compared within: streaming, splitting of large ones, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of equal leading columns in sorted Arrow batches; one group is held."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = row[:n_keys]
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row[n_keys:])
    if held:
        yield now, held


def dealt(df: DataFrame, group: str, size: str, member: str, most: int) -> DataFrame:
    """Send every row to the tasks of its group, as columns ``group, i, j, side``.

    A group of at most ``most`` rows is one task. A larger one is cut by a hash of ``member``
    into chunks of about that size; every pair of chunks i <= j is a task, so each pair of rows
    meets in exactly one of them and no task holds more than two chunks.
    """
    chunks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(97)), chunks).cast("int")
    task = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"), F.when(own <= k, 0).otherwise(1).alias("side")),
    )
    rest = [c for c in df.columns if c not in (group, size)]
    return df.select(F.col(group), F.explode(task).alias("__t"), *rest).select(group, "__t.i", "__t.j", "__t.side", *rest)


def collected(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one partition and next to each other.

    The number of partitions is the session's: what is done with a group costs more than its bytes
    say, so partitions are not merged by size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


class Union:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stars that connect what the graph with edges a[k]-b[k] connects: each node with the smallest
    node of its component. Stars need the fewest rounds to be joined with those of other tasks."""
    u = Union(n)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u.join(x, y)
    return [(k, r) for k in range(n) if (r := u.root(k)) != k]


def null_safe(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
