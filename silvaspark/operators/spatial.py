"""Distance joins by grid buckets, neighbourhoods, clusters and nearest neighbours.

A distance condition is a theta join, which Spark would run as a nested loop. Here both sides get
the grid cell of side r; one side is sent to the cells around its own, and the equi-join on
cells plus the exact predicate gives every pair once.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.operators.components import FEW_EDGES, connected_components
from silvaspark.runtime import written


def _cells(cols: list[str], side: float, prefix: str) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(side)).alias(f"{prefix}{k}") for k, c in enumerate(cols)]


def range_join(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str], radius: float, keys: list[str] | None = None, strict: bool = False, d2: str = "d2", placed: bool = False, wide: int = 1) -> DataFrame:
    """Pairs of rows within ``radius`` in the plane or in space, with the squared distance ``d2``.

    Column names of the two sides must differ, but for ``keys``, which must be equal. ``right`` is copied to the cells
    around, so the side of fewer rows goes there; copies to cells that are out of reach are dropped. The join is
    by sorting: Spark takes the copied side for as small as its files and would send it to the driver whole.
    ``placed`` leaves the cell of the left row (__c0, ...), which the pairs are dealt by. Cells are ``wide`` radii wide: wider
    ones mean fewer copies to shuffle and more rows to compare, in space 21 copies and 21 cubic radii, or 7 copies and 55.
    """
    keys = keys or []
    n = len(left_cols)
    own = [f"__c{k}" for k in range(n)]
    side = radius * wide
    a = left.select("*", *_cells(left_cols, side, "__c"))
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{k}") for k, o in enumerate(off)]) for off in product((-1, 0, 1), repeat=n)])
    b = right.select("*", *_cells(right_cols, side, "__b"), F.explode(around).alias("__o"))
    # distance from the cell that a copy goes to, as a share of the cell's side; with room for rounding
    share = [F.col(c) / F.lit(side) - F.col(f"__b{k}") for k, c in enumerate(right_cols)]
    off = [F.when(F.col(f"__o.o{k}") < 0, f).when(F.col(f"__o.o{k}") > 0, 1 - f).otherwise(0.0) for k, f in enumerate(share)]
    b = b.where(sum((d * d for d in off[1:]), off[0] * off[0]) <= (1 + 1e-6) / wide / wide)
    b = b.select("*", *[(F.col(f"__b{k}") + F.col(f"__o.o{k}")).alias(own[k]) for k in range(n)]).drop("__o", *[f"__b{k}" for k in range(n)]).hint("merge")
    diff = [F.col(x).cast("double") - F.col(y).cast("double") for x, y in zip(left_cols, right_cols, strict=True)]
    sq = sum((d * d for d in diff[1:]), diff[0] * diff[0])
    pairs = a.join(b, [*keys, *own]).withColumn(d2, sq)
    limit = F.lit(radius * radius)
    pairs = pairs.where(F.col(d2) < limit if strict else F.col(d2) <= limit)
    return pairs if placed else pairs.drop(*own)


def _renamed(df: DataFrame, cols: list[str], suffix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}{suffix}") for c in cols])


def neighbour_counts(points: DataFrame, pid: str, cols: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """(pid, n) of the points within ``radius``, the point itself included.

    Copies are coordinates alone. A point's pairs are all found where its cell is, so they are counted there and not shuffled."""
    keys = keys or []
    a = _renamed(points, [pid, *cols], "_a", keys)
    b = _renamed(points, cols, "_b", keys)
    pairs = range_join(a, b, [f"{c}_a" for c in cols], [f"{c}_b" for c in cols], radius, keys, placed=True, wide=2)
    return pairs.groupBy(*keys, *[f"__c{k}" for k in range(len(cols))], F.col(f"{pid}_a").alias(pid)).agg(F.count("*").alias("n")).select(*keys, pid, "n")


def moments(points: DataFrame, pid: str, radius: float, keys: list[str] | None = None, min_neighbours: int = 5) -> DataFrame:
    """Covariance (divided by n) of the neighbourhood of every point with enough neighbours.

    Differences to the point itself are summed, so large coordinates cost no digits and only
    partial sums are shuffled.
    """
    keys = keys or []
    cols = ["x", "y", "z"]
    a = _renamed(points, [pid, *cols], "_a", keys)
    b = _renamed(points, [pid, *cols], "_b", keys)
    pairs = range_join(a, b, [f"{c}_a" for c in cols], [f"{c}_b" for c in cols], radius, keys)
    d = {c: F.col(f"{c}_b").cast("double") - F.col(f"{c}_a").cast("double") for c in cols}
    two = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    g = pairs.groupBy(*keys, F.col(f"{pid}_a").alias(pid)).agg(F.count("*").alias("n"), *[F.sum(d[c]).alias(f"s{c}") for c in cols], *[F.sum(d[p] * d[q]).alias(f"s{p}{q}") for p, q in two])
    n = F.col("n")
    cov = [(F.col(f"s{p}{q}") / n - F.col(f"s{p}") * F.col(f"s{q}") / n / n).alias(f"c{p}{q}") for p, q in two]
    return g.where(n >= min_neighbours).select(*keys, pid, "n", *cov)


def normals(points: DataFrame, pid: str, radius: float = 0.10, keys: list[str] | None = None, min_neighbours: int = 5) -> DataFrame:
    """(pid, n, nx, ny, nz, verticality, curvature) of every valid point; others have no row.

    The normal is the eigenvector of the least eigenvalue, turned up; verticality is 1 - |nz| and
    curvature the share of the least eigenvalue, as float32.
    """
    cov = moments(points, pid, radius, keys, min_neighbours)

    @F.pandas_udf("nx double, ny double, nz double, verticality float, curvature float")
    def eig(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        w, v = np.linalg.eigh(m)
        e = v[:, :, 0] * np.where(v[:, 2, 0] < 0, -1.0, 1.0)[:, None]
        total = w.sum(axis=1)
        curve = np.where(total > 0, np.maximum(w[:, 0], 0) / np.where(total > 0, total, 1), 0)
        return pd.DataFrame({"nx": e[:, 0], "ny": e[:, 1], "nz": e[:, 2], "verticality": (1 - np.abs(e[:, 2])).astype(np.float32), "curvature": curve.astype(np.float32)})

    out = cov.withColumn("__e", eig("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    return out.select(*(keys or []), pid, "n", "__e.*")


#: Pairs of cells with at most this many pairs of points are decided by their points, others by cells a quarter as wide.
FEW = 1024


def _boxes(points: DataFrame, cols: list[str], by: list[str], *more: Column) -> DataFrame:
    """One row a cell: its points' number ``n`` and box ``lo0, hi0, ...``, from partial sums."""
    ends = [f(c).alias(f"{name}{k}") for k, c in enumerate(cols) for name, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *ends, *more)


def _gap(a: str, b: str, dims: int, point: list[str] | None = None) -> Column:
    """Square of the least distance between two boxes, or of the point ``point`` from box ``b``."""
    out = None
    for k in range(dims):
        lo, hi = (F.col(f"{a}lo{k}"), F.col(f"{a}hi{k}")) if point is None else (F.col(point[k]), F.col(point[k]))
        d = F.greatest(F.lit(0.0), lo - F.col(f"{b}hi{k}"), F.col(f"{b}lo{k}") - hi)
        out = d * d if out is None else out + d * d
    return out


def _reach(a: str, b: str, dims: int) -> Column:
    """Square of the greatest distance between two boxes."""
    out = None
    for k in range(dims):
        d = F.greatest(F.abs(F.col(f"{a}hi{k}") - F.col(f"{b}lo{k}")), F.abs(F.col(f"{b}hi{k}") - F.col(f"{a}lo{k}")))
        out = d * d if out is None else out + d * d
    return out


def _near_cells(cells: DataFrame, dims: int, eps: float, side: float, keys: list[str], within) -> tuple[DataFrame, list[str], list[str], Column]:
    """Pairs (u, v, sure, id) of cells whose boxes are within eps; ``sure`` if all of their points are. Numbers and boxes
    of both are there where they are not.

    Cells meet on a coarser grid: each is at home where its box begins, and goes wherever a near one can be at home."""
    wide = 3 * eps
    box = [f"{e}{k}" for k in range(dims) for e in ("lo", "hi")]
    home = [F.floor(F.col(f"lo{k}") / wide).alias(f"__h{k}") for k in range(dims)]
    a = cells.select(*keys, F.col("node").alias("u"), F.col("n").alias("an"), *[F.col(c).alias(f"a{c}") for c in box], *home)
    b = cells.select(*keys, F.col("node").alias("v"), F.col("n").alias("bn"), *[F.col(c).alias(f"b{c}") for c in box])
    for k in range(dims):
        b = b.withColumn(f"__h{k}", F.explode(F.sequence(F.floor((F.col(f"blo{k}") - (eps + side)) / wide), F.floor((F.col(f"bhi{k}") + eps) / wide))))
    met = a.join(b, [*keys, *[f"__h{k}" for k in range(dims)]]).where("u < v").where(within(_gap("a", "b", dims)))
    ends = ["an", "bn", *[f"{x}{c}" for x in "ab" for c in box]]
    sure = within(_reach("a", "b", dims))
    pairs = written(met.select("u", "v", sure.alias("sure"), *[F.when(~sure, F.col(c)).alias(c) for c in ends], F.monotonically_increasing_id().alias("id")), "cell-pairs")
    return pairs, ends, box, sure


def adjacency(points: DataFrame, pid: str, cols: list[str], eps: float, keys: list[str] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, edges, points): sub-cells of points (keys, s0, s1, ..., node, n, box), an edge (u, v) for each pair of sub-cells
    that are joined, and the points with the place s0, s1, ... of their sub-cell.

    Points of one sub-cell of side eps/sqrt(dims) are all adjacent, so a sub-cell is one node, named by its
    smallest pid. Two sub-cells are joined if their least distance is within eps. The boxes around their points decide
    that for most pairs: joined if the greatest distance of the boxes is within eps, not joined if the least is beyond.
    Only pairs between these go on: few points are compared as they are, and only those within eps of the other
    box; many are cut into cells a quarter as wide, of which again the boxes decide. Points are not joined with points
    but there, however many share a cell.
    """
    keys, dims = keys or [], len(cols)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    sub = [f"s{k}" for k in range(dims)]
    limit = F.lit(eps * eps)
    within = (lambda d: d < limit) if strict else (lambda d: d <= limit)
    p = points.select(*keys, pid, *[F.col(c).cast("double").alias(c) for c in cols])
    # written, since open pairs and the result ask for the points again
    p = written(p.select("*", *[F.floor(F.col(c) / F.lit(side)).alias(s) for c, s in zip(cols, sub, strict=True)]), "points-of-cells")
    in_cells = p
    cells = written(_boxes(p, cols, [*keys, *sub], F.min(pid).alias("node")), "sub-cells")

    pairs, ends, box, sure = _near_cells(cells, dims, eps, side, keys, within)
    edges = pairs.where("sure").select("u", "v")
    grid: list[str] = []
    for level in range(1, 30):
        left = pairs.where(~F.col("sure"))
        if level > 1:
            left = left.join(pairs.where("sure").select("u", "v").distinct(), ["u", "v"], "left_anti")
        left = written(left.drop("sure"), "open-pairs")
        few = F.col("an") * F.col("bn") <= FEW
        n_few, n_many = left.agg(F.count_if(few), F.count_if(~few)).first()
        # where a pair's cells are: the sub-cell's name and, from the second round on, the finer cell in it
        cell = {x: [F.col(n).alias("node"), *[F.col(f"{x}{g}").alias(g) for g in grid]] for x, n in (("a", "u"), ("b", "v"))}

        def sent(rows: DataFrame, what: DataFrame, x: str, names: dict[str, str], near: Column) -> DataFrame:
            """The rows of ``what`` in one side's cells, near the box of the other side."""
            other = "b" if x == "a" else "a"
            to = rows.select("id", *cell[x], *[F.col(f"{other}{c}").alias(f"o{c}") for c in box])
            return to.join(what, ["node", *grid]).where(within(near)).select("id", *[F.col(c).alias(n) for c, n in names.items()])  # noqa: B023

        def named(what: DataFrame, rows: DataFrame) -> DataFrame:
            """With the sub-cell's name, for sub-cells of ``rows`` only."""
            used = rows.select(F.col("u").alias("node")).unionAll(rows.select(F.col("v").alias("node"))).distinct()
            return what.join(cells.select(*keys, *sub, "node").join(used, "node", "left_semi"), [*keys, *sub])

        if n_few:
            rows = left.where(few)
            pts = named(p.drop(pid), rows)
            side_of = lambda x: sent(rows, pts, x, {c: f"{x}{c}" for c in cols}, _gap("", "o", dims, cols))  # noqa: B023, E731
            d = [F.col(f"a{c}") - F.col(f"b{c}") for c in cols]
            hit = side_of("a").join(side_of("b"), "id").where(within(sum((x * x for x in d[1:]), d[0] * d[0]))).select("id").distinct()
            edges = edges.unionAll(written(rows.join(hit, "id", "left_semi").select("u", "v").distinct(), "close-pairs"))
        if not n_many:
            break
        rows = left.where(~few)
        finer = [f"g{level}_{k}" for k in range(dims)]
        p = p.select("*", *[F.floor(F.col(c) / F.lit(side / 4**level)).alias(g) for c, g in zip(cols, finer, strict=True)])
        fine = named(_boxes(p, cols, [*keys, *sub, *grid, *finer]), rows)
        of = lambda x: sent(rows, fine, x, {c: f"{x}{c}" for c in ("n", *box, *finer)}, _gap("", "o", dims))  # noqa: B023, E731
        met = of("a").join(of("b"), "id").where(within(_gap("a", "b", dims))).join(rows.select("id", "u", "v"), "id").drop("id")
        pairs = written(met.select("*", sure.alias("sure"), F.monotonically_increasing_id().alias("id")), "cell-pairs")
        edges = edges.unionAll(pairs.where("sure").select("u", "v").distinct())
        p, grid = p.drop(*grid), finer
    return cells, edges, in_cells


def _components(points: DataFrame, pid: str, cols: list[str], eps: float, keys: list[str], strict: bool = False) -> tuple[DataFrame, list[str], DataFrame]:
    """(sub-cells with their ``group``, the smallest pid of the component, and number ``n`` of points; their columns s0, ...;
    points with the same columns)."""
    cells, edges, placed = adjacency(points, pid, cols, eps, keys, strict)
    sub = [f"s{k}" for k in range(len(cols))]
    comp = connected_components(edges, few=FEW_EDGES)
    named = cells.select(*keys, *sub, "n", "node").join(comp, "node", "left")
    return named.select(*keys, *sub, "n", F.coalesce("component", "node").alias("group")), sub, placed


def clusters(points: DataFrame, pid: str, eps: float, cols: list[str] | None = None, min_points: int = 1, max_points: int = 10_000_000, keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, pid, size): Euclidean clusters, named by their smallest pid, within size limits.

    ``pid`` must be unique over all keys. Sizes are summed over sub-cells; points meet the sub-cells of clusters within
    the limits once, at the end.
    """
    keys = keys or []
    cols = cols or ["x", "y", "z"]
    cells, sub, placed = _components(points, pid, cols, eps, keys)
    sizes = cells.groupBy("group").agg(F.sum("n").alias("size")).where(F.col("size").between(min_points, max_points))
    kept = cells.join(sizes, "group").select(*keys, *sub, F.col("group").alias("cluster"), "size")
    return placed.select(*keys, pid, *sub).join(kept, [*keys, *sub]).select(*keys, "cluster", pid, "size")


#: Runs whose marks fit one integer.
RUNS = 62


def clusters_of_runs(points: DataFrame, pid: str, eps: float, cols: list[str] | None = None, min_points: int = 1, max_points: int = 10_000_000, runs: str = "runs") -> DataFrame:
    """(run, cluster, pid): ``clusters`` of the points of each run; ``runs`` is the array of the numbers (from 0) of a point's runs.

    Sub-cells and the pairs of them that are near are found once for all runs. An edge carries a mark, a bit for each run in
    which it holds: of the runs that both sub-cells occur in if all points of them are within reach, else of those
    that have two points within reach. So what grows with the number of runs is components and the rows of the result.
    Points of open pairs are compared with each other, so they must have been thinned: a sub-cell holds as many as
    voxels fit into it. ``pid`` must be unique and below 2**57.
    """
    cols = cols or ["x", "y", "z"]
    dims = len(cols)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    sub = [f"s{k}" for k in range(dims)]
    limit = F.lit(eps * eps)
    within = lambda d: d <= limit
    p = points.select(pid, runs, *[F.col(c).cast("double").alias(c) for c in cols])
    p = written(p.select("*", *[F.floor(F.col(c) / F.lit(side)).alias(s) for c, s in zip(cols, sub, strict=True)]), "points-of-runs")
    n_runs = p.agg(F.max(F.array_max(runs))).first()[0]
    out = None
    for low in range(0, (n_runs if n_runs is not None else 0) + 1, RUNS):
        # the marks of this batch of runs
        mark = F.aggregate(F.filter(runs, lambda r: (r >= low) & (r < low + RUNS)), F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (r - low).cast("int"))))  # noqa: B023
        q = p.select(pid, *cols, *sub, mark.alias("mark")).where("mark <> 0")
        cells = written(_boxes(q, cols, sub, F.min(pid).alias("node"), F.bit_or("mark").alias("mark")), "sub-cells")
        pairs, _, box, _ = _near_cells(cells, dims, eps, side, [], within)
        marks = lambda n: cells.select(F.col("node").alias(n), F.col("mark").alias(f"{n}mark"))  # noqa: B023, E731
        sure = pairs.where("sure").select("u", "v").join(marks("u"), "u").join(marks("v"), "v").select("u", "v", F.col("umark").bitwiseAND(F.col("vmark")).alias("mark"))
        left = pairs.where(~F.col("sure"))
        used = left.select(F.col("u").alias("node")).unionAll(left.select(F.col("v").alias("node"))).distinct()
        pts = q.join(cells.select(*sub, "node").join(used, "node", "left_semi"), sub).select("node", "mark", *cols)

        def sent(x: str, n: str, other: str) -> DataFrame:
            to = left.select("id", F.col(n).alias("node"), *[F.col(f"{other}{c}").alias(f"o{c}") for c in box])  # noqa: B023
            return to.join(pts, "node").where(within(_gap("", "o", dims, cols))).select("id", F.col("mark").alias(f"{x}mark"), *[F.col(c).alias(f"{x}{c}") for c in cols])  # noqa: B023

        d = [F.col(f"a{c}") - F.col(f"b{c}") for c in cols]
        both = F.col("amark").bitwiseAND(F.col("bmark"))
        hit = sent("a", "u", "b").join(sent("b", "v", "a"), "id").where((both != 0) & within(sum((x * x for x in d[1:]), d[0] * d[0])))
        close = hit.groupBy("id").agg(F.bit_or(both).alias("mark")).join(left.select("id", "u", "v"), "id").select("u", "v", "mark")
        # a node of a run is the sub-cell's name and the run in the lowest six bits
        of = F.filter(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.call_function("shiftright", F.col("mark"), r).bitwiseAND(F.lit(1)) == 1)
        in_run = lambda c: F.call_function("shiftleft", F.col(c), F.lit(6)).bitwiseOR(F.col("r").cast("long"))
        edges = sure.unionAll(close).where("mark <> 0").withColumn("r", F.explode(of)).select(in_run("u").alias("u"), in_run("v").alias("v"))
        comp = connected_components(edges, few=FEW_EDGES)
        each = q.join(cells.select(*sub, "node"), sub).select(pid, "node", F.explode(of).alias("r")).withColumn("__n", in_run("node"))
        named = each.join(comp.withColumnRenamed("node", "__n"), "__n", "left").withColumn("__c", F.coalesce("component", "__n"))
        # clusters go by the smallest point of theirs in the run
        w = named.groupBy("__c").agg(F.count("*").alias("size"), F.min(pid).alias("cluster")).where(F.col("size").between(min_points, max_points))
        part = named.join(w, "__c").select((F.col("r") + low).cast("int").alias("run"), "cluster", pid)
        out = part if out is None else out.unionAll(part)
    return out


def merge_points(points: DataFrame, pid: str, radius: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, pid, x, y, z, n): groups of points linked by horizontal distances below ``radius``,
    replaced by their mean and named by the smallest pid; a radius of 0 or less merges nothing."""
    keys = keys or []
    if radius <= 0:
        return points.select(*keys, pid, "x", "y", "z", F.lit(1).cast("long").alias("n"))
    cells, sub, placed = _components(points, pid, ["x", "y"], radius, keys, strict=True)
    named = points.join(placed.select(pid, *keys, *sub).join(cells.select(*keys, *sub, F.col("group").alias("__g")), [*keys, *sub]).select(pid, "__g"), pid)
    g = named.groupBy(*keys, F.col("__g").alias(pid)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))
    return g.select(*keys, pid, "x", "y", "z", "n")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_cols: list[str], right_cols: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, left_id, right_id, d): nearest right row within ``radius``, ties to the smaller id."""
    keys = keys or []
    pairs = range_join(left.select(*keys, left_id, *left_cols), right.select(*keys, right_id, *right_cols), left_cols, right_cols, radius, keys)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("d2", right_id)).alias("b"))
    return best.select(*keys, left_id, F.col(f"b.{right_id}").alias(right_id), F.sqrt("b.d2").alias("d"))


def mutual_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_cols: list[str], right_cols: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs that are each other's nearest within ``radius``: (keys, left_id, right_id, d)."""
    keys = keys or []
    there = nearest(left, right, left_id, right_id, left_cols, right_cols, radius, keys)
    back = nearest(right, left, right_id, left_id, right_cols, left_cols, radius, keys).drop("d")
    return there.join(back, [*keys, left_id, right_id])


def classify(old: DataFrame, new: DataFrame, old_id: str, new_id: str, old_cols: list[str], new_cols: list[str], same: float, shifted: float) -> DataFrame:
    """(old_id, new_id, d, kind): new rows are identical (d <= same), shifted (d <= shifted) or new;
    old rows that are nearest to no new row within ``shifted`` are lost."""
    near = nearest(new, old, new_id, old_id, new_cols, old_cols, shifted)
    kinds = new.select(new_id).join(near, new_id, "left")
    kinds = kinds.select(old_id, new_id, "d", F.when(F.col("d").isNull(), "new").when(F.col("d") <= same, "identical").otherwise("shifted").alias("kind"))
    lost = old.select(old_id).join(near.select(old_id), old_id, "left_anti")
    return kinds.unionByName(lost.select(old_id, F.lit("lost").alias("kind")), allowMissingColumns=True)


def local_ground(trees: DataFrame, ground: DataFrame, tree_id: str, radius: float, p: float = 0.02, min_points: int = 5, above: float = 1.0) -> DataFrame:
    """(tree_id, n, ground_z, height, flagged): low percentile of the heights around each tree.

    trees(tree_id, tx, ty, tz), ground(gx, gy, gz)."""
    # points that coincide are one row with their number; trees are fewer than points, so they are sent to the cells around
    once = ground.groupBy("gx", "gy", "gz").agg(F.count("*").alias("__many"))
    pairs = range_join(once, trees.select(tree_id, "tx", "ty", "tz"), ["gx", "gy"], ["tx", "ty"], radius)
    # pairs are counted by height where they are found, since a percentile's own partial results are sorted, pair by pair, beyond a few trees;
    # what is sorted then is a row for each height around a tree
    known = F.when(F.col("gz").isNotNull(), F.col("c")).otherwise(0)
    counts = pairs.groupBy(tree_id, "tz", "gz").agg(F.sum("__many").alias("c"))
    tree = Window.partitionBy(tree_id, "tz")
    counts = counts.withColumns({"n": F.sum("c").over(tree), "at": F.lit(p) * (F.sum(known).over(tree) - 1), "upto": F.sum(known).over(tree.orderBy("gz").rowsBetween(Window.unboundedPreceding, 0))})
    beyond = lambda k: F.min(F.when(F.col("upto") > k(F.col("at")), F.col("gz")))
    g = counts.where(F.col("n") >= min_points).groupBy(tree_id, "tz", "n", "at").agg(beyond(F.floor).alias("lo"), beyond(F.ceil).alias("hi"))
    low, high, at = F.col("lo"), F.col("hi"), F.col("at")
    g = g.select(tree_id, "tz", "n", F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("ground_z"))
    h = F.col("tz") - F.col("ground_z")
    return g.select(tree_id, "n", "ground_z", h.alias("height"), (h > above).alias("flagged"))


def repeatable(source: DataFrame, target: DataFrame, sid: str, tid: str, near: float = 0.3, reach: float = 40.0) -> DataFrame:
    """Source rows within ``reach`` of the target origin that have a target within ``near``.

    source(sid, sx, sy) in target coordinates, target(tid, tx, ty)."""
    inside = source.where(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) <= reach)
    hit = range_join(inside.select(sid, "sx", "sy"), target.select(tid, "tx", "ty"), ["sx", "sy"], ["tx", "ty"], near)
    return inside.join(hit.select(sid), sid, "left_semi")
