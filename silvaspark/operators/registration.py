"""Rigid registration: Kabsch, its RANSAC form, errors, and optimal assignment."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.functions.retention import mix
from silvaspark.operators.components import FEW_EDGES, connected_components
from silvaspark.operators.spatial import range_join
from silvaspark.runtime import written

R_COLS = [f"r{i}{j}" for i in range(3) for j in range(3)]
T_COLS = [f"t{i}" for i in range(3)]
TRANSFORM = ", ".join(f"{c} double" for c in R_COLS + T_COLS)


def apply_rigid(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", out: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """R p + t of columns; the transform's 12 columns stand in the row."""
    p = [F.col(c) for c in (x, y, z)]
    return df.withColumns({o: F.col(f"r{i}0") * p[0] + F.col(f"r{i}1") * p[1] + F.col(f"r{i}2") * p[2] + F.col(f"t{i}") for i, o in enumerate(out)})


def kabsch(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Least-squares rotation and translation of at least three pairs, none for collinear ones."""
    if len(src) < 3:
        return None
    a, b = src.mean(axis=0), dst.mean(axis=0)
    return from_moments((src - a).T @ (dst - b), a, b)


def from_moments(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    u, s, vt = np.linalg.svd(h)
    if s[1] < 1e-9 * max(1.0, s[0]):
        return None
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ d @ u.T
    return r, b - r @ a


def kabsch_ransac(src: np.ndarray, dst: np.ndarray, iterations: int = 1000, inlier: float = 0.3, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(R, t, inliers). Triples come from a splitmix64 stream; one that repeats an index or is collinear counts as
    an iteration. The first model with most inliers is refitted to them, if they are three at least; the inliers
    returned are those of the refitted transform.

    All triples are drawn and all models solved and compared as arrays."""
    n = len(src)
    if n < 3:
        return None
    s, stream = np.full(1, seed, np.uint64), np.empty(3 * iterations, np.uint64)
    for k in range(len(stream)):
        s = mix(s)
        stream[k] = s[0]
    pick = (stream % np.uint64(n)).astype(np.int64).reshape(-1, 3)
    pick = pick[(pick[:, 0] != pick[:, 1]) & (pick[:, 1] != pick[:, 2]) & (pick[:, 0] != pick[:, 2])]
    inliers = lambda r, t: np.linalg.norm(np.einsum("kij,nj->kni", r, src) + t[:, None] - dst, axis=2) < inlier
    best, most = None, 2
    block = max(1, 2_000_000 // n)
    for at in range(0, len(pick), block):
        a, b = src[pick[at : at + block]], dst[pick[at : at + block]]
        ca, cb = a.mean(axis=1), b.mean(axis=1)
        u, w, vt = np.linalg.svd(np.einsum("kni,knj->kij", a - ca[:, None], b - cb[:, None]))
        solid = w[:, 1] >= 1e-9 * np.maximum(1.0, w[:, 0])
        v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
        d = np.repeat(np.eye(3)[None], len(v), axis=0)
        d[:, 2, 2] = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
        r = v @ d @ ut
        ok = inliers(r, cb - np.einsum("kij,kj->ki", r, ca)) & solid[:, None]
        count = ok.sum(axis=1)
        if len(count) and count.max() > most:
            most = int(count.max())
            best = ok[count.argmax()]
    m = None if best is None else kabsch(src[best], dst[best])
    return None if m is None else (*m, inliers(m[0][None], m[1][None])[0])


def moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Centroids and the 3x3 cross-covariance of matched pairs (sx, sy, sz) -> (tx, ty, tz)."""
    s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in s + t], *[F.sum(F.col(a) * F.col(b)).alias(f"p{a}{b}") for a in s for b in t])
    h = [(F.col(f"p{a}{b}") - F.col("n") * F.col(f"m{a}") * F.col(f"m{b}")).alias(f"h{i}{j}") for i, a in enumerate(s) for j, b in enumerate(t)]
    return g.select(*keys, "n", *[f"m{c}" for c in s + t], *h)


def estimate(pairs: DataFrame, keys: list[str], ransac: bool = False, iterations: int = 1000, inlier: float = 0.3, seed: int = 1) -> DataFrame:
    """(keys, r00..t2, n_pairs, n_inliers) of every job with a transform; others have no row.

    Without RANSAC only the moments of each job leave the JVM."""
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *R_COLS, *T_COLS, "n_pairs", "n_inliers"]
    schema = f"{kinds}, {TRANSFORM}, n_pairs long, n_inliers long"
    if not ransac:
        def solve(batches):
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    h = np.array([[getattr(r, f"h{i}{j}") for j in range(3)] for i in range(3)])
                    m = from_moments(h, np.array([r.msx, r.msy, r.msz]), np.array([r.mtx, r.mty, r.mtz])) if r.n >= 3 else None
                    if m is not None:
                        rows.append((*[getattr(r, k) for k in keys], *m[0].ravel(), *m[1], r.n, r.n))
                yield pd.DataFrame(rows, columns=names)

        return moments(pairs, keys).mapInPandas(solve, schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sx", "sy", "sz", "tx", "ty", "tz"])
        m = kabsch_ransac(pdf[["sx", "sy", "sz"]].to_numpy(), pdf[["tx", "ty", "tz"]].to_numpy(), iterations, inlier, seed)
        rows = [] if m is None else [(*[pdf[k].iloc[0] for k in keys], *m[0].ravel(), *m[1], len(pdf), int(m[2].sum()))]
        return pd.DataFrame(rows, columns=names)

    return pairs.groupBy(*keys).applyInPandas(fit, schema)


def rotation_error(a: str = "", b: str = "g") -> Column:
    """Angle in degrees between two rotations given by columns with prefixes."""
    trace = None
    for c in R_COLS:
        t = F.col(f"{a}{c}") * F.col(f"{b}{c}")
        trace = t if trace is None else trace + t
    return F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def translation_error(a: str = "", b: str = "g") -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in T_COLS]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def station_separation(prefix: str = "") -> Column:
    """Horizontal distance between two stations by the transform between them."""
    return F.hypot(F.col(f"{prefix}t0"), F.col(f"{prefix}t1"))


def yaw_tilt(a: str = "", b: str = "g") -> tuple[Column, Column]:
    """Yaw and tilt in degrees of the rotation from b to a."""
    def at(i: int, j: int) -> Column:
        x = [F.col(f"{b}r{k}{i}") * F.col(f"{a}r{k}{j}") for k in range(3)]
        return x[0] + x[1] + x[2]

    return F.degrees(F.atan2(at(1, 0), at(0, 0))), F.degrees(F.acos(F.least(F.greatest(at(2, 2), F.lit(-1.0)), F.lit(1.0))))


#: Points and transforms that meet at once: what a task holds, beside a distance for each pair of them.
POINTS, TRANSFORMS = 2000, 250


def point_errors(points: DataFrame, transforms: DataFrame, job: list[str], cloud: list[str] | None = None) -> DataFrame:
    """(job, e_p, n): mean distance of the source points under the estimated (r.., t..) and true (gr.., gt..)
    transform. All jobs of a cloud are served by one scan; the transforms are one row per job.

    Where all jobs share one cloud, blocks of points meet blocks of transforms: distances stay in numpy, and a block
    gives one sum for each job."""
    many = transforms.limit(100_001).count()
    if many > 100_000 and not cloud:
        raise ValueError("more than 100,000 jobs need the cloud of each one as a key")
    p = [F.col(c).cast("double") for c in "xyz"]
    # by rows of the difference between the two transforms: its shift, then its three factors
    moved = [[F.col(f"t{i}") - F.col(f"gt{i}"), *[F.col(f"r{i}{k}") - F.col(f"gr{i}{k}") for k in range(3)]] for i in range(3)]
    if cloud:
        j = points.join(F.broadcast(transforms) if many <= 100_000 else transforms, cloud)
        d = [e[0] + e[1] * p[0] + e[2] * p[1] + e[3] * p[2] for e in moved]
        return j.groupBy(*job).agg(F.avg(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("e_p"), F.count("*").alias("n"))

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, POINTS):
                part = batch.slice(at, POINTS)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=list("xyz"))

    def summed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.stack([batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in "xyz"])
                jobs = batch.column("jobs")[k].values
                e = np.stack([jobs.field(f"e{c}").to_numpy(zero_copy_only=False) for c in range(12)], axis=1).reshape(-1, 3, 4)
                known = batch.column("known")[k].values.to_numpy(zero_copy_only=False)
                total = 0.0
                for c in range(3):
                    total = total + (e[:, c, 1:] @ x[:, known] + e[:, c, :1]) ** 2
                n = len(e)
                more = [pa.array(np.sqrt(total).sum(axis=1)), pa.array(np.full(n, int(known.sum()))), pa.array(np.full(n, len(known)))]
                yield pa.RecordBatch.from_arrays([*[jobs.field(c) for c in job], *more], names=[*job, "__sum", "__known", "__n"])

    kinds = ", ".join(f"`{k}` {transforms.schema[k].dataType.simpleString()}" for k in job)
    at = points.select(*[c.alias(n) for c, n in zip(p, "xyz", strict=True)]).mapInArrow(blocks, "x array<double>, y array<double>, z array<double>")
    # points without a coordinate are counted and have no distance
    at = at.withColumn("known", F.transform(F.arrays_zip(*"xyz"), lambda v: v["x"].isNotNull() & v["y"].isNotNull() & v["z"].isNotNull()))
    flat = transforms.select(*job, *[c.alias(f"e{i * 4 + k}") for i, e in enumerate(moved) for k, c in enumerate(e)])
    flat = flat.groupBy(F.pmod(F.xxhash64(*flat.columns), F.lit(many // TRANSFORMS + 1)).alias("__b")).agg(F.collect_list(F.struct(*flat.columns)).alias("jobs"))
    got = at.crossJoin(F.broadcast(flat.drop("__b"))).mapInArrow(summed, f"{kinds}, __sum double, __known long, __n long")
    e_p = F.when(F.sum("__known") > 0, F.sum("__sum") / F.sum("__known"))
    return got.groupBy(*job).agg(e_p.alias("e_p"), F.sum("__n").alias("n"))


def evaluate(jobs: DataFrame, max_rot: float = 2.0, max_trans: float = 0.5) -> DataFrame:
    """Add rot_err, trans_err and success (both strictly below their limits)."""
    out = jobs.withColumns({"rot_err": rotation_error(), "trans_err": translation_error()})
    return out.withColumn("success", (F.col("rot_err") < max_rot) & (F.col("trans_err") < max_trans))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost; rows <= columns.

    Shortest augmenting paths with dual prices, one row at a time."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        reach = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, bool)
        row, last = i, -1
        base = 0.0
        path_rows = [(i, 0.0)]
        while True:
            slack = base + cost[row] - price_row[row] - price_col
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            via[better] = last
            j = int(np.where(done, np.inf, reach).argmin())
            base = reach[j]
            done[j] = True
            last = j
            if owner[j] < 0:
                break
            row = int(owner[j])
            path_rows.append((row, base))
        for r, at in path_rows:
            price_row[r] += base - at
        used = done.copy()
        price_col[used] -= base - reach[used]
        j = last
        while j >= 0:
            k = via[j]
            owner[j] = i if k < 0 else owner[k]
            j = int(k)
    out = np.full(n, -1)
    for j, r in enumerate(owner):
        if r >= 0:
            out[r] = j
    return out


def match_positions(det: np.ndarray, ref: np.ndarray, radius: float) -> list[tuple[int, int, float]]:
    """(det, ref, distance) of a matching within ``radius`` of most pairs, then least total distance."""
    if not len(det) or not len(ref):
        return []
    d = np.hypot(det[:, None, 0] - ref[None, :, 0], det[:, None, 1] - ref[None, :, 1])
    flip = len(det) > len(ref)
    c = d.T if flip else d
    penalty = (c.shape[0] + 1) * radius + 1
    got = hungarian(np.where(c <= radius, c, penalty))
    pairs = [(int(j), i) if flip else (i, int(j)) for i, j in enumerate(got) if c[i, j] <= radius]
    return sorted((a, b, float(d[a, b])) for a, b in pairs)


def sparse_assignment(edges: list[list[tuple[int, float]]], unmatched: float) -> list[int]:
    """The column of every row, -1 for none, of least total cost; ``edges[row]`` lists (column, cost), and a row without a
    column costs ``unmatched``.

    Shortest augmenting paths over the given edges: each row searches from itself with a heap until it comes to a free column,
    or to a row that had better go without. Memory grows with the edges, and a search goes only as far as costs make it."""
    row_price, col_price = [0.0] * len(edges), {}
    owner: dict[int, int] = {}
    match = [-1] * len(edges)
    for i in range(len(edges)):
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        rows, settled = {i: 0.0}, set()
        heap: list[tuple[float, int, int]] = []
        row, base = i, 0.0
        while True:
            left = base - row_price[row]
            heapq.heappush(heap, (left + unmatched, -1, row))
            for j, cost in edges[row]:
                d = left + cost - col_price.get(j, 0.0)
                if j not in settled and d < dist.get(j, math.inf):
                    dist[j], via[j] = d, row
                    heapq.heappush(heap, (d, j, row))
            while True:
                base, j, row = heapq.heappop(heap)
                if j < 0 or (j not in settled and base == dist[j]):
                    break
            if j < 0 or j not in owner:
                break
            settled.add(j)
            row = owner[j]
            rows[row] = base
        for r, at in rows.items():
            row_price[r] += base - at
        for k in settled:
            col_price[k] = col_price.get(k, 0.0) - (base - dist[k])
        # along the path every row takes the column that it was reached by
        while True:
            row = row if j < 0 else via[j]
            held, match[row] = match[row], j
            if j >= 0:
                owner[j] = row
            if row == i:
                break
            j = held
    return match


def assign_positions(det: DataFrame, ref: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys, det_id, ref_id, d): per key the assignment of most pairs within ``radius``, and of least total distance among those.

    det(keys, det_id, dx, dy), ref(keys, ref_id, rx, ry). The grid join leaves only pairs within the
    radius; their connected parts are independent, so each part, a few stems, is solved by itself, on its pairs alone.
    """
    edges = written(range_join(det, ref, ["dx", "dy"], ["rx", "ry"], radius, keys).select(*keys, "det_id", "ref_id", "d2"), "near")
    ends = edges.withColumns({"__u": F.xxhash64(F.lit("det"), *keys, "det_id"), "__v": F.xxhash64(F.lit("ref"), *keys, "ref_id")})
    part = connected_components(ends, "__u", "__v", few=FEW_EDGES).select(F.col("node").alias("__u"), F.col("component").alias("__part"))
    edges = ends.join(part, "__u").drop("__u", "__v")
    kinds = ", ".join(f"`{k}` {det.schema[k].dataType.simpleString()}" for k in keys)

    names = [*keys, "det_id", "ref_id", "d"]

    def matched(rows: list[tuple]) -> list[tuple]:
        """Rows (part, keys, det_id, ref_id, d2) of one part, by det_id and ref_id."""
        if len(rows) == 1:
            return [(*rows[0][1:-1], math.sqrt(rows[0][-1]))]
        ids = list(dict.fromkeys(r[-3] for r in rows))
        refs = sorted({r[-2] for r in rows})
        row, col = ({x: k for k, x in enumerate(of)} for of in (ids, refs))
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        for r in rows:
            near[row[r[-3]]].append((col[r[-2]], math.sqrt(r[-1])))
        # to go without a partner costs more than all distances of the part together
        got = sparse_assignment(near, (len(ids) + 1) * radius + 1)
        return [(*rows[0][1:-3], ids[r], refs[j], dict(near[r])[j]) for r, j in enumerate(got) if j >= 0]

    def solve(batches):
        held: list[tuple] = []
        types: list[pa.DataType] = []
        for batch in batches:
            out, types = [], [*batch.schema.types[1:-1], pa.float64()]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    out += matched(held)
                    held = []
                held.append(r)
            yield from told(out, types)
        if held:
            yield from told(matched(held), types)

    def told(rows: list[tuple], types: list[pa.DataType]):
        # the types that keys came with: what Python's values would be taken for is not what the schema says (int, date, null)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # parts are rows next to each other: there are about as many as stems, too many for a call each
    n = int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select("__part", *keys, F.col("det_id").cast("long"), F.col("ref_id").cast("long"), "d2")
    rows = rows.repartition(n, "__part").sortWithinPartitions("__part", "det_id", "ref_id")
    return rows.mapInArrow(solve, f"{kinds}, det_id long, ref_id long, d double")


def assignment_scores(det: DataFrame, ref: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_det, n_ref, n_match, recall, precision, mean_error, rmse); errors are null without a match."""
    a = det.groupBy(*keys).agg(F.count("*").alias("n_det"))
    b = ref.groupBy(*keys).agg(F.count("*").alias("n_ref"))
    m = matched.groupBy(*keys).agg(F.count("*").alias("n_match"), F.avg("d").alias("mean_error"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    j = a.join(b, keys, "full").join(m, keys, "left").na.fill(0, ["n_det", "n_ref", "n_match"])
    rate = lambda n: F.when(F.col(n) > 0, F.col("n_match") / F.col(n)).otherwise(0.0)
    return j.select(*keys, "n_det", "n_ref", "n_match", rate("n_ref").alias("recall"), rate("n_det").alias("precision"), "mean_error", "rmse")
