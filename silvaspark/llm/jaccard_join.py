"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word shingles and those MinHash signatures. A signature is a set of ``t``
tokens (position, minimum); two texts of similarity J share about J*t of them. From the root of
a run, every token of a text is a child with a probability that makes ``branch`` shared children
of a pair at the threshold expected; texts that chose the same child meet in its bucket. A
bucket of many texts is split again in the same way, down to ``max_depth``; small buckets are
compared by brute force on the signatures. Runs are repeated until the survival of a pair at the
threshold reaches the target recall.

Buckets yield spanning edges, not pairs. Texts of one component of these edges are then compared
by their exact shingle sets, so what the signatures let through or what a run missed inside a
component is put right, and links are counted there without listing pairs. Copies of a text are
one member with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm import groups
from silvaspark.llm import words as W
from silvaspark.llm.shingles import overlap_counts, shingle_set, signature
from silvaspark.operators.components import connected_components
from silvaspark.runtime import written

SIGNATURE = 96
#: Similarity estimated from signatures below which a pair in a bucket is passed over, under the threshold.
SLACK = 0.15
#: Texts in a bucket above which it is split, signatures compared at once in a task, and texts verified at once.
SPLIT, MEET, AT_ONCE = 300, 8192, 1024
#: Shingles that weigh as much as one text where components are cut into chunks, so that long texts fill no task.
HEAVY = 2000


def survival(branch: float, depth: int) -> float:
    """Probability that a pair at the threshold meets at ``depth`` of one run (Poisson children)."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-branch * p)
    return p


def runs_for(recall: float, branch: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(branch, depth)))


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def children(sig: np.ndarray, node: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the tokens that each row's node chooses; sig (n, t) uint32, node (n) uint64."""
    tokens = sig.astype(np.uint64) + (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32))
    h = W.mix(W.mix(tokens) ^ node[:, None])
    r, c = np.nonzero(h < _u64(int(chance * 2**64)))
    return r, W.mix(h[r, c] + np.uint64(1))


def summarize(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, th, set_id, n, sig) of every row: hash of the text, hash of the shingle set and its
    signature; set_id is null without shingles. Written once."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))

    def run(batches):
        W.claim("jaccard_join")
        for b in batches:
            ids, sigs, ns = [], [], []
            for x in b.column(2):
                s = shingle_set(x.as_py(), size)
                ns.append(len(s))
                if len(s):
                    ids.append(int(np.int64(W.xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))))
                    sigs.append(signature(s, SIGNATURE).astype(np.uint32).tobytes())
                else:
                    ids.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "th", "set_id", "n", "sig"])

    return written(rows.mapInArrow(run, "doc_id long, th long, set_id long, n long, sig binary"), "jaccard-rows")


def _sigs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _descend(batches, chance: float, runs: int):
    """(node, member, sig) rows to the children that each row chooses; run seeds at the root."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = _sigs(b.column(2))
        node = np.array(b.column(0), np.int64).view(np.uint64)
        member = np.array(b.column(1), np.int64)
        for k in range(runs):
            with np.errstate(over="ignore"):
                at = W.mix(node + _u64(0x51ED27 * (k + 1)))
            r, c = children(sig, at, chance)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(member[r])], names=["node", "member"])


def candidate_edges(members: DataFrame, threshold: float, recall: float, branch: float, max_depth: int) -> DataFrame:
    """Spanning edges (u, v) within buckets between members whose signatures agree enough.

    members(member, sig) with distinct members."""
    chance = branch / (threshold * SIGNATURE)
    n_runs = runs_for(recall, branch, max_depth)
    need = math.floor((threshold - SLACK) * SIGNATURE)
    at = members.select(F.lit(0).cast("long").alias("node"), "member", "sig")
    edges = None
    for depth in range(1, max_depth + 1):
        n = n_runs if depth == 1 else 1
        keys = written(at.mapInArrow(lambda x, n=n: _descend(x, chance, n), "node long, member long"), "jaccard-paths")
        sizes = keys.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor("member").alias("x"), F.sum(F.col("member").cast("decimal(38,0)")).alias("s")).where("size > 1")
        # buckets of the same members say the same
        sizes = written(sizes.groupBy("size", "x", "s").agg(F.min("node").alias("node"), F.count("*").alias("same")).select("node", "size", "same"), "jaccard-buckets")
        last = depth == max_depth
        # of buckets that were merged, one descent would stand for all: they are compared at once
        small = (sizes if last else sizes.where((F.col("size") <= SPLIT) | (F.col("same") > 1))).drop("same")
        met = keys.join(small, "node").join(members, "member").select("node", "size", "member", "sig")
        found = groups.collected(groups.dealt(met, "node", "size", "member", MEET), ["node", "i", "j"]).mapInArrow(lambda x: _compare(x, need), "u long, v long")
        edges = found if edges is None else edges.unionAll(found)
        if last:
            break
        large = sizes.where((F.col("size") > SPLIT) & (F.col("same") == 1))
        if large.isEmpty():
            break
        at = keys.join(large.select("node"), "node", "left_semi").join(members, "member").select("node", "member", "sig")
    return edges


def _compare(batches, need: int):
    """Edges that connect all pairs of a bucket whose signatures agree enough; rows that are connected already
    are not compared again."""
    for (_, i, j), rows in groups.runs(batches, 3):
        members = [r[1] for r in rows]
        sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(-1, SIGNATURE)
        side = np.array([r[0] for r in rows])
        part = np.arange(len(rows))
        out = []
        for k in range(len(rows) - 1):
            other = part[k + 1 :] != part[k]
            if i != j:
                other &= side[k + 1 :] != side[k]
            later = np.flatnonzero(other) + k + 1
            near = later[(sig[later] == sig[k]).sum(axis=1) >= need]
            if len(near):
                joined, first = np.unique(part[near], return_index=True)
                out += [(members[k], members[x]) for x in near[first].tolist()]
                part[np.isin(part, joined)] = part[k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])


def _verify(batches, size: int, threshold: float):
    """Links by exact sets in each task: (member, links, to) with links weighted by copies."""
    for (_, i, j), rows in groups.runs(batches, 3):
        a = [r for r in rows if r[0] == 0]
        b = a if i == j else [r for r in rows if r[0] == 1]
        if not a or not b or (i == j and len(a) < 2):
            continue
        sa = [shingle_set(r[3], size) for r in a]
        sb = sa if i == j else [shingle_set(r[3], size) for r in b]
        both = overlap_counts(sa, sb)
        union = np.array([len(s) for s in sa])[:, None] + np.array([len(s) for s in sb]) - both
        link = both >= threshold * union - 1e-9
        if i == j:
            np.fill_diagonal(link, False)
        wa, wb = np.array([r[2] for r in a]), np.array([r[2] for r in b])
        ids = [r[1] for r in a] + ([] if i == j else [r[1] for r in b])
        links = np.zeros(len(ids), np.int64)
        links[: len(a)] += link @ wb
        if i != j:
            links[len(a) :] += link.T @ wa
        x, y = np.nonzero(link)
        edges = groups.spanning(len(ids), x, y if i == j else y + len(a))
        out = [(ids[k], int(n), None) for k, n in enumerate(links) if n] + [(ids[p], 0, ids[q]) for p, q in edges]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["member", "links", "to"])


def similar_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.9995, branch: float = 1.5, max_depth: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, class_id, n_links, keep, repeated) of every row.

    ``class_id`` is the smallest doc_id of the rows that are linked to the row, directly or
    through others; ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of ``threshold`` or more, copies included; ``keep`` marks the rows with the
    smallest id (then text hash) of their class, which are several (``repeated``) only if rows
    are repeated whole. Texts of fewer than ``size`` words are one shingle. Null texts and texts
    without words are linked to nothing and their class is their own id. A null id is never a
    class id unless no row of the class has another.
    """
    rows = summarize(docs, doc_id, text, size)
    with_set = rows.where("set_id is not null")
    sets = written(
        with_set.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig")),
        "jaccard-sets",
    )
    edges = candidate_edges(sets.select(F.col("set_id").alias("member"), "sig"), threshold, recall, branch, max_depth)
    parts = written(connected_components(edges), "jaccard-parts")
    told = parts.join(sets.drop("sig"), F.col("node") == F.col("set_id"))
    sizes = told.groupBy("component").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / HEAVY)).alias("size"))
    members = told.join(sizes, "component").select(
        "component", "size", F.col("set_id").alias("member"), "copies", F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th")
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("__d"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).cast("string").alias("text"))
    with_text = texts.join(members, (F.col("__th") == F.col("__h")) & groups.null_safe("__id", "__d")).select("component", "size", "member", "copies", "text")
    # rows that are repeated whole reach here more than once
    twice = rows.groupBy("doc_id", "th").count().where("count > 1")
    if not twice.isEmpty():
        with_text = with_text.dropDuplicates(["component", "member"])
    tasks = groups.collected(groups.dealt(with_text, "component", "size", "member", AT_ONCE), ["component", "i", "j"])
    verified = written(tasks.mapInArrow(lambda x: _verify(x, size, threshold), "member long, links long, to long"), "jaccard-links")
    final = connected_components(verified.where("to is not null").select(F.col("member").alias("u"), F.col("to").alias("v")))
    links = verified.where("to is null").groupBy("member").agg(F.sum("links").alias("links"))
    classes = (
        sets.select("set_id", "first", "copies")
        .join(final.withColumnRenamed("node", "set_id"), "set_id", "left")
        .join(links.withColumnRenamed("member", "set_id"), "set_id", "left")
        .select("set_id", "first", "copies", F.coalesce("component", "set_id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    heads = classes.groupBy("component").agg(F.min("first").alias("head"))
    said = classes.join(heads, "component").select("set_id", "head", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "th", "set_id").join(said, "set_id", "left")
    mark = F.col("set_id").isNull() | ((F.col("head.th") == F.col("th")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")))
    marked = out.select(
        "doc_id", "th",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        mark.alias("keep"),
        F.col("set_id").isNotNull().alias("__set"),
    )
    again = twice.select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.lit(True).alias("__twice"))
    marked = marked.join(again, (F.col("th") == F.col("__h")) & groups.null_safe("doc_id", "__d"), "left")
    return marked.select("doc_id", "th", "class_id", "n_links", "keep", (F.coalesce("__twice", F.lit(False)) & F.col("__set")).alias("repeated"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that ``similar_classes`` keeps: one row of each class."""
    d, h, r = groups.free_names(docs, "d", "h", "r")
    said = similar_classes(docs, doc_id=doc_id, text=text, **how).where("keep").select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("repeated").alias(r)).distinct()
    kept = docs.join(said, (F.xxhash64(F.col(text)) == F.col(h)) & F.col(doc_id).cast("long").eqNullSafe(F.col(d)))
    once = kept.where(~F.col(r)).drop(d, h, r)
    several = kept.where(r).dropDuplicates([d, h]).drop(d, h, r)
    return once.unionAll(several)
