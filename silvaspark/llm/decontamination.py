"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a run of words; the hash of a seed at a place covers the words under the
mask and ignores those between. Training text and benchmark items that share a seed hash are
compared word by word around the hit; a document is contaminated by an item if some
``WINDOW`` aligned words differ in at most ``MISSES`` places. For any such window some mask at
some shift avoids the places that differ (tested over all patterns), so the hashing loses none.
Items of fewer than ``WINDOW`` words are found where they occur whole; those of fewer than
``len(SHORT_MASK)`` words are not looked for, since such phrases say nothing of where a text is from.

The hashes of test and training text meet in a join. Of the training side only hashes come to it that pass a Bloom
filter of the test side's, whose size is bounded; each brings the words around it, so texts are
read once and are not shuffled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm import groups
from silvaspark.llm import words as W
from silvaspark.runtime import written

WINDOW, MISSES = 13, 2
#: Two spaced seeds for windows with substitutions, and one without gaps for short items.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORT_MASK = (0, 1, 2, 3, 4)
#: Words before the start of a seed that a window around it can have, and words that go with each hit.
BEFORE = WINDOW - 1 - MASKS[0][-1]
AROUND = BEFORE + WINDOW
#: Bits of the filter: for each seed of the benchmark, and at least and at most.
SEED_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27
#: Rows of hits up to which they are sent to all tasks; more meet the documents in a shuffle.
SENT_HITS = 500_000
_edge = re.compile(r"^[\W_]+|[\W_]+$")


class NormalHashes(W.WordHashes):
    """Hash of a word in lower case without punctuation at its ends; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        w = _edge.sub("", word.decode("utf-8", "replace").lower())
        h = self[word] = (xxhash.xxh3_64_intdigest(w) | 1) if w else 0
        return h


_normal = NormalHashes()


def normal_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): words that keep a letter or digit, and their places among all words."""
    ws = W.split(text)
    h = np.fromiter(map(_normal.__getitem__, ws), np.uint64, len(ws))
    at = np.flatnonzero(h)
    return h[at], at


def seeds(w: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(w) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt + 1))
    for k in mask:
        out *= np.uint64(W.BASE)
        out += w[k : k + n]
    return W.mix(out)


def around(w: np.ndarray, at: np.ndarray, other: int) -> np.ndarray:
    """(hit, word) the words around seeds that start at ``at``; ``other`` where there is none."""
    wide = np.concatenate((np.full(BEFORE, other), w, np.full(AROUND, other))).astype(w.dtype)
    return wide[at[:, None] + np.arange(AROUND)]


SEEDS = "mask int, hash long, item_id long, item long, place int, size int, words binary"


def item_seeds(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each seed of each item, with the words around it. Items with a null id or text are left out. Written."""
    items = written(
        benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").withColumn("row", F.monotonically_increasing_id()), "benchmark-items"
    )

    def cut(batches):
        for b in batches:
            for i, t, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, _ = normal_words(t)
                for m, mask in enumerate((*MASKS, SHORT_MASK)):
                    if len(w) < len(SHORT_MASK) or (len(w) < WINDOW) != (mask is SHORT_MASK):
                        continue
                    s = seeds(w, mask, m)
                    if mask is SHORT_MASK:
                        s = s[:1]
                    n = len(s)
                    near = around(w, np.arange(n), 2)
                    cols = [np.full(n, m, np.int32), s.view(np.int64), np.full(n, i), np.full(n, row), np.arange(n, dtype=np.int32), np.full(n, len(w), np.int32), [x.tobytes() for x in near]]
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SEEDS.split(", ")])

    return written(items.mapInArrow(cut, SEEDS), "benchmark-seeds")


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of a hash in a filter of ``bits`` bits."""
    return [(h >> np.uint64(k)) & np.uint64(bits - 1) for k in (0, 36)]


def filter_of(found: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds' hashes as bytes. Tasks make filters of their own rows; the driver holds two at a time."""
    n = found.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SEED_BITS * n):
        bits *= 2

    def fill(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _bits(np.array(b.column(0), np.int64).view(np.uint64), bits):
                np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(mine.tobytes(), 1)], pa.binary())], names=["part"])

    out = np.zeros(bits // 8, np.uint8)
    for r in found.select("hash").coalesce(8).mapInArrow(fill, "part binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    return out


HITS = "mask int, hash long, doc_id long, th long, at int, near binary, places binary"


def _passing(batches, bloom: np.ndarray, masks: list[int]):
    """Seeds of texts that pass the filter, with the words around them and their places among all words."""
    W.claim("decontamination", _normal.clear)
    bits = 8 * len(bloom)
    all_masks = (*MASKS, SHORT_MASK)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            part = b.slice(k, 1000)
            docs = [normal_words(t.as_py()) for t in part.column(2)]
            size = np.array([len(h) for h, _ in docs])
            flat = np.concatenate([h for h, _ in docs])
            first = np.cumsum(size) - size
            rows = []
            for m in masks:
                s = seeds(flat, all_masks[m], m)
                maybe = np.arange(len(s))
                for at in _bits(s, bits):
                    at = at[maybe]
                    maybe = maybe[(bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
                of = np.searchsorted(first, maybe, "right") - 1
                inside = maybe - first[of] + all_masks[m][-1] < size[of]
                for d in np.unique(of[inside]).tolist():
                    at = maybe[inside & (of == d)] - first[d]
                    w, place = docs[d]
                    i, h = part.column(0)[d].as_py(), part.column(1)[d].as_py()
                    near = around(w, at, 0)
                    where = around(place.astype(np.int32), at, -1)
                    rows += [(m, x, i, h, q, n.tobytes(), p.tobytes()) for x, q, n, p in zip(s[maybe[inside & (of == d)]].view(np.int64).tolist(), at.tolist(), near, where, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])


def _verified(batches):
    """(doc_id, th, item_id, item, diagonal, start, end) of the hits around which words agree, from the first to the
    last word that does. Words that a text or item does not have count as different."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for b in batches:
        if not b.num_rows:
            continue
        doc_id, th, at, near, places, item_id, item, place, size, words = (b.column(c) for c in ("doc_id", "th", "at", "near", "places", "item_id", "item", "place", "size", "words"))
        same = np.frombuffer(b"".join(near.to_pylist()), np.uint64).reshape(-1, AROUND) == np.frombuffer(b"".join(words.to_pylist()), np.uint64).reshape(-1, AROUND)
        where = np.frombuffer(b"".join(places.to_pylist()), np.int32).reshape(-1, AROUND)
        n = np.array(size)
        run = np.cumsum(np.concatenate((np.zeros((len(same), 1), np.int64), same), axis=1), axis=1)
        good = run[:, WINDOW:] - run[:, :-WINDOW] >= WINDOW - MISSES
        good[n < WINDOW] = False
        start, end = good.argmax(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + WINDOW
        short = np.flatnonzero(n < WINDOW)
        start[short], end[short] = BEFORE, BEFORE + n[short]
        ok = good.any(axis=1)
        ok[short] = run[short, BEFORE + n[short]] - run[short, BEFORE] == n[short]
        k = np.flatnonzero(ok)
        if len(k):
            diagonal = np.array(at)[k] - np.array(place)[k]
            cols = [doc_id.take(pa.array(k)), th.take(pa.array(k)), item_id.take(pa.array(k)), item.take(pa.array(k)), pa.array(diagonal, pa.int32())]
            at_ = np.arange(AROUND)
            agree = same[k] & (at_ >= start[k, None]) & (at_ < end[k, None])
            first, last = where[k, agree.argmax(axis=1)], where[k, AROUND - 1 - agree[:, ::-1].argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first, pa.int64()), pa.array(last + 1, pa.int64())], names=["doc_id", "th", "item_id", "item", "diagonal", "start", "end"])


_HIT = "array<struct<item_id:long,start:long,end:long>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, hits) of the rows that overlap with items: id, hash of the text, overlaps. Written."""
    found = item_seeds(benchmark)
    masks = sorted(r["mask"] for r in found.select("mask").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(found))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    passing = rows.mapInArrow(lambda x: _passing(x, sent.value, masks), HITS)
    met = passing.join(found, ["mask", "hash"])
    real = met.mapInArrow(_verified, "doc_id long, th long, item_id long, item long, diagonal int, start long, end long")
    each = real.groupBy("doc_id", "th", "item_id", "item", "diagonal").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    hits = F.sort_array(F.collect_list(F.struct("item_id", "start", "end"))).cast(_HIT)
    return written(each.groupBy("doc_id", "th").agg(hits.alias("hits")), "benchmark-hits")


def _with_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, how: str, column: str | None = None) -> DataFrame:
    d, h, key = groups.free_names(docs, "d", "h", "key")
    found = overlaps(docs, benchmark, doc_id, text)
    found = found.select(F.col("doc_id").alias(d), F.col("th").alias(h), *([F.col("hits").alias(column)] if column else []))
    if found.count() <= SENT_HITS:
        found = F.broadcast(found)
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    return keyed.join(found, (F.col(key) == F.col(h)) & F.col(doc_id).cast("long").eqNullSafe(F.col(d)), how).drop(d, h, key)


def contaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "hits", doc_id: str = "doc_id") -> DataFrame:
    """Add the array of overlaps with benchmark items to every row (empty if there are none).

    ``start`` and ``end`` count words of the text. Null and empty texts have none; repeated rows
    and items each count; an empty benchmark finds nothing. All columns of ``docs`` stay, but for one named
    ``column``, which is replaced.
    """
    out = _with_hits(docs.drop(column), benchmark, doc_id, text, "left", column)
    return out.withColumn(column, F.coalesce(F.col(column), F.array().cast(_HIT)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows, all columns, that overlap with no benchmark item."""
    return _with_hits(docs, benchmark, doc_id, text, "left_anti")
