"""Removal of repeated token windows.

Every window of ``size`` consecutive words is hashed by Rabin-Karp. A window is repeated in a
document if its hash also occurs in a document with a smaller id; overlapping repeated windows
merge into maximal removal intervals.

What is shuffled is packed: map tasks gather the windows of many documents, keep the smallest
document of each hash, and send one binary row per hash range. A window that a third of all
documents share thus costs one entry per map batch. Later documents of the batch are decided on
the spot. Reducers see one hash range at a time and answer with (document, hash) pairs of
repeated windows, which meet the texts by document. The numbers of hash ranges and of document
parts follow the size of the input, so what a task holds at once does not.

The range comes from a second hash of the window, of other hashes of its words. Windows count as equal if
both agree, 64 bits and those of the range, whose number grows with the windows: among n windows about n * 3e-14
pairs of different ones are taken for equal, one in 10**13 windows expected 0.3.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.llm import words as W

#: Windows that a map task gathers before it sends them.
FLUSH = 1_500_000
#: Windows in one hash range and text bytes in one document part, about.
RANGE_WINDOWS, PART_BYTES = 1 << 20, 6 << 20
#: Text bytes for each task of a shuffle, about.
TASK_BYTES = 24 << 20
ROUTED = "range long, part int, kind int, payload binary"
_ROUTED = pa.schema([("range", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of an int64 array by significance, compressed: sorted differences become small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _expand(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=8 * n + 8), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


def pack(ids: np.ndarray, h: np.ndarray) -> bytes:
    """(id, hash) pairs sorted by id: count, length of the ids' part, ids as differences, hashes."""
    order = np.argsort(ids, kind="stable")
    ids, h = ids[order], h[order]
    d = _squeeze(np.diff(ids, prepend=0))
    return np.array([len(ids), len(d)], "<i8").tobytes() + d + h.astype("<u8").tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(b, "<i8", 2))
    return np.cumsum(_expand(b[16 : 16 + m], n)), np.frombuffer(b, "<u8", n, 16 + m)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def repeats(ids: np.ndarray, h: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first ids, their hashes, later ids, their hashes, ranges of the first): each hash once with its smallest
    id, and every other id that has it once."""
    order = np.lexsort((ids, h))
    ids, h = ids[order], h[order]
    of = ids if of is None else of[order]
    if not len(h):
        return ids, h, ids, h, of
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= ids[1:] != ids[:-1]
    later = new & ~new_h
    return ids[new_h], h[new_h], ids[later], h[later], of[new_h]


def range_of(w: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash range of each window."""
    return W.windows(W.mix(w + np.uint64(1)), size) >> np.uint64(64 - bits)


def _pieces(keys: np.ndarray):
    """(key, slice) of each run of equal keys in a sorted array."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


def _answers(ids: np.ndarray, h: np.ndarray, parts: int):
    p = part_of(ids, parts)
    order = np.argsort(p, kind="stable")
    ids, h = ids[order], h[order]
    for k, s in _pieces(p[order]):
        yield k, pack(ids[s], h[s])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROUTED.types, strict=True)], schema=_ROUTED)


def covered(w: np.ndarray, size: int, bad: np.ndarray) -> np.ndarray:
    """Which words stand in a window whose hash is in ``bad``."""
    hit = np.isin(W.windows(w, size), bad)
    step = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def intervals(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def remove_repeats(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) of every row.

    Windows are judged on the input. Null and empty texts have no words and give an empty
    ``kept_text``, as do texts that are removed whole. Texts shorter than a window lose nothing.
    Rows of equal id do not remove each other's windows. A row with a null id loses nothing and
    removes nothing. Further columns are ignored; an empty table gives an empty result.
    """
    ids, t = F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    rows = docs.select(ids, t)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(6, math.ceil(math.log2(max(1, total / 6 / RANGE_WINDOWS)))))
    parts = max(48, total // PART_BYTES)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)

    def gather(batches):
        W.claim("substring_dedup")
        held, n = [], 0

        def flush():
            i = np.concatenate([x[0] for x in held])
            h = np.concatenate([x[1] for x in held])
            first_i, first_h, later_i, later_h, of = repeats(i, h, np.concatenate([x[2] for x in held]))
            order = np.argsort(of, kind="stable")
            first_i, first_h, of = first_i[order], first_h[order], of[order]
            for k, s in _pieces(of):
                yield k, 0, 0, pack(first_i[s], first_h[s])
            # decided already; they only pass through the reducers, spread over them
            for p, b in _answers(later_i, later_h, parts):
                yield p % (1 << bits), p, 1, b

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d is None:
                    continue
                w = W.hashes(W.split(x.as_py()))
                h = W.windows(w, size)
                if len(h):
                    held.append((np.full(len(h), d, np.int64), h, range_of(w, size, bits).astype(np.uint32)))
                    n += len(h)
                if n >= FLUSH:
                    yield _rows(list(flush()))
                    held, n = [], 0
        if held:
            yield _rows(list(flush()))

    def judge(batches):
        now, ids_, hs = None, [], []

        def answer():
            if ids_:
                _, _, later_i, later_h, _ = repeats(np.concatenate(ids_), np.concatenate(hs))
                for p, b in _answers(later_i, later_h, parts):
                    yield 0, p, 1, b

        for b in batches:
            out = []
            for k, p, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    out.append((0, p, 1, payload))
                    continue
                if k != now:
                    out += answer()
                    now, ids_, hs = k, [], []
                i, h = unpack(payload)
                ids_.append(i)
                hs.append(h)
            if out:
                yield _rows(out)
        last = list(answer())
        if last:
            yield _rows(last)

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            i = b.column(0)
            known = np.array(i.fill_null(0), np.int64)
            p = part_of(known, parts)
            data = [None if x is None else z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([i, pa.array(p), pa.array(np.full(len(p), 2, np.int32)), pa.array(data, pa.binary())], schema=_ROUTED)

    def apply(batches):
        z = zstandard.ZstdDecompressor()
        now, facts, bad = None, [], None
        for b in batches:
            out = []
            for d, p, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != now:
                    now, facts, bad = p, [], None
                if kind == 1:
                    facts.append(unpack(payload))
                    continue
                if bad is None:
                    i = np.concatenate([x[0] for x in facts]) if facts else np.zeros(0, np.int64)
                    h = np.concatenate([x[1] for x in facts]) if facts else np.zeros(0, np.uint64)
                    order = np.argsort(i, kind="stable")
                    bad, facts = (i[order], h[order]), []
                ws = W.split(z.decompress(payload).decode("utf-8", "surrogatepass")) if payload else []
                lo, hi = (np.searchsorted(bad[0], d, "left"), np.searchsorted(bad[0], d, "right")) if d is not None else (0, 0)
                if hi > lo:
                    gone = covered(W.hashes(ws), size, bad[1][lo:hi])
                    kept = [x for x, g in zip(ws, gone.tolist(), strict=True) if not g]
                    out.append((d, len(ws), int(gone.sum()), intervals(gone), b" ".join(kept).decode("utf-8", "replace")))
                else:
                    out.append((d, len(ws), 0, [], b" ".join(ws).decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)

    entries = rows.mapInArrow(gather, ROUTED)
    found = entries.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(judge, ROUTED)
    texts = rows.mapInArrow(send, ROUTED)
    met = found.unionAll(texts).repartition(tasks, "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(apply, OUT)
