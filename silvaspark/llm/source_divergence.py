"""How far the vocabularies of the sources of a language are from each other, in exact integers.

1. *Counts.* Texts come to Python as Arrow buffers. A table of 256 bytes tells term bytes from others and folds A-Z,
   so the boundaries of all terms of a batch are where that table changes; slices between them are grouped by xxhash,
   and the bytes of every slice are compared with those that stand for its group. What leaves a task is one row for
   each group of documents and term in it, with occurrences and documents. Spark adds these up.
2. *Kept terms* are those in enough documents of a language; sums over them give the totals of groups and languages, and every
   count its smoothed share ``p`` (column arithmetic in 64-bit integers).
3. *Pairs of sources.* The sum over all kept terms is split by where a term occurs::

       sum f(p, q) = V f(p0, q0) + sum over terms of the group  [f(p, q0) - f(p0, q0)]
                                 + sum over terms of the other  [f(p0, q) - f(p0, q0)]
                                 + sum over terms of both       [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

   (p0, q0: the shares of terms that do not occur). The first three parts need no terms, only how often each count occurs in
   each group. The last goes over matrices of terms by sources in compressed sparse rows: the pairs of entries of
   each row are laid out and added up by ``reduceat`` over equal pairs, so what leaves a task is a row for each pair of sources.
4. *Terms* of a group that are likelier than in the language, by rank windows that keep the first ranks before the shuffle.

No step depends on the number of sources or terms that fit a task: matrices are cut into blocks of a set number of
pairs, and one row of a matrix (a very common term) into blocks of its left entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.runtime import written

UNIT = 1_000_000_000
#: Bytes of text, table entries and pairs of matrix entries that are worked on at once.
BYTES, ENTRIES, PAIRS = 4_000_000, 200_000, 1_000_000

#: 0 for bytes that end a term, else the byte that it counts as.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x41], FOLD[0x5B:0x61], FOLD[0x7B:0x80] = 0, 0, 0
FOLD[0x41:0x5B] += 0x20


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, documents) of all terms in concatenated texts; ``offsets`` bound the texts.

    A zero is put after every text, so no term runs on into the next."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    folded = np.zeros(len(data) + n + 1, np.uint8)
    folded[np.arange(len(data)) + text + 1] = FOLD[data]  # one zero before every text
    change = np.flatnonzero(np.diff((folded != 0).view(np.int8), append=0))
    starts, ends = change[::2] + 1, change[1::2] + 1
    bounds = offsets[1:] - offsets[0] + np.arange(1, n + 1)  # where each text ends in ``folded``
    return folded, starts, ends, np.searchsorted(bounds, starts, side="right")


def grouped(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of its term for every slice, the terms). Slices of equal hashes are compared byte by byte with the
    first of them; those that differ, if ever there are any, get terms of their own."""
    raw = folded.tobytes()
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    size = ends - starts
    same = size == size[first][code]
    k = np.flatnonzero(same)
    at = np.repeat(starts[k] - np.concatenate([[0], np.cumsum(size[k])[:-1]]) if len(k) else k, size[k]) + np.arange(size[k].sum())
    other = at + np.repeat(starts[first][code[k]] - starts[k], size[k])
    wrong = folded[at] != folded[other]
    if len(k):
        same[k] = ~np.logical_or.reduceat(wrong, np.concatenate([[0], np.cumsum(size[k])[:-1]]))
    extra: dict[bytes, int] = {}
    for s in np.flatnonzero(~same).tolist():
        code[s] = extra.setdefault(raw[starts[s] : ends[s]], len(terms) + len(extra))
    return code, [*terms, *extra]


def _parts(texts: pa.LargeStringArray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BYTES`` bytes; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
        yield at, to
        at = to


def _offsets(texts: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of ``BYTES`` bytes and what follows up to the end of a term."""
    at = 0
    while at < len(data):
        to = at + BYTES
        while to < len(data):
            ends = np.flatnonzero(FOLD[data[to : to + BYTES]] == 0)
            if len(ends):
                to += int(ends[0])
                break
            to += BYTES
        yield data[at:to]
        at = to


def document_terms(data: np.ndarray, offsets: np.ndarray, held: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of every term in every text; terms are numbered by ``held``, which grows."""
    pieces = [(data, offsets)] if len(offsets) != 2 else [(x, np.array([0, len(x)])) for x in _cuts(data)]
    doc, term, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, bounds in pieces:
        folded, starts, ends, at = slices(x, bounds)
        if not len(starts):
            continue
        code, terms = grouped(folded, starts, ends)
        known = np.fromiter((held.setdefault(t, len(held)) for t in terms), np.int64, len(terms))
        key, count = added((at << 32) | known[code], np.ones(len(code), np.int64))
        key, n = added(np.concatenate([(doc << 32) | term, key]), np.concatenate([n, count]))
        doc, term = key >> 32, key & 0xFFFFFFFF
    return doc, term, n


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group of documents, and documents that have it."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: dict[bytes, int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names, terms = list(groups), pa.array(list(held), pa.binary()).cast(pa.string())
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                g = (k >> 32).tolist()
                cols = [pa.array([names[x][0] for x in g], pa.string()), pa.array([names[x][1] for x in g], pa.string()), terms.take(pa.array(k & 0xFFFFFFFF))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sums[a : a + 50_000, 0]), pa.array(sums[a : a + 50_000, 1])], schema=schema)

        for b in batches:
            texts = b.column(2).cast(pa.large_string())
            of = np.array([groups.setdefault(x, len(groups)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            offsets = _offsets(texts) if len(texts) else np.zeros(1, np.int64)
            for lo, hi in _parts(texts, offsets) if len(texts) else ():
                cut = offsets[lo : hi + 1]
                doc, term, n = document_terms(data[cut[0] : cut[-1]], cut, held)
                keys, sums = added(np.concatenate([keys, (of[lo + doc] << 32) | term]), np.concatenate([sums, np.stack([n, np.ones_like(n)], 1)]))
                if len(keys) > ENTRIES:
                    yield from out()
                    held, keys, sums = {}, keys[:0], sums[:0]
        yield from out()

    each = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows, by ``reduceat`` over equal keys; integers stay exact."""
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums[order], first, axis=0)


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count, in units of 1 / UNIT, never 0."""
    return F.call_function("div", F.lit(UNIT) * (n + 1), total + terms) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(p - q)**2 // q; shares are at most UNIT + 1, so squares fit."""
    d = p - q
    return (d * d).view(np.uint64) // q.view(np.uint64)


def both(indptr: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, value): sums of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over the ordered pairs of different entries in
    the rows of a sparse matrix; a pair is ``source * width + source of the other``."""
    rows = np.diff(indptr)
    partners = np.repeat(rows, rows)  # of every entry: those of its row
    begin = np.repeat(indptr[:-1], rows)
    ends = np.cumsum(partners)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = partners[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
        left, right = left[left != right], right[left != right]
        q, q0, x, x0 = p[right], p0[right], p[left], p0[left]
        value = (_f(x, q) - _f(x, q0) - _f(x0, q) + _f(x0, q0)).view(np.int64)
        keys, sums = added(np.concatenate([keys, source[left] * width + source[right]]), np.concatenate([sums, value]))
        at = to
    return keys, sums


def _shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): the part of ``both`` of all pairs of sources, a row a pair and block.

    rows(lang, term, source, p, p0): the entries, each term of a language in one task and next to each other."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
            new = _changes(lang) | _changes(term)
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            if last < 100_000 and t.num_rows < 200_000:  # few whole rows so far
                rest = t
                continue
            yield from of_block(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from of_block(rest)

    def of_block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        lang = t["lang"].combine_chunks().dictionary_encode()
        source = t["source"].combine_chunks().dictionary_encode()
        l, s = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)  # noqa: E741
        new = _changes(t["term"].combine_chunks()) | np.concatenate([[True], l[1:] != l[:-1]])
        indptr = np.append(np.flatnonzero(new), t.num_rows)
        width = len(source.dictionary)
        # rows of different languages never meet, so a pair of (language, source) codes names its language
        code = l * width + s
        names, code = np.unique(code, return_inverse=True)
        keys, sums = both(indptr, code.astype(np.int64), t["p"].to_numpy(), t["p0"].to_numpy(), len(names))
        a, b = names[keys // len(names)], names[keys % len(names)]
        for k in range(0, len(keys), 50_000):
            x, y = a[k : k + 50_000], b[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(x // width)), source.dictionary.take(pa.array(x % width)), source.dictionary.take(pa.array(y % width)), pa.array(sums[k : k + 50_000])], names=["lang", "source", "item", "value"])

    return rows.mapInArrow(blocks, "lang string, source string, item string, value long")


def _changes(a: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; the first does."""
    if len(a) < 2:
        return np.ones(len(a), bool)
    return np.concatenate([[True], pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)])


def divergences(docs: DataFrame, least_docs: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source", salts: int = 16) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents with one language and source.

    ``pair``: every other source of the language and the sum of f(p, q) over all kept terms of the language, p the share
    of a term in the group and q in the other source. ``term``: the kept terms of the group whose share is above that
    in the language, first ``ranks`` by f. Ranks go by value descending and item ascending by bytes.

    A null text, language or source counts as the empty string; groups without terms take part; a language without kept
    terms has pairs of value 0; repeated rows count each; an empty table gives an empty result; further columns are
    ignored. Shares need ``UNIT * (count + 1)`` in 64 bits: a term may occur 9 * 10**9 times.
    """
    spark = docs.sparkSession
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs).drop("docs")
    entries = written(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    # one row a language: terms and occurrences; one row a group: occurrences
    vocabulary = entries.groupBy("lang", "term").agg(F.first("all").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("nl"))
    totals = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("ng")), ["lang", "source"], "left").join(vocabulary, "lang", "left")
    totals = totals.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ng", "v", "nl")])
    totals = written(totals.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("ng"), F.col("v"))).otherwise(1)), "group-totals")
    shared = entries.join(totals, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("ng"), F.col("v")).alias("p"), share(F.col("all"), F.col("nl"), F.col("v")).alias("q"), "p0")
    shared = written(shared, "shares")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _shared_terms(shared.drop("q").repartition(n, "lang", "term").sortWithinPartitions("lang", "term")).groupBy("lang", "source", "item").agg(F.sum("value").alias("common"))

    # how often each share occurs in each group; the groups of a language meet on salted keys, so that a language with
    # most of the sources is spread over tasks
    hist = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    salt = F.pmod(F.xxhash64("source"), F.lit(salts))
    g = totals.select("lang", "source", "p0", "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    h = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), salt.cast("int").alias("salt"))
    pairs = g.join(h, ["lang", "salt"]).where("source <> item")
    other = g.select("lang", F.col("source").alias("to"), F.col("p0").alias("t0"), "salt")
    spread = hist.join(totals.select("lang", "source", "p0"), ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(salts)).cast("int"))
    spread = spread.join(other, ["lang", "salt"]).where("source <> to")
    as_own = F.sum(F.col("m") * (divergence(F.col("p"), F.col("t0")) - divergence(F.col("p0"), F.col("t0"))))
    as_other = F.sum(F.col("m") * (divergence(F.col("t0"), F.col("p")) - divergence(F.col("t0"), F.col("p0"))))
    alone = spread.groupBy("lang", "source", "to").agg(as_own.alias("own"), as_other.alias("other"))
    own = alone.select("lang", "source", F.col("to").alias("item"), "own")
    theirs = alone.select("lang", F.col("to").alias("source"), F.col("source").alias("item"), "other")
    at = ["lang", "source", "item"]
    summed = pairs.join(own, at, "left").join(theirs, at, "left").join(met, at, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = F.when(F.col("v") > 0, F.col("v") * divergence(F.col("p0"), F.col("q0")) + zero("own") + zero("other") + zero("common")).otherwise(0)
    out = summed.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = out.withColumn("rank", F.row_number().over(w))
    likelier = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    first = likelier.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranks)
    return out.unionByName(first)
