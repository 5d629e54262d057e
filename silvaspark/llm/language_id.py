"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built. A text is
parsed greedily by each automaton into the longest phrases that occur in the language's sample;
the phrase count times log2 of the sample's length is the cost in bits of copying the text out
of that sample, and the language with the least cost wins.

Texts are cut into segments of ``SEGMENT`` letters, which are parsed side by side: one step
takes every segment and language one symbol further with a single gather from a dense table.
Then the parse of each segment is carried on into the next one until both begin a phrase at the
same letter, from where on they agree; so the count is that of one parse of the whole text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.llm import suffix_automaton

SEGMENT = 512
SPACE, OTHER = 0, 1
#: Letters that have a code of their own, the most frequent ones of all samples, and codes that rarer letters share.
ALPHABET, CLASSES = 120, 120


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    letters: str
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    lengths: list[int]
    #: whether rarer letters share codes; if not, no sample holds one
    classes: bool
    #: digest of all of the above: workers keep what they derive from a model under it
    key: str

    @property
    def codes(self) -> int:
        return 2 + len(self.letters) + CLASSES * self.classes


_letter: dict[tuple[str, bool], np.ndarray] = {}


def lookup(letters: str, classes: bool = False) -> np.ndarray:
    """Code of every code point: 0 for what is no letter, a letter's own code, or for other letters one of
    ``CLASSES`` codes by code point or, without classes, 1, which matches nothing."""
    if (letters, classes) not in _letter:
        lut = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000) * np.uint8(OTHER)
        if classes:
            for i in np.flatnonzero(lut).tolist():
                lut[i] = 2 + len(letters) + ord(chr(i).lower()[0]) % CLASSES
        for k, c in enumerate(letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    lut[ord(form)] = 2 + k
        _letter.clear()
        _letter[letters, classes] = lut
    return _letter[letters, classes]


def encode(text: str, lut: np.ndarray) -> np.ndarray:
    """Codes of the letters, with one space for each run of anything else and one in front."""
    c = lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    return np.concatenate(([SPACE], c[keep])).astype(np.uint8)


def train(samples: dict[str, list[str]], max_chars: int) -> Model:
    """``samples``: whole texts by language, in the order they are taken while ``max_chars`` lasts."""
    count: dict[str, int] = {}
    kept: dict[str, list[str]] = {}
    for lang, texts in samples.items():
        left = max_chars
        for t in texts:
            if len(t) <= left:
                kept.setdefault(lang, []).append(t)
                left -= len(t)
                for ch in t.lower():
                    if ch.isalpha():
                        count[ch] = count.get(ch, 0) + 1
    letters = "".join(sorted(sorted(count, key=lambda ch: (-count[ch], ch))[:ALPHABET]))
    classes = len(count) > len(letters)
    lut = lookup(letters, classes)
    langs, tables, lengths = [], [], []
    for lang in sorted(kept):
        # between texts stands a symbol that no text matches
        seq = np.concatenate([np.append(encode(t, lut), OTHER) for t in kept[lang]])
        if (seq > OTHER).any():
            langs.append(lang)
            tables.append(suffix_automaton.build(seq.tolist()))
            lengths.append(len(seq))
    key = hashlib.sha256(repr((langs, letters, lengths, classes)).encode())
    for s, c, t, _ in tables:
        for x in (s, c, t):
            key.update(np.ascontiguousarray(x).tobytes())
    return Model(langs, letters, tables, lengths, classes, key.hexdigest())


_dense: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def dense(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """One table over all languages: entry = next state * 2 + 1 where a new phrase starts."""
    if model.key not in _dense:
        a = model.codes
        parts, roots, base = [], [], 0
        for s, c, t, n in model.tables:
            go = np.full((n, a), -1, np.int32)
            real = c != OTHER
            go[s[real], c[real]] = t[real]
            root = np.where(go[0] < 0, 0, go[0])
            table = np.where(go >= 0, (go + base) * 2, (root + base) * 2 + 1)
            parts.append(table.astype(np.int32))
            roots.append(base)
            base += n
        _dense.clear()
        _dense[model.key] = np.concatenate(parts).ravel(), np.array(roots, np.int32)
    return _dense[model.key]


def phrases(codes: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrase counts (text, language) of the greedy parse of whole texts."""
    table, roots = dense(model)
    a, n_lang = model.codes, len(model.langs)
    owner, starts, sizes, nth = [], [], [], []
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
    at = 0
    for i, c in enumerate(codes):
        for k in range(0, len(c), SEGMENT):
            owner.append(i)
            starts.append(at + k)
            sizes.append(min(SEGMENT, len(c) - k))
            nth.append(k // SEGMENT)
        at += len(c)
    out = np.zeros((len(codes), n_lang), np.int64)
    if not owner:
        return out
    size = np.array(sizes)
    order = np.argsort(-size, kind="stable")
    size, start, own = size[order], np.array(starts)[order], np.array(owner)[order]
    m = len(size)
    state = np.repeat(roots[:, None], m, axis=1).astype(np.int64)
    count = np.zeros((n_lang, m), np.int32)
    begins = np.zeros((size[0], n_lang, m), bool)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for t in range(size[0]):
        k = active[t]
        got = table[state[:, :k] * a + flat[start[:k] + t]]
        begins[t, :, :k] = got & 1
        count[:, :k] += begins[t, :, :k]
        state[:, :k] = got >> 1
    # carry the parse on over the cuts, second segments first; the parse of a segment by itself begins a phrase at its first letter
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    nth = np.array(nth)
    for step in range(1, int(nth.max(initial=0)) + 1):
        here = place[np.flatnonzero(nth == step)]
        before = place[np.flatnonzero(nth == step) - 1]
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(n_lang), np.arange(len(here)), indexing="ij"))
        seg, now = here[lane], state[lang, before[lane]]
        more = np.zeros(len(seg), np.int64)
        for t in range(int(size[here].max())):
            got = table[now * a + flat[start[seg] + t]]
            now = got >> 1
            new = (got & 1).astype(bool)
            old = begins[t, lang, seg]
            more += new.astype(np.int64) - old
            met = new & (old | (t == 0))
            ends = ~met & (size[seg] == t + 1)
            count[lang[met | ends], seg[met | ends]] += more[met | ends].astype(np.int32)
            state[lang[ends], seg[ends]] = now[ends]
            go = ~(met | ends)
            if not go.any():
                break
            lang, seg, now, more = lang[go], seg[go], now[go], more[go]
    np.add.at(out, own, count.T)
    # the phrase that is open at the end of a text
    return out + 1


def judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    lut = lookup(model.letters, model.classes)
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    codes, at = [], []
    for i, t in enumerate(texts):
        if t:
            c = encode(t, lut)
            if (c != SPACE).any():
                codes.append(c)
                at.append(i)
    if not model.langs:
        return langs, scores
    bits = phrases(codes, model) * np.log2(np.array(model.lengths, float) + 2)
    for i, b in zip(at, bits, strict=True):
        best = int(np.argmin(b))
        langs[i] = model.langs[best]
        scores[i] = float(1.0 / np.exp2(np.maximum(b[best] - b, -1000)).sum())
    return langs, scores


def fit(docs: DataFrame, label: str, doc_id: str, text: str, train_on: Column | None = None, docs_per_lang: int = 60, max_chars: int = 40_000) -> Model:
    """Learn from at most ``docs_per_lang`` whole documents of each language and ``max_chars``
    characters of them: the rows that come first by a hash of their id. This bound is a
    parameter of the classifier and does not grow with the table."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(label).alias("l"))
    rows = rows.where("t is not null and l is not null").where(train_on if train_on is not None else F.lit(True))
    rows = rows.where(F.length("t") <= max_chars)
    w = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    pick = rows.select("id", "l").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= docs_per_lang)
    got = rows.join(F.broadcast(pick.distinct()), ["id", "l"]).select("l", "rank", "t").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["rank"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"])
    return train(samples, max_chars)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, ..., lang_pred, score) of every whole text.

    Null texts and texts without a letter give ``und`` and score 0, and so does every text if
    nothing could be learned; equal costs give the first language by name; repeated rows each
    give a row; further columns are ignored unless asked for by ``keep``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    extra = keep or {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.col(text).cast("string").alias("__text"))

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            langs, scores = [], []
            for k in range(0, len(texts), 1500):
                x, y = judge(texts.slice(k, 1500).to_pylist(), sent.value)
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
