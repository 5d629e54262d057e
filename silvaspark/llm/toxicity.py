"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not. Tokens are labelled by what the labelled documents say:
a word or word beginning that occurs in many toxic documents of a bounded sample and (almost)
no clean one marks its tokens as toxic, every other token is not. Near copies in the sample
count once. On these labelled tokens a two-label CRF over word, prefix and suffix features is
trained by full-batch Adagrad on the exact log-likelihood.

A document's tokens get marginals by forward-backward; the score is the noisy-or over the
tokens that are likelier toxic than ``FLOOR``, or else the greatest marginal. Long texts are
cut into segments whose 2x2 transfer matrices are multiplied side by side, then chained, so the
marginals are those of the whole text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.llm import words as W

SEGMENT = 128
FLOOR = 0.05
#: Texts whose tokens a task holds at once.
AT_ONCE = 300
#: Words before and after a marked token that go into a training sequence.
AROUND = 12
_edge = re.compile(r"^\W+|\W+$")


def features(token: str) -> list[str]:
    w = token.lower()
    if not w.isalnum():
        w = _edge.sub("", w)
        if not w:
            return ["empty"]
    out = ["w=" + w, "s=" + w[-3:], "bias" if w.isalpha() or not any(c.isdigit() for c in w) else "digit"]
    for k in (3, 4, 5, 6):
        if len(w) <= k:
            break
        out.append("p=" + w[:k])
    return out


def evidence(token: str) -> list[str]:
    """What can mark a token: its word and beginnings of at least four letters."""
    return [f for f in features(token) if f[0] == "w" or f[0] == "p" and len(f) >= 6]


@dataclass(frozen=True)
class Crf:
    """Log potentials of label toxic minus label other, by feature; ``trans[i][j]`` from i to j."""

    weights: dict[str, float]
    trans: tuple[tuple[float, float], tuple[float, float]]
    start: float
    prior: float

    def emission(self, token: str) -> float:
        x = 0.0
        for f in features(token):
            x += self.weights.get(f, 0.0)
        return min(30.0, max(-30.0, x))


class Emissions(dict):
    """exp(emission) by raw token; remembers a bounded number of tokens."""

    limit = 200_000

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        x = self[token] = math.exp(self.crf.emission(token))
        return x


def marginals(e: np.ndarray, sizes: np.ndarray, w: np.ndarray, start: float) -> np.ndarray:
    """Marginals of label 1 of chains laid end to end.

    e: exp(emission) of every token; sizes: tokens of each chain, at least 1; w: exp(transition).
    """
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n_seg = -(-sizes // SEGMENT)
    chain = np.repeat(np.arange(len(sizes)), n_seg)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = first[chain] + nth * SEGMENT
    size = np.minimum(SEGMENT, sizes[chain] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    m = len(begin)
    active = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), side="right")
    # transfer matrix of each segment, scaled
    p = np.zeros((4, m))
    p[0] = p[3] = 1.0
    for t in range(size[0]):
        k = active[t]
        x = e[begin[:k] + t]
        a, b, c, d = p[0, :k], p[1, :k], p[2, :k], p[3, :k]
        q = np.stack((a * w[0, 0] + b * w[1, 0], (a * w[0, 1] + b * w[1, 1]) * x, c * w[0, 0] + d * w[1, 0], (c * w[0, 1] + d * w[1, 1]) * x))
        p[:, :k] = q / q.max(axis=0)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    p = p[:, back]
    # odds that enter each segment from the left, and likelihood ratios that enter from the right
    at = np.cumsum(n_seg) - n_seg
    left, right = np.empty(m), np.empty(m)
    by_len = np.argsort(-n_seg, kind="stable")
    ns, at = n_seg[by_len], at[by_len]
    x = np.full(len(ns), start)
    for k in range(ns[0]):
        j = np.searchsorted(-ns, -(k + 1), side="right")
        s = at[:j] + k
        left[s] = x[:j]
        x[:j] = (p[1, s] + x[:j] * p[3, s]) / (p[0, s] + x[:j] * p[2, s])
    x = np.ones(len(ns))
    for k in range(ns[0]):
        j = np.searchsorted(-ns, -(k + 1), side="right")
        s = at[:j] + ns[:j] - 1 - k
        right[s] = x[:j]
        x[:j] = (p[2, s] + p[3, s] * x[:j]) / (p[0, s] + p[1, s] * x[:j])
    odds = np.empty(len(e))
    x = left[order]
    for t in range(size[0]):
        k = active[t]
        i = begin[:k] + t
        x[:k] = e[i] * (w[0, 1] + w[1, 1] * x[:k]) / (w[0, 0] + w[1, 0] * x[:k])
        odds[i] = x[:k]
    y = right[order]
    for t in range(size[0] - 1, -1, -1):
        k = active[t]
        i = begin[:k] + t
        odds[i] *= y[:k]
        z = e[i] * y[:k]
        y[:k] = (w[1, 0] + w[1, 1] * z) / (w[0, 0] + w[0, 1] * z)
    return odds / (1 + odds)


def _sketch(text: str) -> int:
    ws = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))), default=0)


def tail(n: int, of: int, chance: float) -> float:
    """Probability of ``n`` or more hits in ``of`` trials."""
    log = lambda k: math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(chance) + (of - k) * math.log1p(-chance)
    return sum(math.exp(log(k)) for k in range(n, of + 1))


def train(toxic: list[str], clean: list[str], share: float = 0.01, least: int = 5, rounds: int = 50, seed: int = 7) -> Crf:
    """Fit on whole labelled texts. With no text of a class or no marks, every score is the prior and no
    text is predicted toxic."""
    one = lambda texts: list({_sketch(t): t for t in sorted(texts, reverse=True)}.values())
    prior = len(toxic) / max(1, len(toxic) + len(clean))
    toxic, clean = one(toxic), one(clean)
    none = Crf({}, ((0.0, 0.0), (0.0, 0.0)), 0.0, prior)
    if not toxic or not clean:
        return none
    known: dict[str, list[str]] = {}

    def shown(x: str) -> list[str]:
        if x not in known:
            known[x] = evidence(x)
        return known[x]

    df: list[dict[str, int]] = [{}, {}]
    for k, texts in enumerate((clean, toxic)):
        for t in texts:
            for f in {f for x in set(t.split()) for f in shown(x)}:
                df[k][f] = df[k].get(f, 0) + 1
    # by chance, of the features of as many documents as this one fewer than 0.01 are as toxic as it
    chance = len(toxic) / (len(toxic) + len(clean))
    need = max(min(least, len(toxic) // 2 + 1), share * len(toxic))
    shown_in = np.sort([n + df[0].get(f, 0) for f, n in df[1].items()])

    def beyond_chance(n: int, m: int) -> bool:
        return tail(n, n + m, chance) * (len(shown_in) - np.searchsorted(shown_in, n + m)) < 0.01

    marks = {f for f, n in df[1].items() if n >= need and (m := df[0].get(f, 0)) / len(clean) <= 0.02 * n / len(toxic) and beyond_chance(n, m)}
    marked: dict[str, bool] = {}

    def is_marked(x: str) -> bool:
        if x not in marked:
            marked[x] = any(f in marks for f in shown(x))
        return marked[x]

    # training sequences: stretches around marked tokens; stretches of clean texts, by chance and
    # around tokens that share a beginning or an end with marked ones
    alike = {f for t in toxic for x in set(t.split()) if is_marked(x) for f in features(x) if f[:2] in ("p=", "s=")}
    like: dict[str, int] = {}

    def likeness(x: str) -> int:
        if x not in like:
            like[x] = sum(f in alike for f in features(x))
        return like[x]

    seqs: list[tuple[list[str], list[int]]] = []
    rng = np.random.default_rng(seed)
    for t in toxic:
        ws = t.split()
        at = [i for i, x in enumerate(ws) if is_marked(x)]
        if at:
            i = at[int(rng.integers(len(at)))]
            part = ws[max(0, i - AROUND) : i + AROUND + 1]
            seqs.append((part, [int(is_marked(x)) for x in part]))
    n_pos = len(seqs)
    if not n_pos:
        return none
    for t in clean:
        ws = t.split()
        near = sorted(range(len(ws)), key=lambda i: (-likeness(ws[i]), i))[:2]
        for i in [*near, int(rng.integers(max(1, len(ws))))]:
            part = ws[max(0, i - AROUND) : i + AROUND + 1]
            if part:
                seqs.append((part, [0] * len(part)))
    return _fit(seqs, prior, rounds)


def _fit(seqs: list[tuple[list[str], list[int]]], prior: float, rounds: int) -> Crf:
    index: dict[str, int] = {}
    width = 2 * AROUND + 1
    n = len(seqs)
    y = np.zeros((n, width), np.int64)
    on = np.zeros((n, width), bool)
    rows, feats = [], []
    for i, (ws, ls) in enumerate(seqs):
        y[i, : len(ls)] = ls
        on[i, : len(ls)] = True
        for j, x in enumerate(ws):
            for f in features(x):
                rows.append(i * width + j)
                feats.append(index.setdefault(f, len(index)))
    rows, feats = np.array(rows), np.array(feats)
    theta, trans, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(1)
    acc = [np.full_like(x, 1e-8) for x in (theta, trans, start)]
    both = on[:, :-1] & on[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(rounds):
        e = np.bincount(rows, theta[feats], n * width).reshape(n, width)
        a = np.zeros((n, width, 2))
        a[:, 0, 1] = e[:, 0] + start[0]
        for t in range(1, width):
            s = np.logaddexp(a[:, t - 1, 0, None] + trans[0], a[:, t - 1, 1, None] + trans[1])
            s[:, 1] += e[:, t]
            a[:, t] = np.where(on[:, t, None], s, a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        b = np.zeros((n, width, 2))
        pair = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            right = b[:, t + 1].copy()
            right[:, 1] += e[:, t + 1]
            s = np.stack([np.logaddexp(trans[k, 0] + right[:, 0], trans[k, 1] + right[:, 1]) for k in (0, 1)], axis=1)
            live = on[:, t + 1]
            b[:, t] = np.where(live[:, None], s, b[:, t + 1])
            joint = np.exp(a[:, t, :, None] + trans[None] + right[:, None, :] - z[:, None, None])
            pair += joint[live].sum(axis=0)
        p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * on
        diff = (y * on - p).ravel()
        grads = (np.bincount(feats, diff[rows], len(theta)) - 0.02 * theta, seen - pair - 0.02 * trans, np.array([(y[:, 0] - p[:, 0]).sum()]) - 0.02 * start)
        for x, g, h in zip((theta, trans, start), grads, acc, strict=True):
            h += g * g
            x += 0.5 * g / np.sqrt(h)
    w = {f: float(theta[k]) for f, k in index.items() if abs(theta[k]) > 1e-3}
    return Crf(w, tuple(tuple(float(v) for v in r) for r in trans), float(start[0]), prior)


def score_texts(texts: list[str | None], crf: Crf, cache: Emissions) -> tuple[list[float], list[list[dict]]]:
    """Score and offending spans (start, end as character offsets, marginal) of every text."""
    scores, spans = [0.0] * len(texts), [[] for _ in texts]
    toks, at = [], []
    for i, t in enumerate(texts):
        ws = t.split() if t else []
        if ws:
            toks.append(ws)
            at.append(i)
    if not toks:
        return scores, spans
    if not crf.weights:
        return [crf.prior if t and t.split() else 0.0 for t in texts], spans
    sizes = np.array([len(x) for x in toks])
    e = np.fromiter((cache[x] for ws in toks for x in ws), float, int(sizes.sum()))
    # labels are counted from a virtual token before the first
    p = marginals(e, sizes, np.exp(np.array(crf.trans)), _enter(crf))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    top = np.maximum.reduceat(p, first)
    high = np.flatnonzero(p >= FLOOR)
    by: dict[int, list[int]] = {}
    for k, j in zip(np.searchsorted(first, high, side="right") - 1, high, strict=True):
        by.setdefault(int(k), []).append(int(j))
    for k, i in enumerate(at):
        if k not in by:
            scores[i] = float(top[k])
            continue
        q = p[by[k]]
        scores[i] = float(np.clip(1 - np.exp(np.log1p(-np.minimum(q, 1 - 1e-12)).sum()), 0, 1))
        where = {j - int(first[k]): float(p[j]) for j in by[k] if p[j] >= 0.5}
        if where:
            for j, hit in enumerate(re.finditer(r"\S+", texts[i])):
                if j in where:
                    spans[i].append({"start": hit.start(), "end": hit.end(), "marginal": where[j]})
    return scores, spans


def _enter(crf: Crf) -> float:
    """The odds x before the first token for which the step to it gives exp(start) times emission."""
    (a, b), (c, d) = np.exp(np.array(crf.trans))
    s = np.exp(crf.start)
    x = (a * s - b) / (d - c * s) if abs(d - c * s) > 1e-12 else 0.0
    return float(x)


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = 1500, max_clean: int = 2500) -> Crf:
    """Learn from at most ``max_toxic`` and ``max_clean`` whole labelled documents: those that
    come first by a hash of their id. The bound is a parameter of the classifier."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("l")).where("l is not null and id is not null")
    if train_on is not None:
        rows = rows.where(train_on)
    rows = rows.groupBy("id").agg(F.max("l").alias("l"))
    pick = None
    for k, n in ((1, max_toxic), (0, max_clean)):
        own = rows.where(F.col("l") == k).orderBy(F.xxhash64("id"), "id").limit(n)
        pick = own if pick is None else pick.unionAll(own)
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(pick), "id").select("l", "t").collect()
    crf = train([r["t"] for r in got if r["l"] == 1], [r["t"] for r in got if r["l"] == 0])
    if crf.weights:
        return crf
    n = rows.agg(F.count_if(F.col("l") == 1).alias("toxic"), F.count("*").alias("all")).first()
    return replace(crf, prior=n["toxic"] / max(1, n["all"]))


def score(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, ..., score, predicted, spans) of every whole text.

    Null and empty texts score 0 and have no spans. Repeated rows each give a row; further
    columns are ignored unless asked for by ``keep``; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    extra = keep or {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.col(text).cast("string").alias("__text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        W.claim("toxicity")
        cache = Emissions(sent.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores, spans = [], []
            for k in range(0, len(texts), AT_ONCE):
                x, y = score_texts(texts.slice(k, AT_ONCE).to_pylist(), sent.value, cache)
                scores += x
                spans += y
            said = [int(is_toxic(s, sent.value, threshold)) for s in scores]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(said, pa.int32()), pa.array(spans, span)], [*b.schema.names[:-1], "score", "predicted", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int, spans array<struct<start:long,end:long,marginal:double>>")


def is_toxic(score: float, crf: Crf, threshold: float) -> bool:
    """Without learned weights the score is the base rate of the labels, which says nothing of a text."""
    return bool(crf.weights) and score >= threshold


def drop_toxic(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    at = docs.columns.index(text)

    def run(batches):
        W.claim("toxicity")
        cache = Emissions(sent.value)
        for b in batches:
            keep = []
            for k in range(0, b.num_rows, AT_ONCE):
                keep += [not is_toxic(s, sent.value, threshold) for s in score_texts(b.column(at).slice(k, AT_ONCE).to_pylist(), sent.value, cache)[0]]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
