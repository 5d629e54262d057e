"""Fuzzy line deduplication.

Lines are normalised (lower case, runs of white space to one space). Equal normalised lines are one
distinct line, of whatever length; an empty one is layout and stays. Distinct lines that are long
enough to be ``compared`` get ``BINS`` MinHashes over their runs of characters, by one permutation:
the bin of a run is the top of its hash, and the least rest of a bin is its MinHash. Lines that
agree in the bins of one of ``tables_for`` blocks are candidates, of which a sketch of ``DIGIT`` bits of
every bin turns away those that met by chance. Candidate *pairs* are then verified by edit
similarity of the normalised lines, and of each group connected by verified pairs the first
occurrence by document and line number stays.

SimHash, the method first thought of, was measured and left: lines of edit similarity 0.8 differ in
about 23 % of their SimHash bits, so pigeonhole blocks that lose none of them are four bits wide and
put a sixteenth of all lines into one bucket; wider blocks lose most pairs (figures in the README).

* Buckets of up to ``NEAR`` lines give every pair that passes the sketch. Larger ones are split where they meet into
  groups connected by pairs that pass it; a line that agrees with no other one goes, and small groups give all their pairs.
* Each line of larger groups gives one pair with a leader first. Where verified links leave lines of such a group in
  several classes, all lines of different classes are compared, in chunks dealt to tasks, by larger sketches of either
  half, and what looks alike is verified there.
* Pairs are verified by groups of candidates, and one whose ends are connected already is not: classes are what counts.

Lines travel as hashes; only lines that have a candidate are spelt.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.llm import groups
from silvaspark.llm import words as W
from silvaspark.llm.substring_dedup import _pieces
from silvaspark.operators.components import _settled, connected_components
from silvaspark.runtime import written

#: Characters of a run, a power of two; and of a line of fewer than ``MIN_WORDS`` words, whose script has no spaces.
RUN, SHORT_RUN = 8, 4
#: Jaccard similarity of the runs of lines of edit similarity 0.8 that differ in whole words, and the
#: share of such pairs that the tables are to find.
LIKE, RECALL = 0.4, 0.95
BINS, DIGIT = 32, 4
#: Bins that must agree in the sketch of a candidate; at ``LIKE`` one pair in ten has fewer.
AGREE = 12
MIN_WORDS = 5
#: Bucket size up to which all pairs of a bucket are candidates.
NEAR = 32
#: Lines of one bucket that are compared at once, beyond that in chunks.
AT_ONCE = 4096
#: Lines of a bucket that is split where it meets, cells of a block of comparisons, and leaders of a larger bucket.
SPLIT, CELLS, LEADERS = 65_536, 1 << 17, 64
#: Lines up to which a line is compared with each of them on its own, at most with so many of them at once, and how many are kept ready.
FEW, TOGETHER, PLACES = 4, 64, 1000
#: Tasks that verify the pairs of one leader.
SALT = 16
#: Line hashes a task remembers as sent already, and characters whose MinHashes are made at once.
SEEN, CHARS = 500_000, 50_000
#: Table entries that a task gathers before it sends them.
ENTRIES = 400_000
#: Distinct lines that two bins tell apart well enough; another bin is added for each ``APART`` times as many.
LINES, APART = 50_000_000, 500
#: MinHashes of each half by which lines of large buckets are told apart, and the shares that must agree: of lines of
#: edit similarity 0.8 one in fifty has less, while most lines that share a passage alone have less in one half.
LOOK, ALIKE, HALF = 128, 0.33, 0.1
#: Length above which shared stretches split lines before their distance is computed, and the length of those.
LONG, ANCHOR = 2500, 16

#: Session settings while lines are marked: shuffle files go when what they were for is written, and Arrow batches are
#: limited by bytes, as what is packed for a key range is large; joins whose partitions are small hash them instead of sorting.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(16 << 20)}

#: White space other than single spaces within a line.
_odd = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: First and last letters of scripts written without spaces: Thai and Lao, Myanmar, Khmer, kana, Han.
_unspaced = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def tables_for(n_lines: int) -> list[list[int]]:
    """Bins of each table: as many bins as keep chance meetings of a line rare among ``n_lines`` lines,
    and as many tables as find ``RECALL`` of the pairs whose runs have a Jaccard similarity of ``LIKE``."""
    rows = 2 + max(0, math.ceil(math.log(max(n_lines, 1) / LINES, APART)))
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - LIKE**rows))
    rng = np.random.default_rng(rows)
    order = [int(x) for _ in range(math.ceil(n * rows / BINS)) for x in rng.permutation(BINS)]
    return [sorted(order[k * rows : (k + 1) * rows]) for k in range(n)]


def compared(norm: str) -> bool:
    """Whether a line is long enough for fuzzy comparison: ``MIN_WORDS`` words or, without spaces between words, as many letters."""
    return norm.count(" ") >= MIN_WORDS - 1 or not norm.isascii() and sum(any(a <= ord(c) <= b for a, b in _unspaced) for c in norm[:200]) >= MIN_WORDS


def normal_lines(text: str | None) -> list[str]:
    """The normalised lines of a text; null and empty texts have none."""
    if not text:
        return []
    t = text.lower()
    if t[0] == " " or t[-1] == " " or any(x in t for x in _odd):
        return [" ".join(x.split()) for x in t.split("\n")]
    return t.split("\n")


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(norm: str) -> int:
    return xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def _bins(lines: list[str], run: int, parts: int, bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, bin) least hashes of ``bits`` bits over the runs of characters of each line, its ends marked by line
    breaks, and whether any run falls into the bin. Each of ``parts`` equal stretches of a line has ``bins`` of its own."""
    n, every = len(lines), parts * bins
    low = every.bit_length() - 1
    if n << low + bits >= 1 << 32:
        half = n // 2
        x, y = _bins(lines[:half], run, parts, bins, bits), _bins(lines[half:], run, parts, bins, bits)
        return np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))
    size = np.array([max(len(x) + 1, run) for x in lines])
    total = int(size.sum())
    h = np.frombuffer("".join("\n" + x.ljust(run - 1, "\n") for x in lines).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0" * run, np.uint32)
    base, step = W.BASE, 1
    while step < run:
        h = h[:-step] * np.uint32(base & 0xFFFFFFFF) + h[step:]
        base, step = base * base, 2 * step
    h = h[:total]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    first = np.cumsum(size) - size
    # runs that reach into the next line do not count
    whole = np.ones(total, bool)
    for k in range(run - 2):
        whole[first[1:] - 1 - k] = False
    whole[total - run + 2 :] = run < 3
    own = bins.bit_length() - 1
    key = h >> np.uint32(32 - own - bits)
    if parts > 1:
        place = np.arange(total) - np.repeat(first, size)
        key += (place * parts // np.repeat(np.maximum(size - run + 2, 1), size)).clip(0, parts - 1).astype(np.uint32) << np.uint32(own + bits)
    # (line, part, bin, rest) in one number; sorted, the first of each bin is its least rest
    key += np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(low + bits), size)
    key = np.sort(key[whole])
    top = key >> np.uint32(bits)
    new = np.ones(len(top), bool)
    new[1:] = top[1:] != top[:-1]
    at = top[new]
    has, out = np.zeros(n * every, bool), np.zeros(n * every, np.uint16)
    has[at] = True
    out[at] = key[new] & np.uint32((1 << bits) - 1)
    return out.reshape(n, every), has.reshape(n, every)


def _filled(got: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Bins that no run falls into take the value of another one, by a fixed order."""
    out = got.copy()
    width = got.shape[1]
    r, q = np.nonzero(~full & full.any(axis=1)[:, None])
    turn = 0
    while len(r):
        turn += 1
        src = (W.mix(q.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(turn)) % np.uint64(width)).astype(np.int64)
        ok = full[r, src]
        out[r[ok], q[ok]] = got[r[ok], src[ok]]
        r, q = r[~ok], q[~ok]
    return out


def minhashes(lines: list[str], run: int = RUN) -> np.ndarray:
    """(line, bin) 16-bit MinHashes of whole lines."""
    return _filled(*_bins(lines, run, 1, BINS, 16))


def looks(lines: list[str], run: int = RUN) -> np.ndarray:
    """(line, bin) bytes: ``LOOK`` MinHashes of each half of a line."""
    got, full = _bins(lines, run, 2, LOOK, 8)
    return np.concatenate([_filled(got[:, k : k + LOOK], full[:, k : k + LOOK]) for k in (0, LOOK)], axis=1).astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``looks`` (rows of a, one row b) agree in ``ALIKE`` of all bins and ``HALF`` of those of either half."""
    same = a == b
    one, two = same[:, :LOOK].sum(axis=1), same[:, LOOK:].sum(axis=1)
    return (one + two >= 2 * LOOK * ALIKE) & (np.minimum(one, two) >= LOOK * HALF)


def table_keys(sig: np.ndarray, tables: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(line, table) keys, which tell tables apart, and (line, word) sketches of 64-bit words."""
    key = np.broadcast_to(np.arange(1, len(tables) + 1, dtype=np.uint64) * np.uint64(W.BASE), (len(sig), len(tables)))
    at = np.array(tables)
    for k in range(at.shape[1]):
        key = W.mix(key ^ sig[:, at[:, k]].astype(np.uint64))
    digit = W.mix(sig.astype(np.uint64)) & np.uint64((1 << DIGIT) - 1)
    shift = np.arange(64 // DIGIT, dtype=np.uint64) * np.uint64(DIGIT)
    return key.astype(np.uint32), np.bitwise_or.reduce(digit.reshape(len(sig), -1, 64 // DIGIT) << shift, axis=2)


#: Words of a sketch.
WORDS = BINS * DIGIT // 64


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether (..., word) sketches agree in at least ``AGREE`` bins."""
    differ = np.uint8(0)
    for k in range(WORDS):
        x = a[..., k] ^ b[..., k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ = differ + np.bitwise_count(x & np.uint64(0x1111111111111111))
    return differ <= BINS - AGREE


def agreeing_groups(check: np.ndarray) -> list[np.ndarray]:
    """Rows of each group that sketches connect by agreeing, ascending; a row that agrees with no other one is in none."""
    n = len(check)
    step = max(1, CELLS // max(n, 1))
    met = np.concatenate([agree(check[s : s + step, None], check[None]).sum(axis=1) > 1 for s in range(0, n, step)] or [np.zeros(0, bool)])
    left, out = np.flatnonzero(met), []
    while len(left):
        group, todo, left = [left[:1]], [left[0]], left[1:]
        while todo and len(left):
            near = agree(check[left], check[todo.pop()])
            if near.any():
                group.append(left[near])
                todo += group[-1].tolist()
                left = left[~near]
        out.append(np.sort(np.concatenate(group)))
    return out


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    step = 16
    while lo < hi:
        k = min(lo + step, hi)
        if a[lo:k] == b[lo:k]:
            lo, step = k, 2 * step
        elif step == 1 or k == lo + 1:
            break
        else:
            hi, step = k - 1 if step > 16 else hi, max(1, step // 4)
    return lo


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or some number above ``most`` if it is greater; Myers' bit-parallel algorithm."""
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    if k:
        a, b = a[:-k], b[:-k]
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) - len(a) > most:
        return len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = full, 0, len(a)
    left = len(b)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        left -= 1
        if d - left > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if not left & 127 and left and len(a) > 128:
            # the column's cells, and at least how many edits are to come from each
            bits = [np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)] for v in (pv, mv)]
            cell = len(b) - left + np.concatenate(([0], np.cumsum(bits[0].astype(np.int64) - bits[1])))
            if (cell + np.abs(np.arange(len(a), -1, -1) - left)).min() > most:
                return most + 1
    return d


def grams(x: str, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` characters of a line, by place."""
    c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < size:
        return np.zeros(0, np.uint64)
    h = c[: len(c) - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(W.BASE) + c[k : len(c) - size + 1 + k]
    return W.mix(h)


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, z in enumerate(places):
        w = bisect_left(ends, z)
        before.append(at[w - 1] if w else -1)
        if w == len(ends):
            ends.append(z)
            at.append(k)
        else:
            ends[w], at[w] = z, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _anchored(a: str, b: str, most: int) -> int:
    """Upper bound of the distance: stretches that stand once in either line and come in the same order are
    kept in place, and what lies between them is compared."""
    u, i, n = np.unique(grams(a, ANCHOR), return_index=True, return_counts=True)
    v, j, m = np.unique(grams(b, ANCHOR), return_index=True, return_counts=True)
    _, p, q = np.intersect1d(u[n == 1], v[m == 1], assume_unique=True, return_indices=True)
    i, j = i[n == 1][p], j[m == 1][q]
    order = np.argsort(i)
    ia, jb = i[order].tolist(), j[order].tolist()
    d = s = t = 0
    for p, q in [*((ia[k], jb[k]) for k in _rising(jb)), (len(a), len(b))]:
        if p < s or q < t:
            continue
        d += distance(a[s:p], b[t:q], most - d)
        if d > most:
            break
        s, t = p + ANCHOR, q + ANCHOR
    return d


def _by_words(a: str, b: str) -> tuple[int, list[tuple[int, list[str], list[str]]]]:
    """Upper bound of the distance and the stretches that differ: words that stand once in either line and come
    in the same order stay, and equal words next to them; what lies between counts whole."""
    x, y = a.split(" "), b.split(" ")
    once: dict[str, int] = {}
    for k, w in enumerate(x):
        once[w] = -1 if w in once else k
    there: dict[str, int] = {}
    for k, w in enumerate(y):
        there[w] = -1 if w in there else k
    both = [(k, j) for w, j in there.items() if j >= 0 and (k := once.get(w, -1)) >= 0]
    chain = [both[k] for k in _rising([k for k, _ in both])]
    chain.append((len(x), len(y)))
    d = i = j = 0
    gaps = []
    for p, q in chain:
        if p < i or q < j:
            continue
        while i < p and j < q and x[i] == y[j]:
            i += 1
            j += 1
        s, t = p, q
        while s > i and t > j and x[s - 1] == y[t - 1]:
            s -= 1
            t -= 1
        if s > i or t > j:
            # every word with its space, as parts of the line
            n = max(sum(map(len, x[i:s])) + s - i, sum(map(len, y[j:t])) + t - j)
            d += n
            gaps.append((n, x[i:s], y[j:t]))
        i, j = p + 1, q + 1
    return d, gaps


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, or 0 if it is below ``least``; bit-parallel. Lines within d edits have one of at least
    the longer length - d, and it is found several times as fast as their distance."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    left = len(b)
    for c in b:
        if u := v & at.get(c, 0):
            v = (v + u | v - u) & full
        left -= 1
        if not left & 31 and len(a) - v.bit_count() + left < least:
            return 0
    return len(a) - v.bit_count()


def letter_places(a: str) -> dict[str, bytes]:
    """The places of each letter as bits, with one more at least that stays empty, and under "" those of all places."""
    at: dict[str, int] = {"": (1 << len(a)) - 1}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    size = len(a) // 8 + 1
    return {c: v.to_bytes(size, "little") for c, v in at.items()}


def common_subsequences(many: list[dict[str, bytes]], b: str) -> np.ndarray:
    """``common_subsequence`` of b with many lines (``letter_places``) at once, next to each other in one number: what a line
    carries over ends in its empty bit."""
    size = [len(x[""]) for x in many]
    none = [bytes(n) for n in size]
    at = {c: int.from_bytes(b"".join([x.get(c, z) for x, z in zip(many, none, strict=True)]), "little") for c in set(b)}
    full = v = int.from_bytes(b"".join([x[""] for x in many]), "little")
    for c in b:
        if u := v & at[c]:
            v = (v + u | v - u) & full
    gone = np.frombuffer((full ^ v).to_bytes(sum(size), "little"), np.uint8)
    return np.add.reduceat(np.bitwise_count(gone).astype(np.int64), np.cumsum([0, *size[:-1]]))


def within_reach(a: str, others: list[str], keys: list[int], places: dict[int, dict[str, bytes]], least: float) -> np.ndarray:
    """Which of ``others`` may be similar to a line: lines within so many edits have a common subsequence of at least the
    longer length without them. ``places`` keeps ``letter_places`` by ``keys``."""
    length = np.array([len(x) for x in others], np.int64)
    n = np.maximum(length, len(a))
    need = n - ((1 - least) * n + 1e-9).astype(np.int64)
    out = np.minimum(length, len(a)) >= need
    at = np.flatnonzero(out)
    if len(at) > FEW and len(a) <= LONG:
        if len(places) > PLACES:
            places.clear()
        for s in range(0, len(at), TOGETHER):
            own = at[s : s + TOGETHER]
            for m in own.tolist():
                if keys[m] not in places:
                    places[keys[m]] = letter_places(others[m])
            out[own] = common_subsequences([places[keys[m]] for m in own.tolist()], a) >= need[own]
    return out


def edit_similar(a: str, b: str, least: float) -> bool:
    """1 - distance / longer length >= least. Bounds of the distance come first."""
    n = max(len(a), len(b))
    may = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > may:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    if k:
        a, b = a[:-k], b[:-k]
    n = max(len(a), len(b))
    if n <= may:
        return True
    bound, gaps = _by_words(a, b)
    if bound <= may:
        return True
    if bound <= 2 * may:
        for whole, x, y in gaps:
            if x and y:
                bound += distance(" ".join(x) + " ", " ".join(y) + " ", whole) - whole
                if bound <= may:
                    return True
    if n > LONG and _anchored(a, b, may) <= may:
        return True
    return common_subsequence(a, b, n - may) >= n - may and distance(a, b, may) <= may


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, line, lid, sig) of every line that is not empty: text hash, line number from 0, line hash and the
    MinHashes of lines that are ``compared``, at least once each. Written once."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))

    def number(batches):
        W.claim("line_dedup")
        seen: set[int] = set()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

        def flush(cols):
            new = {SHORT_RUN: [], RUN: []}
            size, sigs = 0, [None] * len(cols[3])
            for k, (h, x) in enumerate(zip(cols[3], cols[4], strict=True)):
                if h not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    if compared(x):
                        new[RUN if x.count(" ") >= MIN_WORDS - 1 else SHORT_RUN].append(k)
            for run, at in new.items():
                part = []
                for k in [*at, -1]:
                    if part and (k < 0 or size + len(cols[4][k]) > CHARS):
                        got = minhashes([cols[4][i] for i in part], run)
                        for i, s in zip(part, got, strict=True):
                            sigs[i] = s.tobytes()
                        part, size = [], 0
                    if k >= 0:
                        part.append(k)
                        size += len(cols[4][k])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*cols[:4], sigs), kinds, strict=True)], names=["doc_id", "th", "line", "lid", "sig"])

        cols, size = [[], [], [], [], []], 0
        for b in batches:
            for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_py()
                for k, x in enumerate(normal_lines(t)):
                    if x:
                        for c, v in zip(cols, (d, h, k, line_hash(x), x), strict=True):
                            c.append(v)
                size += len(t or "")
                if size > 1_000_000:
                    yield flush(cols)
                    cols, size = [[], [], [], [], []], 0
        if size:
            yield flush(cols)

    return written(rows.mapInArrow(number, "doc_id long, th long, line int, lid long, sig binary"), "line-places")


PAIR, STAR, MEMBER = range(3)


def candidates(lines: DataFrame, n_lines: int) -> DataFrame:
    """(kind, u, v, near), written: ``PAIR`` of lines of a small group to verify, ``STAR`` from a line of a large group to one
    before it that it may be similar to, ``MEMBER`` line u of large group v, whose low 32 bits are the bucket's key. Pairs that
    candidates connect within a key range have one ``near``, the smallest of their lines.

    Map tasks send lines packed by key range."""
    parts = max(8, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = parts * 16
    tables = tables_for(n_lines)

    def send(batches):
        W.claim("line_dedup")
        W.give_back()
        held, n = [], 0

        def flush():
            k, lid, check = (np.concatenate([x[i] for x in held]) for i in range(3))
            p = (W.mix(k.astype(np.uint64)) % np.uint64(ranges)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
            order = np.argsort(p, kind="stable")
            k, lid, check = k[order], lid[order], check[order]
            cols = [[], []]
            for r, s in _pieces(p[order]):
                cols[0].append(r)
                cols[1].append(k[s].tobytes() + lid[s].tobytes() + check[s].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["range", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BINS)
            lid = np.array(b.column(0), np.int64)
            for at in range(0, len(lid), 2000):
                keys, check = table_keys(sig[at : at + 2000], tables)
                held.append((keys.ravel(), np.repeat(lid[at : at + 2000], len(tables)), np.repeat(check, len(tables), axis=0)))
                n += keys.size
                if n > ENTRIES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def meet(batches):
        W.claim("line_dedup")
        W.give_back()
        for _, rows in groups.runs(batches, 1):
            k, lid, check = [], [], []
            for (p,) in rows:
                n = len(p) // (12 + 8 * WORDS)
                k.append(np.frombuffer(p, np.uint32, n))
                lid.append(np.frombuffer(p, np.int64, n, 4 * n))
                check.append(np.frombuffer(p, np.uint64, n * WORDS, 12 * n).reshape(n, WORDS))
            k, lid, check = np.concatenate(k), np.concatenate(lid), np.concatenate(check)
            order = np.argsort(k)
            same = k[order[1:]] == k[order[:-1]]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(k) > 1 else order[:0]
            if not len(order):
                continue
            k, lid, check = k[order], lid[order], check[order]
            order = np.lexsort((lid, k))
            k, lid, check = k[order], lid[order], check[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (lid[1:] != lid[:-1])
            k, lid, check = k[new], lid[new], check[new]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            few = np.repeat(sizes <= NEAR, sizes)
            rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {PAIR: [], STAR: [], MEMBER: []}
            for d in range(1, min(NEAR, int(sizes.max(initial=1)))):
                x = np.flatnonzero((k[d:] == k[:-d]) & few[:-d])
                x = x[agree(check[x], check[x + d])]
                rows[PAIR].append((np.minimum(lid[x], lid[x + d]), np.maximum(lid[x], lid[x + d])))
            for s, n in zip(starts[sizes > NEAR].tolist(), sizes[sizes > NEAR].tolist(), strict=True):
                for group in agreeing_groups(check[s : s + n]) if n <= SPLIT else [np.arange(n)]:
                    rest = group + s
                    if len(rest) <= NEAR:
                        x, y = (rest[z] for z in np.triu_indices(len(rest), 1))
                        near = agree(check[x], check[y])
                        rows[PAIR].append((lid[x[near]], lid[y[near]]))
                        continue
                    rows[MEMBER].append((lid[rest], np.full(len(rest), (int(lid[rest[0]]) & 0x7FFFFFFF) << 32 | int(k[s]), np.int64)))
                    # leaders by their hash: the lines of a group have few of them over all its buckets
                    turns = LEADERS if n > SPLIT else n
                    while len(rest) > 1 and turns:
                        near = agree(check[rest[1:]], check[rest[0]])
                        rows[STAR].append((lid[rest[1:][near]], np.full(int(near.sum()), lid[rest[0]])))
                        rest = rest[1:][~near]
                        turns -= 1
            for kind, found in rows.items():
                if found:
                    ends = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
                    if kind == STAR:
                        ends = ends[np.concatenate(([True], ends[1:, 0] != ends[:-1, 0]))[: len(ends)]]
                    near = ends[:, 1]
                    if kind == PAIR and len(ends):
                        node, least = _settled(ends[:, 0], ends[:, 1])
                        near = least[np.searchsorted(node, ends[:, 0])]
                    for at in range(0, len(ends), 20_000):
                        cols = (ends[at : at + 20_000, 0], ends[at : at + 20_000, 1], near[at : at + 20_000])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], names=["kind", "u", "v", "near"])

    sent = lines.where("sig is not null").select("lid", "sig").mapInArrow(send, "range long, payload binary")
    return written(groups.collected(sent, ["range"]).mapInArrow(meet, "kind int, u long, v long, near long"), "line-candidates")


def _verified(batches, least: float):
    """Verified edges, as few as connect them, of each group of pairs.

    Rows: group, line hash and normalised line, or group, one end, no line and the other end."""
    for _, rows in groups.runs(batches, 1):
        text = {r[0]: r[1] for r in rows if r[1] is not None}
        of = {h: k for k, h in enumerate(sorted(text))}
        lid = list(of)
        union = groups.Union(len(lid))
        for u, x, v in rows:
            if x is None and union.root(of[u]) != union.root(of[v]) and edit_similar(text[u], text[v], least):
                union.join(of[u], of[v])
        ends = [(lid[k], lid[r]) for k in range(len(lid)) if (r := union.root(k)) != k]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends, strict=True)], names=["u", "v"])


def _mixed(batches, tables: list[list[int]], least: float):
    """Verified edges, as few as connect them, between lines of one large bucket that are of different classes.

    Rows: bucket, i, j, side, line hash, class, MinHashes, normalised line. Lines that share a bucket of an
    earlier table too were compared there, or are in its task."""
    for (bucket, i, j), rows in groups.runs(batches, 3):
        rows = list({r[1]: r for r in rows}.values())
        _, of = np.unique([r[2] for r in rows], return_inverse=True)
        lid = np.array([r[1] for r in rows], np.int64)
        keys, check = table_keys(np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, BINS), tables)
        here = int(np.flatnonzero((keys == np.uint32(bucket & 0xFFFFFFFF)).any(axis=0))[0])
        look = np.empty((len(rows), 2 * LOOK), np.uint8)
        for run in (RUN, SHORT_RUN):
            own = [k for k, r in enumerate(rows) if (r[4].count(" ") >= MIN_WORDS - 1) == (run == RUN)]
            for at in range(0, len(own), 200):
                look[own[at : at + 200]] = looks([rows[k][4] for k in own[at : at + 200]], run)
        side = np.array([r[0] for r in rows])
        places: dict[int, dict[str, bytes]] = {}
        u = groups.Union(int(of.max()) + 1)
        part = of.copy()
        a, b = [], []
        for k in range(len(rows) - 1):
            other = (part[k + 1 :] != part[k]) & ((i == j) | (side[k + 1 :] != side[k]))
            at = np.flatnonzero(other) + k + 1
            at = at[agree(check[at], check[k])]
            at = at[alike(look[at], look[k])]
            at = at[~(keys[at, :here] == keys[k, :here]).any(axis=1)]
            at = at[within_reach(rows[k][4], [rows[m][4] for m in at.tolist()], at.tolist(), places, least)]
            for m in at.tolist():
                if u.root(of[m]) != u.root(of[k]) and edit_similar(rows[k][4], rows[m][4], least):
                    u.join(of[k], of[m])
                    part[part == part[m]] = part[k]
                    a.append(lid[k])
                    b.append(lid[m])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def _place():
    """Order of occurrences: null ids last, then id, text hash and line number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")


def spelt(docs: DataFrame, lines: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(lid, norm) of the ``wanted`` lines (lid), each from one of its places. Written once."""
    at = lines.join(wanted, "lid", "left_semi").groupBy("lid").agg(*(F.first(c).alias(c) for c in ("doc_id", "th", "line")))
    by_doc = at.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).agg(F.collect_list(F.struct("lid", "line")).alias("lines"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    met = rows.join(by_doc.hint("shuffle_hash"), (F.col("th") == F.col("__h")) & groups.null_safe("doc_id", "__d"))
    raw = met.select(F.split("text", "\n", -1).alias("all"), F.inline("lines")).select("lid", F.element_at("all", F.col("line") + 1).alias("raw"))

    def fold(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalise(x) for x in b.column(1).to_pylist()], pa.string())], names=["lid", "norm"])

    return written(raw.mapInArrow(fold, "lid long, norm string"), "line-texts")


def line_groups(docs: DataFrame, lines: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(lid, group) of the distinct lines that are similar to others, by the smallest line hash."""
    n_lines = lines.where("sig is not null").count()
    found = candidates(lines, n_lines)
    of_kind = lambda kind: found.where(F.col("kind") == kind)
    # a line of large groups goes to one leader; what that leaves apart meets in ``_mixed``
    stars = of_kind(STAR).groupBy("u").agg(F.min("v").alias("v")).select("u", "v", F.xxhash64("v", F.pmod(F.xxhash64("u"), F.lit(SALT))).alias("near"))
    pairs = written(of_kind(PAIR).groupBy("u", "v").agg(F.min("near").alias("near")).unionAll(stars), "line-pairs")
    large = of_kind(MEMBER).select(F.col("u").alias("lid"), F.col("v").alias("bucket"))
    ends = pairs.select("near", F.explode(F.array("u", "v")).alias("lid")).distinct()
    wanted = ends.select("lid").unionAll(large.select("lid")).distinct()
    texts = spelt(docs, lines, wanted, doc_id, text).dropDuplicates(["lid"])
    rows = ends.join(texts, "lid").select("near", "lid", "norm", F.lit(None).cast("long").alias("other")).unionAll(pairs.select("near", F.col("u").alias("lid"), F.lit(None).cast("string").alias("norm"), F.col("v").alias("other")))
    links = written(groups.collected(rows, ["near"]).mapInArrow(lambda x: _verified(x, least), "u long, v long"), "line-links")
    parts = connected_components(links).select(F.col("node").alias("lid"), F.col("component").alias("group"))
    if large.isEmpty():
        return parts
    parts = written(parts, "line-parts")
    classed = large.join(parts, "lid", "left").select("bucket", "lid", F.coalesce("group", "lid").alias("class"))
    several = classed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("bucket", "size")

    def sign(batches):
        for b in batches:
            x = b.column(1).to_pylist()
            spaced = [t.count(" ") >= MIN_WORDS - 1 for t in x]
            sigs: list[bytes | None] = [None] * len(x)
            for run, kind in ((RUN, True), (SHORT_RUN, False)):
                own = [k for k, z in enumerate(spaced) if z == kind]
                for at in range(0, len(own), 200):
                    for k, sig in zip(own[at : at + 200], minhashes([x[k] for k in own[at : at + 200]], run) if own else (), strict=True):
                        sigs[k] = sig.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary())], names=["lid", "norm", "sig"])

    signed = texts.join(large.select("lid").distinct(), "lid", "left_semi").select("lid", "norm").mapInArrow(sign, "lid long, norm string, sig binary")
    rows = classed.join(several, "bucket").join(signed, "lid").select("bucket", "size", "lid", "class", "sig", "norm")
    tasks = groups.collected(groups.dealt(rows, "bucket", "size", "lid", AT_ONCE), ["bucket", "i", "j"])
    tables = tables_for(n_lines)
    more = written(tasks.mapInArrow(lambda x: _mixed(x, tables, least), "u long, v long"), "line-mixed")
    if more.isEmpty():
        return parts
    # classes are joined, not their lines; a class is named by its smallest line
    for end in ("u", "v"):
        own = parts.select(F.col("lid").alias(end), F.col("group").alias("class"))
        more = more.join(own, end, "left").withColumn(end, F.coalesce("class", end)).drop("class")
    joined = written(connected_components(more).select(F.col("node").alias("group"), F.col("component").alias("into")), "line-classes")
    alone = joined.join(parts, joined["group"] == parts["lid"], "left_anti").select(F.col("group").alias("lid"), F.col("into").alias("group"))
    return parts.join(joined, "group", "left").select("lid", F.coalesce("into", "group").alias("group")).unionAll(alone)


@contextmanager
def settings(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def mark_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, th, drop) of the rows that lose lines: the numbers from 0 of the lines to drop. Written once."""
    with settings(docs.sparkSession):
        lines = line_table(docs, doc_id, text)
        groups_ = written(line_groups(docs, lines, doc_id, text, least), "line-groups")
        at = lines.select("doc_id", "th", "line", "lid")
        # only lines that stand twice or are similar to others are looked at again
        often = at.groupBy("lid").agg(F.count("*").alias("n")).join(groups_, "lid", "left").where("n > 1 or group is not null")
        places = written(at.join(often.select("lid", F.coalesce("group", "lid").alias("group")), "lid").select("doc_id", "th", "line", "group"), "line-repeated")
        heads = places.groupBy("group").agg(F.min(_place()).alias("head"))
        gone = places.join(heads, "group").where(~(F.col("head") == _place()))
        return written(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("drop")), "line-drops")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, n_chars: str | None = None, removed: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, all rows and columns kept.

    Of each group of equal or similar lines the first occurrence stays, by document id (null
    last), text hash and line number. Lines that are too short to be ``compared`` go only if they
    are equal after normalisation; empty lines stay. Of rows that are repeated whole, each is treated alike:
    all keep the lines that one keeps. Null texts stay null; a text all of whose lines go becomes empty. ``n_chars`` names a column
    of the text's length to be renewed where lines went (left alone where docs has no such column), ``removed`` a column for their
    number, which replaces one of that name.
    """
    if removed:
        docs = docs.drop(removed)
    mine = groups.free_names(docs, "d", "h", "drop")
    drop = mark_lines(docs, doc_id, text, least).select(F.col("doc_id").alias(mine[0]), F.col("th").alias(mine[1]), F.col("drop").alias(mine[2]))
    met = docs.join(drop.hint("shuffle_hash"), (F.xxhash64(F.col(text)) == F.col(mine[1])) & F.col(doc_id).cast("long").eqNullSafe(F.col(mine[0])), "left")
    hit = F.col(mine[2]).isNotNull()
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x, k: ~F.array_contains(F.col(mine[2]), k))
    out = met.withColumn(text, F.when(hit, F.array_join(lines, "\n")).otherwise(F.col(text)))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(hit, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(mine[2]), F.lit(0)).cast("long"))
    return out.drop(*mine)
