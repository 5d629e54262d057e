"""Word shingles of texts as sorted sets of 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np

from silvaspark.llm import words as W

_mul: dict[tuple[int, int], np.ndarray] = {}


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a text of fewer words is one shingle, and
    one without words has none."""
    h = W.hashes(W.split(text))
    if not len(h):
        return h
    return np.unique(W.windows(h, min(size, len(h))))


def signature(s: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """``t`` minima of the set under independent hash functions."""
    if (t, seed) not in _mul:
        rng = np.random.default_rng(seed)
        _mul[t, seed] = rng.integers(0, 1 << 63, (2, t), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = _mul[t, seed]
    out = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(s), 4096):
        x = s[k : k + 4096, None] * a
        x ^= x >> np.uint64(29)
        x *= b
        np.minimum(out, x.min(axis=0), out=out)
    return out


def overlap_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each other set, exact.

    Shingles are columns. A column held by most rows is counted by the rows that lack it, so
    near copies of one text cost about as much as they differ.
    """
    n, m = len(sets), len(others)
    out = np.zeros((n, m), np.int64)
    if not n or not m:
        return out
    va, vb = np.concatenate(sets), np.concatenate(others)
    ra = np.repeat(np.arange(n), [len(s) for s in sets])
    rb = np.repeat(np.arange(m), [len(s) for s in others])
    both = np.intersect1d(va, vb)
    if not len(both):
        return out
    ka, kb = np.isin(va, both), np.isin(vb, both)
    va, ra, vb, rb = va[ka], ra[ka], vb[kb], rb[kb]
    oa, ob = np.argsort(va, kind="stable"), np.argsort(vb, kind="stable")
    ra, rb = ra[oa], rb[ob]
    ca = np.searchsorted(va[oa], both, "left"), np.searchsorted(va[oa], both, "right")
    cb = np.searchsorted(vb[ob], both, "left"), np.searchsorted(vb[ob], both, "right")
    full_a, full_b = ca[1] - ca[0] == n, cb[1] - cb[0] == m
    base = int((full_a & full_b).sum())
    # columns that all rows hold on one side add a count by row of the other
    row_a = np.zeros(n, np.int64)
    row_b = np.zeros(m, np.int64)
    for k in np.flatnonzero(full_b & ~full_a):
        row_a[ra[ca[0][k] : ca[1][k]]] += 1
    for k in np.flatnonzero(full_a & ~full_b):
        row_b[rb[cb[0][k] : cb[1][k]]] += 1
    for k in np.flatnonzero(~full_a & ~full_b):
        x, y = ra[ca[0][k] : ca[1][k]], rb[cb[0][k] : cb[1][k]]
        much_a, much_b = 2 * len(x) > n, 2 * len(y) > m
        if much_a and much_b:  # |X||Y| as 1 - lacking rows, by inclusion and exclusion
            lx, ly = np.setdiff1d(np.arange(n), x), np.setdiff1d(np.arange(m), y)
            base += 1
            row_a[lx] -= 1
            row_b[ly] -= 1
            out[lx[:, None], ly] += 1
        elif much_b:
            ly = np.setdiff1d(np.arange(m), y)
            row_a[x] += 1
            out[x[:, None], ly] -= 1
        elif much_a:
            lx = np.setdiff1d(np.arange(n), x)
            row_b[y] += 1
            out[lx[:, None], y] -= 1
        else:
            out[x[:, None], y] += 1
    return out + base + row_a[:, None] + row_b
