"""Suffix automaton of a sequence of small integers."""

from __future__ import annotations

import numpy as np


def build(codes: bytes | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(state, symbol, next) of every transition and the number of states; state 0 is the root.

    The automaton accepts exactly the substrings of ``codes``; it has at most 2n states and 3n
    transitions.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    s = np.fromiter((i for i, d in enumerate(nxt) for _ in d), np.int32)
    c = np.fromiter((k for d in nxt for k in d), np.uint8)
    t = np.fromiter((v for d in nxt for v in d.values()), np.int32)
    return s, c, t, len(nxt)
