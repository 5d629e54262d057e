"""Words of a text as 64-bit hashes, and rolling hashes of word windows."""

from __future__ import annotations

import ctypes
import gc
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Odd, so that it can be divided by modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """Hash of a word (bytes); remembers a bounded number of words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()

#: Options of the C library's ``mallopt``, and bytes of a block that is large.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, LARGE = -1, -3, 1 << 20

_owner = [""]
_kept = {"": _hashes.clear}


def claim(owner: str, clear=None) -> None:
    """Python workers run tasks of many stages. At the start of a task of another operator than the last one, what all
    of them keep by module is dropped, so that it does not add up; ``clear`` drops what ``owner`` will keep."""
    if clear is not None:
        _kept[owner] = clear
    sparing()
    if _owner[0] != owner:
        for drop in _kept.values():
            drop()
        _owner[0] = owner
        gc.collect()
        give_back()


@cache
def sparing() -> None:
    """From now on large blocks of this process go back to the system as soon as they are freed: the C library raises the
    size from which they do with each of them that is freed, and Arrow's own allocator keeps what it had."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option in (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD):
            libc.mallopt(option, LARGE)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """What this process has freed goes back to the system, as far as its allocators can tell; else a worker stays as large
    as the largest task that it ran."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for at, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[at] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def split(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    h = h.copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def windows(w: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` words: the polynomial in BASE of their hashes
    modulo 2**64, from prefix sums, then mixed. Equal runs have equal hashes wherever they stand."""
    n = len(w)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(w * down[:n], out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * up[: n - size + 1])
