"""Suffix sorting by a difference cover (positions 1 and 2 modulo 3), in NumPy.

Sample suffixes are named by their leading symbols and, while names repeat, sorted by
recursion on the string of names; the remaining suffixes follow from one symbol and a
sample rank; the three sorted classes are then merged by counting.
"""

from __future__ import annotations

import numpy as np


def _ranks_of(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of non-negative integers, from 0."""
    key = keys[0].astype(np.uint64)
    top = int(key.max(initial=0)) + 1
    for k in keys[1:]:
        more = int(k.max(initial=0)) + 1
        if top * more >= 1 << 63:
            _, key = np.unique(key, return_inverse=True)
            key = key.astype(np.uint64)
            top = int(key.max(initial=0)) + 1
        key = key * np.uint64(more) + k.astype(np.uint64)
        top *= more
    order = np.argsort(key)
    step = np.zeros(len(key), np.int64)
    sorted_ = key[order]
    step[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_array(s: np.ndarray, leading: np.ndarray | None = None) -> np.ndarray:
    """Order of all suffixes of ``s`` (integers from 1; past the end counts as 0).

    ``leading`` may give, for each position, any integer that orders suffixes by their
    first three symbols or more; names made from it repeat less often.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    one = np.arange(1, n + (n % 3 == 1), 3)  # a dummy at n when n % 3 == 1 ends the first half
    two = np.arange(2, n, 3)
    sample = np.append(one, two)
    if leading is None:
        names = _ranks_of(t[sample], t[sample + 1], t[sample + 2])
    else:
        names = _ranks_of(np.append(leading, np.zeros(1, leading.dtype))[sample])
    if names.max() + 1 < len(sample):
        names[suffix_array(names + 1)] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names + 1

    by_rank = np.empty(len(sample), np.int64)
    by_rank[names] = sample
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    width = np.int64(n + 3)
    zero_key = t[zero] * width + rank[zero + 1]
    zero = zero[np.argsort(zero_key)]

    # Merge: the place of a suffix is the number of suffixes of each class before it.
    top = int(t.max()) + 1
    pair = t[:n] * top + t[1 : n + 1] if top * top * (n + 3) < 1 << 63 else _ranks_of(t[:n], t[1 : n + 1])
    short = lambda p: t[p] * width + rank[p + 1]
    long = lambda p: pair[p] * width + rank[p + 2]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    place0 = np.arange(len(zero)) + np.searchsorted(short(ones), short(zero)) + np.searchsorted(long(twos), long(zero))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place0] = False
    out[place0] = zero
    out[free] = by_rank  # samples keep their own order
    return out


def eights(b: np.ndarray) -> np.ndarray:
    """Of every position of a byte array, the next eight bytes as one big-endian number, zeros after the end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray(len(b), ">u8", padded.data, 0, (1,)).astype(np.uint64)


def same_prefix(b: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Whether b[i:i+size] == b[j:j+size], pair by pair; pairs that differ early drop out early."""
    words, out = eights(b), np.zeros(len(i), bool)
    left = np.arange(len(i))
    for k in range(0, size, 8):
        drop = np.uint64(8 * max(0, k + 8 - size))  # bits of the last word beyond the prefix
        left = left[words[i[left] + k] >> drop == words[j[left] + k] >> drop]
    out[left] = True
    return out
