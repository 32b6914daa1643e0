"""Suffix order by the difference cover {1, 2} mod 3, in array operations, down to a given depth."""

from __future__ import annotations

import numpy as np


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of non-negative keys, equal ones by place, and the keys in it."""
    bits = max(1, len(keys)).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort(keys << bits | np.arange(len(keys)))
    return both & ((1 << bits) - 1), both >> bits


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1, equal keys equal."""
    order, keys = _sorted(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], keys[1:] != keys[:-1]]))
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-preserving single keys of pairs of small numbers."""
    return a * (int(b.max(initial=0)) + 1) + b


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All positions ordered by the ``depth`` symbols from each on; beyond the depth the order is arbitrary.

    Triples at the positions 1 and 2 mod 3 are sorted and named; if names repeat and the depth needs it, the string
    of names is ordered by recursion. Their ranks then order the positions 0 mod 3, and all three classes are merged
    by pairwise ranks. Positions that agree to the depth are neighbours in the result.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(symbols[i : i + depth])), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    one = np.arange(1, n + (n % 3 == 1), 3)  # a dummy at n keeps the two halves of the sample apart
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _rank(_pair(_rank(_pair(s[sample], s[sample + 1])) if s.max() > 2**20 else _pair(s[sample], s[sample + 1]), s[sample + 2]))
    if depth > 3 and names.max() < len(sample):
        order = suffix_order(names, -(-depth // 3))
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    del names, sample

    zero, one = np.arange(0, n, 3), one[one < n]
    both = np.concatenate([zero, one])
    first = _rank(_pair(s[both], rank[both + 1]))
    r0, r1 = first[: len(zero)], first[len(zero) :]
    with_one = np.zeros(n + 3, np.int64)
    with_one[zero], with_one[one] = r0, r1
    other = np.concatenate([zero, two])
    second = _rank(_pair(s[other], with_one[other + 1]))
    q0, q2 = second[: len(zero)], second[len(zero) :]

    def below(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(theirs, minlength=int(max(mine.max(initial=0), theirs.max(initial=0))) + 2))[mine - 1]

    def own(x: np.ndarray) -> np.ndarray:
        return below(x, x)

    place = np.empty(n, np.int64)
    m1, m2 = rank[one], rank[two]
    place[zero] = own(q0) + below(r0, r1) + below(q0, q2)
    place[one] = own(m1) + below(r1, r0) + below(m1, m2)
    place[two] = own(m2) + below(m2, m1) + below(q2, q0)
    return _sorted(place)[0]


def equal_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class number for each start: equal where the ``length`` bytes from there on are equal.

    The starts are put in suffix order and the prefixes of neighbours compared.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = suffix_order(data.astype(np.int64) + 1, length)
    order = order[wanted[order]]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    same = np.ones(len(order) - 1, bool)
    offsets = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data), 8), (1, 1))
    for k in offsets:
        w = np.ascontiguousarray(words[np.minimum(order + k, len(data) - 1)]).view(np.uint64).reshape(-1)
        same &= w[1:] == w[:-1]
    if not offsets:
        for k in range(length):
            w = padded[order + k]
            same &= w[1:] == w[:-1]
    out = np.empty(len(data), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~same]))
    return out[starts]
