"""Suffix arrays by prefix doubling, and permuted common prefixes, on numpy arrays.

``suffix_array`` orders the positions by their first seven bytes, and then by the ranks of what follows: each round packs
the ranks at distances 0, h, 2h, ... into one number, so that the known depth h grows threefold or so, and sorts only
positions that are still equal. A round is a handful of passes over whole arrays. ``common_prefixes`` computes the permuted array from the
positions whose left neighbours differ (the irreducible ones); the others follow from the position before.
"""

from __future__ import annotations

import numpy as np


def _bytes_from(text: np.ndarray, n: int, kind: str) -> np.ndarray:
    """For each of the first ``n`` positions of a byte array, the next eight bytes as one number (zeros after the end)."""
    padded = np.concatenate((text, np.zeros(16, dtype=np.uint8)))
    return np.ndarray((n,), kind, padded, 0, (1,)).astype(np.uint64)


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    """True where an entry of a sorted array differs from the one before."""
    new = np.ones(len(sorted_values), dtype=bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return new


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a non-negative integer array (below 2**31 entries), in order (a shorter suffix before a longer one)."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if int(text.max()) < 256:
        # Seven bytes, and how many of them there are: zeros after the end come before real ones.
        key, depth = _bytes_from(text.astype(np.uint8), n, ">u8"), 7
        key &= ~np.uint64(255)
        key |= np.minimum(np.arange(n, 0, -1), depth).astype(np.uint64)
    else:
        key, depth = text, 1
    order = np.argsort(key)
    slots, rank = np.arange(n), np.zeros(n + 1, dtype=np.int64)
    own, key = order, key[order]
    bits = n.bit_length()
    width = min(4, 63 // bits)
    while True:
        # A position's rank is one more than the first place of those that are equal so far; 0 is the end of the text.
        new = _firsts(key)
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        own = order[slots]
        key = rank[own]
        for k in range(1, width):
            key <<= bits
            key |= rank[np.minimum(own + k * depth, n)]
        by_key = np.argsort(key)
        own, key = own[by_key], key[by_key]
        order[slots] = own
        depth *= width


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of a byte array, its common prefix with the suffix that comes before it in order (0 for the first)."""
    n = len(text)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    # Reducible: the symbols to the left agree, so the prefix is that of the position before less one.
    irreducible = (phi <= 0) | (at == 0)
    irreducible |= text[np.maximum(at - 1, 0)] != text[np.maximum(phi - 1, 0)]
    start = np.flatnonzero(irreducible)
    lcp = np.zeros(len(start), dtype=np.int64)
    words = _bytes_from(text, n + 8, "<u8")
    active = np.flatnonzero(phi[start] >= 0)
    a, b = start[active], phi[start[active]]
    while len(active):
        x = words[a] ^ words[b]
        room = n - np.maximum(a, b)
        whole = (x == 0) & (room > 8)
        ended = ~whole
        same = np.zeros(int(ended.sum()), dtype=np.int64)
        left = x[ended]
        for k in range(1, 9):
            same += (left & np.uint64((1 << (8 * k)) - 1)) == 0
        lcp[active[ended]] += np.minimum(same, room[ended])
        active, a, b = active[whole], a[whole] + 8, b[whole] + 8
        lcp[active] += 8
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    plcp = np.zeros(n, dtype=np.int64)
    plcp[start] = lcp
    return np.maximum(plcp[last] - (at - last), 0)
