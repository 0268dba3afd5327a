"""Vectorised 64-bit hashing of byte ranges, for operators that hash every word or window of a text.

A text is a uint8 array. ``prefix_sums`` gives wrap-around sums of ``table[byte] * INV**position``;
the difference of two of them, scaled back by ``BASE**start``, depends only on the bytes between, so the
hash of any range costs O(1) and whole arrays of ranges are hashed at once. All functions are pure and
give the same values on every machine.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def splitmix(x: np.ndarray) -> np.ndarray:
    """Scramble uint64 values (a bijection), so that their order and low bits look random."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_TABLE = splitmix(np.arange(256, dtype=U64)) | U64(1)


def _powers(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse modulo 2**64; kept and grown per process."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "base" else _INV, dtype=U64)
        steps[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """len(data) + 1 running sums for :func:`range_hash`."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_TABLE[data] * _powers("inv", len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for arrays of starts and ends."""
    base = _powers("base", len(sums))
    return splitmix((sums[end] - sums[start]) * base[start] ^ (end - start).astype(U64))


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns of hashes, in order."""
    out = splitmix(parts[0].astype(U64))
    for part in parts[1:]:
        out = splitmix(out * U64(0xD6E8FEB86659FD93) + part.astype(U64))
    return out


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]
