"""Keyed permutations of 0..n-1 without tables: a balanced Feistel network that walks its cycles back into range."""

from __future__ import annotations

import numpy as np

ROUNDS = 4


def _mix(values: np.ndarray, key: int) -> np.ndarray:
    x = (values + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_key(seed: int, step: int) -> int:
    return int(_mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64), step * 0x632BE59BD9B4E019 + 1)[0])


def permute(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Images of `index` (each below `size`) under the permutation of `seed`."""
    values = np.asarray(index).astype(np.uint64)
    if size <= 1:
        return values.astype(np.int64)
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [_round_key(seed, step) for step in range(ROUNDS)]
    out, todo = values.copy(), np.arange(len(values))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)
