"""Compressed bitmaps over key ranges of 65,536, after the container scheme of the public Roaring format."""

from __future__ import annotations

import numpy as np

RANGE_BITS = 16
SPAN = 1 << RANGE_BITS
#: Up to so many set bits a container is a sorted array of 16-bit positions, beyond that packed bits.
ARRAY_LIMIT = 4096


def container(positions: np.ndarray) -> np.ndarray:
    """The positions' container: uint16 (sorted, distinct) or uint8 (packed bits)."""
    positions = np.unique(positions).astype(np.uint16)
    if len(positions) <= ARRAY_LIMIT:
        return positions
    bits = np.zeros(SPAN, np.uint8)
    bits[positions] = 1
    return np.packbits(bits)


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == b.dtype == np.uint8:
        return a | b
    return container(np.concatenate([decode(a), decode(b)]))


def and_not(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of ``a`` that ``b`` lacks."""
    if a.dtype == np.uint8:
        if b.dtype == np.uint8:
            return container(decode(a & ~b))
        bits = np.unpackbits(a)
        bits[b] = 0
        return container(np.flatnonzero(bits))
    if b.dtype == np.uint8:
        return a[(b[a >> 3] >> (7 - (a & 7)) & 1) == 0]
    return np.setdiff1d(a, b, assume_unique=True)


def decode(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(a)).astype(np.uint16) if a.dtype == np.uint8 else a
