"""Hashed n-grams of a text's bytes and hashes of its words, by array operations."""

from __future__ import annotations

import numpy as np

_BLANK = bytes(32 if c in b"\t\n\x0b\x0c\r " else c for c in range(256))
_TABLE = np.random.default_rng(20_240_601).integers(0, 1 << 63, (64, 256), dtype=np.uint64) | np.uint64(1)


def folded(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes with one kind of blank, one more at both ends."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" ", dtype=np.uint8)


def gram_buckets(raw: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket (of 2**bits) of every n-gram of the given sizes."""
    out, code = [], raw.astype(np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(257) + raw[n - 1:] + np.uint32(n)
        if n in sizes:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2_654_435_761)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each blank-separated word; depends on bytes and places."""
    solid = np.flatnonzero(raw != 32)
    if not solid.size:
        return np.zeros(0, np.uint64)
    first = np.concatenate(([True], np.diff(solid) > 1))
    starts = np.flatnonzero(first)
    place = np.arange(solid.size) - np.repeat(starts, np.diff(np.append(starts, solid.size)))
    parts = _TABLE[place & 63, raw[solid]] * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    total = np.add.reduceat(parts, starts)
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)
