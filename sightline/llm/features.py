"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters of a text that are hashed at once, so that memory stays bounded for very long texts.
BLOCK = 1 << 20


def chars(text: str | None) -> np.ndarray:
    """Code points, lower case, a space at both ends."""
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket numbers below 2 ** bits of all n-grams of the sizes."""
    out = []
    for n in sizes:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n * 0x51ED270B & 0xFFFFFFFF, "u4")
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, "u4")


def blocks(text: str | None, sizes: tuple[int, ...], bits: int):
    """The n-grams of a text in blocks that overlap just so that each n-gram is in one."""
    points = chars(text)
    if len(points) <= BLOCK:
        yield grams(points, sizes, bits)
        return
    for n in sizes:
        for k in range(0, len(points) - n + 1, BLOCK):
            yield grams(points[k : k + BLOCK + n - 1], (n,), bits)


def distinct(text: str | None, sizes: tuple[int, ...], bits: int, seen: np.ndarray, segment: int):
    """The distinct buckets of each segment of a text, one after the other; no n-gram is lost between segments.

    seen: scratch of 2 ** bits ints, any content."""
    points = chars(text)
    for k in range(0, len(points), segment):
        h = grams(points[k : k + segment + max(sizes) - 1], sizes, bits)
        at = np.arange(len(h), dtype=seen.dtype)
        seen[h] = at
        yield h[seen[h] == at]
