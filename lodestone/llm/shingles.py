"""Five-word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are looked at together; a longer text is cut between two words.
PART = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code point below ``size``: whether it is a letter or digit (1), white space (2) or neither, and a number for it."""
    kinds = np.fromiter((1 if c.isalnum() else 2 if c.isspace() else 0 for c in map(chr, range(size))), np.uint8, size)
    return kinds, mixed(np.arange(1, size + 1, dtype=np.uint64) * _STEP)


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD1342543DE82EF95, np.uint64))


def words(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order: of each run without white space its letters and digits, in lower case. A run without any is no word.

    All characters are hashed at once: a word's hash is the sum of its characters' numbers, each times a power for its place.
    """
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, numbers = _tables(0x250 if points.max() < 0x250 else 0x10000 if points.max() < 0x10000 else 0x110000)
    out = []
    while len(points):
        kind = kinds[points[:PART]]
        if len(points) > PART:
            spaces = np.flatnonzero(kind == 2)
            if len(spaces):
                kind = kind[: spaces[-1] + 1]
            else:  # a word without an end in sight
                kind = kinds[points]
        at = np.flatnonzero(kind == 1)
        if len(at):
            token = np.cumsum(kind == 2, dtype=np.int32)[at]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            lengths = np.diff(np.r_[starts, len(at)])
            place = np.arange(len(at)) - np.repeat(starts, lengths)
            longest = 1 << int(lengths.max() - 1).bit_length()
            h = np.add.reduceat(numbers[points[at]] * _powers(max(64, longest))[place], starts)
            h = mixed(h + lengths.astype(np.uint64) * _STEP)
            h[h == 0] = 1
            out.append(h)
        points = points[len(kind) :]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_key(h: np.ndarray) -> bytes:
    """128-bit key under which texts of the same words meet."""
    return xxhash.xxh3_128_digest(h.tobytes())


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each run of ``width`` words; a shorter text with words is one shingle."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _STEP + h[k : len(h) - width + 1 + k]
    return mixed(out)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each is in the text."""
    return np.unique(h, return_counts=True)
