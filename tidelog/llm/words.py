"""Words of UTF-8 text as numpy arrays: runs of letters, digits and bytes above 127, lower-cased in ASCII."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FOLD = np.zeros(256, np.uint64)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b >= 128:
        _FOLD[_b] = ord(chr(_b).lower()) + 1 if _b < 128 else _b + 1
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_MULTIPLIER, k, 1 << 64) for k in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    bounds: np.ndarray  # words[bounds[i]:bounds[i+1]] belong to document i


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    value = _FOLD[data]
    inside = value != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = inside[edge]  # a document begins a word of its own
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(last) + 1
    hashes = span_hashes(value, starts) + (ends - starts).astype(np.uint64)
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def span_hashes(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A polynomial hash of value[starts[i]:starts[i+1]] for every i; zeros at the end of a span do not count. Changes value."""
    place = _places(len(value), starts)
    far = np.flatnonzero(place > 255)
    some = value[far] != 0
    value *= _POWERS[place & 255]
    if len(far):  # beyond the table of powers
        value[far] = mix(value[far] + (place[far] >> 8).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * some
    return np.add.reduceat(value, starts)


def _places(n: int, starts: np.ndarray) -> np.ndarray:
    place = np.arange(n)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    return place


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every n words in a row within one document, by a rolling polynomial over word hashes."""
    count = len(w.hashes)
    if count < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(count - n + 1, np.uint64)
    for k in range(n):
        h *= np.uint64(0xD1342543DE82EF95)
        h += w.hashes[k : count - n + 1 + k]
    owner = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    first = np.flatnonzero(owner[: count - n + 1] == owner[n - 1 :])
    return first, mix(h[first])
