"""Pre-tokenisation for byte-level BPE as a finite automaton over codepoint classes.

The pattern is the published one
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
but no regular expression runs. Every codepoint becomes one of a few symbols (its
class, with the bounded lookahead folded in), every symbol is a transition function
on eight states, and the functions form a small finite monoid. Prefix products of
transition functions are associative, so all documents of a batch are scanned
together: blocks are scanned column by column, block totals are scanned recursively,
and the resulting states say where a piece begins.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, PUNCT, SHORT, LONG, GLUE, LONE, SPACE = range(8)
SYMBOLS = 16  # each symbol again for the first codepoint of a document
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_START, _LETTERS, _NUMBERS, _PUNCTS, _SPACES, _GLUED, _ONE_LEFT, _TWO_LEFT = range(8)


@cache
def class_table() -> np.ndarray:
    """Codepoint -> 0 letter, 1 number, 2 other, 3 white space."""
    table = np.full(0x110000, 2, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = 0
        elif kind == "N":
            table[i] = 1
    table[_WHITE] = 3
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at this codepoint)."""
    if symbol == LETTER:
        if state in (_LETTERS, _GLUED):
            return _LETTERS, False
        if state == _TWO_LEFT:
            return _ONE_LEFT, False
        if state == _ONE_LEFT:
            return _START, False
        return _LETTERS, True
    if symbol == NUMBER:
        return _NUMBERS, state not in (_NUMBERS, _GLUED)
    if symbol in (PUNCT, SHORT, LONG):
        if state in (_PUNCTS, _GLUED):
            return _PUNCTS, False
        return {PUNCT: _PUNCTS, SHORT: _ONE_LEFT, LONG: _TWO_LEFT}[symbol], True
    if symbol == GLUE:
        return _GLUED, True
    if symbol == LONE:
        return _START, True
    return _SPACES, state != _SPACES


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol -> element, flat composition table, flat element x state -> state, flat state x symbol -> begins)."""
    functions: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    plain = [tuple(_step(s, a)[0] for s in range(8)) for a in range(8)]
    symbols = plain + [(f[_START],) * 8 for f in plain]
    todo = []
    for f in symbols:
        if f not in functions:
            functions[f] = len(functions)
            todo.append(f)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                todo.append(h)
    elements = list(functions)
    size = len(elements)
    compose = np.zeros((size, size), np.uint16)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            compose[i, j] = functions[tuple(g[x] for x in f)]
    begins = np.array([[_step(s, a % 8)[1] or a >= 8 for a in range(SYMBOLS)] for s in range(8)])
    return np.array([functions[f] for f in symbols], np.uint16), compose.ravel(), np.array(elements, np.uint8).ravel(), begins.ravel()


def prefix_maps(elements: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix products within blocks, laid out (block, rows), and the map before each row."""
    _, compose, _, _ = monoid()
    size = np.int32(round(len(compose) ** 0.5))
    rows = -(-len(elements) // block)
    padded = np.zeros(rows * block, np.uint16)  # 0 is the identity
    padded[: len(elements)] = elements
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    out = np.empty((block, rows), np.uint16)
    out[0] = columns[0]
    for k in range(1, block):
        np.take(compose, out[k - 1].astype(np.int32) * size + columns[k], out=out[k], mode="clip")
    before = np.zeros(rows, np.uint16)
    if rows > 1:
        inner, inner_before = prefix_maps(out[-1], block)
        whole = compose[inner_before.astype(np.int32)[None, :] * size + inner].T.ravel()[:rows]
        before[1:] = whole[:-1]
    return out, before


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, codepoint) of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        tail = np.concatenate([data, np.zeros(3, np.uint8)])
        p, b = at[wide], cp[wide]
        c1, c2, c3 = (tail[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        cp[wide] = np.where(b < 0xE0, (b & 31) << 6 | c1, np.where(b < 0xF0, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    return at, cp


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a piece begins, for documents data[offsets[i]:offsets[i+1]]."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    at, cp = codepoints(data)
    n = len(cp)
    kind = class_table()[cp]
    first = np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])
    is_first = np.zeros(n + 1, bool)
    is_first[first] = True
    is_first[n] = True
    following = np.full(n, 3, np.uint8)
    following[:-1] = kind[1:]
    following[is_first[1:]] = 3  # the end of a document is as white space
    symbol = np.array([LETTER, NUMBER, PUNCT, SPACE], np.uint8)[kind]
    ends_run = (kind == 3) & (following != 3)
    symbol[ends_run] = np.where(cp[ends_run] == 32, GLUE, LONE)
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        inside = ~is_first[np.minimum(quote + 1, n)]
        q = quote[inside]
        one = cp[q + 1]
        symbol[q[np.isin(one, [115, 116, 109, 100])]] = SHORT
        has2 = ~is_first[np.minimum(q + 2, n)]
        q, one = q[has2], one[has2]
        two = cp[q + 2]
        symbol[q[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = LONG
    symbol[is_first[:n]] += 8
    element, _, apply, begins = monoid()
    maps, before = prefix_maps(element[symbol])
    entry = apply[before.astype(np.int32) * 8]
    after = np.ascontiguousarray(apply[maps.astype(np.int32) * 8 + entry[None, :]].T).ravel()[:n]
    state = np.zeros(n, np.uint8)
    state[1:] = after[:-1]
    return at[begins[state.astype(np.int32) * SYMBOLS + symbol]]


class Pieces:
    """The pieces of a batch, grouped by equal bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts = piece_starts(data, offsets)
        self.lengths = np.diff(np.append(self.starts, len(data)))
        #: pieces[bounds[i]:bounds[i+1]] belong to document i
        self.bounds = np.searchsorted(self.starts, offsets)
        self.codes, first = group_slices(data, self.starts, self.lengths)
        raw = data.tobytes()
        s, e = self.starts[first], self.starts[first] + self.lengths[first]
        self.unique = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def group_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group) by exact bytes."""
    import pandas as pd

    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = words[starts] & mask[np.minimum(lengths, 8)]
    more = np.clip(lengths - 8, 0, 8)
    high = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(more)
    high[some] = words[starts[some] + 8] & mask[more[some]]
    key = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F) + lengths.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    codes, _ = pd.factorize(key)
    codes = codes.astype(np.int64)
    n = len(starts)
    first = np.empty(int(codes.max()) + 1, np.int64)
    first[codes[::-1]] = np.arange(n - 1, -1, -1)
    owner = first[codes]
    odd = np.flatnonzero((lengths > 16) | (low != low[owner]) | (high != high[owner]) | (lengths != lengths[owner]))
    if len(odd):  # longer than two words, or a hash collision: by the bytes themselves
        groups: dict[bytes, int] = {}
        more_first = []
        base = len(first)
        new = np.empty(len(odd), np.int64)
        raw = data.tobytes()
        for k, (i, a, m) in enumerate(zip(odd.tolist(), starts[odd].tolist(), lengths[odd].tolist(), strict=True)):
            g = groups.setdefault(raw[a : a + m], base + len(groups))
            if g - base == len(more_first):
                more_first.append(i)
            new[k] = g
        codes[odd] = new
        first = np.concatenate([first, np.array(more_first, np.int64)])
        used, codes = np.unique(codes, return_inverse=True)  # a group all of whose slices moved is gone
        first = first[used]
    return codes, first
