"""Operators written once more for one text at a time, without arrays and without the operators' own functions."""

from __future__ import annotations

import math
import re

from tidelog.llm import neardup, quality

_M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def elements(text):
    """{hash: count} of word bigrams, of the word if there is one, of the bytes if there is none."""
    raw = text.encode()
    words = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        h = 0
        for i, b in enumerate(c + 32 if 65 <= c <= 90 else c for c in m.group()):
            value = (b + 1) * pow(0x9E3779B97F4A7C15, i & 255, 1 << 64) & _M
            h = h + (value if i < 256 else mix(value + (i >> 8) * 0xD6E8FEB86659FD93 & _M)) & _M
        words.append(mix(h + len(m.group()) & _M))
    if not words:
        hashes = [mix(b + (1 << 40)) for b in raw]
    elif len(words) == 1:
        hashes = [mix(words[0] + 1 & _M)]
    else:
        hashes = [mix(a * 0xD1342543DE82EF95 + b & _M) for a, b in zip(words, words[1:], strict=False)]
    out = {}
    for h in hashes:
        out[h >> 20] = out.get(h >> 20, 0) + 1
    return out


_POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def signature(text, k=neardup.COORDINATES):
    """The earliest dart of each coordinate, dart by dart."""
    bag = elements(text)
    if not bag:
        return (0,) * k
    limit = (k * math.log(k) + 2 * k) / sum(bag.values())
    while True:
        best = {}
        for e, w in bag.items():
            for octave in range(int(math.log2(w)) + 1):
                scale = 2.0**octave
                for cell in range(math.ceil(limit * scale)):
                    seed = mix(e + cell * 0x9E3779B97F4A7C15 + (octave << 58) & _M)
                    u = (seed >> 11) * 2.0**-53
                    for number in range(next((n for n, p in enumerate(_POISSON) if u <= p), 12)):
                        h = mix(seed + (number + 1) * 0xD6E8FEB86659FD93 & _M)
                        across = scale - 1 + scale * ((h >> 11) * 2.0**-53)
                        h = mix(h + 0xA0761D6478BD642F & _M)
                        rank = (cell + (h >> 11) * 2.0**-53) / scale
                        h = mix(h + 0xE7037ED1A0B428DB & _M)
                        if across < w and rank < limit:
                            at = (h >> 32) % k
                            best[at] = min(best.get(at, (math.inf, 0)), (rank, h & 0xFFFFFFFF))
        if len(best) == k:
            return tuple(best[i][1] for i in range(k))
        limit *= 2


def groups(texts, threshold=neardup.THRESHOLD):
    """{id: least id of its group} of {id: text}: all pairs that share a band and agree enough, and pairs of equal signatures."""
    s = {i: signature(t) for i, t in texts.items() if t}
    root = {i: i for i in texts}
    buckets = {}
    for i, own in s.items():
        for b in range(neardup.BANDS):
            buckets.setdefault((b, own[b * neardup.ROWS : (b + 1) * neardup.ROWS]), []).append(i)
    for own in buckets.values():
        for i in own:
            for j in own:
                if j < i and sum(x == y for x, y in zip(s[i], s[j], strict=True)) >= threshold * neardup.COORDINATES:
                    a, b = root[i], root[j]
                    if a != b:
                        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def vector(model, raw):
    """A document's latent-semantic vector, byte by byte and term by term."""
    counts = [0] * quality.FEATURES
    padded = raw + bytes(max(0, 3 - len(raw))) if raw else b""
    for n, odd in ((3, 0x9E3779B1), (6, 0x85EBCA77)):
        for i in range(len(padded) - n + 1):
            h = 0
            for b in padded[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            counts[(h * odd & 0xFFFFFFFF) >> 20] += 1
    total, square = sum(counts), sum(c * c for c in counts)
    terms = [math.log(1 + c) * float(w) if c else 0.0 for c, w in zip(counts, model.weights, strict=True)]
    size = math.sqrt(sum(t * t for t in terms)) or 1
    level = min(max(2 * (min(math.log2(total), quality.PROSE_BITS) - math.log2(total * total / square)), 0), quality.LEVELS - 1)
    terms = [t / size for t in terms] + [quality.TEXTURE_WEIGHT * max(0, 1 - abs(level - k)) for k in range(quality.LEVELS)]
    used = [i for i, t in enumerate(terms) if t]
    v = [sum(terms[i] * float(column[i]) for i in used) for column in model.projection.T]
    size = math.sqrt(sum(x * x for x in v)) or 1
    return [x / size for x in v]


def vote(model, raw):
    """The weighted share of good among the nearest labelled rows."""
    v = vector(model, raw)
    near = sorted(((sum(a * float(b) for a, b in zip(v, row, strict=True)), float(y), float(w)) for row, y, w in zip(model.vectors, model.labels, model.balance, strict=True)), reverse=True)
    k = min(quality.NEIGHBOURS, len(near))
    voters = [x for x in near if x[0] >= near[k - 1][0] - 1e-6 and x[0] > 0]
    return sum(s * w * y for s, y, w in voters) / sum(s * w for s, y, w in voters) if voters else 0.5


def read(p, raw):
    """(mean probabilities, positions labelled) of the network, one position after the other over the whole text."""
    import numpy as np

    def cell(way, h, byte):
        e, u, n = p["E" + way][byte], h @ p["U" + way], len(h)
        sig = lambda x: 1 / (1 + np.exp(-x))
        r, z = sig(e[:n] + u[:n]), sig(e[n : 2 * n] + u[n : 2 * n])
        c = np.tanh(e[2 * n :] + r * (u[2 * n :] + p["c" + way]))
        return (1 - z) * c + z * h

    total, votes, states = np.zeros(len(p["b"])), np.zeros(len(p["b"])), {}
    for way, order in (("f", range(len(raw))), ("b", range(len(raw) - 1, -1, -1))):
        h = np.zeros(len(p["Uf"]))
        for t in order:
            h = cell(way, h, raw[t])
            states[way, t] = h
    for t in range(len(raw)):
        z = states["f", t] @ p["Wf"] + states["b", t] @ p["Wb"] + p["b"]
        e = np.exp(z - z.max())
        total += e / e.sum()
        votes[z.argmax()] += 1
    return total / max(1, len(raw)), votes
