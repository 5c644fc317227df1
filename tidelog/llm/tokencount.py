"""Operator 7: token counts by a compiled finite-state transducer.

Byte-pair encoding of a piece is read from left to right by a deterministic
transducer. After a prefix p let e(i) be the last token and c(i) the number of
tokens of p[:i]. The next byte b closes exactly one vocabulary token t = p[j:]+b
that may follow e(j), so the only facts a state needs are, for every j where p[j:]
still begins some token, (trie node of p[j:], e(j), c(j) - c(now)). Each transition
emits the change of the count, which may be negative. Transitions are compiled when
text first needs them, all that a step of a batch lacks together, and states merge
when their facts agree (by a 64-bit hash of them); a table that is full is dropped and
rebuilt, as lazy automata do.

Around it stands the pre-tokenisation automaton, whose chunk maps are composed by a
parallel prefix scan (pretokenize.prefix_maps). At every piece boundary the
transducer returns to its initial state, so the map of a piece is constant: a pair
(initial state, emitted count). The maps of all unseen pieces of a batch are run
together, a byte of each in a step. Composing maps of pieces is adding their counts,
done by one prefix sum over the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.bpe import DEFAULT_VOCABULARY, Vocabulary, read_vocabulary, vocabulary
from tidelog.llm.pretokenize import Pieces
from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, pieces, ragged_range, segment_sum
from tidelog.llm.words import mix

MAX_STATES = 120_000
MAX_COUNTS = 300_000
MAX_PAIRS = 2_000_000
#: Pieces that are run together; longer ones are run alone, byte by byte.
TOGETHER = 20_000
LONG_PIECE = 256
_BIAS = 1 << 15


class IntMap:
    """Whole numbers of 0 or more to whole numbers, for arrays of keys: open addressing."""

    def __init__(self, bits: int = 12):
        self.resize(bits)

    def resize(self, bits: int) -> None:
        self.shift, self.mask, self.used = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        at = self._home(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not there, each once."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            old = self.keys >= 0
            kept, known = self.keys[old], self.values[old]
            self.resize(int((self.used + len(keys)) * 4).bit_length())
            self.add(kept, known)
        self.used += len(keys)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several that want one place the last has it
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask


class Grown:
    """An array of whole numbers that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1024, np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), np.int64)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Transducer:
    """Counting transducer of a vocabulary; transition (state << 8 | byte) -> (next state << 16 | emitted + 2**15)."""

    def __init__(self, v: Vocabulary):
        self.v = v
        children: dict[int, int] = {}
        token_at = [-1]
        for token, rank in v.ranks.items():
            node = 0
            for b in token:
                nxt = children.get(node << 8 | b)
                if nxt is None:
                    nxt = children[node << 8 | b] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = rank
        self.token_at = np.array(token_at, np.int64)
        keys = np.fromiter(children, np.int64, len(children))
        self.children = IntMap()
        self.children.add(keys, np.fromiter(children.values(), np.int64, len(children)))
        self.has_children = np.zeros(len(token_at), bool)
        self.has_children[keys >> 8] = True
        self.left, self.right = v.halves()
        self.may_follow = IntMap()
        self.counts: dict[bytes, int] = {}
        self.flush()

    def flush(self) -> None:
        """Only the initial state: the root of the trie after no token."""
        self.nodes, self.last, self.ago = Grown(), Grown(), Grown()
        self.begins = Grown()
        self.begins.extend(np.zeros(1, np.int64))
        self.state_of, self.table = IntMap(), IntMap()
        self.alone: dict[int, int] = {}  # transitions for pieces that are run by themselves
        self.states_for(np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64))

    def states(self) -> int:
        return self.begins.n - 1

    def states_for(self, node: np.ndarray, last: np.ndarray, ago: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """States of facts: those of the i-th begin at begin[i]. New ones are added."""
        size = np.diff(np.append(begin, len(node)))
        place = np.arange(len(node)) - np.repeat(begin, size)
        h = mix(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((last + 2).astype(np.uint64) + (place.astype(np.uint64) << np.uint64(40))) + (ago + _BIAS).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        key = (mix(np.add.reduceat(h, begin) + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        state = self.state_of.find(key)
        lacking = np.flatnonzero(state < 0)
        if len(lacking):
            new, first = np.unique(key[lacking], return_index=True)
            which = lacking[first]
            at = ragged_range(begin[which], size[which])
            self.state_of.add(new, self.states() + np.arange(len(new)))
            self.begins.extend(self.nodes.n + np.cumsum(size[which]))
            for grown, values in ((self.nodes, node), (self.last, last), (self.ago, ago)):
                grown.extend(values[at])
            state[lacking] = self.state_of.find(key[lacking])
        return state

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two tokens, side by side, are the encoding of their bytes; -1 is the beginning."""
        out = np.ones(len(a), bool)
        pair = np.flatnonzero(a >= 0)
        key = a[pair] << 32 | b[pair]
        known = self.may_follow.find(key)
        lacking = np.flatnonzero(known < 0)
        if len(lacking):
            if self.may_follow.used > MAX_PAIRS:
                self.may_follow = IntMap()
                lacking = np.arange(len(key))
            new = np.unique(key[lacking])
            self.may_follow.add(new, self.splits(new >> 32, new & 0xFFFFFFFF).astype(np.int64))
            known[lacking] = self.may_follow.find(key[lacking])
        out[pair] = known > 0
        return out

    def splits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges next to the seam, latest first: the seam holds if no pair across it would have been merged before."""
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        out, todo = np.zeros(len(a), bool), np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            joined = self.v.merged(x, y)
            todo = todo[(joined == _NEVER) | (joined >= limit[todo])]
            x, y = a[todo], b[todo]
            left, right = self.right[x], self.left[y]
            whole = (left < 0) & (right < 0)
            out[todo[whole]] = True
            # what was made last is undone first; equal ranks merge from the left, so b's merge also forbids its own rank across the seam
            by_left = (right < 0) | (left >= 0) & (x > y)
            limit[todo] = np.where(by_left, x, y + 1)
            a[todo], b[todo] = np.where(by_left, left, x), np.where(by_left, y, right)
            todo = todo[~whole]
        return out

    def compile(self, keys: np.ndarray) -> None:
        """Adds the transitions of keys that the table lacks, each once."""
        state, byte = keys >> 8, keys & 255
        begin = self.begins.data[state]
        size = self.begins.data[state + 1] - begin
        at, owner = ragged_range(begin, size), np.repeat(np.arange(len(keys)), size)
        nxt = self.children.find(self.nodes.data[at] << 8 | byte[owner])
        there = np.flatnonzero(nxt >= 0)
        nxt, owner = nxt[there], owner[there]
        last, ago = self.last.data[at[there]], self.ago.data[at[there]]
        token = self.token_at[nxt]
        closes = np.flatnonzero(token >= 0)
        closes = closes[self.follows(last[closes], token[closes])]
        owners, first = np.unique(owner[closes], return_index=True)  # facts stand by their beginning, so the first is the longest token
        if len(owners) < len(keys):
            raise ValueError("no token ends here: the vocabulary lacks a single byte")
        closes = closes[first]
        change = ago[closes] + 1
        kept = np.flatnonzero(self.has_children[nxt])
        many = np.bincount(owner[kept], minlength=len(keys)) + 1
        ends = np.cumsum(many)
        node, new_last, new_ago = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int64)
        new_last[ends - 1] = token[closes]
        rest = np.ones(ends[-1], bool)
        rest[ends - 1] = False
        node[rest], new_last[rest], new_ago[rest] = nxt[kept], last[kept], ago[kept] - change[owner[kept]]
        target = self.states_for(node, new_last, new_ago, ends - many)
        self.table.add(keys, target << 16 | change + _BIAS)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of (state << 8 | byte)."""
        out = self.table.find(keys)
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            self.compile(np.unique(keys[lacking]))
            out[lacking] = self.table.find(keys[lacking])
        return out

    def count_together(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each piece: a byte of every piece in each step."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = (np.cumsum(size) - size)[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active = len(words) - np.cumsum(np.bincount(size))  # pieces longer than each length
        for k in range(int(size.max())):
            n = int(active[k])
            value = self.step(state[:n] << 8 | data[begin[:n] + k])
            state[:n] = value >> 16
            total[:n] += (value & 0xFFFF) - _BIAS
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out

    def count_alone(self, piece: bytes) -> int:
        """Tokens of one long piece."""
        state = total = 0
        for byte in piece:
            key = state << 8 | byte
            value = self.alone.get(key)
            if value is None:
                if self.states() > 2 * MAX_STATES:  # keep only the state it is in
                    a, b = self.begins.data[state : state + 2]
                    here = [g.data[a:b].copy() for g in (self.nodes, self.last, self.ago)]
                    self.flush()
                    key = int(self.states_for(*here, np.zeros(1, np.int64))[0]) << 8 | byte
                value = self.alone[key] = int(self.step(np.array([key]))[0])
            state = value >> 16
            total += (value & 0xFFFF) - _BIAS
        return total

    def count(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words])
        short = np.flatnonzero(size <= LONG_PIECE)
        for k in range(0, len(short), TOGETHER):
            if self.states() > MAX_STATES:
                self.flush()
            own = short[k : k + TOGETHER]
            out[own] = self.count_together([words[i] for i in own.tolist()])
        for i in np.flatnonzero(size > LONG_PIECE).tolist():
            if self.states() > MAX_STATES:
                self.flush()
            out[i] = self.count_alone(words[i])
        return out

    def count_flat(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document data[offsets[i]:offsets[i+1]]."""
        found = Pieces(data, offsets)
        if len(self.counts) > MAX_COUNTS:
            self.counts.clear()
        known = self.counts
        out = np.array([known.get(w, -1) for w in found.unique], np.int64)
        unseen = np.flatnonzero(out < 0)
        if len(unseen):
            words = [found.unique[i] for i in unseen.tolist()]
            out[unseen] = self.count(words)
            known.update(zip(words, out[unseen].tolist(), strict=True))
        return segment_sum(out[found.codes] if len(out) else np.zeros(0, np.int64), found.bounds)


_NEVER = 2**31 - 1
_built: dict[int, Transducer] = {}


def transducer(file: bytes) -> Transducer:
    key = hash(file)
    if key not in _built:
        _built.clear()
        _built[key] = Transducer(vocabulary(file))
    return _built[key]


def token_counts(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, n_bytes long) for every row, over whole texts.

    Cases: a null text has null counts; an empty text has 0 and 0; repeated rows and
    equal or null ids give a row each; an empty table gives no rows; other columns are
    not carried, so their names cannot clash.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(file.value)
        for batch in pieces(batches, "text"):
            data, offsets, null = flat_text(batch.column(1))
            counts = machine.count_flat(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, mask=null), pa.array(np.diff(offsets), mask=null)], names=["id", "n_tokens", "n_bytes"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(picked, run, f"id {id_type}, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)
