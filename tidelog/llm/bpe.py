"""Operator 3: byte-level BPE encoding and decoding.

Piece boundaries come from the automaton of pretokenize.py. Equal pieces of a batch
are merged once; results are kept in a bounded cache in each Python worker. New
pieces are merged together, as rows of a matrix: in every round each row merges its
lowest-ranked leftmost pair. Token byte offsets stay beside the tokens, so any span
can be decoded by itself.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.pretokenize import Pieces
from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, list_array, pieces, ragged_range, segment_sum

DEFAULT_VOCABULARY = os.environ.get("TIDELOG_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces that a worker keeps the tokens of, and text bytes of one numpy step: both bound its memory, neither changes a result.
CACHE_PIECES = 150_000
STEP_BYTES = 1 << 20
LONG_PIECE = 64
_NONE = np.int32(2**31 - 1)


def read_vocabulary(path: str) -> bytes:
    """The rank file's bytes; it is shipped to every worker, so its size is checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes is not broadcast")
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks of byte strings; a merged pair is the token of its joined bytes."""

    def __init__(self, file: bytes):
        import pandas as pd

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for k, v in self.ranks.items():
            self.tokens[v] = k
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.array([len(x) for x in self.tokens], np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        keys, values = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._index = pd.Index(np.array(keys, np.int64))
        self._merged = np.array([*values, _NONE], np.int32)
        self.pairs = dict(zip(keys, values, strict=True))
        self.cache: dict[bytes, bytes] = {}

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or the largest int."""
        return self._merged[self._index.get_indexer(a.astype(np.int64) << 32 | b)]

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece by a heap of pairs and a linked list: for long pieces."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n and (m := pairs.get(ids[left] << 32 | ids[nxt[left]])) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[nxt[left]]))
        return [x for x in ids if x >= 0]

    def last_merge(self, token: bytes) -> tuple[int, int]:
        """The pair of tokens that the last merge of these bytes joins."""
        ids = [self.ranks[bytes([b])] for b in token]
        if len(ids) < 2:
            return -1, -1
        pairs = self.pairs
        while len(ids) > 2:
            rank, at = min((pairs.get(ids[i] << 32 | ids[i + 1], 1 << 60), i) for i in range(len(ids) - 1))
            ids[at : at + 2] = [rank]
        return ids[0], ids[1]

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """For every token the two that its last merge joins; -1, -1 for a single byte."""
        left, right = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        own = np.flatnonzero((self.lengths > 1) & (self.lengths <= LONG_PIECE))
        for limit in (4, 8, 16, LONG_PIECE):
            chosen = own[(self.lengths[own] <= limit) & (left[own] < 0)]
            self._merge_block(self.tokens, chosen, limit, [b""] * self.size, (left, right))
        for i in np.flatnonzero(self.lengths > LONG_PIECE).tolist():
            left[i], right[i] = self.last_merge(self.tokens[i])
        return left, right

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """int32 bytes of the tokens of each word."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        done = 0
        for limit in (4, 8, 12, 16, 24, 32, LONG_PIECE):
            chosen = np.flatnonzero((size > done) & (size <= limit))
            done = limit
            for k in range(0, len(chosen), 20_000):
                self._merge_block(words, chosen[k : k + 20_000], limit, out)
        for i in np.flatnonzero(size > LONG_PIECE).tolist():
            out[i] = np.array(self.merge_one(words[i]), np.int32).tobytes()
        return out

    def _merge_block(self, words: list[bytes], chosen: np.ndarray, width: int, out: list[bytes], pairs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Tokens of words[i] for i of chosen into out[i]; into `pairs` the two tokens that are left before the last merge."""
        if not len(chosen):
            return
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in chosen.tolist()), np.uint8).reshape(-1, width)
        count = np.array([len(words[i]) for i in chosen.tolist()])
        ids = self.byte[raw]
        rank = np.full(ids.shape, _NONE, np.int32)  # of the pair that begins here
        columns = np.arange(width)
        r, c = np.nonzero(columns[None, :] < count[:, None] - 1)
        rank[r, c] = self.merged(ids[r, c], ids[r, c + 1])
        where = chosen
        while len(where):
            best = rank.argmin(1)
            rows = np.arange(len(best))
            low = rank[rows, best]
            over = low == _NONE
            if over.any():
                for i, n, row in zip(where[over].tolist(), count[over].tolist(), ids[over], strict=True):
                    out[i] = row[:n].tobytes()
                keep = ~over
                where, count, ids, rank, best, low = where[keep], count[keep], ids[keep], rank[keep], best[keep], low[keep]
                rows = np.arange(len(best))
                if not len(where):
                    return
            if pairs is not None:
                two = count == 2
                pairs[0][where[two]], pairs[1][where[two]] = ids[two, 0], ids[two, 1]
            past = columns[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(past, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(past, rank[:, 1:], rank[:, :-1])
            ids[rows, best] = low
            count = count - 1
            rank[rows, best] = _NONE
            right = np.flatnonzero(best + 1 < count)
            b = best[right]
            rank[right, b] = self.merged(low[right], ids[right, b + 1])
            left = np.flatnonzero(best > 0)
            b = best[left]
            rank[left, b - 1] = self.merged(ids[left, b - 1], low[left])
            rank[rows, count - 1] = _NONE

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all documents, bounds by document)."""
        found = Pieces(data, offsets)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache = self.cache
        got = [cache.get(w) for w in found.unique]
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            words = [found.unique[i] for i in missing]
            for i, w, x in zip(missing, words, self.merge_many(words), strict=True):
                got[i] = x
                cache[w] = x
        sizes = np.array([len(x) for x in got], np.int64) // 4
        flat = np.frombuffer(b"".join(got), np.int32)
        per_piece = sizes[found.codes]
        tokens = flat[ragged_range((np.cumsum(sizes) - sizes)[found.codes], per_piece)]
        per_doc = segment_sum(per_piece, found.bounds)
        return tokens, np.concatenate([[0], np.cumsum(per_doc)])

    def decode_flat(self, tokens: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after another."""
        return self.bytes[ragged_range(self.begin[tokens], self.lengths[tokens].astype(np.int64))]


_loaded: dict[int, Vocabulary] = {}


def vocabulary(file: bytes) -> Vocabulary:
    """One parsed vocabulary a Python worker."""
    key = hash(file)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(file)
    return _loaded[key]


def encode(docs: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, tokens, offsets, round_trip) for every row of `docs`.

    offsets[i] is the byte of the UTF-8 text at which token i begins; round_trip says
    that decoding the tokens gave the text's bytes again. Whole texts are encoded.

    Cases: a null text has null tokens, offsets, n_tokens and round_trip; an empty text
    has empty arrays and 0; repeated rows (and equal or null ids) give a row each; an
    empty table gives no rows; other columns, whatever their names, are not carried.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file.value)
        for batch in pieces(batches, "text", STEP_BYTES):
            data, offsets, null = flat_text(batch.column(1))
            tokens, bounds = v.encode_flat(data, offsets)
            lengths = v.lengths[tokens]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
            begins = ends[:-1] - np.repeat(offsets[:-1], np.diff(bounds))
            back = v.decode_flat(tokens)
            same = np.ones(len(null), bool)
            if len(back) != len(data) or not np.array_equal(ends[bounds], offsets):
                same[:] = False
            else:
                same = segment_sum(back != data, offsets) == 0
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(null, False)), pa.array(x)) for x in (tokens, begins.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int32), mask=null), *lists, pa.array(same, mask=null)], names=["id", "n_tokens", "tokens", "offsets", "round_trip"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = map_arrow(picked, run, f"id {id_type}, n_tokens int, tokens array<int>, offsets array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, text) from token arrays.

    Cases: null tokens give null; an empty array gives ''; null tokens inside an array
    are left out; bytes that are not UTF-8 (a cut inside a character) become U+FFFD; an
    id outside the vocabulary is an error.
    """
    file = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file.value)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                if x.is_valid:
                    ids = np.array([t for t in x.as_py() if t is not None], np.int64) if x.values.null_count else x.values.to_numpy()
                    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
                        raise ValueError("a token id is outside the vocabulary")
                    texts.append(v.decode_flat(ids).tobytes().decode("utf-8", "replace"))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = encoded.select(encoded[id_col].alias("id"), encoded[tokens_col].alias("tokens"))
    return map_arrow(picked, run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
