"""Operators 3 and 7 against a public tokenizer library, and round trips."""

from __future__ import annotations

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bpe, pretokenize, tokencount
from tidelog.llm.textbatch import flat_text, pieces

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MULTI = bpe.DEFAULT_VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=[bpe.DEFAULT_VOCABULARY, MULTI])
def both(request):
    file = bpe.read_vocabulary(request.param)
    return bpe.Vocabulary(file), tokencount.Transducer(bpe.Vocabulary(file)), library(request.param)


def hard_texts():
    rng = random.Random(5)
    alphabet = "ab cst'lrevmdLS  \n\t0129.,!?éß中文'' İ🙂\r\x85_- \x00"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(3000)] + ["a" * 400, "  " * 300, "", "don't we'll 'sx 's's ''s", "=" * 2000, "x" * 65 + "yz" * 60, "\n\n\n", " 's", "'ll've"]


def encode_all(v, texts):
    data, offsets, _ = flat_text(pa.array(texts))
    tokens, bounds = v.encode_flat(data, offsets)
    return [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_tokens_equal_the_library(both):
    v, machine, lib = both
    texts = hard_texts()
    want = [lib.encode_ordinary(t) for t in texts]
    assert encode_all(v, texts) == want
    data, offsets, _ = flat_text(pa.array(texts))
    assert machine.count_flat(data, offsets).tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=12))
def test_any_text(texts):
    file = bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)
    v, machine, lib = bpe.vocabulary(file), tokencount.transducer(file), library(bpe.DEFAULT_VOCABULARY)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [lib.encode_ordinary(t) for t in texts]
    assert encode_all(v, texts) == want
    for t, ids in zip(texts, want, strict=True):
        assert v.decode_flat(np.array(ids, np.int64)).tobytes() == t.encode()
    data, offsets, _ = flat_text(pa.array(texts, pa.string()))
    assert machine.count_flat(data, offsets).tolist() == [len(x) for x in want]


def test_bounded_tables_do_not_change_counts(both, monkeypatch):
    _, machine, lib = both
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    machine.flush()
    machine.counts.clear()
    texts = hard_texts()[:400] + ["qwrtzpsdf" * 300]
    data, offsets, _ = flat_text(pa.array(texts))
    assert machine.count_flat(data, offsets).tolist() == [len(lib.encode_ordinary(t)) for t in texts]


def test_the_scan_is_the_automaton():
    """The parallel prefix scan against one state after the other."""
    text = "".join(hard_texts()[:200])
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = pretokenize.piece_starts(data, np.array([0, len(data)]))
    lib = library(bpe.DEFAULT_VOCABULARY)
    import regex

    want = [len(text[: m.start()].encode()) for m in regex.finditer(lib._pat_str, text)]
    assert cuts.tolist() == want


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 100, 1, 0, 50)])], names=["t"])
    parts = list(pieces(iter([batch]), "t", 60))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and len(parts) > 2


def test_encode_and_decode_frames(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = bpe.encode(docs)
    rows = encoded.collect()
    lib = library(bpe.DEFAULT_VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.tokens == lib.encode_ordinary(texts[r.doc_id]) and r.round_trip
        sizes = [len(lib.decode_single_token_bytes(t)) for t in r.tokens]
        assert r.offsets == [sum(sizes[:i]) for i in range(min(len(sizes), 50))] + r.offsets[50:]
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == texts
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in rows}


def test_decode_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 64])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == {1: None, 2: "", 3: "a"}
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, tokens array<int>")).collect()
