"""The pipeline against plain rewrites of its stages (see plain.py), stage by stage and as a whole."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

import corpus_pipeline
import plain
from tidelog.llm import bpe, language, mixing, quality

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "mix_to_weights", "encode_bpe"]
    before, outputs = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        outputs.append((before, spark.read.parquet(str(tmp_path / name))))
        before = outputs[-1][1]
        if name != "encode_bpe":
            assert before.columns == docs.columns

    a, b = outputs[0]
    model = quality.fit(a, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: plain.vote(model, r.text.encode()) for r in a.collect() if r.text}
    got = {r.doc_id for r in b.collect()}
    assert all((i in got) == (x >= quality.MIN_SCORE) for i, x in score.items() if abs(x - quality.MIN_SCORE) > 2e-3) and got <= set(score)
    assert 0.5 * a.count() < len(got) < a.count()

    a, b = outputs[1]
    net = language.fit(a)
    top = {r.doc_id: plain.read(net.params, r.text.encode())[0].max() for r in a.collect()}
    got = {r.doc_id for r in b.collect()}
    assert all((i in got) == (x >= language.MIN_PROBABILITY) for i, x in top.items() if abs(x - language.MIN_PROBABILITY) > 1e-4) and len(got) >= 0.97 * a.count()

    a, b = outputs[2]
    root = plain.groups({r.doc_id: r.text for r in a.collect()})
    assert sorted(r.doc_id for r in b.collect()) == sorted(i for i in root if root[i] == i) and b.count() < a.count()

    a, b = outputs[3]
    mixed = {(r.shard * mixing.SHARD_BLOCKS + r.slot, r.text) for r in mixing.mix_sources(a).collect()}
    assert {(r.doc_id, r.text) for r in b.collect()} == mixed

    a, b = outputs[4]
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}, special_tokens={})
    texts = {r.doc_id: r.text for r in a.collect()}
    got = {r.doc_id: r.tokens for r in b.collect()}
    assert got == {k: lib.encode_ordinary(v) for k, v in texts.items()}

    whole = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == got and len(np.unique(list(whole))) == len(whole)
