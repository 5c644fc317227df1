"""Operators 6 and 10: brute force, gradients, held-out accuracy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

import plain
from tidelog.llm import language, quality
from tidelog.llm.textbatch import flat_text


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, docs.join(labels, "doc_id").toPandas().drop_duplicates("text").reset_index(drop=True)


def test_votes_by_brute_force(labelled):
    table = labelled[2]
    model = quality.fit_model(list(table.text[:150]), list(table.quality[:150]))
    texts = list(table.text[150:200])
    data, offsets, _ = flat_text(pa.array(texts))
    got = quality.score_flat(model, data, offsets)
    for text, score in zip(texts, got, strict=True):
        raw = text.encode()
        counts = np.zeros(quality.FEATURES)
        for n, odd in ((3, 0x9E3779B1), (6, 0x85EBCA77)):
            for i in range(len(raw) - n + 1):
                h = 0
                for b in raw[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
                counts[(h * odd & 0xFFFFFFFF) >> 20] += 1
        v = quality.weigh(counts[None].astype(np.float32), model.weights) @ model.projection
        v = v[0] / np.linalg.norm(v[0])
        near = sorted(((float(v @ r), y, w) for r, y, w in zip(model.vectors, model.labels, model.balance, strict=True)), reverse=True)
        voters = [x for x in near if x[0] >= near[quality.NEIGHBOURS - 1][0] - 1e-6 and x[0] > 0]
        want = sum(s * w * y for s, y, w in voters) / sum(s * w for s, y, w in voters)
        assert math.isclose(score, want, abs_tol=2e-3)


def test_scores_without_the_codes_own_functions(labelled):
    table = labelled[2]
    model = quality.fit_model(list(table.text[:80]), list(table.quality[:80]))
    texts = ["a", "é", "ab", "abc", "abcde", "aaaaaa", *(t[:400] for t in table.text[150:156])]
    data, offsets, _ = flat_text(pa.array(texts))
    for text, score in zip(texts, quality.score_flat(model, data, offsets), strict=True):
        assert math.isclose(score, plain.vote(model, text.encode()), abs_tol=2e-3)


def test_short_texts_are_judged(spark, labelled):
    model = quality.fit(labelled[0], labelled[1], per_label=60)
    rows = [(1, "a"), (2, "é"), (3, "ab"), (4, ""), (5, None), (6, "abc")]
    got = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(0 <= got[i] <= 1 for i in (1, 2, 3, 6)) and got[4] is None and got[5] is None


def test_the_sample_is_bounded_where_ids_repeat(spark):
    """However often a labelled id stands, one text of it reaches the driver."""
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.labelled_rows(docs, labels, "doc_id", "text", "quality", 20) == (["text 0", "other"], [1, 0])
    tagged = spark.createDataFrame([(1, "wort", "de")] * 800 + [(2, "word", "en")] * 5, "doc_id long, text string, lang string")
    assert sorted(zip(*language.training_rows(tagged, "lang", "text", "doc_id", 1000), strict=True)) == [(b"word", "en"), (b"wort", "de")]


def test_quality_on_held_out_rows(labelled):
    table = labelled[2].sample(frac=1, random_state=4)
    train, test = table[:250], table[250:]
    model = quality.fit_model(list(train.text), list(train.quality))
    data, offsets, _ = flat_text(pa.array(list(test.text)))
    keep = quality.judge(model, data, offsets, quality.MIN_SCORE)[1]
    good = test.quality.to_numpy() == 1
    assert keep[good].mean() >= 0.97 and (~keep[~good]).mean() >= 0.8


def test_the_sample_is_bounded_and_needs_agreeing_labels(spark, labelled):
    docs, labels, _ = labelled
    texts, values = quality.labelled_rows(docs, labels, "doc_id", "text", "quality", 20)
    assert values.count(0) <= 20 and values.count(1) <= 20 and min(values.count(0), values.count(1)) >= 10
    torn = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int")
    assert quality.labelled_rows(docs, torn, "doc_id", "text", "quality", 20) == ([], [])


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language.initial(["a", "b", "c"], 4, rng).items()}
    x, y, mask = rng.integers(0, 257, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4))
    mask[5, 2] = 0
    _, g = language.loss_and_gradients(p, x, y, mask)
    for k in p:
        for _ in range(4):
            i = tuple(int(rng.integers(s)) for s in p[k].shape)
            i = (int(x[2, 1]), i[1]) if k[0] == "E" else i
            ends = []
            for step in (1e-5, -1e-5):
                q = {a: b.copy() for a, b in p.items()}
                q[k][i] += step
                ends.append(language.loss_and_gradients(q, x, y, mask)[0])
            assert math.isclose((ends[0] - ends[1]) / 2e-5, g[k][i], rel_tol=1e-4, abs_tol=1e-8)


def net(seed=2):
    """A network that remembers for hundreds of bytes."""
    p = language.initial(["a", "b", "c"], 5, np.random.default_rng(seed))
    for d in "fb":
        p["E" + d][:, 5:10] += 3
    return language.Model(["a", "b", "c"], p)


@pytest.mark.parametrize("cells", [64, 16_384])
def test_reader_by_brute_force(monkeypatch, cells):
    """Whole texts without windows: states go on from end to end, whatever stands beside a text."""
    monkeypatch.setattr(language, "STEP_CELLS", cells)
    rng = np.random.default_rng(2)
    model = net()
    texts = [bytes(rng.integers(32, 250, n).astype(np.uint8)) for n in (0, 1, 40, 128, 129, 400, 1500, 3, 400)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    pooled, labelled = language.Reader(model).documents(data, offsets)
    for d, raw in enumerate(texts):
        mean, votes = plain.read(model.params, raw)
        assert np.allclose(pooled[d], mean, atol=1e-4)
        assert np.abs(labelled[d] - votes).sum() <= 2


@pytest.mark.parametrize(("n", "block"), [(4000, 512), (4096, 512), (700, 2048), (5000, 1000)])
def test_long_texts_by_blocks(monkeypatch, n, block):
    """A text that is not held at once gives what it gives when held."""
    rng = np.random.default_rng(n)
    raw = rng.integers(32, 250, n).astype(np.uint8)
    reader = language.Reader(net())
    want = reader.documents(raw, np.array([0, n]))
    monkeypatch.setattr(language, "HELD_BYTES", 600)
    monkeypatch.setattr(language, "BLOCK_BYTES", block)
    got = reader.documents(raw, np.array([0, n]))
    assert np.allclose(got[0], want[0], atol=1e-5) and np.abs(got[1] - want[1]).sum() <= 2
    mixed = reader.documents(np.concatenate([raw, raw[:90]]), np.array([0, n, n, n + 90]))
    assert np.allclose(mixed[0][0], want[0], atol=1e-5) and mixed[0][1].sum() == 0 and abs(mixed[0][2].sum() - 1) < 1e-5


def test_spans():
    from tidelog.llm.textbatch import spans

    rng = np.random.default_rng(1)
    texts = [None if n == 7 else "x" * int(n) for n in rng.integers(0, 40, 300)] + ["y" * 500, "", "z"]
    table = pa.table({"id": list(range(len(texts))), "text": texts})
    for rows in (1, 7, 1000):
        out = list(spans(iter(table.to_batches(max_chunksize=rows)), 100, 1))
        assert pa.Table.from_batches(out).to_pydict() == table.to_pydict()
        sizes = [sum(len(t or "") for t in b.column(1).to_pylist()) for b in out]
        assert all(s <= 100 or b.num_rows == 1 for s, b in zip(sizes, out, strict=True)) and len(out) < 100


def test_language_on_held_out_rows(labelled):
    table = labelled[0].toPandas().drop_duplicates("text").sample(frac=1, random_state=1)
    train, test = table[:500], table[500:]
    model = language.train([t.encode() for t in train.text], list(train.lang))
    data, offsets, _ = flat_text(pa.array(list(test.text)))
    pooled, _ = language.Reader(model).documents(data, offsets)
    right = np.array(model.languages)[pooled.argmax(1)] == test.lang.to_numpy()
    assert right.mean() >= 0.97
    assert (pooled.max(1) >= language.MIN_PROBABILITY).mean() >= 0.98


def test_filters_agree_with_their_figures(labelled):
    docs, labels, _ = labelled
    q, m = quality.fit(docs, labels, per_label=100), language.fit(docs, per_label=50, steps=60)
    for figures, kept in ((quality.classify(docs, q), quality.keep_good(docs, q)), (language.identify(docs, m), language.keep_identified(docs, m))):
        assert sorted(r.doc_id for r in figures.where("keep").collect()) == sorted(r.doc_id for r in kept.collect())
        assert kept.columns == docs.columns
