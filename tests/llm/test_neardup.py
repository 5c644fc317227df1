"""Operator 5 against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from tidelog.llm import neardup
from tidelog.llm.textbatch import flat_text


def bigrams(text):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def similar_pairs(texts):
    """(i, j) with i > j that share a bigram -> their similarity; all others have 0."""
    sets, where = [bigrams(t) for t in texts], defaultdict(list)
    for i, b in enumerate(sets):
        for g in b:
            where[g].append(i)
    pairs = {(i, j) for own in where.values() for j in own for i in own if i > j}
    return {(i, j): jaccard(sets[i], sets[j]) for i, j in pairs}


def copies_of(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [f"w{i}" for i in range(4000)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        words = [rng.choice(VOCABULARY) for _ in range(rng.choice([30, 100, 400, 2000]))]
        texts.append(" ".join(words))
        texts += [copies_of(rng, words, rng.choice([0, 0.01, 0.05, 0.1, 0.3])) for _ in range(rng.choice([0, 0, 1, 2, 8]))]
    return texts


def signatures(texts):
    data, offsets, _ = flat_text(pa.array(texts))
    return neardup.dart_signatures(*neardup.weighted_elements(data, offsets), len(texts))


def test_estimates(corpus):
    s = signatures(corpus)
    errors = [(s[i] == s[j]).mean() - x for (i, j), x in similar_pairs(corpus).items() if x > 0.1]
    assert len(errors) > 100 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    weighted = [" ".join(["a b c d e f g h"] * n) for n in (1, 2, 8)] + ["a b", "a b " * 50 + "z y"]
    s, sets = signatures(weighted), [bigrams(t) for t in weighted]
    assert all(abs((s[i] == s[j]).mean() - jaccard(sets[i], sets[j])) < 0.2 for i in range(5) for j in range(5))


def test_a_signature_does_not_depend_on_its_neighbours(corpus):
    assert np.array_equal(signatures(corpus)[7], signatures([corpus[7]])[0])


def test_signatures_dart_by_dart():
    """Against a rewrite without arrays: repeated words, one word, signs alone, long words, other scripts."""
    texts = ["a b c d e f g h", "a b " * 9 + "c", "word", "...!", "x" * 700 + " y " + "x" * 700, "é 中文 ABC abc", "to be or not to be that is the question " * 3]
    assert [tuple(r) for r in signatures(texts).tolist()] == [plain.signature(t) for t in texts]


def test_groups_pair_by_pair(spark, corpus):
    """Whole result against all pairs of the rewrite, with the operator's own threshold."""
    texts = dict(enumerate(corpus[:90]))
    got = {r.doc_id: r.group_id for r in neardup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain.groups(texts)


def test_groups_against_brute_force(spark, corpus):
    """Pairs above the threshold by exact similarity are together (recall), and groups hold no stranger."""
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)
    group = {r.doc_id: r.group_id for r in neardup.near_groups(docs).collect()}
    similar = similar_pairs(corpus)
    near = [p for p, x in similar.items() if x >= 0.65]
    assert len(near) > 50
    assert sum(group[i] == group[j] for i, j in near) / len(near) >= 0.98
    assert not any(group[i] == group[j] for i in range(len(corpus)) for j in range(i) if (i, j) not in similar)
    kept = [r.doc_id for r in neardup.drop_near_copies(docs).collect()]
    assert sorted(kept) == sorted(set(group.values()))


def test_bucket_search_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = rng.integers(0, 2, (25, 16)).astype(np.uint32)
        near = (s[:, None] == s[None]).sum(2) >= 12
        label = list(range(25))
        for i in range(25):
            for j in range(25):
                if near[i, j]:
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
        root = list(range(25))
        for j, r in neardup.bucket_links(np.arange(25), s, 0.75):
            root[j] = r
        assert [min(i for i in range(25) if label[i] == label[k]) for k in range(25)] == root


def test_buckets_across_batches():
    ids = pa.array(range(60_000))
    key = pa.array(np.repeat(np.arange(3), 20_000))
    raw = np.repeat(np.arange(3, dtype=np.uint32), 20_000)[:, None] * np.ones(neardup.COORDINATES, np.uint32)
    raw[30_000] = 99
    sig = pa.array([r.tobytes() for r in raw.astype(np.uint32)], pa.binary())
    table = pa.table({"key": key, "id": ids, "signature": sig})
    out = pa.Table.from_batches(list(neardup.links_of_sorted(iter(table.to_batches(max_chunksize=7_001)), 0.6)))
    got = defaultdict(set)
    for u, v in zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True):
        got[v].add(u)
    assert {k: len(v) for k, v in got.items()} == {0: 19_999, 20_000: 19_998, 40_000: 19_999}


def test_components_of_paths(spark):
    n = 300
    chain = [(i + 1, i) for i in range(n)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000, 1002: 1000}


def test_large_buckets_in_blocks(spark, corpus):
    """Buckets cut into blocks give the same groups as whole ones."""
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)
    whole = {tuple(r) for r in neardup.near_groups(docs).collect()}
    assert {tuple(r) for r in neardup.near_groups(docs, bucket_rows=3).collect()} == whole
    size = Counter(g for _, g, _, _ in whole)
    assert all(n == size[g] - 1 and keep == (i == g) for i, g, n, keep in whole)


def test_repeated_rows_cost_no_pairs(spark, monkeypatch):
    """Repeats of a row and copies of a text under other ids are one node: none reach a bucket."""
    seen = []
    whole = neardup.bucket_pairs
    monkeypatch.setattr(neardup, "bucket_pairs", lambda heads, *a: seen.append(heads.count()) or whole(heads, *a))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 20_000 + [(i, text) for i in range(2, 3_000)] + [(5_000, text + " more"), (6_000, "another thing")]
    got = {r.doc_id: (r.group_id, r.n_links) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen == [3] and got == {i: (1, 2_999) for i in [*range(1, 3_000), 5_000]} | {6_000: (6_000, 0)}


def test_who_stays_of_a_shared_id(spark):
    rows = [
        (1, "zebra apple", 1, "a"), (1, "apple zebra text", 9, "b"), (1, None, 0, "c"), (1, "apple zebra text", 2, None), (1, "apple zebra text", 2, "z"),
        (2, None, 5, None), (2, None, 4, "q"), (3, "apple zebra text", 0, "copy of a text of 1"), (4, "zebra apple", 0, "copy of the other"), (None, "apple zebra text", 0, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, note string").withColumn("extra", F.create_map(F.lit("k"), "n")).repartition(4)
    for one in (docs, docs.coalesce(1)):
        kept = {tuple(r)[:4] for r in neardup.drop_near_copies(one).collect()}
        assert kept == {(1, "apple zebra text", 2, "z"), (2, None, 4, "q"), (None, "apple zebra text", 0, "")}
        assert {r.doc_id: r.group_id for r in neardup.near_groups(one).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
