"""Operator 1 against a plain rewrite of its definition."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing
from tidelog.llm.mixing import permute
from tidelog.llm.words import mix

TOKENS, SHARD = 64, 10


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(7)


def split(text):
    """Tokens with the white space after them; white space at the head belongs to the first."""
    import re

    out = re.findall(r"[^\t\n\v\f\r ]+[\t\n\v\f\r ]*", text)
    head = len(text) - len(text.lstrip("\t\n\v\f\r "))
    return ([text[:head] + out[0], *out[1:]]) if out else []


def brute(docs, weights, n_blocks, lane_bytes):
    """All rows (shard, slot, source, epoch, block, n_tokens, doc_ids, text) one by one."""
    rows = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("deal")).collect()
    size = Counter()
    for r in rows:
        if split(r.text or ""):
            size[r.source] += len(r.text.encode())
    lanes = {s: max(1, -(-b // lane_bytes)) for s, b in size.items()}
    blocks = {}
    for s in lanes:
        blocks[s] = []
        for lane in range(lanes[s]):
            stream = []
            for r in sorted((r for r in rows if r.source == s and r.deal % lanes[s] == lane), key=lambda r: (r.deal, r.doc_id)):
                stream += [(r.doc_id, t) for t in split(r.text or "")]
            for i in range(0, len(stream), TOKENS):
                ids, texts = [], []
                for d, t in stream[i : i + TOKENS]:
                    if not ids or ids[-1] != d:
                        ids.append(d)
                        texts.append("")
                    texts[-1] += t
                blocks[s].append((len(stream[i : i + TOKENS]), ids, "\n\n".join(texts)))
    keys = sorted(("s" + s for s in lanes if weights is None or weights.get(s, 0) > 0))
    share = np.array([1.0 if weights is None else weights[k[1:]] for k in keys])
    share /= share.sum()
    total = n_blocks or sum(map(len, blocks.values()))
    drawn, out = Counter(), []
    for shard in range(-(-total // SHARD)):
        n = min(SHARD, total - shard * SHARD)
        place = 0
        for w, c in enumerate(np.random.Generator(np.random.Philox(key=[mixing.SEED, shard])).multinomial(n, share)):
            own = blocks[keys[w][1:]]
            for _ in range(c):
                epoch, at = divmod(drawn[w], len(own))
                salt = mix(np.uint64([mixing.SEED]) + mix(np.uint64([w << 40 | epoch])))
                block = int(permute(np.array([at]), np.array([len(own)]), salt)[0])
                slot = int(permute(np.array([place]), np.array([n]), mix(np.uint64([shard + mixing.SEED + 1])))[0])
                out.append((shard, slot, keys[w][1:], epoch, block, own[block][0], tuple(own[block][1]), own[block][2]))
                drawn[w] += 1
                place += 1
    return sorted(out)


@pytest.mark.parametrize(("weights", "n_blocks", "lane_bytes", "group_bytes"), [(None, None, 20_000, 32 << 20), ({"src0": 0.1, "src1": 3.0, "src2": 1.0}, 250, 1 << 20, 1 << 20), ({"src0": 0.001, "src1": 30.0}, 9_000, 10_000, 100_000)])
def test_against_brute_force(docs, weights, n_blocks, lane_bytes, group_bytes):
    """The last case draws one source many times over, in several groups of epochs."""
    got = mixing.mix_sources(docs, weights, n_blocks, TOKENS, SHARD, lane_bytes=lane_bytes, group_bytes=group_bytes).drop("lang").collect()
    got = sorted((r.shard, r.slot, r.source, r.epoch, r.block, r.n_tokens, tuple(r.doc_ids), r.text) for r in got)
    assert got == brute(docs, weights, n_blocks, lane_bytes)


def test_packing_loses_nothing(docs):
    """With weights of the sources' own block counts every token is in some block once an epoch."""
    rows = mixing.mix_sources(docs, block_tokens=TOKENS, shard_blocks=SHARD, n_blocks=20_000).collect()
    per = defaultdict(dict)
    uses = defaultdict(Counter)
    for r in rows:
        per[r.source][r.block] = (r.n_tokens, r.text)
        uses[r.source][r.block] += 1
    want = Counter()
    for r in docs.collect():
        want[r.source] += len(split(r.text))
    for s, found in per.items():
        assert sorted(found) == list(range(len(found)))
        assert sum(n for n, _ in found.values()) == want[s]
        assert max(uses[s].values()) - min(uses[s].values()) <= 1


def test_groups_are_bounded(docs, spark):
    """A small source of great weight is packed in many groups, each of a bounded number of epochs."""
    small = docs.where("source = 'src1'").limit(1)
    rows = small.unionByName(docs.where("source = 'src0'"))
    plan = mixing.mix_sources(rows, {"src0": 0.01, "src1": 0.99}, 5_000, TOKENS, SHARD, group_bytes=50_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = plan.where("source = 'src1'").select(F.spark_partition_id().alias("p"), F.length("text").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = Counter()
    for r in got:
        by[r.p] += r.n
    assert sum(by.values()) > 1_000_000 and len(by) == 4 and max(by.values()) < 0.6 * sum(by.values())


def test_sums_before(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in range(3) for i in range(0, 300, k + 1)]
    got = mixing.sum_before(spark.createDataFrame(rows, "k int, i long, n long"), ["k"], "i", "n", "before", run=16).collect()
    assert {(r.k, r.i): r.before for r in got} == {(k, i): sum(n for a, j, n in rows if a == k and j < i) for k, i, _ in rows}


def test_shares_meet_the_targets(docs):
    target = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    got = Counter(r.source for r in mixing.mix_sources(docs, target, 4000, TOKENS, SHARD).select("source").collect())
    assert all(abs(got[s] / 4000 - w) < 0.03 for s, w in target.items())


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (1, 99):
            image = permute(np.arange(n), np.full(n, n), np.full(n, seed, np.uint64))
            assert sorted(image.tolist()) == list(range(n))
    a, b = (permute(np.arange(1000), np.full(1000, 1000), np.full(1000, s, np.uint64)) for s in (1, 2))
    assert (a == b).sum() < 20


def test_as_documents(docs):
    got = mixing.mixed_documents(docs, block_tokens=TOKENS, shard_blocks=SHARD)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(rows))) and all(r.n_chars == len(r.text) for r in rows)
