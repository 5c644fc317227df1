"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators and stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bpe, language, licences, media, mixing, neardup, quality, repetition, tokencount, warc

CLASHES = "id string, score string, keep string, tokens string, offsets string, root string, group_id string, key string, lane string, deal string, label string, rank string, signature string, __number int, number int, block string, slot string, shard string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here today "


def rows():
    out = [
        (1, PROSE * 3, "en", "a", 10), (1, PROSE * 3, "en", "a", 10), (2, PROSE * 3, "en", "a", None), (3, "", "en", "a", 0), (4, None, "en", "a", None), (None, PROSE + "null id", "en", "b", 5), (None, None, None, None, None),
        (5, "x" * 300_000, "de", "b", 300_000), (6, "ein wort und noch ein wort " * 20_000, "de", None, 1), (7, "wort", None, "b", 4), (8, "  \n\t ", "de", "b", 6), (9, "\U0001f642 é 中文\x00z", "de", "b", 9), (10, "...!!!", "en", "a", 6), (10, "other text of the same id", "en", "a", 6),
    ]
    return [(*r, *["clash"] * 13, 7, 8, "c", "c", "c") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (6, 0, 1), (None, 1, 0), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def models(docs, labels):
    return quality.fit(docs, labels), language.fit(docs, steps=3)


def per_row(docs, models):
    return {
        "bpe": lambda d: bpe.encode(d), "counts": lambda d: tokencount.token_counts(d), "rules": lambda d: repetition.quality_rules(d), "licences": lambda d: licences.scan(d),
        "classify": lambda d: quality.classify(d, models[0]), "identify": lambda d: language.identify(d, models[1]), "classify without model": lambda d: quality.classify(d, None), "identify without model": lambda d: language.identify(d, None),
    }


@pytest.mark.parametrize("name", ["bpe", "counts", "rules", "licences", "classify", "identify", "classify without model", "identify without model"])
def test_one_row_for_each_row(docs, models, name):
    run = per_row(docs, models)[name]
    got = run(docs).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(r[0]) for r in rows())
    assert run(docs.limit(0)).collect() == []


def test_null_and_empty_texts(docs, models):
    by = {k: {r["doc_id"]: r for r in f(docs).collect()} for k, f in per_row(docs, models).items()}
    assert by["bpe"][4].tokens is None and by["bpe"][4].n_tokens is None and by["bpe"][4].round_trip is None
    assert by["bpe"][3].tokens == [] and by["bpe"][3].n_tokens == 0 and by["bpe"][3].round_trip
    assert all(r.round_trip for r in by["bpe"].values() if r.tokens is not None)
    assert by["counts"][4].n_tokens is None and by["counts"][3].n_tokens == 0
    assert by["counts"][5].n_bytes == 300_000
    assert by["rules"][4].n_words is None and not by["rules"][4].keep and by["rules"][3].keep and not by["rules"][6].keep
    assert by["licences"][4].licences == [] and by["licences"][4].keep and by["licences"][3].restriction == "none"
    assert by["classify"][4].score is None and not by["classify"][4].keep and not by["classify"][3].keep
    assert by["classify without model"][1].score is None and by["classify without model"][1].keep
    assert by["identify"][4].language is None and by["identify"][3].probability == 0 and not by["identify"][3].keep
    assert by["identify without model"][1].language is None and not by["identify without model"][1].keep


def test_near_groups(docs):
    got = {r.doc_id: r for r in neardup.near_groups(docs).collect()}
    assert sorted(got) == list(range(1, 11))  # an id is one document, null ids are left out
    assert got[1].group_id == got[2].group_id == 1 and got[1].keep and not got[2].keep
    assert all(got[i].group_id == i and got[i].keep for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert neardup.near_groups(docs.limit(0)).collect() == []


def test_drop_near_copies(docs):
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2


def test_mixing(docs, spark):
    got = mixing.mix_sources(docs, block_tokens=16, shard_blocks=8, n_blocks=100).collect()
    assert len(got) == 100 and {(r.shard, r.slot) for r in got} == {(i // 8, i % 8) for i in range(100)}
    assert {r.source for r in got} == {"a", "b", None}
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert mixing.mix_sources(docs.where("doc_id in (3, 4, 8)")).collect() == []
    assert mixing.mix_sources(docs, {"a": 0.0}).collect() == []
    only = mixing.mix_sources(docs, {"a": 1.0, "not there": 5.0}, n_blocks=5).collect()
    assert {r.source for r in only} == {"a"} and len(only) == 5
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": -1.0})


def test_stages(docs, labels, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            n = out.count()
            if name in ("quality_classifier", "language_id", "near_dedup"):
                assert out.columns == docs.columns and n <= table.count()
            elif name == "mix_to_weights":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if table is not docs:
                assert n == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.b/c", "<html>é</html>"), (1, "http://a.b/c", "<html>é</html>"), (2, None, "<html>2</html>"), (3, "http://x\ny", ""), (4, "u", None), (None, "u", "<html>"), (5, "http://long", "<p>" + "y" * 3_000_000), (None, None, None)]
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, name string, payload string, __member string")


def test_warc_pages(spark, pages):
    got = sorted((r.page_id, r.url, r.n_bytes) for r in warc.page_responses(spark, pages).select("page_id", F.coalesce("url", F.lit("-")).alias("url"), "n_bytes").collect())
    assert got == [(1, "http://a.b/c", 15), (1, "http://a.b/c", 15), (2, "-", 14), (3, "http://x%0Ay", 0), (5, "http://long", 3_000_003)]
    assert warc.page_responses(spark, pages.limit(0)).collect() == []


def test_media_pages(spark, pages):
    got = sorted((r.page_id, r["size"], r.error) for r in media.page_media(spark, pages).collect())
    assert got == [(1, 15, None), (1, 15, None), (2, 14, None), (3, 0, None), (5, 3_000_003, None)]
    assert media.page_media(spark, pages.limit(0)).collect() == []
