"""Scans, searches, sources, streams, guards: bounds, errors and round trips."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog.errors import InvalidIdentifier, InvalidState, NotFound, PermissionDenied, StorageCorrupt, Unauthenticated
from tidelog.functions import scalars, subjects
from tidelog.operators import guards, logs, maintenance, objects, parity, scan, search, stores
from tidelog.schemas import check_schema, schema_of
from tidelog.sources import frames, ipc, journal
from tidelog.streaming import feeds, groups


def test_snapshot_tables(spark, tmp_path):
    c = scan.Catalog(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("e1", 1, None), ("e2", 2, "x"), (None, 3, "y")], "id string, attempt long, note string")
    c.write(rows, "acme", "ops", "runs", "s1", "alice")
    c.write(rows.where("attempt > 1"), "acme", "ops", "runs", "s2", "alice")
    assert c.read_latest("acme", "ops", "runs").count() == 2
    assert c.scan("acme", "ops", "runs", scan.Predicate("id", "e2"), ["attempt"]).collect()[0].asDict() == {"attempt": 2}
    assert c.scan("acme", "ops", "runs", scan.Predicate("attempt", 3)).collect()[0].id is None
    with pytest.raises(PermissionDenied):
        c.scan("acme", "ops", "runs", principal="bob")
    c.grant("acme", "ops", "runs", "bob")
    assert c.scan("acme", "ops", "runs", principal="bob").count() == 2
    for bad, error in ((lambda: c.grant("acme", "ops", "runs", "bob"), InvalidState), (lambda: c.get_table("acme", "ops", "none"), NotFound), (lambda: c.create_table("acme", "ops", "runs", "x"), InvalidState), (lambda: c.create_table("a b", "ops", "runs", "x"), InvalidIdentifier), (lambda: c.commit_snapshot("acme_ops_runs", "s3", "s1", ["f"]), InvalidState), (lambda: c.commit_snapshot("acme_ops_runs", "s3", "s2", []), InvalidState), (lambda: c.write(rows.drop("note"), "acme", "ops", "runs", "s4", "alice"), InvalidState)):
        with pytest.raises(error):
            bad()
    assert scan.broken_chains(c.snapshots).isEmpty() and c.get_snapshot("acme_ops_runs", "s1").parent_id is None


@pytest.mark.parametrize("bad", [lambda d: scan.filter_project(d, None, []), lambda d: scan.filter_project(d, None, ["a", "a"]), lambda d: scan.filter_project(d, None, ["z"]), lambda d: scan.filter_project(d, scan.Predicate("a", "1")), lambda d: scan.filter_project(d, scan.Predicate("b", 1)), lambda d: scan.filter_project(d, scan.Predicate("a", True)), lambda d: scan.filter_project(d, scan.Predicate("z", 1)), lambda d: scan.filter_project(d, scan.Predicate("c", "1.0"))])
def test_scan_rejections(spark, bad):
    with pytest.raises(InvalidState):
        bad(spark.createDataFrame([(1, "x", 1.0)], "a long, b string, c double"))


def test_pushdown_reaches_the_scan(spark, sf):
    plan = scan.filter_project(spark.read.parquet(f"{sf}/orders.parquet"), scan.Predicate("o_custkey", 5), ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_search_bounds(spark):
    points = spark.createDataFrame([("c", "p", "m", [1.0, 0.0]), ("c", "q", "m", [1.0]), ("c", "z", "m", [0.0, 0.0])], "collection string, point_id string, model_id string, vector array<float>")
    for k in (0, 65):
        with pytest.raises(InvalidState):
            search.tier_topk(points, "c", "m", [1.0, 0.0], k)
    for q in ([], [0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(InvalidState):
            search.tier_topk(points, "c", "m", q, 3)
    assert [(r.point_id, r.score) for r in search.tier_topk(points, "c", "m", [1.0, 0.0], 3).collect()] == [("p", 1.0), ("z", 0.0)]
    assert [(r.point_id, r.score) for r in search.log_topk(points, "c", [1.0, 0.0], 9).collect()] == [("p", 1.0), ("q", 0.0), ("z", 0.0)]
    assert search.log_topk(points, "c", [1.0, 0.0], 0).collect() == []


def test_retrieval_outcomes(spark):
    docs = spark.createDataFrame([("d", "t", "n")], "document_id string, tenant string, namespace string")
    chunks = spark.createDataFrame([(f"d-{i}", "d", i, "Aa aA é" * (i + 1)) for i in range(12)], "chunk_id string, document_id string, ordinal int, text string")
    first = lambda **k: search.retrieve(chunks, docs, "t", "n", **k).collect()
    assert first(query="  ")[0].outcome == "invalid" and first(query="a", top_k=65)[0].outcome == "rejected" and first(query="zzz")[0].outcome == "empty"
    hits = first(query="aa", top_k=3, max_chunk_bytes=8)
    assert [r.ordinal for r in hits] == [11, 10, 9] and hits[0].candidate_count == 12 and hits[0].truncated_by_top_k and hits[0].truncated and hits[0].text == "Aa aA é"
    assert search.retrieve(chunks, docs, "t", "other", "aa").collect()[0].outcome == "empty"


def test_functions(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()] or [F.lit(1)]).select(c.alias("r")).first().r
    assert one(scalars.count_matches(F.lit("AAA"), "aa")) == 1
    assert one(scalars.truncate_bytes(F.lit("aéb"), 2)) == "a" and one(scalars.truncate_bytes(F.lit("aéb"), 3)) == "aé"
    assert one(scalars.content_digest(F.lit("x"))).startswith("sha256:2d711642b726b044")
    assert len(one(scalars.wide_digest(F.lit("x")))) == 32
    assert [one(scalars.is_object_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "a//b", "", "a\\b")] == [True, False, False, False, False, False]
    assert [one(scalars.is_identifier(F.lit(p))) for p in ("a-b_9", "", "a b", "x" * 129)] == [True, False, False, False]
    assert [one(scalars.is_subject(F.lit(p))) for p in ("a.b", "a..b", "a.*", "")] == [True, False, False, False]
    assert one(scalars.event_fields(F.lit('{"event_id": 4, "status": "x"}'))).status == "x"
    assert [one(scalars.event_fields(F.lit(j))) for j in ("[1]", '{"event_id": "q"}', "{", '{"event_id": 1.5}')] == [None] * 4
    assert one(subjects.command_subject(F.lit('{"execution_pool":"gpu"}'), F.lit(3))) == "commands.gpu.shard.3" and one(subjects.command_subject(F.lit("nope"), F.lit(3))) == "commands.shared.shard.3"
    assert tuple(one(subjects.command_parts(F.lit("commands.gpu.shard.3")))) == ("gpu", 3) and one(subjects.command_parts(F.lit("a.b"))) is None


def test_subject_filters_by_brute_force():
    import itertools
    import re

    def matches(f, s):
        f, s = f.split("."), s.split(".")
        for i, t in enumerate(f):
            if t == ">":
                return len(s) > i
            if i >= len(s) or t not in ("*", s[i]):
                return False
        return len(f) == len(s)

    words = ["a", "b", "a.b", "b.a", "a.b.a", "b.b.b", "a.a.a.a"]
    for f in (".".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "*"], repeat=n)):
        for g in (f, f + ".>"):
            assert [bool(re.search(subjects.filter_pattern(g), w)) for w in words] == [matches(g, w) for w in words]
    for bad in ("", "a..b", ">.a", "a*", "a."):
        with pytest.raises(InvalidState):
            subjects.filter_pattern(bad)


def test_consumers(spark):
    c = spark.createDataFrame([("x", 5), ("y", None)], "consumer string, acked long")
    assert {r.consumer: r.acked for r in logs.acknowledge(c, "x", 7, 9).collect()}["x"] == 7
    assert {r.consumer: r.acked for r in logs.acknowledge(c, "x", 3, 9, strict=False).collect()}["x"] == 5
    for args in (("x", 3, 9), ("x", 10, 9), ("none", 1, 9)):
        with pytest.raises(InvalidState):
            logs.acknowledge(c, *args)
    assert logs.interest_ceiling(c).first().ceiling == 0
    with pytest.raises(InvalidState):
        logs.retain_newest(c, "consumer", "acked", 0)


def test_objects_and_parity(spark):
    o = spark.createDataFrame([("k", "v", "sha256:" + "0" * 64, 1)], "key string, content string, digest string, byte_len long")
    assert tuple(objects.verify(o).first())[1:] == (False, True)
    a = spark.createDataFrame([("k", "d", 1, True), ("m", "d", 2, True), ("n", "d", 1, False)], "key string, digest string, byte_len long, verified boolean")
    s = spark.createDataFrame([("k", "e", 1), ("m", "d", 3), ("n", "d", 1), ("x", "d", 1)], "key string, digest string, byte_len long")
    assert {r.key: r.divergence for r in parity.object_parity(s, a).collect()} == {"k": "digest", "m": "length", "n": "retrievable", "x": "presence"}
    assert parity.same_ids(a, s, "key").first().same is False
    assert parity.report(a, a, "key", ["digest"], 3, 3).first().asDict() == {"key_ok": True, "value_ok": True, "checkpoint_ok": True, "checkpoint_lag": 0, "divergence": None}
    assert parity.log_parity(s.withColumnRenamed("key", "seq"), a.withColumnRenamed("key", "seq"), "seq", "digest").count() == 2


def test_reclaiming(spark):
    seg = spark.createDataFrame([(i, 10 * i + 10) for i in range(6)], "segment long, last_seq long")
    gone = lambda acked, **k: sorted(r.segment for r in maintenance.reclaim_plan(seg, spark.createDataFrame(acked, "consumer string, acked long"), **k).where("reclaim").collect())
    assert gone([("a", 35), ("b", 60)]) == [0, 1, 2] and gone([("a", None)]) == [] and gone([]) == []
    assert gone([("a", 60)], min_retained=3) == [0, 1, 2] and gone([], max_retained=3) == [0, 1, 2] and gone([("a", 15)], max_retained=2) == [0]


def test_transactions_and_journals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t1", "a", "n", [("create", "{}"), ("put", "{}")]), (2, "t2", "a", "n", [("put", "{}")])], schema_of("transaction"))
    path = f"{tmp_path}/log"
    journal.append(rows, path)
    got = journal.open_transactions(spark, path)
    assert stores.expand_transactions(got).count() == 3 and [r.sequence for r in got.collect()] == [1, 2]
    journal.append(spark.createDataFrame([(4, "t2", "a", "n", [])], schema_of("transaction")), path)
    with pytest.raises(StorageCorrupt):
        journal.open_transactions(spark, path)
    (tmp_path / "odd").write_text('{"sequence": 1, "transaction_id": "t", "colour": "red"}\n')
    with pytest.raises(Exception, match="colour"):
        journal.read(spark, f"{tmp_path}/odd", "transaction").collect()
    (tmp_path / "bad").write_text('{"sequence": "x"}\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        journal.read(spark, f"{tmp_path}/bad", "transaction").collect()
    assert journal.read(spark, f"{tmp_path}/bad", "transaction", strict=False).collect() == []
    check_schema(rows.schema, "transaction")
    with pytest.raises(InvalidState):
        check_schema(rows.drop("tenant").schema, "transaction")


def test_ipc_and_frames(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id as string) as s").repartition(3)
    assert sum(r.rows for r in ipc.write_ipc(df, f"{tmp_path}/ipc").collect()) == 100
    back = ipc.read_ipc(spark, f"{tmp_path}/ipc")
    assert sorted(map(tuple, back.collect())) == [(i, str(i)) for i in range(100)]
    raw = b"".join(frames.encode(f'{{"n":{i}}}'.encode()) for i in range(5))
    (tmp_path / "a.frames").write_bytes(raw[:-3])
    assert frames.read_frames(spark, str(tmp_path)).count() == 4
    assert [b for _, b in frames.decode(raw)][-1] == b'{"n":4}'
    with pytest.raises(StorageCorrupt):
        list(frames.decode(raw[:20] + b"x" + raw[21:]))
    with pytest.raises(StorageCorrupt):
        list(frames.decode(b"x" * 50))


def test_parts_on_disk(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id + 1 as seq", "cast(user_id % 4 as int) as shard")
    maintenance.write_parts(log, str(tmp_path / "parts"), "shard", "seq", seal=100)
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert back.count() == log.count()
    plan = stores.owned(back, "shard", [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert max(r.n for r in back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()) <= 100


def test_materialising_twice_changes_nothing(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "event_id + 1 as global_sequence")
    (rows.where("event_id < 500")).write.parquet(f"{tmp_path}/in")
    run = lambda check: feeds.materialise(feeds.follow(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/{check}").awaitTermination()
    run("c1")
    rows.where("event_id between 400 and 800").write.mode("append").parquet(f"{tmp_path}/in")
    run("c1")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(801))
    shutil.rmtree(tmp_path / "c1")  # a lost checkpoint repeats batches
    run("c1")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(801))


def test_groups(spark, tmp_path):
    g = groups.Group(5)
    for s in (1, 2, 3):
        g.append(s)
    assert [g.poll("a", 0), g.poll("b", 1), g.ack(1), g.ack(1), g.poll("a", 4), g.poll("a", 6), g.committed(), g.backlog()] == [(1, False), (2, False), True, False, (3, False), (2, True), 1, 2]
    g.ack(None)
    g.ack(3)
    assert g.committed() == 3 and g.poll("a", 99) is None
    rng = random.Random(1)
    rows = [(i % 3, i, rng.choice(["append", "poll", "poll", "ack"]), i, rng.choice(["a.x", "b.x"]), f"m{rng.randrange(3)}") for i in range(600)]
    for n in range(3):
        spark.createDataFrame(rows[n * 200 : n * 200 + 200], groups.SCRIPT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = []
    for shard in range(3):
        for t, m, s, r in groups.Group(20).play([(t, k, s if k == "append" else None, m) for sh, t, k, s, subject, m in rows if sh == shard and (k != "append" or subject.startswith("a."))]):
            want.append((shard, t, m, s, r))
    script = feeds.follow(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema).withColumn("seq", F.when(F.col("kind") == "append", F.col("seq")))
    feeds.append_to(groups.deliver(script, 20, "a.*"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, spark.read.schema(groups.DELIVERIES).parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_guards():
    ticket = guards.ScanTicket("a", "n", "t", ("x",), "c", 3)
    assert guards.ScanTicket.decode(ticket.encode()) == ticket
    for raw in (b"{", b"[]", ticket.encode() + b" ", ticket.encode().replace(b'"version":1', b'"version":2'), b"x" * 20_000, ticket.encode().replace(b'"a"', b'"a b"')):
        with pytest.raises((InvalidState, InvalidIdentifier)):
            guards.ScanTicket.decode(raw)
    guards.check_token("Bearer s3", {"s3"})
    for header in (None, "Bearer", "Basic s3", "Bearer s4"):
        with pytest.raises(Unauthenticated):
            guards.check_token(header, {"s3"})
    guards.require("system", "control_plane")
    with pytest.raises(PermissionDenied):
        guards.require("worker", "control_plane")
    guards.check_scope("t", None, "t", "n")
    with pytest.raises(PermissionDenied):
        guards.check_scope("t", "m", "t", "n")


def test_constraints(spark):
    d = spark.createDataFrame([("d",), ("d",)], "document_id string")
    c = spark.createDataFrame([("c", "d", "x" * 70_000), ("e", "none", "y")], "chunk_id string, document_id string, text string")
    e = spark.createDataFrame([("c", 3, [1.0]), ("q", 1, [1.0])], "chunk_id string, dimensions int, vector array<float>")
    assert sorted(r.kind for r in stores.retrieval_violations(d, c, e).collect()) == ["chunk without document", "document repeated", "embedding of wrong length", "embedding without chunk"]
    assert [tuple(r) for r in stores.ingest_violations(c).collect()] == [("d", "a chunk is too long")]
    lib = spark.createDataFrame([("p", 1, "d", ["x"], 5), ("q", 1, "d", [], 5), ("r", 1, "d", ["x"], 0)], "path string, revision int, digest string, capabilities array<string>, byte_len long")
    assert {r.path: r.reason for r in stores.check_libraries(lib).collect()} == {"q": "no capability", "r": "empty"}
    binds = spark.createDataFrame([(1, "c1", "p", 1, "d"), (2, "c1", "q", 1, "d")], "op_seq long, channel string, path string, revision int, digest string")
    assert stores.resolve_bindings(binds, lib).first().path == "q"


_STANDS = """
import sys, __spark_entry__ as e
from pyspark.sql import SparkSession
q, sql = e.queries(), e.oracle_sql()
ops = [n for n in q if n.startswith("op") and n[2].isdigit()]
assert len(q) > 60 and set(sql) <= set(q) and (len(ops), "pipeline" in q) == (int(sys.argv[1]), sys.argv[2] == "True"), (ops, "pipeline" in q)
import tidelog.streaming.demos, tidelog.sources.ipc, tidelog.__main__
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.entry(s).columns == ["execution_id", "status"] and q["log_tip"](s, "/root/testdata/sf0.001").first()[0] == 1000
"""


@pytest.mark.parametrize(
    ("gone", "ops", "pipeline"),
    [(("tidelog/llm", "tests/llm", "corpus_pipeline.py"), 0, False), (("tidelog/llm", "tests/llm"), 0, False), (("tidelog/llm/neardup.py",), 0, False), (("corpus_pipeline.py",), 10, False)],
)
def test_the_rest_stands_without_the_optional_parts(tmp_path, gone, ops, pipeline):
    root = Path(__file__).resolve().parents[1]
    if not (root / "tidelog/llm").exists() and ops:
        pytest.skip("the optional folders are not here")
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        at = tmp_path / "r" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-B", "-c", _STANDS, str(ops), str(pipeline)], cwd=tmp_path / "r", capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-3000:]


def test_folders_of_a_run(spark, tmp_path):
    """Scratch folders lie in the shared folder; a cluster without one is an error, not a folder on one machine."""
    from tidelog import session

    made = session.scratch_folder(spark, "kind")
    assert made.startswith(session.shared_folder(spark) + "/kind-") and Path(made.removeprefix("file://")).is_dir()
    session.remove_folder(spark, made)
    assert not Path(made.removeprefix("file://")).exists()

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(InvalidState, match="share"):
        session.shared_folder(Cluster)


def test_every_row_is_a_query(spark):
    """The searches for all rows give what the single searches give, one by one: over several blocks, lengths, zero vectors and scopes."""
    rng = random.Random(5)
    vector = lambda i: [0.0, 0.0] if i % 17 == 0 else [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(2 + (i % 7 == 0))]
    points = spark.createDataFrame([(f"c{i % 2}", f"m{i % 3}", f"p{i}", vector(i)) for i in range(60)], "collection string, model_id string, point_id string, vector array<double>").cache()
    rows = points.collect()
    queries = points.withColumnRenamed("point_id", "query_id")
    old, search.BLOCK, search.STEP = (search.BLOCK, search.STEP), 7, 3
    try:
        tier = {(r.query_id, r.point_id): r.score for r in search.tier_topk_each(queries, points, 4).collect()}
        log = {(r.query_id, r.point_id): r.score for r in search.log_topk_each(queries, points, 9).collect()}
    finally:
        search.BLOCK, search.STEP = old
    assert {q for q, _ in tier} == {q for q, _ in log} == {r.point_id for r in rows}
    for r in rows[14:26]:
        assert {p: s for (q, p), s in log.items() if q == r.point_id} == {x.point_id: x.score for x in search.log_topk(points, r.collection, r.vector, 9).collect()}
        if any(r.vector):
            assert {p: s for (q, p), s in tier.items() if q == r.point_id} == {x.point_id: x.score for x in search.tier_topk(points, r.collection, r.model_id, r.vector, 4).collect()}
    assert search.tier_topk_each(queries.where("false"), points, 4).isEmpty() and search.tier_topk_each(queries, points.where("false"), 4).isEmpty()
    with pytest.raises(Exception, match="must be finite"):
        search.log_topk_each(queries.limit(1).withColumn("vector", F.array(F.lit(float("nan")))), points, 1).collect()


def test_retention_counts_records_not_sequences(spark):
    log = spark.createDataFrame([("a", s) for s in (1, 2, 50, 51, 90)] + [("b", s) for s in (3, 4)] + [("c", s) for s in range(7, 20)], "stream string, sequence long")
    got = sorted((r.stream, r.sequence) for r in logs.retain_newest(log, "stream", "sequence", 3).collect())
    assert got == [("a", 50), ("a", 51), ("a", 90), ("b", 3), ("b", 4), ("c", 17), ("c", 18), ("c", 19)]
