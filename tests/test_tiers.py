"""The tiers' contracts as scenarios, and numbering without whole keys in one task."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.errors import InvalidState, NotFound, NotOwner, StorageCorrupt
from tidelog.operators import folds, logs, maintenance, numbering, objects, parity, scan, stores, tiers
from tidelog.plans import catalogue
from tidelog.sources.storage import Substrate
from tidelog.streaming import feeds, groups


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("run", [1, 7, 1 << 16])
def test_numbering_by_runs(spark, run):
    rng = random.Random(run)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), i, f"v{i}") for i in rng.sample(range(-500, 5000), 400)]
    df = spark.createDataFrame(rows, "k string, seq long, v string").repartition(5)
    by = {}
    for k, s, _ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(s)
    assert {(r.k, r.seq): r.n for r in numbering.number(df, ["k"], "seq", "n", run).collect()} == {(k, s): i + 1 for k, own in by.items() for i, s in enumerate(own)}
    assert {(r.k, r.seq): r.p for r in numbering.previous(df, ["k"], "seq", "p", run).collect()} == {(k, s): p for k, own in by.items() for p, s in zip([None, *own], own, strict=False)}
    assert rows_of(numbering.number(df, ["k"], "v", "n").select("k", "n")) == rows_of(numbering.number(df, ["k"], "seq", "n").select("k", "n"))
    assert numbering.number(df.limit(0), ["k"], "seq", "n").isEmpty()


def test_event_log(spark, tmp_path):
    """append -> scan -> tail -> ack -> reclaim, with owners; what is refused leaves nothing."""
    root = f"file://{tmp_path}/log"
    arrive = lambda shard, ids, run: spark.createDataFrame([(shard, f"e{i % 3}", f"t{i}", f"p{i}", i) for i in ids], "shard int, execution_id string, transaction_id string, payload string, at long").repartition(run)
    log = tiers.EventLog(spark, root, owner=[0, 1])
    assert log.tail(0, "c").isEmpty() and log.cursors().isEmpty()
    assert rows_of(log.append(arrive(0, range(5), 3).unionByName(arrive(1, range(10, 12), 1)), "at")) == [(0, 5, 5, True), (1, 2, 2, True)]
    assert rows_of(log.append(arrive(0, range(5, 8), 2), "at")) == [(0, 3, 8, False)]
    with pytest.raises(NotOwner):
        log.append(arrive(0, [90], 1).unionByName(arrive(2, [91], 1)), "at")
    assert [r.sequence for r in log.scan_global(0, 2, 3).collect()] == [3, 4, 5] and log.records().count() == 10
    assert [(r.shard, r.sequence) for r in log.read_execution("e1").collect()] == [(0, 2), (0, 5), (0, 8), (1, 1)]
    assert [r.sequence for r in log.tail(0, "c", 2).collect()] == [1, 2] and rows_of(log.cursors()) == [(0, "c", 0)]
    assert [r.sequence for r in log.tail(0, "c", 2).collect()] == [1, 2]  # a tail moves nothing
    assert log.ack(0, "c", 4) and [r.sequence for r in log.tail(0, "c", 2).collect()] == [5, 6]
    for bad in (0, 9):
        with pytest.raises(InvalidState):
            log.ack(0, "c", bad)
    with pytest.raises(InvalidState):
        log.ack(0, "c", 2)
    with pytest.raises(InvalidState):
        log.ack(0, "nobody", 1)
    assert not tiers.EventLog(spark, root, strict=False).ack(0, "c", 2) and rows_of(log.cursors()) == [(0, "c", 4)]
    other = tiers.EventLog(spark, root, owner=[1])
    for call in (lambda: other.append(arrive(0, [1], 1), "at"), lambda: other.ack(0, "c", 5), lambda: other.reclaim(0), lambda: other.tail(0, "new")):
        with pytest.raises(NotOwner):
            call()
    assert rows_of(log.cursors()) == [(0, "c", 4)] and [r.sequence for r in other.scan_global(0).collect()] == list(range(1, 9))
    assert log.reclaim(0) == 4 and [r.sequence for r in log.scan_global(0, 1).collect()] == [5, 6, 7, 8]
    assert rows_of(log.append(arrive(0, [99], 1), "at")) == [(0, 1, 9, False)]


def test_projection_cycle(spark):
    """apply -> list -> per execution -> read one -> apply again is nothing -> a replay gives the same -> parity."""
    events = spark.createDataFrame([(i, i % 40, f"x{i % 4}", "step", None, "running" if i % 5 else "failed", None) for i in range(1, 61)], "global_sequence long, event_id long, execution_id string, event_type string, node_name string, status string, prev_event_id long")
    first = logs.apply_once(tiers.check_batch(events.where("global_sequence <= 30")), None)
    second = logs.apply_once(events.where("global_sequence > 20"), first, checkpoint=30)
    held = first.unionByName(second).cache()
    assert held.count() == 40 and rows_of(folds.distinct_ids(held, "execution_id")) == [("x0",), ("x1",), ("x2",), ("x3",)]
    assert held.where("execution_id = 'x1'").count() == 10 and held.where("event_id = 7").first().global_sequence == 7
    assert logs.apply_once(events, held).isEmpty()
    fresh = logs.apply_once(events, None)
    assert parity.compare(folds.fold_executions(fresh), folds.fold_executions(held), "execution_id", ["status", "event_count"]).isEmpty()
    with pytest.raises(InvalidState):
        tiers.check_batch(events, 59)
    states = spark.createDataFrame([("a", "running", "1"), ("b", "running", "2"), ("a", "done", "3")], "execution_id string, status string, data string").withColumn("at", F.col("data").cast("long"))
    none = spark.createDataFrame([], "proj_seq long, execution_id string, status string, data string")
    log = tiers.record_states(none, states, "at")
    log = log.unionByName(tiers.record_states(log, states.where("data = '2'").withColumn("status", F.lit("failed")), "at"))
    assert rows_of(tiers.projection_state(log)) == [("a", "done", "3", 3), ("b", "failed", "2", 4)] and rows_of(tiers.projection_state(log, ["b", "z"])) == [("b", "failed", "2", 4)]


def test_kv_cycle(spark):
    ops = spark.createDataFrame([], "op_seq long, bucket string, key string, value string, version long, deleted boolean, expires_at_ms long")
    ask = lambda *rows: spark.createDataFrame(list(rows), "bucket string, key string, value string, delete boolean, expected_version long, expires_at_ms long")
    keys = ["bucket", "key"]
    for requests, applied in ((ask(("b", "k", "1", False, 0, None), ("b", "l", "1", False, None, 50)), [True, True]), (ask(("b", "k", "2", False, 0, None)), [False]), (ask(("b", "k", "2", False, 1, None)), [True]), (ask(("b", "k", "", True, None, None)), [True]), (ask(("b", "k", "", True, None, None)), [False]), (ask(("b", "k", "3", False, 0, None)), [True])):
        done = stores.kv_write(ops, tiers.kv_bounded(requests), keys, monotonic=True).cache()
        assert [r.applied for r in done.orderBy("key").collect()] == applied
        ops = spark.createDataFrame(ops.collect() + done.where("applied").drop("applied").collect(), ops.schema)
    assert [(r.key, r.version, r.value) for r in stores.kv_state(ops, keys, now_ms=60).collect()] == [("k", 4, "3")] and sorted(r.op_seq for r in ops.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="more than 4 bytes"):
        tiers.kv_bounded(ask(("b", "k", "12345", False, None, None)), 4).collect()
    with pytest.raises(Exception, match="one request a key"):
        stores.kv_write(ops, ask(("b", "k", "1", False, None, None), ("b", "k", "2", False, None, None)), keys, monotonic=True).collect()


def test_object_and_vector_cycle(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one"), ("d", None), ("e", "")], "key string, content string")
    assert rows_of(objects.put_objects(texts, root).select("puts", "byte_len", "stored")) == [(1, 0, True), (1, 3, True), (2, 3, True)]
    assert rows_of(objects.put_objects(texts, root).select("stored").distinct()) == [(False,)]
    ops = spark.createDataFrame([], "op_seq long, key string, digest string, byte_len long, version long, deleted boolean")
    from tidelog.functions.scalars import content_digest

    asked = texts.where("content is not null").select("key", content_digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("byte_len"), F.lit(False).alias("delete"))
    first = tiers.object_write(ops, asked)
    ops = spark.createDataFrame(first.drop("outcome", "applied", "deduplicated").collect(), ops.schema)
    again = tiers.object_write(ops, asked.withColumn("delete", F.col("key") != "a").unionByName(spark.createDataFrame([("z", None, None, True)], asked.schema)))
    assert {r.key: (r.outcome, r.version, r.deduplicated) for r in again.collect()} == {"a": ("written", 2, True), "b": ("deleted", 2, False), "c": ("deleted", 2, False), "e": ("deleted", 2, False), "z": ("absent", 1, False)}
    path = Substrate(root).list_prefix("objects/sha256/")
    assert len(path) == 3
    got = objects.get_objects(ops.select("key", "digest", "byte_len"), root)
    assert {r.key: (bytes(r.content), r.outcome) for r in got.collect()} == {"a": (b"one", "ok"), "b": (b"two", "ok"), "c": (b"one", "ok"), "e": (b"", "ok")}
    Substrate(root).overwrite(next(p for p in path if Substrate(root).get_range(p) == b"two"), b"TWO")
    assert {r.key: r.outcome for r in got.collect()} == {"a": "ok", "b": "digest", "c": "ok", "e": "ok"}
    points = spark.createDataFrame([], "op_seq long, collection string, point_id string, model_id string, vector array<float>, payload string, version long, deleted boolean")
    ask = spark.createDataFrame([("c", "p", "m", [1.0, 2.0], "x", False), ("c", "q", "m", [float("nan")], "x", False), ("c", "r", "m", [], "x", False), ("c", "s", "m", [1.0] * 5, "x", False), ("c", "t", None, None, None, True)], "collection string, point_id string, model_id string, vector array<float>, payload string, delete boolean")
    done = tiers.vector_write(points, ask, dimensions=4)
    assert {r.point_id: r.outcome for r in done.collect()} == {"p": "written", "q": "rejected: not finite", "r": "rejected: dimensions", "s": "rejected: dimensions", "t": "absent"}


def test_substrate(tmp_path):
    s = Substrate(f"file://{tmp_path}/s")
    assert s.list_prefix("") == [] and s.put_if_absent("a/b", b"12345") and not s.put_if_absent("a/b", b"x") and s.put_if_absent("a/bc/d", b"")
    assert s.get_range("a/b", 1, 3) == b"234" and s.get_range("a/b", 9) == b"" and s.list_prefix("a/b") == ["a/b", "a/bc/d"] and s.list_prefix("a/bc") == ["a/bc/d"]
    s.overwrite("a/b", b"new")
    assert s.get_range("a/b") == b"new" and s.delete("a/b") and not s.delete("a/b")
    with pytest.raises(NotFound):
        s.get_range("a/b")
    for bad in ("", "/a", "a/../b", "a//b"):
        with pytest.raises(InvalidState):
            s.put_if_absent(bad, b"")


def test_snapshots_hold_their_digests(spark, tmp_path):
    c = scan.Catalog(spark, f"file://{tmp_path}/c")
    c.write(spark.range(50).withColumn("t", F.lit("x")).repartition(2), "a", "b", "t", "s1", "me")
    assert c.scan("a", "b", "t", verify=True).count() == 50 and c.contents.count() == 2
    one = next((tmp_path / "c/a/b/tables/t/snapshots/s1").glob("part-*.parquet"))
    for own in one.parent.glob(".*.crc"):  # else the local file system finds the damage before the digests do
        own.unlink()
    raw = bytearray(one.read_bytes())
    raw[10] ^= 1
    one.write_bytes(raw)
    assert [tuple(r) for r in c.damaged("a_b_t", "s1").collect()] == [(one.name, "digest")]
    with pytest.raises(StorageCorrupt, match="digest"):
        c.scan("a", "b", "t", verify=True)
    one.write_bytes(raw + b"x")
    assert c.damaged("a_b_t", "s1").first().reason == "length"
    one.unlink()
    assert c.damaged("a_b_t", "s1").first().reason == "missing"
    with pytest.raises(InvalidState):
        scan.checked_batches(spark.range(0))
    with pytest.raises(InvalidState):
        scan.same_schema([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])
    assert scan.same_schema([spark.range(2), spark.range(3)]).count() == 5


def test_cold_load(spark, tmp_path):
    log = spark.createDataFrame([(i % 2, i) for i in range(100)], "shard int, seq long")
    for name in ("a", "b"):
        maintenance.write_replica(log, f"file://{tmp_path}/{name}", "shard", "seq", 20)
    stray = next((tmp_path / "a/parts").rglob("part-*.parquet"))
    (stray.parent / "part-stray.parquet").write_bytes(stray.read_bytes())
    replicas = [f"file://{tmp_path}/{name}" for name in ("none", "a", "b")]
    assert sorted((r.shard, r.seq) for r in maintenance.cold_load(spark, replicas).collect()) == sorted((i % 2, i) for i in range(100))
    with pytest.raises(NotFound):
        maintenance.cold_load(spark, replicas[:1])


def test_blooms_never_miss(spark):
    rows = [(i % 3, i // 30, f"m{i % 50}") for i in range(300)]
    parted = spark.createDataFrame(rows, "shard int, part long, m string")
    asked = spark.createDataFrame([(f"m{i}",) for i in range(200)], "m string")
    got = {tuple(r) for r in maintenance.maybe_members(maintenance.part_blooms(parted, "shard", "m"), "shard", asked, "m").collect()}
    assert {(m, s, p) for s, p, m in rows} <= got
    strangers = [x for x in got if int(x[0][1:]) >= 50]
    assert len(strangers) < 0.02 * 150 * 30


def test_checksums_and_modes(spark, sf):
    got = {r.sequence: r.crc32 for r in catalogue.queries()["payload_checksums"](spark, sf).collect()}
    want = {r.event_id + 1: zlib.crc32(r.props.encode()) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert got == want
    assert tiers.backend_matrix(True, "worker", {"kv": " Primary ", "vector": "shadow", "object": "odd"}) == {"eventlog": "external", "projection": "external", "kv": "own", "object": "external", "vector": "external"}
    for enabled, role, modes in ((False, "worker", {"kv": "shadow"}), (True, "gateway", {"kv": "primary"}), (True, "worker", {"other": "off"})):
        with pytest.raises(InvalidState):
            tiers.backend_matrix(enabled, role, modes)


def test_groups_against_a_plain_rewrite():
    """Redelivery of random scripts, nacks among them, against lists that are searched whole."""
    rng = random.Random(4)
    for _ in range(60):
        wait, rows, seq = rng.choice([1, 3, 9]), [], 0
        for tick in range(120):
            kind = rng.choice(["append", "append", "poll", "poll", "poll", "ack", "nack"])
            seq += kind == "append"
            rows.append((tick, kind, seq if kind == "append" else rng.choice([None, rng.randrange(1, seq + 2)]), "m"))
        pending, flight, out = [], {}, []
        for tick, kind, s, m in rows:
            if kind == "append":
                pending.append(s)
            elif kind == "ack":
                flight.pop(min(flight, default=None) if s is None else s, None)
            elif kind == "poll":
                due = [x for x, d in flight.items() if d <= tick]
                got = (min(due), True) if due else (pending.pop(0), False) if pending else None
                if got:
                    flight[got[0]] = tick + wait
                    out.append((tick, m, *got))
        g = groups.Group(wait)
        assert g.play(rows) == out and g.backlog() == len(pending) + len(flight)
        lowest = min([*flight, *pending[:1]], default=None)
        assert g.committed() == (g.frontier if lowest is None else max(lowest - 1, 0))
        assert g.nack(None) == bool(flight) and g.backlog() == len(pending) + len(flight)


def test_once_each_in_a_stream(spark, tmp_path):
    for batch in ([(1, "a"), (2, "b")], [(1, "late"), (3, "c")]):
        spark.createDataFrame(batch, "event_id long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("event_id long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feeds.append_to(feeds.once_each(rows), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.event_id for r in spark.read.schema("event_id long, v string").parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_command_line(spark, sf, capsys):
    """Every verb with arguments gives rows, or an error's exit code."""
    from tidelog import __main__ as cli

    for line, said in (
        ("execution {} 7", "event_count"), ("log-scan {} 10 3", "13"), ("log-read {} 7 0", "transaction_id"), ("tail {} fresh 2", "events."), ("tail {} new 1", "true"), ("ack {} fresh 5", "moved"), ("ack {} nobody 5", "no consumer"), ("subject {} events.click.>", "events.click"),
        ("kv-get {} click k/3/1", "bucket"), ("kv-scan {} k/3/", "k/3/"), ("registry-get {} p/1 2", "content"), ("objects {} http", "sha256:"), ("text-search {} src0 en the 2", "match_count"), ("retrieve {} src0 en the", "hit"), ("summary {}", "transactions"), ("lag {}", "consumer_lag"),
    ):
        assert cli.main(line.format(sf).split()) == 0 and said in capsys.readouterr().out, line
    assert cli.main(["subject", sf, "a..b"]) != 0 and "failed_precondition" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", sf])
    assert set(cli._QUERIES.values()) <= set(catalogue.queries()) and len(cli.VERBS) + len(cli._QUERIES) >= 35
