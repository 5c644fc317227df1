"""Folds against row-by-row replay of random scripts."""

from __future__ import annotations

import random

from tidelog.operators import folds, logs, maintenance, stores


def script(n, make, seed=1):
    rng = random.Random(seed)
    return [(i + 1, *make(rng)) for i in range(n)]


def test_queue(spark):
    ops = script(2000, lambda r: (f"c{r.randrange(200)}", r.choice(["Enqueue", "Claim", "Claim"]), f"w{r.randrange(9)}"))
    state = {}
    for _, c, kind, w in ops:
        if kind == "Enqueue":
            state[c] = ("unclaimed", None)
        elif c in state:
            state[c] = ("claimed", w)
    df = spark.createDataFrame(ops, "op_seq long, command_id string, kind string, claimer string")
    assert {r.command_id: (r.state, r.claimer) for r in folds.fold_queue(df).collect()} == state
    assert [r.command_id for r in folds.unclaimed(df).collect()] == sorted(c for c, (s, _) in state.items() if s == "unclaimed")


def test_runtime(spark):
    ops = script(1500, lambda r: (f"w{r.randrange(60)}", r.choice(["register", "heartbeat", "heartbeat", "deregister"]), f"c{r.randrange(99)}"), 2)
    state = {}
    for _, w, event, contract in ops:
        live = state.get(w, ("gone",))[0] == "live"
        if event == "register":
            state[w] = ("live", 1, contract)
        elif event == "heartbeat" and live:
            state[w] = ("live", state[w][1] + 1, state[w][2])
        elif event == "deregister" and live:
            state[w] = ("gone", state[w][1], "")
    df = spark.createDataFrame(ops, "op_seq long, worker_id string, event string, contract string")
    assert {r.worker_id: (r.state, r.heartbeat, r.contract) for r in folds.runtime_states(df).collect()} == state


def test_provider(spark):
    ops = script(800, lambda r: (f"s{r.randrange(3)}", f"u{r.randrange(30)}", r.choice(["set_desired", "set_observed", "forget"]), str(r.randrange(4))), 3)
    state, history = {}, []
    for seq, s, u, kind, v in ops:
        d, o, p = state.get((s, u), ("", "", None))
        d, o, p = (v, o, True) if kind == "set_desired" else (d, v, True) if kind == "set_observed" else (d, o, False if p is not None else None)
        state[s, u] = (d, o, p)
        history.append((seq, d, o))
    df = spark.createDataFrame(ops, "op_seq long, stack string, provider_urn string, kind string, value string")
    facts = folds.provider_facts(df)
    assert {(r.stack, r.provider_urn): (r.desired, r.observed, r.present) for r in facts.collect()} == {k: v for k, v in state.items() if v[2] is not None}
    assert {(r.stack, r.provider_urn) for r in folds.drift(facts).collect()} == {k for k, (d, o, p) in state.items() if p and d != o}
    assert sorted((r.op_seq, r.desired, r.observed) for r in folds.provider_history(df).collect()) == history


def test_kv_writes_by_replay(spark):
    rng = random.Random(4)
    for monotonic in (True, False):
        ops = spark.createDataFrame([], "op_seq long, key string, value string, version long, deleted boolean")
        live, last = {}, {}
        for _ in range(5):
            batch = []
            for k in rng.sample("abcdefgh", 5):
                expected = rng.choice([None, 0, live.get(k, (None, 1))[1], 7])
                batch.append((k, str(rng.random()), rng.random() < 0.3, expected))
            got = {r.key: r for r in stores.kv_write(ops, spark.createDataFrame(batch, "key string, value string, delete boolean, expected_version long"), ["key"], monotonic).collect()}
            rows = []
            for k, v, delete, expected in batch:
                fits = expected is None or (expected == 0 and k not in live) or (k in live and live[k][1] == expected)
                applied = fits and (not delete or k in live)
                assert got[k].applied == applied
                if applied:
                    version = (last.get(k, 0) if monotonic else live.get(k, (None, 0))[1]) + 1
                    assert got[k].version == version
                    last[k] = version
                    rows.append(got[k])
                    if delete:
                        del live[k]
                    else:
                        live[k] = (v, version)
            ops = spark.createDataFrame([r[:5] for r in [*ops.collect(), *rows]], ops.schema)
        assert {r.key: (r.value, r.version) for r in stores.kv_state(ops).collect()} == live
        seqs = [r.op_seq for r in ops.collect()]
        assert sorted(seqs) == list(range(1, len(seqs) + 1))


def test_registry_and_wasm(spark):
    ops = spark.createDataFrame([(1, "p", 1, "tool", "a", False), (2, "p", 2, "tool", "b", False), (3, "p", 2, "tool", "", True)], "op_seq long, path string, version long, kind string, content string, deleted boolean")
    assert stores.registry_state(ops).collect() == [] and stores.registry_version(ops, "p", 2).first().content == "b"
    new = stores.registry_write(ops, spark.createDataFrame([("p", "tool", "c", False), ("q", "tool", "", True)], "path string, kind string, content string, delete boolean")).collect()
    assert {r.path: (r.version, r.applied) for r in new} == {"p": (3, True), "q": (1, False)}
    old = spark.createDataFrame([(1, "p", 4, "tool", "a", False)], ops.schema)
    gone = stores.registry_write(old, spark.createDataFrame([("p", None, None, True)], "path string, kind string, content string, delete boolean")).first()
    assert (gone.op_seq, gone.version, gone.kind, gone.content, gone.deleted, gone.applied) == (2, 5, "tool", "", True, True)
    raw = [(1, "k", "publish", None, "d1"), (2, "k", "publish", None, "d2"), (3, "k", "bind", 1, None), (4, "k", "bind", 9, None), (5, "j", "unpublish", None, None), (6, "j", "publish", None, "e"), (7, "j", "unpublish", None, None)]
    rows = spark.createDataFrame([(a, b, "p", "c", "e", *r) for a, b, *r in raw], "op_seq long, key string, path string, channel string, env string, kind string, bind_to long, digest string")
    assert [(r.key, r.version, r.digest) for r in stores.wasm_resolve(stores.wasm_history(rows)).collect()] == [("k", 1, "d1")]


def test_states_do_not_change_by_compaction_or_repetition(spark):
    rng = random.Random(9)
    log = spark.createDataFrame([(i + 1, f"k{rng.randrange(20)}", str(i), rng.random() < 0.2) for i in range(300)], "op_seq long, key string, value string, deleted boolean")
    state = sorted(folds.fold_latest(log, "key", "op_seq").collect())
    merged = maintenance.merge_parts([log.where("op_seq % 2 = 0"), log.where("op_seq % 2 = 1")], "op_seq")
    assert sorted(folds.fold_latest(merged, "key", "op_seq").collect()) == state and merged.count() == 300
    assert sorted(folds.fold_latest(log.unionAll(log), "key", "op_seq").collect()) == state


def test_empty_logs(spark):
    log = spark.createDataFrame([], "global_sequence long, event_id long, execution_id string, event_type string, node_name string, status string")
    assert folds.fold_executions(log).collect() == [] and folds.tip(log, "global_sequence").first().tip == 0
    assert logs.interest_ceiling(spark.createDataFrame([], "consumer string, acked long")).first().ceiling is None


def test_terminal_events_decide(spark):
    rows = [(1, 1, "e", "playbook.failed", None, None), (2, 2, "e", "step", "n", "running"), (3, 3, "e", "playbook_completed", None, None), (4, 4, "e", "step", None, None), (5, 5, "f", "step", None, None)]
    got = {r.execution_id: r for r in folds.fold_executions(spark.createDataFrame(rows, "global_sequence long, event_id long, execution_id string, event_type string, node_name string, status string")).collect()}
    assert (got["e"].status, got["e"].terminal_event_type, got["e"].current_node, got["e"].last_event_id) == ("completed", "playbook_completed", "n", 4)
    assert (got["f"].status, got["f"].terminal) == ("running", False)
