"""Bloom filters of parts: every pair tried, against a plain rewrite, and no more rows than the input and the result have."""

from __future__ import annotations

import hashlib

from tidelog.operators import maintenance

WORDS = 4


def mask(value: str) -> int:
    digest = hashlib.md5(value.encode()).hexdigest()
    one, two = int(digest[:8], 16), int(digest[8:16], 16)
    return sum(1 << b for b in {(one + k * (two + 1)) % (32 * WORDS) for k in range(7)})


def most_rows(plan) -> int:
    """The most rows that a step of an executed plan returned."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    metric = plan.metrics().get("numOutputRows")
    inner = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([metric.get().value() if metric.isDefined() else 0, *map(most_rows, inner)])


def test_all_pairs_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "_PARTS", 7, raising=False)  # several tables and several steps a lane
    monkeypatch.setattr(maintenance, "_ASKED", 50, raising=False)
    rows = [(None if p % 5 == 4 else p % 5, p // 5, None if k == 19 else f"m{(p * 31 + k * 17) % 3000}") for p in range(2500) for k in range(20)]
    values = [f"m{i}" for i in range(600)]
    filters: dict[tuple, int] = {}
    for s, p, m in rows:
        filters[s, p] = filters.get((s, p), 0) | (0 if m is None else mask(m))
    want = {(v, s, p) for v, b in ((v, mask(v)) for v in values) for (s, p), f in filters.items() if f & b == b}
    parted = spark.createDataFrame(rows, "shard int, part long, m string")
    asked = spark.createDataFrame([(v,) for v in [*values, values[0], None]], "m string")
    df = maintenance.maybe_members(maintenance.part_blooms(parted, "shard", "m", WORDS), "shard", asked, "m", WORDS)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20_000
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= 7 * len(rows) + 64 * len(values) + len(want)


def test_nothing_asked_and_no_parts(spark):
    parted = spark.createDataFrame([(1, 0, "a"), (1, 1, None)], "shard int, part long, m string")
    blooms = maintenance.part_blooms(parted, "shard", "m")
    none = spark.createDataFrame([(None,)], "m string")
    one = spark.createDataFrame([("a",)], "m string")
    assert maintenance.maybe_members(blooms, "shard", none, "m").isEmpty()
    assert maintenance.maybe_members(blooms.where("false"), "shard", one, "m").isEmpty()
    assert [tuple(r) for r in maintenance.maybe_members(blooms, "shard", one, "m").collect()] == [("a", 1, 0)]
