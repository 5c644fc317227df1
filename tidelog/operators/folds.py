"""Read models as folds over logs: group by key, keep what the last record says.

All of them are partial aggregations with one shuffle of (key, last) rows; windows are
used only where every record's own history matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import terminal_status

DEFAULT_STATUS = "running"


def last_records(log: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The record with the greatest `seq` of each key, tombstones included."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    folded = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last"))
    return folded.select(*keys, "last.*").select(*log.columns)


def fold_latest(log: DataFrame, key: str | list[str], seq: str, deleted: str | None = "deleted") -> DataFrame:
    """Live state: last_records() without tombstones."""
    state = last_records(log, key, seq)
    return state if deleted is None else state.where(~F.col(deleted)).drop(deleted)


def last_value(column: Column, seq: Column) -> Column:
    """The last value that is not null."""
    return F.max_by(column, F.when(column.isNotNull(), seq))


def fold_executions(events: DataFrame) -> DataFrame:
    """One row of state for each execution.

    Any terminal event decides the status, the last one if there are several; otherwise
    the last status that an event carried; otherwise 'running'.
    """
    seq = F.col("global_sequence")
    terminal = F.when(terminal_status(F.col("event_type")).isNotNull(), F.col("event_type"))
    folded = events.groupBy("execution_id").agg(
        F.count("*").alias("event_count"), F.min(seq).alias("first_global_sequence"), F.max(seq).alias("last_global_sequence"), F.max_by("event_id", seq).alias("last_event_id"),
        last_value(F.col("node_name"), seq).alias("current_node"), last_value(F.col("status"), seq).alias("last_status"), last_value(terminal, seq).alias("terminal_event_type"),
    )
    status = F.coalesce(terminal_status(F.col("terminal_event_type")), "last_status", F.lit(DEFAULT_STATUS))
    return folded.select("execution_id", status.alias("status"), "current_node", "event_count", "first_global_sequence", "last_global_sequence", "last_event_id", F.col("terminal_event_type").isNotNull().alias("terminal"), "terminal_event_type")


def fold_queue(ops: DataFrame) -> DataFrame:
    """(command_id, state, claimer): claims count only after the last enqueue, the last of them wins; ids never enqueued are absent."""
    enqueued = F.when(F.col("kind") == "Enqueue", F.col("op_seq"))
    claimed = F.when(F.col("kind") == "Claim", F.col("op_seq"))
    folded = ops.groupBy("command_id").agg(F.max(enqueued).alias("e"), F.max(claimed).alias("c"), F.max_by("claimer", claimed).alias("claimer")).where("e is not null")
    open_ = F.coalesce(F.col("c") < F.col("e"), F.lit(True))
    return folded.select("command_id", F.when(open_, "unclaimed").otherwise("claimed").alias("state"), F.when(~open_, F.col("claimer")).alias("claimer"))


def unclaimed(ops: DataFrame) -> DataFrame:
    return fold_queue(ops).where("state = 'unclaimed'").select("command_id").orderBy("command_id")


def provider_facts(half_ops: DataFrame) -> DataFrame:
    """(stack, provider_urn, desired, observed, present) from half operations (op_seq, stack, provider_urn, kind, value).

    Each field keeps the last value set, '' if never set; forget keeps both and clears
    present. A forget before any set leaves no fact.
    """
    seq = F.col("op_seq")
    is_set = F.col("kind").isin("set_desired", "set_observed")
    folded = half_ops.groupBy("stack", "provider_urn").agg(
        F.max_by("value", F.when(F.col("kind") == "set_desired", seq)).alias("desired"), F.max_by("value", F.when(F.col("kind") == "set_observed", seq)).alias("observed"),
        F.max(F.when(is_set, seq)).alias("s"), F.max(F.when(~is_set, seq)).alias("f"),
    ).where("s is not null")
    return folded.select("stack", "provider_urn", F.coalesce("desired", F.lit("")).alias("desired"), F.coalesce("observed", F.lit("")).alias("observed"), F.coalesce(F.col("s") > F.col("f"), F.lit(True)).alias("present"))


def provider_history(half_ops: DataFrame) -> DataFrame:
    """Every operation with both fields carried forward."""
    w = Window.partitionBy("stack", "provider_urn").orderBy("op_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lambda kind: F.coalesce(F.last(F.when(F.col("kind") == kind, F.col("value")), ignorenulls=True).over(w), F.lit(""))
    return half_ops.select("op_seq", "stack", "provider_urn", carried("set_desired").alias("desired"), carried("set_observed").alias("observed"), (F.col("kind") != "forget").alias("present"))


def drift(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("present") & (F.col("desired") != F.col("observed")))


def runtime_states(ops: DataFrame) -> DataFrame:
    """(worker_id, event, heartbeat, contract) by replay of raw register / heartbeat / deregister events.

    A register starts the count at 1, heartbeats add to it while the worker is live and
    are ignored otherwise; a deregister of a live worker keeps the count and clears the contract.
    """
    w = Window.partitionBy("worker_id").orderBy("op_seq")
    last_turn = F.last(F.when(F.col("event") != "heartbeat", F.col("event")), ignorenulls=True).over(w)
    marked = ops.withColumn("phase", F.sum(F.when(F.col("event") == "register", 1).otherwise(0)).over(w)).withColumn("turn", last_turn)
    phases = marked.where("phase > 0").groupBy("worker_id", "phase").agg(
        F.min(F.when(F.col("event") == "deregister", F.col("op_seq"))).alias("gone"), F.min("op_seq").alias("from"),
        F.count_if((F.col("event") == "heartbeat") & (F.col("turn") == "register")).alias("beats"), F.max_by("contract", F.when(F.col("event") == "register", F.col("op_seq"))).alias("contract"),
    )
    newest = phases.groupBy("worker_id").agg(F.max_by(F.struct("gone", "beats", "contract"), "phase").alias("p"))
    live = F.col("p.gone").isNull()
    return newest.select("worker_id", F.when(live, "live").otherwise("gone").alias("state"), (F.col("p.beats") + 1).alias("heartbeat"), F.when(live, F.col("p.contract")).otherwise("").alias("contract"))


def live_workers(states: DataFrame, min_heartbeat: int = 0) -> DataFrame:
    return states.where((F.col("state") == "live") & (F.col("heartbeat") >= min_heartbeat))


def distinct_ids(log: DataFrame, key: str) -> DataFrame:
    return log.select(key).distinct().orderBy(key)


def with_versions(log: DataFrame, key: str | list[str], seq: str, restart_after: str | None = None) -> DataFrame:
    """`version` counts the records of a key from 1; with `restart_after` (a tombstone column) it starts anew after each tombstone."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(seq)
    if restart_after is None:
        return log.withColumn("version", F.row_number().over(w).cast("long"))
    era = F.coalesce(F.sum(F.col(restart_after).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("__era", era).withColumn("version", F.row_number().over(Window.partitionBy(*keys, "__era").orderBy(seq)).cast("long")).drop("__era")


def tip(log: DataFrame, seq: str) -> DataFrame:
    """One row: the greatest sequence, 0 for an empty log."""
    return log.agg(F.coalesce(F.max(seq), F.lit(0)).cast("long").alias("tip"))


def bounded(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first `limit` rows with the number of all candidates beside them; the count is its own aggregation, so the limit stays a top-k."""
    total = rows.agg(F.count("*").alias("match_count"))
    return rows.orderBy(*order).limit(limit).crossJoin(total).withColumn("truncated", F.col("match_count") > limit)
