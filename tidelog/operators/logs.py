"""Reading append-only logs: cursors, consumers, lags, retention, sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.errors import InvalidState
from tidelog.functions.subjects import subject_matches
from tidelog.operators.numbering import number, previous


def after_cursor(log: DataFrame, seq: str, cursor: int) -> DataFrame:
    """Records past a cursor; the comparison is pushed to the scan's statistics."""
    return log.where(F.col(seq) > cursor)


def read_key(log: DataFrame, key: str, value: str, seq: str, cursor: int = 0) -> DataFrame:
    return log.where((F.col(key) == value) & (F.col(seq) > cursor)).orderBy(seq)


def scan(log: DataFrame, seq: str, cursor: int, limit: int, floor: int = 0) -> DataFrame:
    """The first `limit` records past the cursor, never below what was reclaimed (`floor`)."""
    return log.where(F.col(seq) > max(cursor, floor)).orderBy(seq).limit(limit)


def replay(log: DataFrame, seq: str) -> DataFrame:
    return log.orderBy(seq)


def pending(log: DataFrame, consumers: DataFrame, seq: str = "sequence", subject_filter: str | None = None) -> DataFrame:
    """(consumer, record) for every record past each consumer's cursor; a missing cursor is 0. Consumers are a small table, checked by the planner."""
    rows = log if subject_filter is None else log.where(subject_matches(F.col("subject"), subject_filter))
    return consumers.select("consumer", F.coalesce("acked", F.lit(0)).alias("acked")).join(rows, F.col(seq) > F.col("acked")).drop("acked")


def acknowledge(consumers: DataFrame, consumer: str, sequence: int, tip: int, strict: bool = True) -> DataFrame:
    """The consumers with one cursor moved. Beyond the tip is an error; backwards is one too if `strict`, else ignored."""
    found = consumers.where(F.col("consumer") == consumer).select(F.coalesce("acked", F.lit(0))).head(1)
    if not found:
        raise InvalidState(f"there is no consumer {consumer}")
    if sequence > tip:
        raise InvalidState(f"sequence {sequence} does not exist")
    if sequence < found[0][0]:
        if strict:
            raise InvalidState(f"the cursor of {consumer} cannot move back from {found[0][0]} to {sequence}")
        return consumers
    return consumers.withColumn("acked", F.when(F.col("consumer") == consumer, F.lit(sequence).cast("long")).otherwise(F.col("acked")))


def acknowledge_each(consumers: DataFrame, acks: DataFrame, log: DataFrame, seq: str = "sequence", strict: bool = True) -> DataFrame:
    """(consumer, acked, outcome) for acknowledgements (consumer, sequence), one a consumer, and the cursors they leave.

    outcome is 'moved', 'unchanged' (no acknowledgement), 'refused: no consumer',
    'refused: beyond the tip', and for a cursor that would go back 'refused: backwards' if
    `strict`, else 'ignored'. What is refused or ignored leaves the cursor as it was.
    """
    tip = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__tip"))
    state = consumers.select("consumer", F.coalesce("acked", F.lit(0)).alias("acked"), F.lit(True).alias("__there"))
    both = state.join(acks.select("consumer", F.col("sequence").alias("__to")), "consumer", "full_outer").crossJoin(tip)
    back = F.lit("refused: backwards" if strict else "ignored")
    outcome = (
        F.when(F.col("__there").isNull(), "refused: no consumer").when(F.col("__to").isNull(), "unchanged").when(F.col("__to") > F.col("__tip"), "refused: beyond the tip")
        .when(F.col("__to") < F.col("acked"), back).otherwise("moved")
    )
    return both.select("consumer", F.when(outcome == "moved", F.col("__to")).otherwise(F.col("acked")).alias("acked"), outcome.alias("outcome"))


def interest_ceiling(consumers: DataFrame) -> DataFrame:
    """One row: the least cursor of all consumers (missing ones are 0); null without consumers."""
    return consumers.agg(F.min(F.coalesce("acked", F.lit(0))).cast("long").alias("ceiling"))


def lag(log: DataFrame, cursors: DataFrame, shard: str, seq: str) -> DataFrame:
    """(shard, lag) with a total row of shard null: records past each shard's committed cursor. One scan and one partial aggregation of the log; cursors are a row a shard."""
    past = F.col(seq) > F.coalesce("committed", F.lit(0))
    counted = log.select(shard, seq).join(cursors.select(shard, "committed"), shard, "left").groupBy(shard).agg(F.count_if(past).alias("lag"))
    return counted.rollup(shard).agg(F.sum("lag").alias("lag"))


def lag_metrics(lags: DataFrame, shard: str, name: str = "consumer_lag") -> DataFrame:
    """Exposition lines of a lag table, one a row."""
    label = F.when(F.col(shard).isNull(), F.lit("")).otherwise(F.concat(F.lit('{shard="'), F.col(shard).cast("string"), F.lit('"}')))
    total = F.when(F.col(shard).isNull(), F.lit("_total")).otherwise(F.lit(""))
    return lags.select(F.concat(F.lit(name), total, label, F.lit(" "), F.col("lag").cast("string")).alias("line"))


def committed_cursor(deliveries: DataFrame, key: str = "shard") -> DataFrame:
    """(key, cursor) from (key, seq, acked): just below the lowest record not acked, else the highest delivered."""
    return deliveries.groupBy(key).agg(F.coalesce(F.min(F.when(~F.col("acked"), F.col("seq"))) - 1, F.max("seq")).alias("cursor"))


def deliveries_with_attempts(deliveries: DataFrame, order: str = "tick") -> DataFrame:
    """Every delivery of a record with its attempt number and whether it repeats an earlier one."""
    w = Window.partitionBy("shard", "seq").orderBy(order)
    return deliveries.withColumn("attempt", F.row_number().over(w)).withColumn("redelivered", F.col("attempt") > 1)


def assign_sequence(arrivals: DataFrame, stream: str, order: Column | str, after: DataFrame | None = None) -> DataFrame:
    """`sequence` from 1 without gaps in each stream, or on from (stream, tip) of `after`."""
    numbered = number(arrivals, [stream], order, "sequence")
    if after is None:
        return numbered
    joined = numbered.join(after.select(stream, "tip"), stream, "left")
    return joined.withColumn("sequence", F.col("sequence") + F.coalesce("tip", F.lit(0))).drop("tip").select(*numbered.columns)


def gaps(log: DataFrame, stream: str, seq: str = "sequence") -> DataFrame:
    """Records that do not follow their predecessor by one (the first must be 1): (stream, seq, previous)."""
    rows = previous(log.select(stream, seq), [stream], seq, "previous")
    return rows.withColumn("previous", F.coalesce("previous", F.lit(0))).where(F.col(seq) != F.col("previous") + 1)


def retain_newest(log: DataFrame, stream: str, seq: str, count: int) -> DataFrame:
    """The newest `count` records of each stream, also where sequences have gaps. The rank is bounded, so each task hands on `count` records of a stream at most."""
    if count <= 0:
        raise InvalidState("retention must keep at least one record")
    newest = Window.partitionBy(stream).orderBy(F.desc(seq))
    return log.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= count).drop("__rank")


def publish(log: DataFrame | None, arrivals: DataFrame, stream: str, order: Column | str) -> DataFrame:
    """Records to append: arrivals with sequences that go on from the log's tips."""
    tips = None if log is None else log.groupBy(stream).agg(F.max("sequence").alias("tip"))
    return assign_sequence(arrivals, stream, order, tips)


def stream_info(log: DataFrame, stream: str, name: str) -> DataFrame:
    """One row (exists, record_count, tip); a missing stream exists = false, not an error."""
    return log.where(F.col(stream) == name).agg((F.count("*") > 0).alias("exists"), F.count("*").alias("record_count"), F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("tip"))


def stream_infos(log: DataFrame, stream: str, names: DataFrame) -> DataFrame:
    """(stream, exists, record_count, tip) for each asked name (stream), whether it is there or not."""
    found = log.groupBy(stream).agg(F.count("*").alias("record_count"), F.max("sequence").alias("tip"))
    rows = names.select(stream).distinct().join(found, stream, "left")
    return rows.select(stream, F.col("record_count").isNotNull().alias("exists"), F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"), F.coalesce("tip", F.lit(0)).cast("long").alias("tip"))


def apply_once(batch: DataFrame, applied: DataFrame | None, seq: str = "global_sequence", event_id: str = "event_id", checkpoint: int = 0) -> DataFrame:
    """The records of a batch to apply: past the checkpoint, not applied before, one for each event id (its lowest sequence)."""
    fresh = batch.where(F.col(seq) > checkpoint)
    if applied is not None:
        fresh = fresh.join(applied.select(event_id), event_id, "left_anti")
    rest = [c for c in batch.columns if c != event_id]
    first = fresh.groupBy(event_id).agg(F.min_by(F.struct(*rest), seq).alias("r"))
    return first.select(event_id, "r.*").select(*batch.columns)
