"""Contracts of the tiers: bounded versioned writes, the event log with durable consumers and owners, domain records, receipts.

A write takes a log of operations and requests (one a key) and returns the operations to
append, each with its outcome. Nothing is changed by a request that is refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import InvalidState, NotOwner
from tidelog.operators.folds import last_records
from tidelog.operators.logs import assign_sequence, publish
from tidelog.operators.stores import _number, _single
from tidelog.session import hadoop_path

MAX_VALUE_BYTES = 1 << 20
MAX_OBJECT_BYTES = 16 << 20
MAX_DIMENSIONS = 4096
MAX_PAYLOAD_BYTES = 16 << 10
MAX_BATCH = 4096
TIERS = ("eventlog", "projection", "kv", "object", "vector")
MODES = ("off", "shadow", "primary")


def _outcomes(deleting: Column, live: Column, fault: Column | None = None) -> Column:
    """'rejected: ...' for a fault, 'written', 'deleted', or 'absent' for a delete of what is not live."""
    base = F.when(deleting & ~live, F.lit("absent")).when(deleting, F.lit("deleted")).otherwise(F.lit("written"))
    return base if fault is None else F.when(fault.isNotNull(), F.concat(F.lit("rejected: "), fault)).otherwise(base)


def _latest(ops: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests beside the last operation of their key (columns __c for c), and whether it is live."""
    rest = [c for c in ops.columns if c not in keys]
    state = last_records(ops, keys, "op_seq").select(*keys, *(F.col(c).alias(f"__{c}") for c in rest))
    joined = _single(requests, keys).join(state, keys, "left")
    return joined.withColumn("__live", F.coalesce(~F.col("__deleted"), F.lit(False)))


def _known_digests(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """rows with __known: whether a digest was put before, under whatever key."""
    known = ops.where("not deleted").select("digest").distinct().withColumn("__known", F.lit(True))
    return rows.join(known, "digest", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))


def blob_write(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """Operations of a blob registry for requests (logical_key, digest, size, delete), with outcome, applied and deduplicated.

    A put points its key at a content; deduplicated says that the content was stored
    before. A delete keeps the digest and has size 0; of an absent key it is no operation.
    """
    rows = _latest(ops, requests, ["logical_key"])
    rows = _known_digests(rows, ops).withColumn("outcome", _outcomes(F.col("delete"), F.col("__live")))
    rows = rows.withColumn("applied", F.col("outcome") != "absent").withColumn("deleted", F.col("delete")).withColumn("deduplicated", ~F.col("delete") & F.col("__known"))
    rows = rows.withColumn("digest", F.when(F.col("delete"), F.col("__digest")).otherwise(F.col("digest"))).withColumn("size", F.when(F.col("delete"), F.lit(0).cast("long")).otherwise(F.col("size")))
    return _number(ops, rows, ["logical_key"]).select(*ops.columns, "outcome", "applied", "deduplicated")


def object_write(ops: DataFrame, requests: DataFrame, most: int = MAX_OBJECT_BYTES) -> DataFrame:
    """Operations of the object tier for requests (key, digest, byte_len, delete), with outcome, applied and deduplicated.

    Versions go on across tombstones. A content of more than `most` bytes is rejected.
    """
    rows = _known_digests(_latest(ops, requests, ["key"]), ops)
    fault = F.when(~F.col("delete") & (F.col("byte_len") > most), F.lit("too large"))
    rows = rows.withColumn("outcome", _outcomes(F.col("delete"), F.col("__live"), fault))
    rows = rows.withColumn("applied", F.col("outcome").isin("written", "deleted")).withColumn("deleted", F.col("delete")).withColumn("deduplicated", (F.col("outcome") == "written") & F.col("__known"))
    rows = rows.withColumn("version", (F.coalesce("__version", F.lit(0)) + 1).cast("long"))
    rows = rows.withColumn("digest", F.when(F.col("delete"), F.col("__digest")).otherwise(F.col("digest"))).withColumn("byte_len", F.when(F.col("delete"), F.lit(0).cast("long")).otherwise(F.col("byte_len")))
    return _number(ops, rows, ["key"]).select(*ops.columns, "outcome", "applied", "deduplicated")


def vector_write(ops: DataFrame, requests: DataFrame, dimensions: int = MAX_DIMENSIONS, payload_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Operations of the vector tier for requests (collection, point_id, model_id, vector, payload, delete), with outcome and applied.

    Versions of a point go on across tombstones. Vectors must have 1 to `dimensions`
    finite values, payloads at most `payload_bytes`; a delete may be repeated.
    """
    rows = _latest(ops, requests, ["collection", "point_id"])
    size = F.coalesce(F.size("vector"), F.lit(0))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fault = F.when(F.col("delete"), F.lit(None)).when((size < 1) | (size > dimensions), "dimensions").when(~finite, "not finite").when(F.octet_length("payload") > payload_bytes, "payload too large")
    rows = rows.withColumn("outcome", _outcomes(F.col("delete"), F.col("__live"), fault))
    rows = rows.withColumn("applied", F.col("outcome").isin("written", "deleted")).withColumn("deleted", F.col("delete")).withColumn("version", (F.coalesce("__version", F.lit(0)) + 1).cast("long"))
    for c in ("model_id", "vector", "payload"):
        rows = rows.withColumn(c, F.when(F.col("delete"), F.col(f"__{c}")).otherwise(F.col(c)))
    return _number(ops, rows, ["collection", "point_id"]).select(*ops.columns, "outcome", "applied")


def kv_bounded(requests: DataFrame, most: int = MAX_VALUE_BYTES) -> DataFrame:
    """Requests for a key-value log; a value of more than `most` bytes is an error when they are read."""
    too_long = F.octet_length("value") > most
    return requests.withColumn("value", F.when(too_long, F.raise_error(F.lit(f"a value has more than {most} bytes"))).otherwise(F.col("value")))


def check_batch(batch: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """A projection batch, if it is not larger than one may be."""
    if batch.limit(most + 1).count() > most:
        raise InvalidState(f"a batch has more than {most} records")
    return batch


def projection_state(snapshots: DataFrame, execution_ids: Iterable[str] | None = None) -> DataFrame:
    """(execution_id, status, data, proj_seq): the last snapshot of each execution, or of those named; the filter comes before the fold."""
    rows = snapshots if execution_ids is None else snapshots.where(F.col("execution_id").isin(list(execution_ids)))
    return last_records(rows, "execution_id", "proj_seq").select("execution_id", "status", "data", "proj_seq")


def record_states(snapshots: DataFrame, states: DataFrame, order: str) -> DataFrame:
    """Snapshot rows to append for states (execution_id, status, data), numbered after the last."""
    tip = snapshots.agg(F.coalesce(F.max("proj_seq"), F.lit(0)).alias("tip")).select(F.lit(0).alias("__log"), "tip")
    numbered = assign_sequence(states.withColumn("__log", F.lit(0)), "__log", order, tip)
    return numbered.withColumnRenamed("sequence", "proj_seq").select(*snapshots.columns)


# the event log


def append_records(log: DataFrame, arrivals: DataFrame, stream: str, order: str) -> DataFrame:
    """Records to append, with their sequence and `created_stream`: true for the first record of a stream that the log did not have."""
    before = log.groupBy(stream).agg(F.max("sequence").alias("__tip")).select(F.col(stream).alias("__stream"), "__tip")
    new = publish(log, arrivals, stream, order)
    flagged = new.join(before, new[stream].eqNullSafe(before["__stream"]), "left")
    return flagged.withColumn("created_stream", F.col("__tip").isNull() & (F.col("sequence") == 1)).drop("__stream", "__tip")


def tail(log: DataFrame, consumers: DataFrame, asked: DataFrame, limit: int, floor: int = 0, seq: str = "sequence") -> DataFrame:
    """Pending records of the asked consumers (consumer): (consumer, exists, created_consumer, acked, pending_count, columns of the log), at most `limit` each, in order.

    A consumer that is not there is created with no cursor; no cursor moves. A consumer
    with nothing pending has one row without a record, so has each on a log without
    records (exists = false, nothing created). Sequences are gapless past `floor`, below
    which nothing is read, so the pending ones are known by number and met by equality.
    """
    state = consumers.select("consumer", F.coalesce("acked", F.lit(0)).cast("long").alias("acked"), F.lit(True).alias("__there"))
    tip = log.agg(F.max(seq).alias("__tip"))
    rows = asked.select("consumer").distinct().join(state, "consumer", "left").crossJoin(tip)
    start = F.greatest(F.coalesce("acked", F.lit(0).cast("long")), F.lit(floor).cast("long"))
    rows = rows.withColumn("exists", F.col("__tip").isNotNull()).withColumn("created_consumer", F.col("exists") & F.col("__there").isNull())
    rows = rows.withColumn("pending_count", F.greatest(F.coalesce(F.col("__tip") - start, F.lit(0)), F.lit(0)).cast("long"))
    last = F.least(start + limit, F.col("__tip"))
    rows = rows.withColumn(seq, F.explode_outer(F.when(F.col("exists") & (last > start), F.sequence(start + 1, last))))
    return rows.join(log, seq, "left").select("consumer", "exists", "created_consumer", "acked", "pending_count", *log.columns)


def route_writes(arrivals: DataFrame, shard: str, owner: Iterable[int]) -> DataFrame:
    """arrivals with `served_by`: 'owner' for shards that are owned, else 'refused: not owner'; what is refused must not be written."""
    return arrivals.withColumn("served_by", F.when(F.col(shard).isin(list(owner)), "owner").otherwise("refused: not owner"))


def route_reads(log: DataFrame, shard: str, owner: Iterable[int]) -> DataFrame:
    """A log with `served_by`: 'local' for shards that are owned, 'cold-load' for others, which a non-owner reads from shared storage."""
    return log.withColumn("served_by", F.when(F.col(shard).isin(list(owner)), "local").otherwise("cold-load"))


def consume(log: DataFrame, consumers: DataFrame, asked: DataFrame, stream: str, limit: int) -> DataFrame:
    """Domain records for (stream, consumer) pairs: (stream, consumer, exists, created_consumer, acked, pending_count, sequence, subject, payload).

    As tail(), of many streams: a stream without records gives exists = false and creates nothing.
    """
    tips = log.groupBy(stream).agg(F.max("sequence").alias("__tip"))
    state = consumers.select(stream, "consumer", F.coalesce("acked", F.lit(0)).cast("long").alias("acked"), F.lit(True).alias("__there"))
    rows = asked.select(stream, "consumer").distinct().join(state, [stream, "consumer"], "left").join(tips, stream, "left")
    start = F.coalesce("acked", F.lit(0).cast("long"))
    rows = rows.withColumn("exists", F.col("__tip").isNotNull()).withColumn("created_consumer", F.col("exists") & F.col("__there").isNull())
    rows = rows.withColumn("pending_count", F.coalesce(F.col("__tip") - start, F.lit(0)).cast("long"))
    last = F.least(start + limit, F.col("__tip"))
    rows = rows.withColumn("sequence", F.explode_outer(F.when(F.col("exists") & (last > start), F.sequence(start + 1, last))))
    return rows.join(log.select(stream, "sequence", "subject", "payload"), [stream, "sequence"], "left").select(stream, "consumer", "exists", "created_consumer", "acked", "pending_count", "sequence", "subject", "payload")


def receipts(outcomes: DataFrame, key: str, status: str, order: str, fields: list[str]) -> DataFrame:
    """Receipt events (sequence, subject, payload) of outcomes, in order: the subject names the status, the payload holds the fields as JSON."""
    rows = outcomes.select(F.lit("receipts").alias("stream"), F.col(order).alias("__order"), F.concat(F.lit("receipts."), F.col(status)).alias("subject"), F.to_json(F.struct(key, *fields)).alias("payload"))
    return assign_sequence(rows, "stream", "__order").select("sequence", "subject", "payload")


def sse_frames(records: DataFrame, seq: str = "sequence", event: str = "subject", payload: str = "payload") -> DataFrame:
    """(seq, frame): records as server-sent events; each line of a payload is a data line."""
    lines = F.array_join(F.transform(F.split(F.coalesce(F.col(payload), F.lit("")), "\r\n|\n|\r", -1), lambda x: F.concat(F.lit("data: "), x)), "\n")
    return records.select(seq, F.concat(F.lit("id: "), F.col(seq).cast("string"), F.lit("\nevent: "), F.col(event), F.lit("\n"), lines, F.lit("\n\n")).alias("frame"))


def create_streams(existing: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """(key..., outcome) of requests to create: 'created', or 'refused: exists' for what is there or is asked twice (then once created)."""
    n = asked.groupBy(*key).agg(F.count("*").alias("__n"))
    there = existing.select(*key).distinct().withColumn("__there", F.lit(True))
    rows = n.join(there, key, "left").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return rows.select(*key, F.when(F.col("__there").isNull() & (F.col("__k") == 1), "created").otherwise("refused: exists").alias("outcome"))


class EventLog:
    """An event log in shared storage: records and consumers as Parquet folders, one writer a shard.

    `owner` names the shards that this writer holds (None: all). An append, an
    acknowledgement or a reclaim of others raises NotOwner before anything is written;
    reads are open to all. Records carry (shard, sequence, execution_id, transaction_id, payload).
    """

    RECORDS = "shard int, sequence long, execution_id string, transaction_id string, payload string"
    CURSORS = "shard int, consumer string, acked long, op_seq long"
    FLOORS = "shard int, floor long"

    def __init__(self, spark: SparkSession, root: str, owner: Iterable[int] | None = None, strict: bool = True):
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict
        self.owner = None if owner is None else frozenset(owner)

    def _read(self, name: str, ddl: str) -> DataFrame:
        fs, at = hadoop_path(self.spark, f"{self.root}/{name}")
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}") if fs.exists(at) else self.spark.createDataFrame([], ddl)

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("shard").parquet(f"{self.root}/{name}")

    def _own(self, shards: Iterable[int]) -> None:
        other = sorted(set(shards) - self.owner) if self.owner is not None else []
        if other:
            raise NotOwner(f"shard {other[0]} belongs to another writer")

    def records(self) -> DataFrame:
        """Records above what was reclaimed."""
        floors = self._read("floors", self.FLOORS).groupBy("shard").agg(F.max("floor").alias("__floor"))
        rows = self._read("records", self.RECORDS).join(floors, "shard", "left")
        return rows.where(F.col("sequence") > F.coalesce("__floor", F.lit(0))).drop("__floor")

    def append(self, arrivals: DataFrame, order: str) -> DataFrame:
        """Appends (shard, execution_id, transaction_id, payload, order) and returns (shard, appended, tip, created_stream). A barrier: what it returned is on shared storage."""
        self._own(r.shard for r in arrivals.select("shard").distinct().collect())
        before = self._read("records", self.RECORDS)
        tips = before.groupBy("shard").agg(F.max("sequence").alias("tip"))
        told = {r.shard: r.tip for r in tips.collect()}
        new = publish(before, arrivals, "shard", order).select("shard", "sequence", "execution_id", "transaction_id", "payload")
        self._add("records", new)
        after = self._read("records", self.RECORDS).groupBy("shard").agg(F.max("sequence").alias("tip")).collect()
        rows = [(r.shard, r.tip - told.get(r.shard, 0), r.tip, r.shard not in told) for r in after if r.tip > told.get(r.shard, 0)]
        return self.spark.createDataFrame(rows, "shard int, appended long, tip long, created_stream boolean")

    def scan_global(self, shard: int, cursor: int = 0, limit: int = MAX_BATCH) -> DataFrame:
        return self.records().where((F.col("shard") == shard) & (F.col("sequence") > cursor)).orderBy("sequence").limit(limit)

    def read_execution(self, execution_id: str, cursor: int = 0) -> DataFrame:
        return self.records().where((F.col("execution_id") == execution_id) & (F.col("sequence") > cursor)).orderBy("shard", "sequence")

    def cursors(self) -> DataFrame:
        """(shard, consumer, acked), the last of each."""
        return last_records(self._read("cursors", self.CURSORS), ["shard", "consumer"], "op_seq").select("shard", "consumer", "acked")

    def _set_cursor(self, shard: int, consumer: str, acked: int) -> None:
        held = self._read("cursors", self.CURSORS).where((F.col("shard") == shard) & (F.col("consumer") == consumer)).agg(F.max("op_seq")).first()[0]
        self._add("cursors", self.spark.createDataFrame([(shard, consumer, acked, (held or 0) + 1)], self.CURSORS).coalesce(1))

    def tail(self, shard: int, consumer: str, limit: int = MAX_BATCH) -> DataFrame:
        """Pending records of a consumer, which is created on its first tail and not moved; none for a shard without records."""
        own = self.cursors().where((F.col("shard") == shard) & (F.col("consumer") == consumer)).head(1)
        rows = self.records().where(F.col("shard") == shard)
        if not own and not rows.isEmpty():
            self._own([shard])
            self._set_cursor(shard, consumer, 0)
        return rows.where(F.col("sequence") > (own[0].acked if own else 0)).orderBy("sequence").limit(limit)

    def ack(self, shard: int, consumer: str, sequence: int) -> bool:
        """Moves a cursor; False if it would go back and the log is not strict. Beyond the tip, and backwards in a strict log, is an error."""
        self._own([shard])
        own = self.cursors().where((F.col("shard") == shard) & (F.col("consumer") == consumer)).head(1)
        if not own:
            raise InvalidState(f"there is no consumer {consumer}")
        tip = self._read("records", self.RECORDS).where(F.col("shard") == shard).agg(F.max("sequence")).first()[0] or 0
        if not 1 <= sequence <= tip:
            raise InvalidState(f"sequence {sequence} does not exist")
        if sequence < own[0].acked:
            if self.strict:
                raise InvalidState(f"the cursor of {consumer} cannot move back from {own[0].acked} to {sequence}")
            return False
        self._set_cursor(shard, consumer, sequence)
        return True

    def reclaim(self, shard: int) -> int:
        """Gives up what every consumer of a shard has acknowledged; the floor, below which nothing is read again."""
        self._own([shard])
        floor = self.cursors().where(F.col("shard") == shard).agg(F.min("acked")).first()[0] or 0
        if floor:
            self._add("floors", self.spark.createDataFrame([(shard, floor)], self.FLOORS).coalesce(1))
        return floor


def backend_matrix(enabled: bool, role: str, modes: dict[str, str | None]) -> dict[str, str]:
    """Which engine serves each tier: 'own' in mode primary, else 'external'. An unknown mode counts as off.

    A tier that serves needs the whole to be enabled and a role that is not the control
    plane's; a tier that is not known is an error.
    """
    strange = sorted(set(modes) - set(TIERS))
    if strange:
        raise InvalidState(f"there is no tier {strange[0]}")
    chosen = {t: m if (m := (modes.get(t) or "").strip().lower()) in MODES else "off" for t in TIERS}
    for tier, mode in chosen.items():
        if mode != "off" and not enabled:
            raise InvalidState(f"{tier}: mode {mode} while the whole is not enabled")
        if mode == "primary" and role in ("gateway", "api", "server"):
            raise InvalidState(f"{tier}: the control plane must not serve it")
    return {t: "own" if m == "primary" else "external" for t, m in chosen.items()}
