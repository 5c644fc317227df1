"""Keyed stores: the state of each log, and the operations that requests turn into.

A write takes a log and a table of requests (one a key) and returns operation rows with
their sequence, and `applied`. Conditions are checked by one join with the folded state.
Single writer a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.errors import InvalidState
from tidelog.functions.scalars import is_expired
from tidelog.operators.folds import fold_latest, last_records

MAX_SCAN = 4096


def _single(requests: DataFrame, keys: list[str]) -> DataFrame:
    """The requests; a key that stands twice is an error when they are read. The count shares the join's partitioning, so it costs no job and no shuffle of its own."""
    n = F.count("*").over(Window.partitionBy(*keys))
    said = F.concat(F.lit("a batch holds one request a key; more have "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    checked = F.when(F.col("__n") > 1, F.raise_error(said)).otherwise(F.col(keys[0]))
    return requests.withColumn("__n", n).withColumn(keys[0], checked).drop("__n")


def _number(ops: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """op_seq after the log's tip for applied rows; a batch of requests is one writer's, so one ordered window numbers it."""
    tips = ops.agg(F.coalesce(F.max("op_seq"), F.lit(0)).alias("__tip"))
    place = F.row_number().over(Window.partitionBy("applied").orderBy(*order))
    return rows.crossJoin(tips).withColumn("op_seq", F.when(F.col("applied"), F.col("__tip") + place)).drop("__tip")


def kv_state(ops: DataFrame, keys: str | list[str] = "key", now_ms: int | None = None) -> DataFrame:
    """Live entries; with an expiry column those that `now_ms` has passed are gone."""
    state = fold_latest(ops, keys, "op_seq")
    return state.where(~is_expired(F.col("expires_at_ms"), now_ms)) if "expires_at_ms" in ops.columns else state


def kv_scan(ops: DataFrame, prefix: str, keys: str | list[str] = "key", now_ms: int | None = None, limit: int = MAX_SCAN) -> DataFrame:
    """Live entries with a key prefix in key order. The prefix filter is pushed below the fold, as it is on the key."""
    own = [keys] if isinstance(keys, str) else keys
    return kv_state(ops.where(F.col("key").startswith(prefix)), keys, now_ms).orderBy(*own).limit(max(0, min(limit, MAX_SCAN)))


def kv_write(ops: DataFrame, requests: DataFrame, keys: list[str], monotonic: bool, now_ms: int | None = None) -> DataFrame:
    """Operations for requests (keys..., value, delete, expected_version[, expires_at_ms]).

    expected_version null writes always, 0 if there is no live entry, n if its version is
    n. Deleting what has no record or a tombstone is not applied; what has expired may still be deleted. A version goes on across tombstones if
    `monotonic`, else starts again at 1.
    """
    requests = _single(requests, keys)
    state = last_records(ops, keys, "op_seq")
    expired = is_expired(F.col("expires_at_ms"), now_ms) if "expires_at_ms" in ops.columns else F.lit(False)
    state = state.select(*keys, (~F.col("deleted") & ~expired).alias("__live"), (~F.col("deleted")).alias("__there"), F.col("version").alias("__version"))
    joined = requests.join(state, keys, "left").withColumn("__live", F.coalesce("__live", F.lit(False))).withColumn("__there", F.coalesce("__there", F.lit(False)))
    current = F.coalesce(F.col("__version") if monotonic else F.when(F.col("__live"), F.col("__version")), F.lit(0))
    fits = F.when(F.col("expected_version").isNull(), F.lit(True)).when(F.col("expected_version") == 0, ~F.col("__live")).otherwise(F.col("__live") & (F.col("__version") == F.col("expected_version")))
    applied = fits & (~F.col("delete") | F.col("__there"))
    rows = joined.withColumn("applied", applied).withColumn("version", (current + 1).cast("long")).withColumn("deleted", F.col("delete"))
    rows = rows.withColumn("value", F.when(F.col("delete"), F.lit("")).otherwise(F.col("value")))
    if "expires_at_ms" in ops.columns:
        rows = rows.withColumn("expires_at_ms", F.when(~F.col("delete"), F.col("expires_at_ms")))
    return _number(ops, rows, keys).select(*ops.columns, "applied")


def registry_state(ops: DataFrame, kind: str | None = None) -> DataFrame:
    state = fold_latest(ops, "path", "op_seq")
    return state if kind is None else state.where(F.col("kind") == kind)


def registry_version(ops: DataFrame, path: str, version: int) -> DataFrame:
    """A pinned version: its first registration, whatever came later."""
    return ops.where((F.col("path") == path) & (F.col("version") == version) & ~F.col("deleted")).orderBy("op_seq").limit(1)


def pinned(ops: DataFrame, pins: DataFrame) -> DataFrame:
    """Registrations of many (path, version) pins: the first of each."""
    rows = ops.where(~F.col("deleted")).join(pins, ["path", "version"])
    rest = [c for c in ops.columns if c not in ("path", "version")]
    return rows.groupBy("path", "version").agg(F.min_by(F.struct(*rest), "op_seq").alias("r")).select("path", "version", "r.*")


def registry_write(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """register / deregister requests (path, kind, content, delete): versions go on across tombstones; deregistering what is not there is not applied, else it takes a version too and keeps the kind."""
    requests = _single(requests, ["path"])
    state = last_records(ops, "path", "op_seq").select("path", F.col("version").alias("__version"), F.col("kind").alias("__kind"), (~F.col("deleted")).alias("__live"))
    joined = requests.join(state, "path", "left")
    rows = joined.withColumn("applied", ~F.col("delete") | F.coalesce("__live", F.lit(False))).withColumn("version", (F.coalesce("__version", F.lit(0)) + 1).cast("long")).withColumn("deleted", F.col("delete"))
    rows = rows.withColumn("kind", F.when(F.col("delete"), F.coalesce("__kind", "kind")).otherwise(F.col("kind"))).withColumn("content", F.when(F.col("delete"), "").otherwise(F.col("content")))
    return _number(ops, rows, ["path"]).select(*ops.columns, "applied")


def wasm_resolve(ops: DataFrame, env: str | None = None, strict: bool = True) -> DataFrame:
    """(key, path, channel, env, version, digest) of active modules: the last operation, if it is no unpublish, with the digest published for its version.

    With strict=False a binding whose version was never published stays, with digest ''.
    """
    rows = ops if env is None else ops.where(F.col("env") == env)
    active = last_records(rows, "key", "op_seq").where("kind <> 'unpublish'").select("key", "path", "channel", "env", "version")
    published = rows.where("kind = 'publish'").groupBy("key", "version").agg(F.min_by("digest", "op_seq").alias("digest"))
    joined = active.join(published, ["key", "version"], "inner" if strict else "left")
    return joined.select("key", "path", "channel", "env", "version", F.coalesce("digest", F.lit("")).alias("digest"))


def wasm_history(raw: DataFrame) -> DataFrame:
    """Operation rows from requests (op_seq, key, path, channel, env, kind, bind_to, digest): publishes count versions from 1, binds to versions not yet published are dropped, so are unpublishes of nothing active."""
    w = Window.partitionBy("key").orderBy("op_seq")
    published = F.sum(F.when(F.col("kind") == "publish", 1).otherwise(0)).over(w)
    rows = raw.withColumn("__published", published).where((F.col("kind") != "bind") | (F.col("bind_to").between(1, F.col("__published"))))
    before = F.lag("kind").over(w)
    last_turn = F.when(F.col("kind") == "unpublish", before.isNotNull() & (before != "unpublish")).otherwise(True)
    rows = rows.withColumn("__keep", last_turn).where("__keep")
    version = F.when(F.col("kind") == "publish", F.col("__published")).when(F.col("kind") == "bind", F.col("bind_to"))
    carried = F.last(version, ignorenulls=True).over(w)
    return rows.withColumn("version", carried.cast("long")).drop("__published", "__keep", "bind_to")


def blob_state(ops: DataFrame, prefix: str = "") -> DataFrame:
    return fold_latest(ops.where(F.col("logical_key").startswith(prefix)), "logical_key", "op_seq").orderBy("logical_key")


def vector_points(ops: DataFrame) -> DataFrame:
    return fold_latest(ops, ["collection", "point_id"], "op_seq")


def resolve_bindings(bindings: DataFrame, libraries: DataFrame) -> DataFrame:
    """Channel bindings (the last of each channel) with the library of their path, revision and digest."""
    latest = last_records(bindings, "channel", "op_seq")
    return latest.join(libraries, ["path", "revision", "digest"])


def check_libraries(libraries: DataFrame) -> DataFrame:
    """(path, revision, digest, reason) of libraries that may not be published."""
    n = F.count("*").over(Window.partitionBy("path", "revision", "digest"))
    reason = F.when(n > 1, "published twice").when(F.size("capabilities") < 1, "no capability").when(F.col("byte_len") <= 0, "empty")
    return libraries.withColumn("reason", reason).where("reason is not null").select("path", "revision", "digest", "reason")


def retrieval_violations(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(kind, id) of rows that break the retrieval catalogue's rules: repeated ids, chunks without document, embeddings without chunk or of a wrong length."""
    twice = lambda df, key, kind: df.groupBy(key).count().where("count > 1").select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    out = twice(documents, "document_id", "document repeated").unionByName(twice(chunks, "chunk_id", "chunk repeated"))
    out = out.unionByName(chunks.join(documents, "document_id", "left_anti").select(F.lit("chunk without document").alias("kind"), F.col("chunk_id").alias("id")))
    out = out.unionByName(embeddings.join(chunks, "chunk_id", "left_anti").select(F.lit("embedding without chunk").alias("kind"), F.col("chunk_id").alias("id")))
    return out.unionByName(embeddings.where(F.size("vector") != F.col("dimensions")).select(F.lit("embedding of wrong length").alias("kind"), F.col("chunk_id").alias("id")))


def ingest_violations(chunks: DataFrame, most: int = 256, most_bytes: int = 65_536) -> DataFrame:
    """(document_id, reason) of documents that an ingest rejects: no or too many chunks, or a chunk that is too long."""
    folded = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    return folded.select("document_id", F.when(F.col("n") > most, "too many chunks").when(F.col("bytes") > most_bytes, "a chunk is too long").alias("reason")).where("reason is not null")


def expand_transactions(transactions: DataFrame) -> DataFrame:
    """One row for each mutation of a transaction log, in order: (sequence, transaction_id, tenant, namespace, ordinal, kind, body)."""
    exploded = transactions.select("sequence", "transaction_id", "tenant", "namespace", F.posexplode("mutations").alias("ordinal", "m"))
    return exploded.select("sequence", "transaction_id", "tenant", "namespace", "ordinal", "m.kind", "m.body")


def transaction_faults(transactions: DataFrame) -> DataFrame:
    """(sequence, reason) of records that a log must not hold: no mutation, a repeated id, a gap."""
    followed = transactions.select((F.col("sequence") + 1).alias("sequence")).distinct().withColumn("__follows", F.lit(True))
    n = F.count("*").over(Window.partitionBy("transaction_id"))
    gap = (F.col("sequence") != 1) & F.col("__follows").isNull()
    reason = F.when(F.size("mutations") < 1, "no mutation").when(F.col("n") > 1, "repeated transaction id").when(gap, "gap")
    return transactions.withColumn("n", n).join(followed, "sequence", "left").select("sequence", reason.alias("reason")).where("reason is not null")


def ingest_document(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame, most: int = 256, most_bytes: int = 65_536) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks) to append, and (document_id, reason) of what is refused: a document that is there, without chunks, or out of bounds. A document comes whole with its chunks or not at all."""
    sizes = new_chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    there = documents.select("document_id").distinct().withColumn("__there", F.lit(True))
    asked = new_documents.join(sizes, "document_id", "left").join(there, "document_id", "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("__there"), "document is there").when(n < 1, "no chunks").when(n > most, "too many chunks").when(F.col("bytes") > most_bytes, "a chunk is too long")
    judged = asked.withColumn("reason", reason)
    taken = judged.where("reason is null").select(*new_documents.columns)
    return taken, new_chunks.join(taken.select("document_id"), "document_id", "left_semi").select(*new_chunks.columns), judged.where("reason is not null").select("document_id", "reason")


def owned(log: DataFrame, shard: str, owner: list[int]) -> DataFrame:
    """A log's records of the shards that an owner holds; shards are partitions, so others are not read."""
    return log.where(F.col(shard).isin(owner))
