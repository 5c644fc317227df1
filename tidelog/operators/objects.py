"""Content-addressed objects: dedup, verification, placement and replication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import content_digest, is_digest, object_path, object_uri
from tidelog.session import ship

MAX_LIST = 4096


def put_flags(puts: DataFrame, digest: str, order: str) -> DataFrame:
    """Each put with `stored`: whether it was the first of its digest."""
    return puts.withColumn("stored", F.row_number().over(Window.partitionBy(digest).orderBy(order)) == 1)


def dedup(puts: DataFrame, digest: str, size: str) -> DataFrame:
    """(digest, puts, bytes_stored, bytes_saved): one row for each content; a partial aggregation."""
    return puts.groupBy(digest).agg(F.count("*").alias("puts"), F.max(size).cast("long").alias("bytes_stored"), (F.sum(size) - F.max(size)).cast("long").alias("bytes_saved"))


def list_prefix(state: DataFrame, key: str, prefix: str, limit: int) -> DataFrame:
    """Live keys with a prefix in key order, `limit` clamped to 4,096."""
    return state.where(F.col(key).startswith(prefix)).orderBy(key).limit(max(0, min(limit, MAX_LIST)))


def resolve(pointers: DataFrame, objects: DataFrame) -> DataFrame:
    """Pointers with their object's bytes by digest; `verified` recomputes the digest."""
    joined = pointers.join(objects.select("digest", "content"), "digest")
    return joined.withColumn("verified", content_digest(F.col("content")) == F.col("digest"))


def verify(objects: DataFrame) -> DataFrame:
    """(key, digest_ok, length_ok) of stored objects (key, digest, byte_len, content)."""
    return objects.select("key", (is_digest(F.col("digest")) & (content_digest(F.col("content")) == F.col("digest"))).alias("digest_ok"), (F.octet_length("content").cast("long") == F.col("byte_len")).alias("length_ok"))


def locate(pointers: DataFrame, scheme: str, namespace: str) -> DataFrame:
    return pointers.select("key", "digest", object_path(F.col("digest")).alias("path"), object_uri(scheme, namespace, F.col("digest")).alias("uri"))


def replication_plan(objects: DataFrame, replicas: DataFrame, policy: DataFrame, identity: tuple[str, ...] = ("path",)) -> DataFrame:
    """(identity..., source, target, action) for each object and target of the policy: 'satisfied' where the source or a replica is there, else 'copy_needed'.

    `objects` have (identity..., placement), `replicas` (identity..., placement), `policy`
    (target). An object is what the columns of `identity` name: where paths repeat with
    different contents they need more than the path. A null is a name like any other.
    The policy is a handful of rows; the planner broadcasts it by its size.
    """
    have = objects.select(*identity, "placement").unionByName(replicas.select(*identity, "placement")).distinct()
    have = have.select(*(F.col(c).alias(f"__{c}") for c in identity), F.col("placement").alias("__placement"), F.lit(True).alias("there"))
    wanted = objects.select(*identity, F.col("placement").alias("source")).crossJoin(policy.select("target"))
    joined = wanted.join(have, [wanted["target"] == have["__placement"], *(wanted[c].eqNullSafe(have[f"__{c}"]) for c in identity)], "left")
    return joined.select(*identity, "source", "target", F.when(F.col("there"), "satisfied").otherwise("copy_needed").alias("action"))


def replicate(plan: DataFrame) -> DataFrame:
    """Replica rows to append for the copies that a plan asks for."""
    return plan.where("action = 'copy_needed'").select("path", F.col("target").alias("placement"))


def replica_counts(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy("path").agg(F.countDistinct("placement").alias("replica_count"))


def replication_totals(objects: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row (object_count, copy_count, object_bytes): different objects (path), and copies of them at different placements, sources included."""
    copies = objects.select("path", "placement").unionByName(replicas.select("path", "placement")).distinct().agg(F.count("*").alias("copy_count"))
    once = objects.groupBy("path").agg(F.max("byte_len").alias("byte_len")).agg(F.count("*").alias("object_count"), F.coalesce(F.sum("byte_len"), F.lit(0)).cast("long").alias("object_bytes"))
    return once.crossJoin(copies).select("object_count", "copy_count", "object_bytes")


def put_objects(rows: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Writes contents below `root` under their digest's path where they are not there yet; (digest, path, byte_len, puts, stored), a row for each content.

    Contents are equal under one path, so a repeated task writes the same again. The
    result is lazy; nothing is written until it is read. Null contents are left out.
    """
    ship(rows.sparkSession)
    hashed = rows.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("content"))
    once = hashed.withColumn("digest", content_digest(F.col("content"))).groupBy("digest").agg(F.count("*").alias("puts"), F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.sources.storage import Substrate

        store = Substrate(root)
        for batch in batches:
            paths, stored = batch.column("path").to_pylist(), []
            for path, body in zip(paths, batch.column("content"), strict=True):
                stored.append(store.put_if_absent(path, body.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("path"), batch.column("byte_len"), batch.column("puts"), pa.array(stored, pa.bool_())], names=["digest", "path", "byte_len", "puts", "stored"])

    placed = once.select("digest", object_path(F.col("digest")).alias("path"), F.octet_length("content").cast("long").alias("byte_len"), "puts", "content")
    return placed.mapInArrow(run, "digest string, path string, byte_len long, puts long, stored boolean")


def get_objects(pointers: DataFrame, root: str) -> DataFrame:
    """(columns of pointers, content, outcome) for (digest, byte_len, ...): outcome is 'ok', 'missing', 'length' or 'digest'; content is null unless ok."""
    ship(pointers.sparkSession)
    rows = pointers.withColumn("__path", F.when(is_digest(F.col("digest")), object_path(F.col("digest"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from tidelog.sources.storage import Substrate

        store = Substrate(root)
        for batch in batches:
            bodies, outcomes = [], []
            for path, digest, size in zip(batch.column("__path").to_pylist(), batch.column("digest").to_pylist(), batch.column("byte_len").to_pylist(), strict=True):
                body = store.get_range(path) if path is not None and store.exists(path) else None
                outcome = "missing" if body is None else "length" if len(body) != size else "ok" if "sha256:" + hashlib.sha256(body).hexdigest() == digest else "digest"
                bodies.append(body if outcome == "ok" else None)
                outcomes.append(outcome)
            own = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__path"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bodies, pa.binary()), pa.array(outcomes, pa.string())], names=[*(n for n in batch.schema.names if n != "__path"), "content", "outcome"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pointers.schema)
    return rows.mapInArrow(run, f"{schema}, content binary, outcome string")


def conflicting_replicas(replicas: DataFrame) -> DataFrame:
    """(path, placement) registered with differing digests."""
    return replicas.groupBy("path", "placement").agg(F.countDistinct("digest").alias("digests")).where("digests > 1").select("path", "placement")


def orphans(listed: DataFrame, referenced: DataFrame, key: str | list[str] = "key") -> DataFrame:
    """The listed keys that nothing refers to, as often as they are listed. A null is a key like any other."""
    keys = [key] if isinstance(key, str) else key
    left, right = listed.select(*keys), referenced.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return left.join(right, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys], "left_anti")


def check_policies(targets: DataFrame) -> DataFrame:
    """(policy, valid, reason) of policy targets (policy, target, copies, is_primary, gravity_shard)."""
    folded = targets.groupBy("policy").agg(F.min("copies").alias("least"), F.sum(F.col("is_primary").cast("int")).alias("primaries"), F.countDistinct("gravity_shard").alias("shards"), F.countDistinct("target").alias("different"), F.count("*").alias("n"))
    reason = F.when(F.col("least") < 1, "a target has no copy").when(F.col("primaries") != 1, "not exactly one primary").when(F.col("shards") != 1, "more than one gravity shard").when(F.col("different") < F.col("n"), "a target is named twice")
    return folded.select("policy", reason.isNull().alias("valid"), reason.alias("reason"))
