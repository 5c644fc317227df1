"""Queries of the tiers' contracts: writes, event log, domain records, receipts, storage. See catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.operators import logs, maintenance, objects, stores, tiers
from tidelog.plans.catalogue import _PARTS, _parts, _query, executions
from tidelog.plans.lenses import lens
from tidelog.session import scratch_folder

# Odd operations are the log, even ones requests: the last of each key.


def _split(rows: DataFrame, keys: list[str], seq: str = "op_seq") -> tuple[DataFrame, DataFrame]:
    log = rows.where(F.col(seq) % 2 == 1)
    rest = [c for c in rows.columns if c not in keys]
    asked = rows.where(F.col(seq) % 2 == 0).groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")
    return log, asked


_BLOB_RAW = "(SELECT event_id + 1 AS op_seq, 'b/' || CAST(user_id % 90 AS STRING) AS logical_key, 'd' || CAST(event_id % 40 AS STRING) AS digest, event_id % 1000 AS size, event_type = 'error' AS deleted FROM events)"


@_query("blob_write", f"""
WITH r AS (SELECT * FROM {_BLOB_RAW} AS x), o AS (SELECT op_seq, logical_key, digest, CASE WHEN deleted THEN 0 ELSE size END AS size, deleted FROM r WHERE op_seq % 2 = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_key ORDER BY op_seq DESC) AS k FROM r WHERE op_seq % 2 = 0) AS y WHERE k = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_key ORDER BY op_seq DESC) AS k FROM o) AS z WHERE k = 1),
w AS (SELECT q.logical_key, q.deleted, CASE WHEN q.deleted THEN l.digest ELSE q.digest END AS digest, CASE WHEN q.deleted THEN 0 ELSE q.size END AS size, CASE WHEN NOT q.deleted THEN 'written' WHEN coalesce(NOT l.deleted, false) THEN 'deleted' ELSE 'absent' END AS outcome,
NOT q.deleted AND q.digest IN (SELECT digest FROM o WHERE NOT deleted) AS deduplicated FROM q LEFT JOIN l ON l.logical_key = q.logical_key)
SELECT logical_key, digest, size, deleted, outcome, deduplicated, CASE WHEN outcome <> 'absent' THEN (SELECT max(op_seq) FROM o) + row_number() OVER (PARTITION BY outcome <> 'absent' ORDER BY logical_key) END AS op_seq FROM w""")  # fmt: skip
def _(spark, sf):
    raw = lens(spark, sf, "events").selectExpr("event_id + 1 AS op_seq", "concat('b/', user_id % 90) AS logical_key", "concat('d', event_id % 40) AS digest", "event_id % 1000 AS size", "event_type = 'error' AS deleted")
    log, asked = _split(raw, ["logical_key"])
    log = log.withColumn("size", F.when(F.col("deleted"), F.lit(0).cast("long")).otherwise(F.col("size")))
    return tiers.blob_write(log, asked.select("logical_key", "digest", "size", F.col("deleted").alias("delete"))).select("logical_key", "digest", "size", "deleted", "outcome", "deduplicated", "op_seq")


_OBJECT_RAW = "(SELECT event_id + 1 AS op_seq, 'o/' || CAST(user_id % 70 AS STRING) AS key, 'd' || CAST(event_id % 40 AS STRING) AS digest, event_id % 1000 AS byte_len, event_type = 'error' AS deleted FROM events)"


@_query("object_tier_write", f"""
WITH r AS (SELECT * FROM {_OBJECT_RAW} AS x), o AS (SELECT op_seq, key, digest, byte_len, deleted, row_number() OVER (PARTITION BY key ORDER BY op_seq) AS version FROM r WHERE op_seq % 2 = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY op_seq DESC) AS k FROM r WHERE op_seq % 2 = 0) AS y WHERE k = 1), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY op_seq DESC) AS k FROM o) AS z WHERE k = 1),
w AS (SELECT q.key, q.deleted, CASE WHEN q.deleted THEN l.digest ELSE q.digest END AS digest, CASE WHEN q.deleted THEN 0 ELSE q.byte_len END AS byte_len, CAST(coalesce(l.version, 0) + 1 AS BIGINT) AS version,
CASE WHEN NOT q.deleted AND q.byte_len > 900 THEN 'rejected: too large' WHEN NOT q.deleted THEN 'written' WHEN coalesce(NOT l.deleted, false) THEN 'deleted' ELSE 'absent' END AS outcome, q.digest IN (SELECT digest FROM o WHERE NOT deleted) AS known FROM q LEFT JOIN l ON l.key = q.key)
SELECT key, digest, byte_len, version, deleted, outcome, outcome = 'written' AND known AS deduplicated FROM w""")  # fmt: skip
def _(spark, sf):
    raw = lens(spark, sf, "events").selectExpr("event_id + 1 AS op_seq", "concat('o/', user_id % 70) AS key", "concat('d', event_id % 40) AS digest", "event_id % 1000 AS byte_len", "event_type = 'error' AS deleted")
    log, asked = _split(raw, ["key"])
    log = logs.assign_sequence(log, "key", "op_seq").withColumnRenamed("sequence", "version")
    out = tiers.object_write(log, asked.select("key", "digest", "byte_len", F.col("deleted").alias("delete")), most=900)
    return out.select("key", "digest", "byte_len", "version", "deleted", "outcome", "deduplicated")


@_query("vector_tier_write", """
WITH r AS (SELECT vec_id, 'c' || CAST(label % 5 AS STRING) AS collection, 'p' || CAST(vec_id % 100 AS STRING) AS point_id, vec_id + 1 AS op_seq, vec_id % 7 = 0 AS deleted, repeat('x', CAST(vec_id % 50 AS INT)) AS payload, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 64 END AS size FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY collection, point_id ORDER BY op_seq) AS version FROM r WHERE op_seq % 2 = 1), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, point_id ORDER BY op_seq DESC) AS k FROM r WHERE op_seq % 2 = 0) AS y WHERE k = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, point_id ORDER BY op_seq DESC) AS k FROM o) AS z WHERE k = 1)
SELECT q.collection, q.point_id, CASE WHEN q.deleted AND coalesce(NOT l.deleted, false) THEN 'deleted' WHEN q.deleted THEN 'absent' WHEN q.size < 1 THEN 'rejected: dimensions' WHEN strlen(q.payload) > 45 THEN 'rejected: payload too large' ELSE 'written' END AS outcome,
CAST(coalesce(l.version, 0) + 1 AS BIGINT) AS version, CASE WHEN q.deleted THEN l.payload ELSE q.payload END AS payload FROM q LEFT JOIN l ON l.collection = q.collection AND l.point_id = q.point_id""")  # fmt: skip
def _(spark, sf):
    raw = lens(spark, sf, "embeddings").selectExpr(
        "CAST(vec_id + 1 AS BIGINT) AS op_seq", "concat('c', label % 5) AS collection", "concat('p', vec_id % 100) AS point_id", "concat('m', label % 2) AS model_id",
        "CASE WHEN vec_id % 11 = 0 THEN CAST(array() AS array<float>) ELSE embedding END AS vector", "repeat('x', CAST(vec_id % 50 AS INT)) AS payload", "vec_id % 7 = 0 AS deleted",
    )
    log, asked = _split(raw, ["collection", "point_id"])
    numbered = log.withColumn("stream", F.concat_ws("/", "collection", "point_id"))
    log = logs.assign_sequence(numbered, "stream", "op_seq").withColumnRenamed("sequence", "version").drop("stream")
    out = tiers.vector_write(log, asked.withColumnRenamed("deleted", "delete").drop("op_seq"), payload_bytes=45)
    return out.select("collection", "point_id", "outcome", "version", "payload")


@_query("projection_get_state", "SELECT execution_id, coalesce(status, 'running') AS status, payload AS data, global_sequence AS proj_seq FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY global_sequence DESC) AS r FROM {event_log} AS e) AS t WHERE r = 1")
def _(spark, sf):
    snapshots = lens(spark, sf, "event_log").select(F.col("global_sequence").alias("proj_seq"), "execution_id", F.coalesce("status", F.lit("running")).alias("status"), F.col("payload").alias("data"))
    return tiers.projection_state(snapshots)


@_query("projection_record", "SELECT execution_id, event_type AS status, (SELECT max(global_sequence) FROM {event_log} AS m WHERE event_id % 2 = 0) + row_number() OVER (ORDER BY global_sequence) AS proj_seq FROM {event_log} AS e WHERE event_id % 2 = 1")
def _(spark, sf):
    """Even events are recorded; odd ones are recorded after them."""
    log = lens(spark, sf, "event_log")
    rows = log.select(F.col("global_sequence").alias("proj_seq"), "execution_id", F.col("event_type").alias("status"), F.col("payload").alias("data"), "event_id")
    new = rows.where("event_id % 2 = 1").withColumnRenamed("proj_seq", "arrival").drop("event_id")
    return tiers.record_states(rows.where("event_id % 2 = 0").drop("event_id"), new, "arrival").select("execution_id", "status", "proj_seq")


# event log

_HALF = "(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY sequence) AS n FROM {stream} AS s WHERE sequence % 2 = 0 AND shard <> 3)"


@_query("eventlog_append", f"""
WITH t AS (SELECT shard, max(n) AS tip FROM {_HALF} AS h GROUP BY shard), a AS (SELECT s.*, row_number() OVER (PARTITION BY shard ORDER BY sequence) AS n FROM {{stream}} AS s WHERE sequence % 2 = 1)
SELECT a.shard, a.subject, a.transaction_id, CAST(coalesce(t.tip, 0) + a.n AS BIGINT) AS sequence, t.tip IS NULL AND a.n = 1 AS created_stream FROM a LEFT JOIN t ON t.shard = a.shard""")  # fmt: skip
def _(spark, sf):
    """Even records of three shards are the log; odd ones of all four arrive, so the fourth stream is created."""
    rows = lens(spark, sf, "stream").withColumnRenamed("sequence", "arrival")
    log = logs.publish(None, rows.where("arrival % 2 = 0 AND shard <> 3"), "shard", "arrival")
    return tiers.append_records(log, rows.where("arrival % 2 = 1"), "shard", "arrival").select("shard", "subject", "transaction_id", "sequence", "created_stream")


@_query("eventlog_tail", """
WITH t AS (SELECT max(sequence) AS tip FROM {stream} AS s), q AS (SELECT n.consumer, c.acked, c.consumer IS NULL AS created_consumer, greatest(coalesce(c.acked, 0), 40) AS start FROM (SELECT 'fresh' AS consumer UNION ALL SELECT 'half' AS consumer UNION ALL SELECT 'done' AS consumer UNION ALL SELECT 'new' AS consumer) AS n LEFT JOIN {consumers} AS c ON c.consumer = n.consumer)
SELECT q.consumer, true AS exists, created_consumer, acked, CAST(greatest(tip - start, 0) AS BIGINT) AS pending_count, s.sequence, s.subject FROM q CROSS JOIN t LEFT JOIN {stream} AS s ON s.sequence > start AND s.sequence <= start + 25""")  # fmt: skip
def _(spark, sf):
    """Four consumers, one of them new, over a log that is reclaimed up to 40."""
    asked = spark.createDataFrame([("fresh",), ("half",), ("done",), ("new",)], "consumer string")
    return tiers.tail(lens(spark, sf, "stream"), lens(spark, sf, "consumers"), asked, 25, floor=40).select("consumer", "exists", "created_consumer", "acked", "pending_count", "sequence", "subject")


@_query("eventlog_route_writes", "SELECT served_by, shard, count(*) AS n FROM (SELECT shard, CASE WHEN shard IN (0, 2) THEN 'owner' ELSE 'refused: not owner' END AS served_by FROM {stream} AS s) AS t GROUP BY served_by, shard")
def _(spark, sf):
    return tiers.route_writes(lens(spark, sf, "stream"), "shard", [0, 2]).groupBy("served_by", "shard").agg(F.count("*").alias("n"))


@_query("eventlog_route_reads", "SELECT sequence, shard, CASE WHEN shard IN (1, 3) THEN 'local' ELSE 'cold-load' END AS served_by FROM {stream} AS s WHERE subject LIKE 'events.error.%'")
def _(spark, sf):
    return tiers.route_reads(lens(spark, sf, "stream"), "shard", [1, 3]).where(F.col("subject").startswith("events.error.")).select("sequence", "shard", "served_by")


@_query("stream_create", "SELECT stream, CASE WHEN there OR k > 1 THEN 'refused: exists' ELSE 'created' END AS outcome FROM (SELECT 's' || CAST(user_id AS STRING) AS stream, EXISTS (SELECT 1 FROM events AS o WHERE o.user_id = e.user_id AND o.event_type = 'signup') AS there, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events AS e WHERE event_type = 'purchase') AS t")
def _(spark, sf):
    """Those who signed up have a stream; every purchase asks for one."""
    events = lens(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stream"), "event_type")
    return tiers.create_streams(events.where("event_type = 'signup'"), events.where("event_type = 'purchase'"), ["stream"])


_DOMAIN = "(SELECT 'u' || CAST(user_id AS STRING) AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, 'domain.' || event_type AS subject, props AS payload FROM events WHERE user_id % 3 <> 2)"


@_query("domain_records", f"""
WITH r AS (SELECT * FROM {_DOMAIN} AS d), t AS (SELECT stream, max(sequence) AS tip FROM r GROUP BY stream), q AS (SELECT DISTINCT 'u' || CAST(user_id AS STRING) AS stream, CASE WHEN user_id % 2 = 0 THEN 'mailer' ELSE 'audit' END AS consumer FROM events),
c AS (SELECT stream, 'mailer' AS consumer, CAST(tip // 2 AS BIGINT) AS acked FROM t), k AS (SELECT q.*, c.acked, t.tip, t.tip IS NOT NULL AS exists, t.tip IS NOT NULL AND c.consumer IS NULL AS created_consumer, coalesce(c.acked, 0) AS start FROM q LEFT JOIN t ON t.stream = q.stream LEFT JOIN c ON c.stream = q.stream AND c.consumer = q.consumer)
SELECT k.stream, k.consumer, exists, created_consumer, acked, CAST(coalesce(tip - start, 0) AS BIGINT) AS pending_count, r.sequence, r.subject, r.payload FROM k LEFT JOIN r ON r.stream = k.stream AND r.sequence > start AND r.sequence <= start + 5""")  # fmt: skip
def _(spark, sf):
    """Each user's events as a stream, but for a third of the users, whose streams are missing; one consumer has read half, the other is new."""
    events = lens(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stream"), F.concat(F.lit("domain."), F.col("event_type")).alias("subject"), F.col("props").alias("payload"), "event_id", "user_id")
    log = logs.assign_sequence(events.where("user_id % 3 <> 2"), "stream", "event_id").select("stream", "sequence", "subject", "payload")
    cursors = log.groupBy("stream").agg(F.max("sequence").alias("tip")).select("stream", F.lit("mailer").alias("consumer"), F.expr("tip div 2").alias("acked"))
    asked = events.select("stream", F.when(F.col("user_id") % 2 == 0, "mailer").otherwise("audit").alias("consumer"))
    return tiers.consume(log, cursors, asked, "stream", 5)


@_query("domain_append", f"""
WITH t AS (SELECT stream, max(sequence) AS tip FROM {_DOMAIN} AS d GROUP BY stream), a AS (SELECT 'u' || CAST(user_id AS STRING) AS stream, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT a.stream, a.event_id, CAST(coalesce(t.tip, 0) + n AS BIGINT) AS sequence, t.tip IS NULL AND n = 1 AS created_stream FROM a LEFT JOIN t ON t.stream = a.stream""")  # fmt: skip
def _(spark, sf):
    events = lens(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stream"), "event_id", "user_id", "event_type")
    log = logs.assign_sequence(events.where("user_id % 3 <> 2"), "stream", "event_id")
    return tiers.append_records(log, events.where("event_type = 'purchase'"), "stream", "event_id").select("stream", "event_id", "sequence", "created_stream")


@_query("receipts_replay", """
SELECT sequence, 'receipts.' || status AS subject, status FROM (SELECT status, row_number() OVER (ORDER BY last_global_sequence) AS sequence FROM @executions AS x) AS r WHERE sequence > 10""")  # fmt: skip
def _(spark, sf):
    """A receipt for each execution, replayed past the tenth."""
    found = tiers.receipts(executions(spark, sf), "execution_id", "status", "last_global_sequence", ["status", "event_count"])
    return logs.after_cursor(found, "sequence", 10).select("sequence", "subject", F.get_json_object("payload", "$.status").alias("status"))


@_query("receipts_acknowledged", "SELECT subject, count(*) AS pending FROM (SELECT 'receipts.' || status AS subject, row_number() OVER (ORDER BY last_global_sequence) AS sequence FROM @executions AS x) AS r WHERE sequence > (SELECT count(*) // 2 FROM @executions AS y) GROUP BY subject")
def _(spark, sf):
    """What a consumer that acknowledged the first half has still to read."""
    found = tiers.receipts(executions(spark, sf), "execution_id", "status", "last_global_sequence", ["event_count"])
    cursors = found.agg(F.lit("billing").alias("consumer"), F.expr("count(*) div 2").alias("acked"))
    return logs.pending(found, cursors).groupBy("subject").agg(F.count("*").alias("pending"))


@_query("feed_frames", "SELECT sequence, 'id: ' || CAST(sequence AS STRING) || chr(10) || 'event: ' || subject || chr(10) || 'data: ' || replace(payload, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM {stream} AS s WHERE subject LIKE 'events.signup.%'")
def _(spark, sf):
    return tiers.sse_frames(lens(spark, sf, "stream").where(F.col("subject").startswith("events.signup.")))


# storage


@_query("retention_apply", f"SELECT global_sequence, shard FROM (SELECT global_sequence, shard, max(global_sequence) OVER (PARTITION BY shard, part) AS top FROM (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY global_sequence) - 1) // 64 AS part FROM {{event_log}} AS e) AS t) AS u WHERE top >= 500")
def _(spark, sf):
    parted = _parts(spark, sf)
    parts = maintenance.retention(maintenance.manifest(parted, "shard", "global_sequence"), 500)
    return maintenance.drop_parts(parted, parts, "shard").select("global_sequence", "shard")


@_query("merge_apply", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY min_seq) - row_number() OVER (PARTITION BY shard, part % 7 <> 2 ORDER BY min_seq) AS run FROM {_PARTS} AS p), r AS (SELECT *, count(*) OVER (PARTITION BY shard, run) AS length FROM n WHERE part % 7 <> 2),
f AS (SELECT *, min(run) OVER (PARTITION BY shard) AS first_run FROM r WHERE length >= 4), k AS (SELECT shard, part, row_number() OVER (PARTITION BY shard ORDER BY min_seq) AS place, min(part) OVER (PARTITION BY shard) AS target FROM f WHERE run = first_run)
SELECT p.shard, coalesce(k.target, p.part) AS part, min(min_seq) AS min_seq, max(max_seq) AS max_seq, CAST(sum(records) AS BIGINT) AS records, count(*) AS merged FROM {_PARTS} AS p LEFT JOIN k ON k.shard = p.shard AND k.part = p.part AND k.place <= 8 GROUP BY p.shard, coalesce(k.target, p.part)""")  # fmt: skip
def _(spark, sf):
    parts = maintenance.manifest(_parts(spark, sf), "shard", "global_sequence").withColumn("durable", F.col("part") % 7 != 2)
    return maintenance.apply_merges(parts, maintenance.plan_merges(parts, "shard", small=64), "shard")


_BITS = "(SELECT (CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) + k * (CAST(('0x' || substr(md5({0}), 9, 8)) AS BIGINT) + 1)) % 2048 AS bit, {1} FROM {2} CROSS JOIN (SELECT unnest(range(0, 7)) AS k) AS h)"


@_query("bloom_narrow", f"""
WITH p AS (SELECT DISTINCT shard, execution_id, (row_number() OVER (PARTITION BY shard ORDER BY global_sequence) - 1) // 64 AS part FROM {{event_log}} AS e), i AS (SELECT DISTINCT bit, shard, part FROM {_BITS.format("execution_id", "shard, part", "p")} AS b),
v AS (SELECT DISTINCT execution_id FROM {{event_log}} AS e WHERE CAST(execution_id AS BIGINT) % 20 = 0), q AS (SELECT DISTINCT execution_id, bit FROM {_BITS.format("execution_id", "execution_id", "v")} AS c), n AS (SELECT execution_id, count(*) AS need FROM q GROUP BY execution_id)
SELECT q.execution_id, i.shard, i.part FROM q JOIN i ON i.bit = q.bit JOIN n ON n.execution_id = q.execution_id GROUP BY q.execution_id, i.shard, i.part, n.need HAVING count(*) = n.need""")  # fmt: skip
def _(spark, sf):
    """The parts that may hold each execution whose id is divisible by 20."""
    log = lens(spark, sf, "event_log").select("shard", "global_sequence", "execution_id")
    parted = maintenance.assign_parts(log, "shard", "global_sequence", 64)
    asked = log.select("execution_id").distinct().where(F.col("execution_id").cast("long") % 20 == 0)
    return maintenance.maybe_members(maintenance.part_blooms(parted, "shard", "execution_id"), "shard", asked, "execution_id")


@_query("object_store_put", "SELECT digest, count(*) AS puts, max(strlen(text)) AS byte_len, true AS stored FROM (SELECT text, 'sha256:' || sha256(text) AS digest FROM documents) AS t GROUP BY digest")
def _(spark, sf):
    """Every text written to content-addressed storage once."""
    return objects.put_objects(lens(spark, sf, "documents"), scratch_folder(spark, "objects"), "text").select("digest", "puts", "byte_len", "stored")


@_query("object_store_get", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'length' ELSE 'ok' END AS outcome, CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 THEN strlen(html) END AS n_bytes FROM pages")
def _(spark, sf):
    """Pages put and got again by pointers, some of which name another content or length."""
    folder, pages = scratch_folder(spark, "objects"), lens(spark, sf, "pages")
    objects.put_objects(pages, folder, "html").write.format("noop").mode("overwrite").save()
    digest = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), F.lit(64)))).otherwise(scalars.content_digest(F.col("html")))
    pointers = pages.select("page_id", digest.alias("digest"), (F.octet_length("html") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("byte_len"))
    return objects.get_objects(pointers, folder).select("page_id", "outcome", F.octet_length("content").cast("long").alias("n_bytes"))


@_query("document_ingest", """
WITH n AS (SELECT document_id, count(*) AS n, max(strlen(text)) AS bytes FROM {chunks} AS c WHERE CAST(substr(document_id, 2) AS BIGINT) % 9 <> 4 GROUP BY document_id),
j AS (SELECT d.document_id, CASE WHEN CAST(substr(d.document_id, 2) AS BIGINT) % 3 = 0 THEN 'document is there' WHEN n.n IS NULL THEN 'no chunks' WHEN n.n > 60 THEN 'too many chunks' WHEN n.bytes > 2000 THEN 'a chunk is too long' END AS reason FROM {docs} AS d LEFT JOIN n ON n.document_id = d.document_id)
SELECT j.document_id, 'chunk' AS outcome, c.chunk_id FROM j JOIN {chunks} AS c ON c.document_id = j.document_id WHERE reason IS NULL UNION ALL SELECT document_id, 'refused: ' || reason AS outcome, NULL AS chunk_id FROM j WHERE reason IS NOT NULL""")  # fmt: skip
def _(spark, sf):
    """All documents arrive; a third is there already, a ninth comes without its chunks."""
    number = F.substring("document_id", 2, 100).cast("long")
    documents, chunks = lens(spark, sf, "docs"), lens(spark, sf, "chunks").where(number % 9 != 4)
    _, taken, refused = stores.ingest_document(documents.where(number % 3 == 0), chunks.where("false"), documents, chunks, 60, 2000)
    out = taken.select("document_id", F.lit("chunk").alias("outcome"), "chunk_id")
    return out.unionByName(refused.select("document_id", F.concat(F.lit("refused: "), F.col("reason")).alias("outcome"), F.lit(None).cast("string").alias("chunk_id")))


@_query("cold_load", "SELECT global_sequence, shard FROM {event_log} AS e WHERE shard <> 3")
def _(spark, sf):
    """The log written as parts of which the first replica's manifest is lost and the second lists three of four shards."""
    folder, log = scratch_folder(spark, "parts"), lens(spark, sf, "event_log").select("global_sequence", "execution_id", "shard")
    maintenance.write_replica(log, f"{folder}/b", "shard", "global_sequence", 1024, keep=F.col("shard") != 3)
    return maintenance.cold_load(spark, [f"{folder}/a", f"{folder}/b"]).select("global_sequence", "shard")


@_query("encoded_keys", "SELECT page_id, 'prod' || chr(31) || url AS key, 'acme/sales/tables/pages/snapshots/s' || CAST(page_id % 3 AS STRING) || '/' || CAST(page_id AS STRING) || '.html' AS path FROM pages")
def _(spark, sf):
    whole = [F.lit(x) for x in ("acme", "sales", "pages")]
    path = scalars.snapshot_path(*whole, F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")), F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    return lens(spark, sf, "pages").select("page_id", scalars.encode_key(F.lit("prod"), F.col("url")).alias("key"), path.alias("path"))


@_query("char_prefixes", "SELECT doc_id, substr(text, 1, 77) AS head, CAST(length(substr(text, 1, 77)) AS INT) AS chars FROM documents")
def _(spark, sf):
    head = scalars.char_prefix(F.col("text"), 77)
    return lens(spark, sf, "documents").select("doc_id", head.alias("head"), F.char_length(head).alias("chars"))


@_query("payload_checksums")
def _(spark, sf):
    """CRC-32 of every payload, which DuckDB does not have."""
    return lens(spark, sf, "stream").select("sequence", F.crc32(F.col("payload").cast("binary")).alias("crc32"))
