"""Views of plain tables as logs: one SQL text for each, which Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LENSES = {
    "event_log": """
SELECT event_id + 1 AS global_sequence, event_id, CAST(user_id AS STRING) AS execution_id, 'txn-' || CAST(event_id AS STRING) AS transaction_id,
CASE WHEN event_type = 'purchase' AND event_id % 61 = 0 THEN 'playbook.completed' WHEN event_type = 'error' AND event_id % 47 = 0 THEN 'playbook_failed'
     WHEN event_type = 'signup' THEN 'playbook_started' ELSE 'step.' || event_type END AS event_type,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'step-' || CAST(event_id % 32 AS STRING) END AS node_name,
CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status,
CAST(user_id % 4 AS INT) AS shard, props AS payload FROM {events}""",
    "event_json": """
SELECT global_sequence, CASE WHEN global_sequence % 10 = 0 THEN 'not json' ELSE chr(123) || '"event_id":' || CAST(event_id AS STRING) || ',"execution_id":"' || execution_id || '","event_type":"' || event_type || '"'
|| CASE WHEN node_name IS NULL THEN '' ELSE ',"node_name":"' || node_name || '"' END || CASE WHEN status IS NULL THEN '' ELSE ',"status":"' || status || '"' END || chr(125) END AS payload FROM {event_log}""",
    "event_replay": """
SELECT * FROM {event_log} UNION ALL
SELECT global_sequence + (SELECT max(global_sequence) FROM {event_log}) AS global_sequence, event_id, execution_id, transaction_id, event_type, node_name, status, shard, payload FROM {event_log} WHERE event_id % 10 = 0""",
    "kv_ops": """
SELECT event_id + 1 AS op_seq, event_type AS bucket, 'k/' || CAST(user_id % 7 AS STRING) || '/' || CAST(event_id % 50 AS STRING) AS key, CAST(event_id AS STRING) AS value,
event_id % 11 = 0 AS deleted, CASE WHEN event_id % 4 = 0 THEN event_id * 10 ELSE NULL END AS expires_at_ms FROM {events}""",
    "command_ops": """
SELECT event_id + 1 AS op_seq, 'c' || CAST(event_id % 500 AS STRING) AS command_id, CASE WHEN event_type IN ('click', 'view') THEN 'Claim' ELSE 'Enqueue' END AS kind, 'w' || CAST(user_id % 5 AS STRING) AS claimer FROM {events}""",
    "registry_ops": """
SELECT event_id + 1 AS op_seq, 'p/' || CAST(event_id % 200 AS STRING) AS path, CASE event_id % 3 WHEN 0 THEN 'playbook' WHEN 1 THEN 'tool' ELSE 'resource' END AS kind, props AS content, event_type = 'error' AS deleted,
CAST(row_number() OVER (PARTITION BY event_id % 200 ORDER BY event_id) AS BIGINT) AS version FROM {events}""",
    "runtime_ops": """
SELECT event_id + 1 AS op_seq, CAST(user_id AS STRING) AS worker_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'deregister' ELSE 'heartbeat' END AS event, 'c' || CAST(event_id AS STRING) AS contract FROM {events}""",
    "provider_half_ops": """
SELECT event_id + 1 AS op_seq, 's' || CAST(user_id % 3 AS STRING) AS stack, 'r' || CAST(user_id AS STRING) AS provider_urn,
CASE event_type WHEN 'purchase' THEN 'set_desired' WHEN 'view' THEN 'set_observed' ELSE 'forget' END AS kind, CAST(event_id % 4 AS STRING) AS value FROM {events} WHERE event_type IN ('purchase', 'view', 'error')""",
    "wasm_raw": """
SELECT event_id + 1 AS op_seq, CAST(user_id % 20 AS STRING) || '/' || CAST(event_id % 2 AS STRING) AS key, 'm' || CAST(user_id % 20 AS STRING) AS path, 'stable' AS channel, CASE event_id % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env,
CASE event_type WHEN 'click' THEN 'bind' WHEN 'error' THEN 'unpublish' ELSE 'publish' END AS kind, CASE WHEN event_type = 'click' THEN event_id % 9 + 1 ELSE NULL END AS bind_to,
CASE WHEN event_type IN ('signup', 'purchase') THEN 'd' || CAST(event_id AS STRING) ELSE NULL END AS digest FROM {events} WHERE event_type <> 'view'""",
    "vector_ops": """
SELECT CAST(vec_id + 1 AS BIGINT) AS op_seq, 'c' || CAST(label % 5 AS STRING) AS collection, CAST(vec_id AS STRING) AS point_id, 'm' || CAST(label % 2 AS STRING) AS model_id, embedding AS vector, vec_id % 13 = 0 AS deleted FROM {embeddings}""",
    "docs": """SELECT 'd' || CAST(doc_id AS STRING) AS document_id, source AS tenant, lang AS namespace FROM {documents}""",
    "stream": """
SELECT event_id + 1 AS sequence, 'events.' || event_type || '.shard.' || CAST(user_id % 4 AS STRING) AS subject, CAST(user_id % 4 AS INT) AS shard, props AS payload, 'txn-' || CAST(event_id AS STRING) AS transaction_id FROM {events}""",
    "consumers": """
SELECT 'fresh' AS consumer, CAST(0 AS BIGINT) AS acked UNION ALL SELECT 'half' AS consumer, CAST((SELECT count(*) FROM {events}) / 2 AS BIGINT) AS acked UNION ALL SELECT 'done' AS consumer, CAST((SELECT count(*) FROM {events}) AS BIGINT) AS acked""",
    "objects": """SELECT url AS key, html AS content, CAST(page_id % 3 AS INT) AS placement, 'sha256:' || sha2(html, 256) AS digest FROM {pages}""",
    "snapshots": """
SELECT 't_orders' AS table_id, 's' || CAST(n AS STRING) AS snapshot_id, CASE WHEN n = 0 THEN NULL ELSE 's' || CAST(n - 1 AS STRING) END AS parent_id, n AS commit_seq FROM (SELECT DISTINCT o_orderkey % 3 AS n FROM {orders}) AS o""",
}
LENSES["chunks"] = """
SELECT document_id, document_id || '-' || CAST(ordinal AS STRING) AS chunk_id, CAST(ordinal AS INT) AS ordinal, text FROM
(SELECT 'd' || CAST(doc_id AS STRING) AS document_id, posexplode(split(text, '\\n', -1)) AS (ordinal, text) FROM {documents}) AS c"""
DUCK = {
    "chunks": """
SELECT document_id, document_id || '-' || CAST(ordinal AS STRING) AS chunk_id, CAST(ordinal AS INT) AS ordinal, text FROM
(SELECT 'd' || CAST(doc_id AS STRING) AS document_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal FROM documents) AS c""",
    "objects": """SELECT url AS key, html AS content, CAST(page_id % 3 AS INT) AS placement, 'sha256:' || sha256(html) AS digest FROM pages""",
    "consumers": """
SELECT 'fresh' AS consumer, CAST(0 AS BIGINT) AS acked UNION ALL SELECT 'half' AS consumer, CAST((SELECT count(*) FROM events) // 2 AS BIGINT) AS acked UNION ALL SELECT 'done' AS consumer, CAST((SELECT count(*) FROM events) AS BIGINT) AS acked""",
}
_NAME = re.compile(r"\{(\w+)\}")


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens over the tables of a folder, or a table itself."""
    if name not in LENSES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = LENSES[name]
    needs = {n: lens(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(sql))}
    return spark.sql(sql, **needs) if needs else spark.sql(sql)


def lens_sql(name: str) -> str:
    """The same lens as a subquery for DuckDB."""
    if name not in LENSES and name not in DUCK:
        return name
    sql = DUCK.get(name) or LENSES[name]
    return "(" + _NAME.sub(lambda m: lens_sql(m.group(1)), sql).strip() + ")"


def duck(sql: str) -> str:
    """A query with {lens} placeholders for DuckDB."""
    return _NAME.sub(lambda m: lens_sql(m.group(1)), sql)
