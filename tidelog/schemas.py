"""Declared schemas of the logs. Reads pass one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

from tidelog.errors import InvalidState

_DDL = {
    "event_log": "global_sequence long not null, execution_id string not null, transaction_id string, payload string",
    "projection_event": "global_sequence long not null, event_id long not null, execution_id string not null, event_type string not null, node_name string, status string, prev_event_id long",
    "command_op": "op_seq long not null, command_id string not null, kind string not null, payload string, claimer string",
    "projection_snapshot": "proj_seq long not null, execution_id string not null, status string, data string",
    "kv_op": "op_seq long not null, key string not null, value string, version long not null, deleted boolean not null",
    "kv_tier_op": "op_seq long not null, bucket string not null, key string not null, value string, version long not null, deleted boolean not null, expires_at_ms long",
    "blob_op": "op_seq long not null, logical_key string not null, digest string, size long, deleted boolean not null",
    "vector_op": "op_seq long not null, collection string not null, point_id string not null, embedding array<float>, deleted boolean not null",
    "vector_tier_op": "op_seq long not null, collection string not null, point_id string not null, model_id string, vector array<float>, payload string, version long, deleted boolean not null",
    "registry_op": "op_seq long not null, path string not null, version long not null, kind string not null, content string, deleted boolean not null",
    "runtime_op": "op_seq long not null, worker_id string not null, event string not null, heartbeat long, contract string",
    "wasm_op": "op_seq long not null, key string not null, path string, channel string, env string, kind string not null, version long, digest string, size long",
    "provider_op": "op_seq long not null, key string not null, stack string, provider_urn string, desired string, observed string, present boolean not null",
    "object_op": "op_seq long not null, key string not null, digest string, byte_len long, version long, deleted boolean not null",
    "stream_record": "sequence long not null, subject string not null, payload binary, transaction_id string",
    "document": "document_id string not null, tenant string not null, namespace string not null, source_uri string, content_type string",
    "chunk": "chunk_id string not null, document_id string not null, ordinal int not null, text string, checksum string",
    "embedding": "chunk_id string not null, model_id string not null, dimensions int, vector array<float>",
    "execution": "execution_id string, status string, current_node string, event_count long, first_global_sequence long, last_global_sequence long, last_event_id long, terminal boolean, terminal_event_type string",
    "transaction": "sequence long not null, transaction_id string not null, tenant string, namespace string, mutations array<struct<kind: string, body: string>>",
}

#: Columns of the executions read model, known without a session.
EXECUTION_COLUMNS = tuple(column.split()[0] for column in _DDL["execution"].split(", "))


def schema_of(dataset: str) -> StructType:
    """A dataset's schema; parsing it asks for a running session."""
    if dataset not in _DDL:
        raise InvalidState(f"no dataset is called {dataset}; there are {', '.join(sorted(_DDL))}")
    return StructType.fromDDL(_DDL[dataset])


def check_schema(actual: StructType, dataset: str) -> None:
    """The same columns of the same types in the same order, or an error naming the first difference."""
    wanted = schema_of(dataset)
    for i, field in enumerate(wanted):
        if i >= len(actual):
            raise InvalidState(f"{dataset}: column {field.name} is missing")
        if (actual[i].name, actual[i].dataType) != (field.name, field.dataType):
            raise InvalidState(f"{dataset}: column {i} is {actual[i].simpleString()}, not {field.simpleString()}")
    if len(actual) > len(wanted):
        raise InvalidState(f"{dataset}: column {actual[len(wanted)].name} is not declared")
