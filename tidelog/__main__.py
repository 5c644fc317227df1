"""python -m tidelog list | run QUERY FOLDER [--explain] | sql FOLDER STATEMENT | VERB FOLDER [arguments]

Verbs read the tables of a folder as logs: see VERBS.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import TidelogError

#: verb -> (help, arguments with their types, what it runs)
VERBS: dict[str, tuple[str, dict[str, type], Callable[..., DataFrame]]] = {}


def _verb(name: str, text: str, **arguments: type):
    def add(function):
        VERBS[name] = (text, arguments, function)
        return function

    return add


def _lens(spark: SparkSession, folder: str, name: str) -> DataFrame:
    from tidelog.plans.lenses import lens

    return lens(spark, folder, name)


@_verb("execution", "the state of one execution", execution_id=str)
def _(spark, folder, execution_id):
    from tidelog.operators import folds

    log = _lens(spark, folder, "event_log").where(F.col("execution_id") == execution_id)
    return folds.fold_executions(log)


@_verb("log-scan", "records past a cursor", cursor=int, limit=int)
def _(spark, folder, cursor, limit):
    from tidelog.operators import logs

    return logs.scan(_lens(spark, folder, "event_log"), "global_sequence", cursor, limit)


@_verb("log-read", "records of one execution past a cursor", execution_id=str, cursor=int)
def _(spark, folder, execution_id, cursor):
    from tidelog.operators import logs

    return logs.read_key(_lens(spark, folder, "event_log"), "execution_id", execution_id, "global_sequence", cursor)


@_verb("tail", "pending records of a consumer", consumer=str, limit=int)
def _(spark, folder, consumer, limit):
    from tidelog.operators import tiers

    asked = spark.createDataFrame([(consumer,)], "consumer string")
    return tiers.tail(_lens(spark, folder, "stream"), _lens(spark, folder, "consumers"), asked, limit)


@_verb("ack", "what an acknowledgement would leave", consumer=str, sequence=int)
def _(spark, folder, consumer, sequence):
    from tidelog.operators import logs

    acks = spark.createDataFrame([(consumer, sequence)], "consumer string, sequence long")
    return logs.acknowledge_each(_lens(spark, folder, "consumers"), acks, _lens(spark, folder, "stream"))


@_verb("subject", "records of a subject filter", filter=str)
def _(spark, folder, filter):  # noqa: A002
    from tidelog.functions.subjects import subject_matches

    return _lens(spark, folder, "stream").where(subject_matches(F.col("subject"), filter))


@_verb("kv-get", "a live entry", bucket=str, key=str)
def _(spark, folder, bucket, key):
    from tidelog.operators import stores

    return stores.kv_state(_lens(spark, folder, "kv_ops").where((F.col("bucket") == bucket) & (F.col("key") == key)), ["bucket", "key"])


@_verb("kv-scan", "live entries with a prefix", prefix=str)
def _(spark, folder, prefix):
    from tidelog.operators import stores

    return stores.kv_scan(_lens(spark, folder, "kv_ops"), prefix, ["bucket", "key"])


@_verb("registry-get", "a pinned version", path=str, version=int)
def _(spark, folder, path, version):
    from tidelog.operators import stores

    return stores.registry_version(_lens(spark, folder, "registry_ops"), path, version)


@_verb("objects", "live objects with a prefix", prefix=str)
def _(spark, folder, prefix):
    from tidelog.operators import objects

    return objects.list_prefix(_lens(spark, folder, "objects").select("key", "digest"), "key", prefix, objects.MAX_LIST)


@_verb("text-search", "chunks that hold a text, most often first", tenant=str, namespace=str, query=str, limit=int)
def _(spark, folder, tenant, namespace, query, limit):
    from tidelog.operators import search

    return search.text_topk(_lens(spark, folder, "chunks"), _lens(spark, folder, "docs"), tenant, namespace, query, limit)


@_verb("retrieve", "a retrieval's hits with their outcome", tenant=str, namespace=str, query=str)
def _(spark, folder, tenant, namespace, query):
    from tidelog.operators import search

    return search.retrieve(_lens(spark, folder, "chunks"), _lens(spark, folder, "docs"), tenant, namespace, query)


#: verb -> query that answers it without arguments
_QUERIES = {
    "summary": "state_summary", "executions": "fold_execution_state", "queue": "queue_state", "unclaimed": "queue_unclaimed", "workers": "runtime_heartbeats", "providers": "provider_facts", "drift": "provider_drift", "modules": "wasm_list",
    "registry": "registry_snapshot", "blobs": "blob_list", "points": "vector_live_points", "streams": "stream_info", "consumers": "consumer_pending", "lag": "lag_metrics", "parts": "parts_manifest", "merges": "merge_plan", "reclaim": "segment_gc",
    "metrics": "engine_metrics", "replicas": "replication_plan", "replica-totals": "replication_totals", "orphans": "orphans", "policies": "policy_check", "parity": "parity_report", "constraints": "retrieval_constraints",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--explain", action="store_true")
    sql = commands.add_parser("sql")
    sql.add_argument("folder")
    sql.add_argument("statement")
    for name, (text, arguments, _) in VERBS.items():
        verb = commands.add_parser(name, help=text)
        verb.add_argument("folder")
        for argument, kind in arguments.items():
            verb.add_argument(argument, type=kind)
    for name, query in _QUERIES.items():
        commands.add_parser(name, help=f"the query {query}").add_argument("folder")
    args = parser.parse_args(argv)
    from tidelog.plans import catalogue, sqlapi

    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if args.command == "run" and args.query not in catalogue.queries():
        parser.error(f"there is no query {args.query}")
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    try:
        if args.command == "sql":
            df = sqlapi.run_sql(catalogue.executions(spark, args.folder), args.statement)
        elif args.command in VERBS:
            _, arguments, function = VERBS[args.command]
            df = function(spark, args.folder, **{a: getattr(args, a) for a in arguments})
        else:
            df = catalogue.queries()[_QUERIES.get(args.command) or args.query](spark, args.folder)
        if getattr(args, "explain", False):
            df.explain("formatted")
        df.show(truncate=False)
    except TidelogError as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
