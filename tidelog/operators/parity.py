"""Comparing a served read model with the authoritative one: full outer joins, one row of verdict.

The first divergence is named in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compare(served: DataFrame, authority: DataFrame, key: str | list[str], values: list[str]) -> DataFrame:
    """(key..., divergence) of all keys that differ: 'missing', 'unexpected', or the first value that differs.

    Where a key repeats, its rows on both sides are paired in the order of their values, one
    with one; those left over are missing or unexpected. A null is a key like any other.
    """
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(*values)
    s = served.select(*keys, F.struct(*values).alias("s"), F.row_number().over(order).alias("__nth"))
    a = authority.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*values).alias("a"), F.row_number().over(order).alias("__other"))
    same = [s["__nth"] == a["__other"], *(s[k].eqNullSafe(a[f"__{k}"]) for k in keys)]
    both = s.join(a, same, "full_outer")
    verdict = F.when(F.col("s").isNull(), "missing").when(F.col("a").isNull(), "unexpected")
    for v in values:
        verdict = verdict.when(_differs(F.col(f"s.{v}"), F.col(f"a.{v}")), v)
    named = (F.when(F.col("s").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys)
    return both.select(*named, verdict.alias("divergence")).where("divergence is not null")


def report(served: DataFrame, authority: DataFrame, key: str | list[str], values: list[str], checkpoint: int | None = None, offset: int | None = None) -> DataFrame:
    """report_at() for a checkpoint and an offset that are known; without an offset there is no lag."""
    cursors = authority.sparkSession.range(1).select(F.lit(checkpoint).cast("long").alias("checkpoint"), F.lit(offset).cast("long").alias("offset"))
    return report_at(served, authority, key, values, cursors)


def report_at(served: DataFrame, authority: DataFrame, key: str | list[str], values: list[str], cursors: DataFrame) -> DataFrame:
    """One row (key_ok, value_ok, checkpoint_ok, checkpoint_lag, divergence): keys before values before the checkpoint. `cursors` is one row (checkpoint, offset)."""
    found = compare(served, authority, key, values)
    bad_keys = F.count_if(F.col("divergence").isin("missing", "unexpected"))
    bad_values = F.count_if(~F.col("divergence").isin("missing", "unexpected"))
    row = found.agg(bad_keys.alias("bad_keys"), bad_values.alias("bad_values")).crossJoin(cursors.select("checkpoint", "offset"))
    lag = F.greatest(F.coalesce(F.col("offset") - F.coalesce("checkpoint", F.lit(0)), F.lit(0)), F.lit(0)).cast("long")
    key_ok, value_ok = F.col("bad_keys") == 0, (F.col("bad_keys") > 0) | (F.col("bad_values") == 0)
    first = F.when(~key_ok, "key").when(~value_ok, "value").when(lag > 0, "checkpoint")
    return row.select(key_ok.alias("key_ok"), value_ok.alias("value_ok"), (lag == 0).alias("checkpoint_ok"), lag.alias("checkpoint_lag"), first.alias("divergence"))


def kv_parity(served: DataFrame, authority: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., divergence): 'presence', then 'value', then 'ttl'."""
    found = compare(served, authority, keys, ["value", "expires_at_ms"])
    return found.withColumn("divergence", F.when(F.col("divergence").isin("missing", "unexpected"), "presence").when(F.col("divergence") == "expires_at_ms", "ttl").otherwise("value"))


def object_parity(served: DataFrame, authority: DataFrame, key: str | list[str] = "key") -> DataFrame:
    """(key..., divergence): 'presence', 'digest', 'length', then 'retrievable' for objects that cannot be read back."""
    found = compare(served.withColumn("retrievable", F.lit(True)), authority.withColumn("retrievable", F.coalesce("verified", F.lit(False))), key, ["digest", "byte_len", "retrievable"])
    return found.withColumn("divergence", F.when(F.col("divergence").isin("missing", "unexpected"), "presence").when(F.col("divergence") == "byte_len", "length").otherwise(F.col("divergence")))


def ranking_parity(served: DataFrame, authority: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row (ids_ok, order_ok, monotonic_ok, divergence) of two rankings (rank, point_id, score): top-k lists, so one small partition."""
    ids = served.select("point_id").exceptAll(authority.select("point_id")).unionAll(authority.select("point_id").exceptAll(served.select("point_id"))).agg(F.count("*").alias("n"))
    order = served.select("rank", "point_id").join(authority.select("rank", F.col("point_id").alias("other")), "rank", "full_outer").agg(F.count_if(_differs(F.col("point_id"), F.col("other"))).alias("m"))
    before = F.lag("score").over(Window.orderBy("rank"))
    falls = served.withColumn("before", before).agg(F.count_if(F.col("before") + tolerance < F.col("score")).alias("r"))
    row = ids.crossJoin(order).crossJoin(falls)
    first = F.when(F.col("n") > 0, "id-set").when(F.col("m") > 0, "rank-order").when(F.col("r") > 0, "score")
    return row.select((F.col("n") == 0).alias("ids_ok"), (F.col("m") == 0).alias("order_ok"), (F.col("r") == 0).alias("monotonic_ok"), first.alias("divergence"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (same): whether two sets of ids are equal."""
    return a.select(key).exceptAll(b.select(key)).unionAll(b.select(key).exceptAll(a.select(key))).agg((F.count("*") == 0).alias("same"))


def log_parity(served: DataFrame, authority: DataFrame, seq: str, payload: str) -> DataFrame:
    """(seq, divergence) of two logs: 'missing', 'unexpected' or 'payload'."""
    return compare(served, authority, seq, [payload])
