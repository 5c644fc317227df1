"""Scalar functions as Column expressions; pandas UDFs only where no built-in gives the bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import InvalidIdentifier, InvalidState

TERMINAL = {f"playbook{dot}{word}": word for word in ("completed", "failed", "cancelled") for dot in "._"}
UNIT_SEPARATOR = "\u001f"
IDENTIFIER = r"^[A-Za-z0-9_-]{1,128}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"


def check_vector(query: Sequence[float]) -> list[float]:
    """A query vector: not empty, finite, not all zero."""
    if not query:
        raise InvalidState("a query vector must not be empty")
    if not all(math.isfinite(x) for x in query):
        raise InvalidState("a query vector must be finite")
    if not any(query):
        raise InvalidState("a query vector must not be zero")
    return [float(x) for x in query]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(query: Sequence[float], vector: Column) -> Column:
    """Cosine in doubles; null for a vector of another length or without length. The query's norm is folded here, once."""
    q = check_vector(query)
    lit = F.array(*[F.lit(x) for x in q])
    norm = math.sqrt(sum(x * x for x in q))
    size = F.sqrt(_dot(vector, vector))
    return F.when((F.size(vector) == len(q)) & (size > 0), _dot(lit, vector) / (F.lit(norm) * size))


def count_matches(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of the trimmed needle, without case; literal, never a pattern."""
    n = needle.strip().lower()
    if not n:
        raise InvalidState("a text query must not be blank")
    low = F.lower(text)
    return F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("long")


def char_prefix(text: Column, n: int | Column) -> Column:
    return F.substring(text, 1, n) if isinstance(n, int) else F.substring(text, F.lit(1), n)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within `limit` UTF-8 bytes; the UDF sees only texts over the limit."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.encode()[:limit].decode("utf-8", "ignore"))

    return F.when(F.octet_length(text) <= limit, text).otherwise(cut(F.when(F.octet_length(text) > limit, text)))


def content_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def wide_digest(content: Column) -> Column:
    """32 hex digits: XXH64 of the bytes under seeds 0 and 0x9E3779B97F4A7C15."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda b: None if b is None else f"{xxhash.xxh64_intdigest(b, 0):016x}{xxhash.xxh64_intdigest(b, 0x9E3779B97F4A7C15):016x}")

    return digest(content.cast("binary"))


def shard_for(execution_id: Column, shards: int) -> Column:
    """XXH64 (seed 0) of the trimmed id, modulo `shards` without sign; ids that are decimal 64-bit integers hash as eight little-endian bytes."""
    if shards <= 1:
        return F.when(execution_id.isNotNull(), F.lit(0))

    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        def one(v: str | None) -> int | None:
            if v is None:
                return None
            v = v.strip()
            digits = v[1:] if v[:1] in "+-" and len(v) > 1 else v
            number = int(v) if digits.isascii() and digits.isdigit() else None
            raw = number.to_bytes(8, "little", signed=True) if number is not None and -(2**63) <= number < 2**63 else v.encode()
            return xxhash.xxh64_intdigest(raw, 0) % shards

        for values in batches:
            yield values.map(one).astype("Int32")

    return shard(execution_id)


def encode_key(*parts: Column) -> Column:
    return F.concat_ws(UNIT_SEPARATOR, *parts)


def snapshot_path(tenant: Column, namespace: Column, table: Column, snapshot: Column, file: Column) -> Column:
    return F.concat_ws("/", tenant, namespace, F.lit("tables"), table, F.lit("snapshots"), snapshot, file)


def object_path(digest: Column) -> Column:
    """objects/sha256/<hex> of sha256:<hex>."""
    return F.concat(F.lit("objects/sha256/"), F.substring_index(digest, ":", -1))


def object_uri(scheme: str, namespace: Column | str, digest: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.lit(namespace) if isinstance(namespace, str) else namespace, F.lit("/"), object_path(digest))


def terminal_status(event_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv]), event_type)


_EVENT = "event_id long, execution_id string, event_type string, node_name string, status string, prev_event_id long"


def event_array(payload: Column) -> Column:
    """An array of the fields of a JSON event: empty unless the payload is an object with an integer event_id. With F.inline() a payload is parsed once, whatever fields are used."""
    whole = F.regexp_like(F.get_json_object(payload, "$.event_id"), F.lit(r"^-?\d+$"))
    parsed = F.array(F.from_json(payload, _EVENT, {"mode": "PERMISSIVE"}))
    return F.filter(parsed, lambda x: x["event_id"].isNotNull() & F.coalesce(whole, F.lit(False)))


def event_fields(payload: Column) -> Column:
    """The fields of a JSON event; null unless the payload is an object with an integer event_id."""
    return F.get(event_array(payload), 0)


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST), F.lit(False))


def is_object_path(value: Column) -> Column:
    """Relative, of non-empty segments, none of them . or .., without backslashes."""
    return F.coalesce(value.rlike(r"^(?!.*(^|/)\.{1,2}(/|$))[^/\\]+(/[^/\\]+)*$"), F.lit(False))


def is_subject(value: Column) -> Column:
    """Tokens between dots, none empty, without white space and wildcards."""
    return F.coalesce(value.rlike(r"^[^.\s*>]+(\.[^.\s*>]+)*$"), F.lit(False))


def check_identifier(value: str, what: str = "identifier") -> str:
    import re

    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", value or ""):
        raise InvalidIdentifier(f"{what}: {value!r} is not 1 to 128 letters, digits, - or _")
    return value


def weighted_score(vector_score: Column, match_count: Column, vector_weight: float, text_weight: float) -> Column:
    return vector_score * F.lit(vector_weight) + match_count * F.lit(text_weight)


def is_expired(expires_at_ms: Column, now_ms: int | None) -> Column:
    """Expired if now has reached the expiry; never without a now or an expiry."""
    return F.lit(False) if now_ms is None else expires_at_ms.isNotNull() & (F.lit(now_ms) >= expires_at_ms)
