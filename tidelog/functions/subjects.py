"""Subjects and their filters: '*' is one token, a final '>' one or more."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import InvalidState

DEFAULT_POOL = "shared"


def filter_pattern(subject_filter: str) -> str:
    """An anchored regular expression for a filter."""
    tokens = subject_filter.split(".")
    if not subject_filter or any(not t for t in tokens):
        raise InvalidState(f"subject filter {subject_filter!r} has an empty token")
    out = []
    for i, t in enumerate(tokens):
        if t == ">":
            if i != len(tokens) - 1:
                raise InvalidState("'>' may only be the last token of a subject filter")
            out.append(".+")
        elif t == "*":
            out.append(r"[^.]+")
        elif "*" in t or ">" in t:
            raise InvalidState(f"token {t!r} mixes a wildcard with text")
        else:
            out.append(re.escape(t))
    return "^" + r"\.".join(out) + "$"


def subject_matches(subject: Column, subject_filter: str) -> Column:
    """A filter without wildcards is an equality, which reaches the scan; others are one pattern."""
    pattern = filter_pattern(subject_filter)
    if not re.search(r"(^|\.)(\*|>)(\.|$)", subject_filter):
        return subject == F.lit(subject_filter)
    return subject.rlike(pattern)


def command_subject(payload: Column, shard: Column) -> Column:
    """commands.<pool>.shard.<n>; the pool is the payload's execution_pool, or 'shared'."""
    pool = F.coalesce(F.nullif(F.get_json_object(payload, "$.execution_pool"), F.lit("")), F.lit(DEFAULT_POOL))
    return F.concat_ws(".", F.lit("commands"), pool, F.lit("shard"), shard.cast("string"))


def command_parts(subject: Column) -> Column:
    """struct(pool, shard) of a command subject; null for any other."""
    tokens = F.split(subject, r"\.")
    fits = (F.size(tokens) == 4) & (tokens[0] == "commands") & (tokens[2] == "shard") & tokens[3].rlike(r"^\d+$")
    return F.when(fits, F.struct(tokens[1].alias("pool"), tokens[3].cast("int").alias("shard")))
