"""Operator 4: quality rules on repetition coverage.

Word n-grams of several lengths get rolling hashes over word hashes; an n-gram that
stood earlier in the same document covers its words. Two shares of a document's word
characters are measured for each length: what is covered by n-grams that stood before
(dup), and what is covered by those that stood at least twice before (again); the same
for characters of lines. A passage that stands twice may be a heading or a quotation,
so dup has one wide limit; what stands a third time is repetition, so again has narrow
ones. The rules are the same for texts of every length. An n-gram can repeat only where the shorter
one at the same word does, so each length looks only at the places the last one left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, pieces, segment_sum
from tidelog.llm.words import mix, span_hashes, words

#: n-gram length -> greatest share covered from the third occurrence on, of a document that is kept.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
#: Greatest share covered from the second occurrence on: a text that says everything twice has half.
TWICE_LIMIT = 0.45


def later_repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places whose hash occurs more than once in their owner, those of them that are not its first, those that are neither first nor second)."""
    key = mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        none = np.zeros(0, np.int64)
        return none, none, none
    twice = twice[np.diff(twice, prepend=twice[:1] ^ np.uint64(1)) != 0]
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    places = np.flatnonzero(twice[at] == key)
    ranked = places[np.argsort(at[places], kind="stable")]
    first = np.diff(at[ranked], prepend=-1) != 0
    third = ~first
    third[1:] &= ~first[:-1]
    return places, np.sort(ranked[~first]), np.sort(ranked[third])


def repetition(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """(words, covered share of word characters by n-gram length, share of line characters in repeated lines, the same two from the third occurrence on) of each document."""
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    w = words(data, offsets)
    count = len(w.hashes)
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(w.bounds))
    size = chars[w.ends] - chars[w.starts]
    total = np.maximum(segment_sum(size, w.bounds), 1)
    stop = w.bounds[1:][owner] if count else owner
    shares, thrice = {}, {}

    def share(later: np.ndarray, n: int) -> np.ndarray:
        covered = np.zeros(count + 1, np.int32)
        np.add.at(covered, later, 1)
        np.add.at(covered, later + n, -1)
        return segment_sum(size * (np.cumsum(covered[:-1]) > 0), w.bounds) / total

    places, done = np.arange(count), 1
    rolled = w.hashes.copy()
    multiplier = np.uint64(0xD1342543DE82EF95)
    for n in sorted(lengths):
        places = places[places + n <= stop[places]]
        for k in range(done, n):  # roll the hashes on to the next length
            rolled[places] = rolled[places] * multiplier + w.hashes[places + k]
        done = n
        found, later, third = later_repeats(owner[places], mix(rolled[places]))
        shares[n], thrice[n] = share(places[later], n), share(places[third], n)
        places = places[found]
    lines, lines_thrice = line_share(data, offsets, chars)
    return np.diff(w.bounds), shares, lines, thrice, lines_thrice


def line_share(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the characters of non-empty lines that are in lines which stood earlier in the document, and at least twice earlier."""
    nothing = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    if not len(data):
        return nothing
    new = data == 10
    inside = ~new
    begins = inside.copy()
    begins[1:] &= new[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return nothing
    value = (data.astype(np.uint64) + np.uint64(1)) * inside
    hashes = span_hashes(value, starts)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    size = chars[ends] - chars[starts]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    _, later, third = later_repeats(owner, mix(hashes + (ends - starts).astype(np.uint64)))
    total = np.maximum(segment_sum(size, bounds), 1)

    def share(at: np.ndarray) -> np.ndarray:
        covered = np.zeros(len(starts), np.int64)
        covered[at] = size[at]
        return segment_sum(covered, bounds) / total

    return share(later), share(third)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, twice_limit: float = TWICE_LIMIT) -> DataFrame:
    """(id, n_words, dup_5 ... dup_10, dup_lines, again_5 ... again_10, again_lines, keep) for every row; shares are rounded to six places.

    dup_n is the share of word characters covered by n-grams from their second
    occurrence on, again_n from the third on; dup_lines and again_lines are the like for
    lines. keep says that no dup share is above `twice_limit` and no again share above
    the limit of its length, or of lines.

    A word is a run of ASCII letters, digits and characters above U+007F, compared
    without ASCII case. The first occurrence of an n-gram or line is not repetition; a
    word is counted once, however many n-grams cover it. Empty lines are no lines.

    Cases: a null text has null figures and is not kept; an empty text has 0 words, 0
    shares and is kept, as no rule is broken; the rules hold for texts of every length
    alike; repeated rows and null ids give a row each; an empty table gives no rows;
    other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f"{kind}_{x}" for kind in ("dup", "again") for x in (*sorted(limits), "lines")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets, null = flat_text(batch.column(1))
            n_words, shares, lines, thrice, lines_thrice = repetition(data, offsets, tuple(limits))
            bad = (lines > twice_limit) | (lines_thrice > line_limit)
            for n, limit in limits.items():
                bad |= (shares[n] > twice_limit) | (thrice[n] > limit)
            figures = [np.round(x, 6) for x in (*(shares[n] for n in sorted(limits)), lines, *(thrice[n] for n in sorted(limits)), lines_thrice)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64), mask=null), *(pa.array(x, mask=null) for x in figures), pa.array(~null & ~bad)], names=["id", "n_words", *names, "keep"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    columns = ", ".join(f"{x} double" for x in names)
    return map_arrow(picked, run, f"id {id_type}, n_words long, {columns}, keep boolean").withColumnRenamed("id", id_col)


def rules_sql(table: str = "documents") -> str:
    """quality_rules() with its default parameters, for DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams, ranks, covered, figures, broken = [], [], [], [], []
    for n in sorted(NGRAM_LIMITS):
        g = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
        grams.append(f"{g} AS g{n}")
        ranks.append(f"CASE WHEN g{n} IS NOT NULL THEN row_number() OVER (PARTITION BY row_id, g{n} ORDER BY i) ELSE 0 END AS r{n}")
        covered.append(f"max(r{n}) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}")
    for kind, least in (("dup", 1), ("again", 2)):
        figures += [(f"{kind}_{n}", f"sum(CASE WHEN c{n} > {least} THEN size ELSE 0 END) / CAST(sum(size) AS DOUBLE)") for n in sorted(NGRAM_LIMITS)]
        limits = {n: TWICE_LIMIT if kind == "dup" else v for n, v in NGRAM_LIMITS.items()} | {"lines": TWICE_LIMIT if kind == "dup" else LINE_LIMIT}
        broken += [f"coalesce({kind}_{n}, 0) > {v}" for n, v in limits.items()]
    names = [f"{kind}_{x}" for kind in ("dup", "again") for x in (*sorted(NGRAM_LIMITS), "lines")]
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS row_id, doc_id, text FROM {table}),
s AS (SELECT row_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM t),
w AS (SELECT row_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM s),
g AS (SELECT row_id, i, length(w) AS size, {", ".join(grams)} FROM w WINDOW o AS (PARTITION BY row_id ORDER BY i)),
r AS (SELECT row_id, i, size, {", ".join(ranks)} FROM g),
c AS (SELECT row_id, size, {", ".join(covered)} FROM r),
f AS (SELECT row_id, count(*) AS n, {", ".join(f"{v} AS {k}" for k, v in figures)} FROM c GROUP BY row_id),
lines AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM t),
ranked AS (SELECT row_id, length(line) AS size, row_number() OVER (PARTITION BY row_id, line) AS k FROM lines WHERE line <> ''),
l AS (SELECT row_id, {", ".join(f"sum(CASE WHEN k > {m} THEN size ELSE 0 END) / CAST(sum(size) AS DOUBLE) AS {kind}_lines" for kind, m in (("dup", 1), ("again", 2)))} FROM ranked GROUP BY row_id)
SELECT t.doc_id, CASE WHEN t.text IS NOT NULL THEN CAST(coalesce(f.n, 0) AS BIGINT) END AS n_words,
{", ".join(f"CASE WHEN t.text IS NOT NULL THEN round(coalesce({x}, 0), 6) END AS {x}" for x in names)},
t.text IS NOT NULL AND NOT ({" OR ".join(broken)}) AS keep
FROM t LEFT JOIN f ON t.row_id = f.row_id LEFT JOIN l ON t.row_id = l.row_id"""
