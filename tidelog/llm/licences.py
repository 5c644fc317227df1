"""Operator 9: licence scans.

An Aho-Corasick automaton finds notice phrases in whole texts, without ASCII case and
with white space, line ends and the comment signs around them folded to one space (texts
that hold no word of any phrase, by another automaton, are not folded); tags are found in
the text as it is. The expression after a tag is read by a shunting-yard parser (WITH
binds closest, then AND, then OR) and evaluated on a scale of restrictions: AND takes
the stricter side, OR the freer one, a known exception moves a licence one step down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, list_array, pieces

LEVELS = ("none", "public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "restricted", "unknown")
#: A document is allowed up to this level.
ALLOWED = "permissive"

#: identifier -> level
LICENCES = {
    **dict.fromkeys(("CC0-1.0", "Unlicense", "PDDL-1.0", "0BSD", "WTFPL"), "public-domain"),
    **dict.fromkeys(("MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "BSL-1.0", "PostgreSQL", "Python-2.0", "PSF-2.0", "X11", "NCSA", "CC-BY-3.0", "CC-BY-4.0", "Artistic-2.0", "AFL-3.0", "UPL-1.0", "BlueOak-1.0.0", "OpenSSL", "curl"), "permissive"),
    **dict.fromkeys(("LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "MS-RL", "CPL-1.0"), "weak-copyleft"),
    **dict.fromkeys(("GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "EUPL-1.2", "OSL-3.0", "GFDL-1.3"), "copyleft"),
    **dict.fromkeys(("AGPL-1.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "SSPL-1.0"), "network-copyleft"),
    **dict.fromkeys(("CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-ND-4.0", "BUSL-1.1", "Elastic-2.0"), "restricted"),
}
EXCEPTIONS = frozenset(x.lower() for x in ("Classpath-exception-2.0", "GCC-exception-3.1", "GCC-exception-2.0", "LLVM-exception", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "Linux-syscall-note", "OpenSSL-exception", "Qt-GPL-exception-1.0"))
_BY_NAME = {k.lower(): k for k in LICENCES}
TAGS = ("spdx-license-identifier:",)
#: notice phrase in lower case -> identifier; where phrases overlap at their end the longest one counts.
PHRASES = {
    "apache license, version 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache-2.0 license": "Apache-2.0", "apache.org/licenses/license-2.0": "Apache-2.0",
    "mit license": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "opensource.org/licenses/mit": "MIT",
    "gnu general public license, version 3": "GPL-3.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v3": "GPL-3.0", "gnu gpl v3": "GPL-3.0", "gplv3": "GPL-3.0",
    "gnu general public license, version 2": "GPL-2.0", "gnu general public license version 2": "GPL-2.0", "gnu general public license v2": "GPL-2.0", "gplv2": "GPL-2.0",
    "gnu lesser general public license, version 3": "LGPL-3.0", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license, version 2.1": "LGPL-2.1", "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu affero general public license, version 3": "AGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "mozilla public license, v. 2.0": "MPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license - v 2.0": "EPL-2.0",
    "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause", "bsd 3-clause": "BSD-3-Clause", "bsd 2-clause": "BSD-2-Clause", "isc license": "ISC", "boost software license": "BSL-1.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by-nd 4.0": "CC-BY-ND-4.0", "cc by 4.0": "CC-BY-4.0", "cc by-sa 3.0": "CC-BY-SA-3.0",
    "creativecommons.org/licenses/by-nc-sa/4.0": "CC-BY-NC-SA-4.0", "creativecommons.org/licenses/by-nc/4.0": "CC-BY-NC-4.0", "creativecommons.org/licenses/by-sa/4.0": "CC-BY-SA-4.0", "creativecommons.org/licenses/by/4.0": "CC-BY-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0", "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0", "creative commons attribution 4.0": "CC-BY-4.0", "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0", "cc0 1.0": "CC0-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense", "do what the fuck you want to public license": "WTFPL", "business source license 1.1": "BUSL-1.1",
}
#: The headers of the Free Software Foundation name the version after the publisher.
_PUBLISHED = "as published by the free software foundation"
for _name, _version, _id in (
    ("general", "1", "GPL-1.0"), ("general", "2", "GPL-2.0"), ("general", "3", "GPL-3.0"), ("library general", "2", "LGPL-2.0"), ("library general", "2.1", "LGPL-2.1"), ("lesser general", "2 ", "LGPL-2.0"), ("lesser general", "2,", "LGPL-2.0"), ("lesser general", "2.0", "LGPL-2.0"),
    ("lesser general", "2.1", "LGPL-2.1"), ("lesser general", "3", "LGPL-3.0"), ("affero general", "3", "AGPL-3.0"),
):
    for _sign in (",", ";"):
        for _either in ("either ", ""):
            PHRASES[f"gnu {_name} public license {_PUBLISHED}{_sign} {_either}version {_version}"] = _id
_TAG = re.compile("|".join(map(re.escape, TAGS)), re.I | re.A)
_SIGNS = r"(?:(?:[/*#;%!>|]++|--++|<!--)\s*+)*+"
_BREAK = rf"(?:[^\S\n]++[*/#;%|]++|[^\S\n]++-->)?[^\S\n]*+\n\s*+{_SIGNS}"
#: What counts as one space: a line end with the comment signs before and after it, and other white space.
_FOLD = re.compile(rf"{_BREAK}|[^\S\n]{{2,}}+|[^\S\n ]")
_LINE_END = re.compile(_BREAK)
_OPERATOR = re.compile(r"(?:AND|OR|WITH)(?![0-9A-Za-z.+:-])")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-+:")
_BINDS = {"or": 1, "and": 2, "with": 3}


def level_of(name: str) -> int:
    """Place of a licence identifier on the scale; a final + (or later) does not change it."""
    known = _BY_NAME.get(name.lower()) or _BY_NAME.get(name.lower().rstrip("+"))
    return LEVELS.index(LICENCES[known]) if known else LEVELS.index("unknown")


def tokens_of(text: str, at: int) -> tuple[list[str], int]:
    """Words and parentheses of a licence expression at text[at:], to the end of its line or sentence, or the first other sign; (tokens, end).

    A line that ends after an operator or inside parentheses, or before an operator in
    capitals, is continued by the next, whatever comment signs stand between.
    """
    out, n = [], len(text)
    while at < n:
        c = text[at]
        if out and (line := _LINE_END.match(text, at)) and (out[-1].lower() in _BINDS or out.count("(") > out.count(")") or _OPERATOR.match(text, line.end())):
            at = line.end()
        elif c in " \t\r":
            at += 1
        elif c in "()":
            out.append(c)
            at += 1
        elif c in _WORD:
            end = at
            while end < n and text[end] in _WORD:
                end += 1
            word = text[at:end].rstrip(".:")  # a full stop ends a sentence, not a name
            if word:
                out.append(word)
            at = end
            if not text[end - 1].isalnum() and text[end - 1] in ".:":
                break
        else:
            break
    return out, at


def parse(tokens: list[str]) -> list[str] | None:
    """Reverse Polish order of the longest prefix that is an expression, by shunting-yard; None if there is none."""
    best, out, stack, operand = None, [], [], True
    for i, raw in enumerate(tokens):
        t = raw.lower()
        if operand:
            if t == "(":
                stack.append(t)
                continue
            if t in _BINDS or t == ")":
                break
            out.append(raw)
            operand = False
        else:
            if t == ")":
                while stack and stack[-1] != "(":
                    out.append(stack.pop())
                if not stack:
                    break
                stack.pop()
            elif t in _BINDS:
                while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                    out.append(stack.pop())
                stack.append(t)
                operand = True
                continue
            else:
                break
        if "(" not in stack:
            best = out + stack[::-1]
        del i
    return best


def evaluate(rpn: list[str]) -> tuple[int, list[str], str]:
    """(level, licences, the expression in canonical form) of an expression in reverse Polish order."""
    stack: list[tuple[int, list[str], str, int]] = []
    for t in rpn:
        low = t.lower()
        if low not in _BINDS:
            name = _BY_NAME.get(low) or t
            stack.append((level_of(t), [name], name, 4))
            continue
        b, a = stack.pop(), stack.pop()
        if low == "with":
            known = b[2].lower() in EXCEPTIONS
            down = {LEVELS.index("network-copyleft"): LEVELS.index("weak-copyleft"), LEVELS.index("copyleft"): LEVELS.index("weak-copyleft"), LEVELS.index("weak-copyleft"): LEVELS.index("permissive")}
            stack.append((down.get(a[0], a[0]) if known else a[0], a[1], f"{a[2]} WITH {b[2]}", 3))
            continue
        binds = _BINDS[low]
        sides = [f"({x[2]})" if x[3] < binds else x[2] for x in (a, b)]
        pick = max if low == "and" else min
        stack.append((pick(a[0], b[0]), a[1] + b[1], f"{sides[0]} {low.upper()} {sides[1]}", binds))
    level, names, text, _ = stack.pop()
    return level, names, text


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, name in PHRASES.items():
        a.add_word(p, (len(p), name))
    a.make_automaton()
    return a


def anchors():
    """An automaton of one whole word of each phrase, the longest. Folding keeps words, so a text without any of them holds no phrase."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in PHRASES:
        a.add_word(max(re.findall(r"[0-9a-z]+", p), key=len), True)
    a.make_automaton()
    return a


def scan_text(a, text: str, folded: str) -> tuple[list[str], list[str], int, int]:
    """(licences, expressions, level, hits) of one text; text may be empty if it has no tags; folded is it in ASCII lower case with its spaces folded."""
    names: set[str] = set()
    expressions: set[str] = set()
    level, hits, end_seen, last = 0, 0, -1, 0
    for tag in _TAG.finditer(text):
        rpn = parse(tokens_of(text, tag.end())[0])
        if rpn is None:
            continue
        grade, found, canonical = evaluate(rpn)
        names.update(found)
        expressions.add(canonical)
        level = max(level, grade)
        hits += 1
    for end, (size, name) in a.iter(folded):
        start = end + 1 - size
        if end == end_seen and size < last:
            continue
        if start and folded[start - 1].isalnum() and folded[start].isalnum() or folded[end].isalnum() and folded[end + 1 : end + 2].isalnum():
            continue  # it begins or ends inside a longer word
        end_seen, last = end, size
        names.add(name)
        level = max(level, level_of(name))
        hits += 1
    return sorted(names), sorted(expressions), level, hits


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """(id, licences, expressions, restriction, n_hits, keep) for every row.

    licences are the identifiers named by tags or notices, sorted; expressions the
    canonical forms of the tags' expressions; restriction the strictest level of all of
    them (they all apply); keep says it is not above `allowed`.

    Cases: null and empty texts, and texts without a hit, have empty arrays, 0 hits,
    restriction 'none', and are kept; of a malformed expression the longest well-formed
    head counts, and a tag without one is no hit; names that are not known count as
    'unknown', the strictest; phrases are matched across the whole text, also several
    times and over line ends and comment signs, but not inside a longer word, neither at
    its beginning nor at its end; repeated rows and null ids give a row each; an empty
    table gives no rows; other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    bar = LEVELS.index(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, some = automaton(), anchors()

        def one(raw: bytes, low: bytes) -> tuple[list[str], list[str], int, int]:
            text = low.decode()
            return scan_text(a, raw.decode() if b"spdx-license" in low else "", _FOLD.sub(" ", text) if next(some.iter(text), None) else "")

        for batch in pieces(batches, "text"):
            data, offsets, _ = flat_text(batch.column(1))
            raw, low = data.tobytes(), fold[data].tobytes()
            found = [one(raw[s:e], low[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = [list_array(np.cumsum([0, *(len(x[k]) for x in found)]), np.array([y for x in found for y in x[k]], object)) for k in (0, 1)]
            level = np.array([x[2] for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(x.cast(pa.list_(pa.string())) for x in lists), pa.array(np.array(LEVELS, object)[level], pa.string()), pa.array([x[3] for x in found], pa.int32()), pa.array(level <= bar)], names=["id", "licences", "expressions", "restriction", "n_hits", "keep"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(picked, run, f"id {id_type}, licences array<string>, expressions array<string>, restriction string, n_hits int, keep boolean").withColumnRenamed("id", id_col)
