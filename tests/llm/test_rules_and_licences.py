"""Operators 4 and 9 against plain rewrites."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import licences, repetition
from tidelog.llm.textbatch import flat_text


def brute_shares(text, lengths):
    ws = [(m.group(), m.group().lower() if m.group().isascii() else "".join(c.lower() if c.isascii() else c for c in m.group())) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    sizes, ws = [len(a) for a, _ in ws], [b for _, b in ws]
    out = []
    for least in (1, 2):
        for n in lengths:
            seen, covered = Counter(), set()
            for i in range(len(ws) - n + 1):
                g = tuple(ws[i : i + n])
                if seen[g] >= least:
                    covered.update(range(i, i + n))
                seen[g] += 1
            out.append(sum(sizes[i] for i in covered) / max(1, sum(sizes)))
    lines = [x for x in text.split("\n") if x]
    seen, again = Counter(), [0, 0]
    for x in lines:
        for k in (0, 1):
            again[k] += len(x) if seen[x] > k else 0
        seen[x] += 1
    return len(ws), out, [x / max(1, sum(map(len, lines))) for x in again]


def check(texts):
    lengths = (2, 3, 5, 6, 10)
    data, offsets, _ = flat_text(pa.array(texts, pa.string()))
    n, shares, lines, thrice, lines_thrice = repetition.repetition(data, offsets, lengths)
    for i, t in enumerate(texts):
        want = brute_shares(t, lengths)
        assert n[i] == want[0]
        assert np.allclose([x[k][i] for x in (shares, thrice) for k in lengths], want[1]) and np.allclose([lines[i], lines_thrice[i]], want[2])


def test_random_texts():
    rng = random.Random(8)
    check(["".join(rng.choice(["a ", "b ", "Cé ", "d-", "\n", "a b c\n", "E", "9"]) for _ in range(rng.randrange(80))) for _ in range(400)])
    check(["", "\n\n", "x", "ab" * 400 + "\n" + "ab" * 400, "w " * 3000, "z" * 700 + " " + "z" * 701])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.é", max_size=50), max_size=6))
def test_any_texts(texts):
    check(texts)


def test_clean_prose_is_kept_and_spam_is_not(spark):
    rng = random.Random(2)
    prose = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    spam = prose + " " + "buy this product now and be happy " * 60
    lines = prose + "\n" + "\n".join(["subscribe to the list below"] * 100)
    got = {r.doc_id: r.keep for r in repetition.quality_rules(spark.createDataFrame([(1, prose), (2, spam), (3, lines), (4, "short short short short short short")], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_rules_hold_at_every_length(spark):
    """Spam of few words goes as that of many does; a heading that stands twice in a short text stays, a text that stands twice in whole goes."""
    words = [f"w{i}" for i in range(400)]
    line = " ".join(words[:10])
    cases = {f"spam {n}": (("buy this product now and be happy " * 60).split()[:n], False) for n in (15, 20, 49, 50, 51, 400)}
    cases |= {f"one word {n}": (["x"] * n, n < 6) for n in (1, 5, 6, 49, 50, 300)}
    cases |= {f"twice {n}": (words[:n] * 2, False) for n in (10, 24, 25, 26, 200)}
    cases |= {f"plain {n}": (words[:n], True) for n in (1, 10, 49, 50, 400)}
    texts = {k: (" ".join(v), keep) for k, (v, keep) in cases.items()}
    texts |= {f"heading {n}": ("\n".join([line, " ".join(words[50 : 50 + n]), line]), True) for n in (8, 20, 40, 300)}
    texts |= {f"lines {n}": ("\n".join([line] * n), False) for n in (2, 3, 5, 40)}
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    assert {r.doc_id: r.keep for r in repetition.quality_rules(docs).collect()} == {k: keep for k, (_, keep) in texts.items()}
    import duckdb

    rows = docs.toPandas()  # noqa: F841
    assert dict(duckdb.sql("SELECT doc_id, keep FROM (" + repetition.rules_sql("rows") + ")").fetchall()) == {k: keep for k, (_, keep) in texts.items()}


@pytest.mark.parametrize(
    ("text", "canonical", "level"),
    [
        ("MIT", "MIT", "permissive"), ("mit OR gpl-3.0", "MIT OR GPL-3.0", "permissive"), ("MIT AND GPL-3.0-only", "MIT AND GPL-3.0-only", "copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "weak-copyleft"), ("GPL-2.0 WITH made-up", "GPL-2.0 WITH made-up", "copyleft"),
        ("MIT OR Apache-2.0 AND AGPL-3.0", "MIT OR Apache-2.0 AND AGPL-3.0", "permissive"), ("(MIT OR Apache-2.0) AND AGPL-3.0", "(MIT OR Apache-2.0) AND AGPL-3.0", "network-copyleft"),
        ("LGPL-2.1-or-later WITH LLVM-exception OR MPL-2.0", "LGPL-2.1-or-later WITH LLVM-exception OR MPL-2.0", "permissive"), ("Nobody-Knows", "Nobody-Knows", "unknown"), ("((MIT))", "MIT", "permissive"), ("MIT. And more", "MIT", "permissive"), ("MIT OR", "MIT", "permissive"), ("MIT ) x", "MIT", "permissive"),
    ],
)
def test_expressions(text, canonical, level):
    tokens, _ = licences.tokens_of(text, 0)
    grade, _, got = licences.evaluate(licences.parse(tokens))
    assert licences.LEVELS[grade] == level and got == canonical


@pytest.mark.parametrize("text", ["", "AND", "( MIT", ")", "OR MIT"])
def test_malformed_expressions(text):
    assert licences.parse(licences.tokens_of(text, 0)[0]) is None


def test_scan(spark):
    long = "x " * 200_000
    rows = [
        (1, long + "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + long), (2, "Licensed under the APACHE License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0. And MIT License"),
        (4, "permit license"), (5, "SPDX-License-Identifier:\nMIT"), (6, "spdx-license-identifier: GPL-3.0-only AND\tMIT"), (7, "submit licenses; gplv3x"), (8, "plain"), (9, "MIT License MIT License"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licences == ["Apache-2.0", "MIT"] and got[1].expressions == ["MIT OR Apache-2.0"] and got[1].keep
    assert got[2].licences == ["Apache-2.0"] and got[2].keep
    assert got[3].licences == ["CC-BY-NC-4.0", "MIT"] and got[3].restriction == "restricted" and not got[3].keep
    assert got[4].licences == [] and got[5].licences == [] and got[5].n_hits == 0
    assert got[6].restriction == "copyleft" and not got[6].keep
    assert got[7].licences == [] and got[7].n_hits == 0 and got[7].keep
    assert got[8].restriction == "none" and got[9].n_hits == 2


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("gplv3x", []), ("gplv3", ["GPL-3.0"]), ("xgplv3", []), ("(gplv3)", ["GPL-3.0"]), ("gplv3+", ["GPL-3.0"]), ("mit licensed", []), ("mit license", ["MIT"]), ("MIT License.", ["MIT"]), ("isc licenses", []), ("isc license, gplv2", ["GPL-2.0", "ISC"]),
        ("GNU GPL v3é", []), ("cc by 4.01", []), ("cc by 4.0", ["CC-BY-4.0"]), ("gnu general public license version 21", []), ("opensource.org/licenses/mit/", ["MIT"]), ("opensource.org/licenses/mitre", []),
    ],
)
def test_words_are_whole(text, names):
    assert licences.scan_text(licences.automaton(), "", text.lower())[0] == names


def plain_fold(text):
    """One space for white space, and for line ends with the comment signs beside them, written line by line."""
    lines = "".join(c.lower() if c.isascii() else c for c in text).split("\n")
    out = []
    for i, line in enumerate(lines):
        if i + 1 < len(lines):
            line = re.sub(r"\s+([*/#;%|]+|-->)\s*$", "", line)
        if i:
            line = re.sub(r"^(\s*([/*#;%!>|]+|--+|<!--))*\s*", "", line)
        out.append(line)
    return re.sub(r"\s+", " ", " ".join(out))


def plain_level(tokens):
    """(level, names, text) by recursive descent; the longest well-formed head."""

    def atom(i):
        if i < len(tokens) and tokens[i] == "(":
            got, j = either(i + 1)
            if got is None or j >= len(tokens) or tokens[j] != ")":
                return None, i
            return (got[0], got[1], got[2], 4) if got[3] == 4 else (got[0], got[1], got[2], got[3]), j + 1
        if i < len(tokens) and tokens[i].lower() not in ("and", "or", "with", ")", "("):
            known = {k.lower(): k for k in licences.LICENCES}
            low = tokens[i].lower()
            name = known.get(low) or known.get(low.rstrip("+"))
            return (licences.LEVELS.index(licences.LICENCES[name]) if name else licences.LEVELS.index("unknown"), [known.get(low) or tokens[i]], known.get(low) or tokens[i], 4), i + 1
        return None, i

    def joined(i, word, inner, binds, pick):
        a, i = inner(i)
        while a is not None and i < len(tokens) and tokens[i].lower() == word:
            b, j = inner(i + 1)
            if b is None:
                break
            if word == "with":
                down = {"network-copyleft": "weak-copyleft", "copyleft": "weak-copyleft", "weak-copyleft": "permissive"}
                known = b[2].lower() in licences.EXCEPTIONS
                level = licences.LEVELS.index(down.get(licences.LEVELS[a[0]], licences.LEVELS[a[0]])) if known else a[0]
                a = (level, a[1], f"{a[2]} WITH {b[2]}", 3)
            else:
                x, y = (f"({s[2]})" if s[3] < binds else s[2] for s in (a, b))
                a = (pick(a[0], b[0]), a[1] + b[1], f"{x} {word.upper()} {y}", binds)
            i = j
        return a, i

    def exception(i):
        return joined(i, "with", atom, 3, None)

    def both(i):
        return joined(i, "and", exception, 2, max)

    def either(i):
        return joined(i, "or", both, 1, min)

    return either(0)[0]


def plain_scan(text):
    """(licences, expressions, restriction, hits, keep) without the automaton and without shunting-yard."""
    names, expressions, level, hits = set(), set(), 0, 0
    for m in re.finditer(r"(?i)spdx-license-identifier:[ \t\r]*([^\n]*)", text or ""):
        line = m.group(1)
        tokens = []
        for t in re.finditer(r"[ \t\r]*([()]|[A-Za-z0-9.:+-]+)|.", line):
            if t.group(1) is None:
                break
            w = t.group(1)
            if w.rstrip(".:"):
                tokens.append(w.rstrip(".:"))
            if w[-1] in ".:":
                break
        got = plain_level(tokens)
        if got is not None:
            level, hits = max(level, got[0]), hits + 1
            names.update(got[1])
            expressions.add(got[2])
    low, ends = plain_fold(text or ""), {}
    for p, name in licences.PHRASES.items():
        for m in re.finditer(f"(?={re.escape(p)})", low):
            a, b = m.start(), m.start() + len(p)
            if a and low[a - 1].isalnum() and p[0].isalnum() or low[b : b + 1].isalnum() and p[-1].isalnum():
                continue
            ends[b] = max(ends.get(b, (0, "")), (len(p), name))
    for _, name in ends.values():
        names.add(name)
        level, hits = max(level, licences.level_of(name)), hits + 1
    return sorted(names), sorted(expressions), licences.LEVELS[level], hits, level <= licences.LEVELS.index("permissive")


def test_whole_rows_by_brute_force(spark):
    """Every column over the whole table, and over texts made to hit the rules."""
    rng = random.Random(9)
    words = [*licences.PHRASES, "SPDX-License-Identifier:", "MIT", "OR", "AND", "WITH", "(", ")", "GPL-2.0-only", "AGPL-3.0", "Classpath-exception-2.0", "\n", "\n# ", " ", "x", ".", "Nobody-1", "\n * ", "é", ",", "version 2", "License"]
    made = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    terms = ["MIT", "mit", "GPL-2.0-only", "AGPL-3.0", "LGPL-2.1+", "Apache-2.0", "Nobody-1", "AND", "and", "OR", "or", "WITH", "Classpath-exception-2.0", "(", ")", "made-up"]
    made += ["// spdx-license-identifier: " + " ".join(rng.choice(terms) for _ in range(rng.randrange(0, 10))) + rng.choice(["", ".", " *", " // x"]) for _ in range(300)]
    one_line = [t for t in made if "\n" not in t]
    notices = [t for t in made if "SPDX" not in t]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.unionByName(spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(one_line + notices)], "doc_id string, text string"))
    got = {r.doc_id: (r.licences, r.expressions, r.restriction, r.n_hits, r.keep) for r in licences.scan(docs).collect()}
    want = {r.doc_id: plain_scan(r.text) for r in docs.collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert sum(v[3] > 0 for k, v in want.items() if k[0] != "m") > 10 and sum(bool(v[1]) for v in want.values()) > 20


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
FSF = "{} as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", "//", ";; ", "-- ", "> ", "\t"])
def test_wrapped_notices(spark, sign):
    texts = {BSD: "BSD-3-Clause", "the Apache\n\nLicense,  Version\t2.0": "Apache-2.0", "the MIT\r\nLicense": "MIT"} | {FSF.format(f"GNU {n}General\nPublic License", v): k for n, v, k in (("", 3, "GPL-3.0"), ("", 2, "GPL-2.0"), ("Lesser ", 3, "LGPL-3.0"), ("Lesser ", 2, "LGPL-2.0"), ("Lesser ", 2.1, "LGPL-2.1"), ("Affero ", 3, "AGPL-3.0"))}
    rows = [(i, "\n".join(sign + x for x in t.split("\n"))) for i, t in enumerate(texts)]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [k] for i, k in enumerate(texts.values())}


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("MIT OR\n// Apache-2.0", "MIT OR Apache-2.0"), ("(MIT\n# OR Apache-2.0)\n# AND ISC", "(MIT OR Apache-2.0) AND ISC"), ("GPL-2.0-only */\n/* WITH Classpath-exception-2.0 */", "GPL-2.0-only WITH Classpath-exception-2.0"), ("MIT\r\n * AND Zlib\r\n */", "MIT AND Zlib"),
        ("MIT\nand some words", "MIT"), ("MIT\nORDER BY x", "MIT"), ("MIT\nwith thanks", "MIT"), ("MIT.\nOR else", "MIT"),
    ],
)
def test_expressions_over_lines(text, canonical):
    assert licences.evaluate(licences.parse(licences.tokens_of(text, 0)[0]))[2] == canonical
