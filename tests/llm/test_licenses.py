"""License scan against a plain scan of every rule, and one example of each form of each rule."""

import re
from itertools import product

from corpus_rows import TEXTS

from stratawave.llm import licenses

RULES = licenses.rules()


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc_id, text):
    w = words_of(text)
    norm = " " + "".join(x + " " for x in w)
    places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p]
    base = sorted({x for _, x in places})
    found = []
    for rule, kind, label, _, pattern in RULES:
        for m in re.finditer(pattern, norm):
            start = norm[:m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, list(licenses.KINDS).index(kind), rule, label, kind))
    kept = [x for x in found if not any(
        y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or y[2:4] < x[2:4]) for y in found)]
    sure = max([licenses.KINDS[x[5]] for x in kept] + [licenses.BASE_SCORE] * bool(places), default=0.0)
    return (doc_id, len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(base), ",".join(sorted({*base, *(x[4] for x in kept)})), sure)


def same(frame, rows):
    got = sorted((tuple(r) for r in licenses.scan(frame).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in rows), key=str)
    return got


def examples(pattern):
    """The texts with every branch and with optional parts absent or present."""
    def each(parts):
        return ["".join(x) for x in product(*(one(*p) for p in parts))]

    def one(op, value):
        op = str(op)
        if op == "LITERAL":
            return [chr(value)]
        if op == "IN":
            return [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        if op == "MAX_REPEAT":
            low, high, inner = value
            return each(inner) if low else ["", *each(inner)] if high == 1 else [each(inner)[0] * 3]
        if op == "SUBPATTERN":
            return each(value[3])
        if op == "BRANCH":
            return [x for b in value[1] for x in each(b)]
        assert op in ("ASSERT", "ASSERT_NOT")
        return [""]

    return each(re._parser.parse(pattern))


def test_every_rule_is_gated_and_found(spark):
    rows, n = [], 0
    for rule, _, _, key, pattern in RULES:
        forms = examples(pattern)
        for text in {forms[0], forms[-1], forms[len(forms) // 2]}:
            assert key in f" {text} ", (pattern, text)
            assert any(g in f" {text} " for g in licenses.GATES), text
            rows.append((rule, f"x {text}, y"))
            n += 1
    assert len(RULES) > 250 and n > 500
    got = {}
    for r in licenses.matches(spark.createDataFrame([(i, " " + "".join(x + " " for x in words_of(t))) for i, (_, t) in enumerate(rows)], "row long, norm string")).collect():
        got.setdefault(r["row"], set()).add(r["rule"])
    assert all(rows[i][0] in got[i] for i in range(len(rows)))
    same(spark.createDataFrame(rows[::5], "doc_id long, text string"), rows[::5])


def test_suppression(spark):
    rows = [
        (1, "Licensed under the GNU Lesser General Public License version 2.1, or the MIT license"),
        (2, "SPDX-License-Identifier: GPL-2.0-or-later\n// the GNU General Public License version 2"), (3, "Under the MIT License under the mit license"),
        (4, "Licensed under CC BY-NC-SA 4.0 and CC BY-NC 4.0"), (5, "apache license version 2"), (6, "Apache License, Version 2.0. apache license"),
        (7, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (8, "mit license" * 3), (9, "MIT licensed under"),
        (10, "unauthorized copying of this file via any medium is strictly prohibited"), (11, "ÀMIT license É mitİ license cc by nc cc by nc by nc"),
    ]
    got = {r[0]: r for r in same(spark.createDataFrame(rows, "doc_id long, text string"), rows)}
    assert got[1][6] == "lgpl-2,mit"
    assert got[2][6:] == ("gpl-2", 1.0)
    assert got[3][2:6] == (2, 0, 4, "mit")
    assert got[4][6] == "cc-by-nc,cc-by-nc-sa"
    assert got[11][2:5] == (2, 5, 8)


def test_odd_rows(spark, docs, none):
    same(docs, [(x[0], x[1]) for x in TEXTS])
    assert licenses.scan(none).count() == 0
    long = "lorem ipsum " * 50_000 + "Released under the MIT License. " * 2000
    same(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), [(1, long)] * 2)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = same(table, [tuple(r) for r in table.select("doc_id", "text").collect()])
    assert {"mit", "apache-2", "cc-by-nc"} <= {x for r in got for x in r[5].split(",")}
