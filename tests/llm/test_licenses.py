import itertools
import re

import pytest

from rulemill.llm import licenses

from .util import EDGE, docs


def words_of(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_matches(words):
    """Every phrase at every word, without an automaton."""
    out = set()
    for phrase, values in licenses.automaton().items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if [w.encode().decode("latin-1") for w in words[i : i + len(p)]] == p:
                out |= {(i, n, k, v) for n, k, v in values}
    return out


def brute_base(t):
    w = words_of(t)
    at = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({b for _, b in at}))


TEXTS = [
    *EDGE,
    "Released under the MIT License.",
    "under  the\nMIT-license, under the mit license under the MIT license",
    "Licensed under the Apache License, Version 2.0. cc by nc by nc CC-BY-NC",
    "under the mitt license; éunder the mit license; under the mit licensé",
    "mit und " * 4000 + "under the mit license",
]


def test_base_and_matches(spark):
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        w = words_of(t)
        if len(w) < 100:
            joined = " " + " ".join(w) + " "
            assert {tuple(f) for f in licenses.matches(joined.encode().decode("latin-1"))} == brute_matches(w)


CASES = {
    "This work is licensed under the GNU General Public License, version 3.": ("gpl-3", 3),
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nMIT": ("apache-2,gpl-2,mit", 2),
    "SPDX-License-Identifier: LGPL-2.1-or-later AND (BSD-3-Clause OR ISC)": ("bsd-3-clause,isc,lgpl-2", 2),
    "dual licensed under either of the Apache License, Version 2.0 or the MIT license at your option": ("apache-2,mit", 1),
    "distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3": ("agpl-3", 4),
    "SPDX-License-Identifier: ((MIT": ("mit", 1),
    "SPDX-License-Identifier: MIT OR": ("mit", 1),
    "SPDX-License-Identifier: ) OR": ("", None),
    "SPDX-License-Identifier:\nnothing": ("", None),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this": ("mit", 1),
    "Available under CC BY-NC-SA 4.0": ("cc-by-nc,cc-by-nc-sa", 5),
    "Es ist mit der Lizenz, und or and with (Apache)": ("", None),
    "We met him with a license to drive": ("", None),
}


@pytest.mark.parametrize("text", CASES)
def test_labels(text):
    r = licenses.scan(text)
    assert (r["labels"], r["burden"]) == CASES[text]


def test_expressions_equal_a_plain_evaluation():
    """All token rows of up to six tokens that Python itself can evaluate."""
    cost = {"mit": 1, "gpl-3": 3}

    class Cost(int):
        __or__ = lambda a, b: Cost(min(int(a), int(b)))
        __and__ = lambda a, b: Cost(max(int(a), int(b)))

    tried = 0
    for n in range(1, 8):
        for tokens in itertools.product(["(", ")", "or", "and", "mit", "gpl-3"], repeat=n) if n < 6 else [tuple("( mit or gpl-3 ) and mit".split()), tuple("mit or gpl-3 and ( gpl-3 )".split())]:
            rpn = licenses.postfix(list(tokens))
            got = licenses.evaluated(rpn)
            code = " ".join({"or": "|", "and": "&", "mit": "A", "gpl-3": "B"}.get(t, t) for t in tokens)
            try:
                want = eval(code, {"A": Cost(cost["mit"]), "B": Cost(cost["gpl-3"])})  # noqa: S307
            except (SyntaxError, TypeError):
                continue
            if isinstance(want, Cost):
                tried += 1
                assert got == int(want), tokens
    assert tried > 50


def test_rows(spark):
    from pyspark.sql import functions as F

    d = docs(spark, ["under the mit license"] * 3 + [None], ids=[1, 1, None, 2]).withColumn("labels", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(((r.doc_id, r.labels) for r in licenses.license_scan(d).collect()), key=str)
    assert got == sorted([(1, "mit"), (1, "mit"), (None, "mit"), (2, "")], key=str)
    assert licenses.license_scan(docs(spark, [])).count() == 0
