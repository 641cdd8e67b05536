"""Licence scans: one Aho-Corasick pass finds identifier tags, notice leads, licence names and permission sentences; a
shunting-yard parser reads the and/or/with expressions behind tags and leads and evaluates them.

The automaton runs over the words of a text (lower-cased A-Z, joined by one space), so a phrase is found at whole words
alone. Behind a tag (``SPDX-License-Identifier:``) or a lead (``licensed under``) a statement is read word by word:
licence names and identifiers are operands, and/or/with operators, parentheses come from what separates the words, a
few filler words are skipped, anything else ends it. ``with`` binds closest, then ``and``, then ``or``; an operator without its second
operand is dropped and open parentheses are closed. Evaluation gives how much a licence asks for (``BURDEN``): the least of
``or``, the most of ``and``, one step less by an exception.

Base places are the matches of ``BASE`` alone; their labels always stay. Further labels come from statements, from
permission sentences and from full licence names. ``score`` is 1 - product(1 - weight) over the kinds of evidence.

Defined results: a null text is empty; without words all counts are 0, ``first_word`` and ``last_word`` null, labels empty
strings, the score 0. Null and repeated doc_ids keep their rows. Texts are scanned whole, in time linear in their length;
phrases may overlap, and of licence names that start at one word the longest counts. An empty table gives no rows. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, UPPER, released, small_batches

#: Phrases whose places are counted, and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: How much a licence asks for: 0 next to nothing, 1 notices, 2 source of changed files, 3 source of the whole, 4 source for
#: users over a network, 5 no commercial use or no changes.
#: label: (burden, names, identifiers); a name or identifier with # stands for any version, which the label then carries.
LICENSES = {
    "0bsd": (0, ["zero clause bsd license"], ["0bsd"]),
    "agpl": (4, ["gnu affero general public license"], ["agpl #"]),
    "apache": (1, ["apache license", "apache software license"], ["apache #"]),
    "artistic": (1, ["artistic license"], ["artistic #"]),
    "boost": (1, ["boost software license"], ["bsl 1 0"]),
    "bsd": (1, ["bsd license"], []),
    "bsd-2-clause": (1, ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"], ["bsd 2 clause"]),
    "bsd-3-clause": (1, ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"], ["bsd 3 clause"]),
    "cc-by": (1, ["creative commons attribution"], ["cc by"]),
    "cc-by-nc": (5, ["creative commons attribution noncommercial", "creative commons attribution non commercial"], ["cc by nc"]),
    "cc-by-nc-nd": (5, ["creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"], ["cc by nc nd"]),
    "cc-by-nc-sa": (5, ["creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"], ["cc by nc sa"]),
    "cc-by-nd": (5, ["creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["cc by nd"]),
    "cc-by-sa": (3, ["creative commons attribution sharealike", "creative commons attribution share alike"], ["cc by sa"]),
    "cc0": (0, ["creative commons zero", "cc0 public domain dedication"], ["cc0", "cc0 1 0"]),
    "cddl": (2, ["common development and distribution license"], ["cddl #"]),
    "epl": (2, ["eclipse public license"], ["epl #"]),
    "eupl": (3, ["european union public license", "european union public licence"], ["eupl #"]),
    "gfdl": (3, ["gnu free documentation license"], ["gfdl #"]),
    "gpl": (3, ["gnu general public license", "gnu gpl"], ["gpl #", "gplv2", "gplv3"]),
    "isc": (1, ["isc license"], ["isc"]),
    "lgpl": (2, ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["lgpl #"]),
    "mit": (1, ["mit license", "mit licence", "expat license"], ["mit"]),
    "mpl": (2, ["mozilla public license"], ["mpl #"]),
    "odbl": (3, ["open database license"], ["odbl #"]),
    "ofl": (1, ["sil open font license"], ["ofl #"]),
    "python": (1, ["python software foundation license"], ["psf #", "python #"]),
    "unlicense": (0, ["the unlicense"], ["unlicense"]),
    "wtfpl": (0, ["do what the fuck you want to public license"], ["wtfpl"]),
    "zlib": (1, ["zlib license"], ["zlib"]),
}
EXCEPTIONS = ["classpath exception", "classpath exception 2 0", "gcc exception", "gcc exception 3 1", "llvm exception", "linking exception", "autoconf exception", "bison exception", "font exception", "openssl exception"]
TAGS = ["spdx license identifier"]
LEADS = [f"{verb} under" for verb in ("licensed", "released", "distributed", "available", "published", "provided", "relicensed", "sublicensed")] + ["under the terms of", "subject to the terms of", "governed by"]
#: Sentences that grant a licence by themselves.
GRANTS = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
FILLER = set("the a an either both of terms conditions license licence licenses version versions v international unported public dual dually".split())
SUFFIX = (b"only", b"version", b"license", b"licence")
WEIGHTS = {"tag": 0.95, "grant": 0.9, "notice": 0.85, "base": 0.8, "name": 0.4}
#: Only 0-9, a-z (A-Z first lower-cased) and what is beyond ASCII make words.
_WORDS = bytes(b if chr(b).isascii() and chr(b).isalnum() or b >= 128 else 32 for b in range(256))
FOLD = _WORDS.translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class Found(NamedTuple):
    start: int  # word
    length: int
    kind: str
    value: str


@cache
def automaton():
    """All phrases, each with its kinds and values; a space stands at both ends."""
    import ahocorasick

    held: dict[str, list] = {}

    def add(phrase, kind, value):
        held.setdefault(f" {phrase} ", []).append((len(phrase.split()), kind, value))

    for phrase, label in BASE.items():
        add(phrase, "base", label)
    for label, (_, names, ids) in LICENSES.items():
        for name in names:
            add(name, "name", label)
        for name in ids:
            if name.endswith("#"):
                for major in range(10):
                    add(f"{name[:-2]} {major}", "id", f"{label}-{major}")
                    add(f"{name[:-1]}{major} 0", "id", f"{label}-{major}")
            elif name[:-1].endswith("v"):
                add(name, "id", f"{label}-{name[-1]}")
            else:
                add(name, "id", label)
    for kind, phrases in (("tag", TAGS), ("lead", LEADS), ("exception", EXCEPTIONS)):
        for phrase in phrases:
            add(phrase, kind, phrase.replace(" ", "-"))
    for phrase, label in GRANTS.items():
        add(phrase, "grant", label)
    out = ahocorasick.Automaton()
    for phrase, values in held.items():
        out.add_word(phrase, values)
    out.make_automaton()
    return out


def matches(joined: str) -> list[Found]:
    """``joined``: words with one space before, between and after."""
    hits = [(end, v) for end, values in automaton().iter(joined) for v in values]
    if not hits:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, [end for end, _ in hits])  # the gap after the last word
    return [Found(int(at) - n, n, kind, value) for at, (_, (n, kind, value)) in zip(last, hits)]


def versioned(label: str, words: list[bytes], at: int) -> str:
    """A licence name's version: ``version 3``, ``v3``, ``either version 3 of the`` in the next few words."""
    if label not in ("agpl", "apache", "artistic", "cddl", "epl", "eupl", "gfdl", "gpl", "lgpl", "mpl", "odbl", "ofl"):
        return label
    near = [w.decode("utf-8", "replace") for w in words[at : at + 14]]
    for i, w in enumerate(near):
        number = w[1:] if w[0] == "v" and w[1:].isdigit() else near[i + 1] if w in ("version", "v") and i + 1 < len(near) else w if i == 0 else ""
        if number.isascii() and number.isdigit() and len(number) == 1:
            return f"{label}-{number}"
        if w in ("licensed", "under", "gnu", "apache"):
            break
    return label


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands, ``or``, ``and``, ``with``, parentheses to postfix order. What stands for nothing (an operator
    without both operands, empty or unclosed parentheses) is dropped."""
    clean: list[str] = []
    depth = 0
    for t in tokens:
        after = not clean or clean[-1] in PRECEDENCE or clean[-1] == "("  # an operand or ( may come
        if t == "(" and after:
            depth += 1
        elif t == ")":
            while clean and clean[-1] in PRECEDENCE:
                clean.pop()
            if not depth or clean[-1] == "(":
                if depth:
                    clean.pop()
                    depth -= 1
                continue
            depth -= 1
        elif t in PRECEDENCE:
            if after:
                continue
        elif t == "(" or not after:
            break
        clean.append(t)
    while clean and (clean[-1] in PRECEDENCE or clean[-1] == "("):
        depth -= clean.pop() == "("
    out, waiting = [], []
    for t in clean + [")"] * depth:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif t in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
        else:
            out.append(t)
    return out + waiting[::-1]


def burden(label: str) -> int:
    """An unknown licence asks for the most."""
    return LICENSES.get(label, LICENSES.get(label.rsplit("-", 1)[0], (5,)))[0]


def evaluated(rpn: list[str]) -> int | None:
    """What a postfix expression asks for."""
    held: list[int] = []
    for t in rpn:
        if t == "with":
            held.pop()
            held[-1] = max(min(held[-1], 1), held[-1] - 1)
        elif t in PRECEDENCE:
            b, a = held.pop(), held.pop()
            held.append(min(a, b) if t == "or" else max(a, b))
        else:
            held.append(0 if t.endswith("exception") or "-exception-" in t else burden(t))
    return held[0] if held else None


class Reader:
    """Statements of one text: operands by their first word, and what separates the words."""

    def __init__(self, raw: bytes, words: list[bytes], found: list[Found]):
        self.raw, self.words = raw, words
        self.operands: dict[int, Found] = {}
        for f in found:
            if f.kind in ("name", "id", "exception") and (f.start not in self.operands or f.length > self.operands[f.start].length):
                self.operands[f.start] = f
        self.places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]

    def gap(self, at: int) -> bytes:
        """What stands before word ``at``."""
        return self.raw[self.places[at - 1][1] if at else 0 : self.places[at][0] if at < len(self.places) else len(self.raw)]

    def suffix(self, at: int) -> int:
        """How many words from ``at`` on still belong to a name: version numbers, ``only``, ``or later``."""
        begin = at
        while at < len(self.words) and (self.words[at] in SUFFIX or self.words[at].isdigit() and len(self.words[at]) < 3):
            at += 1
        return at - begin + (2 if self.words[at : at + 2] in ([b"or", b"later"], [b"or", b"newer"]) else 0)

    def statement(self, at: int, tag: bool) -> tuple[list[str], int]:
        """Tokens from word ``at`` on, and the word after the last one."""
        tokens, end, first, skipped = [], at, True, 0
        while at < len(self.words):
            gap = self.gap(at)
            if (b"\n" in gap if tag else b"\n\n" in gap or b". " in gap) and not first:
                break
            first = False
            for c in gap:
                if c in b"()":
                    tokens.append(chr(c))
            word = self.words[at].decode("utf-8", "replace")
            f = self.operands.get(at)
            operand = not tokens or tokens[-1] in PRECEDENCE or tokens[-1] == "("
            if f and operand and (f.kind != "exception") == (not tokens or tokens[-1] != "with"):
                at += f.length
                label = versioned(f.value, self.words, at) if f.kind == "name" else f.value
                tokens.append(label)
                at += self.suffix(at)
                end, skipped = at, 0
                continue
            if word in PRECEDENCE and tokens and tokens[-1] not in PRECEDENCE and tokens[-1] != "(":
                tokens.append(word)
            elif not tag and word in FILLER and skipped < 6:
                skipped += 1
            else:
                break
            at += 1
        else:
            tokens += [chr(c) for c in self.gap(at) if c == 41]
            return tokens, end
        tokens += [chr(c) for c in self.gap(at) if c == 41] if at == end else []
        return tokens, end


def infix(rpn: list[str]) -> str:
    held: list[tuple[str, int]] = []
    for t in rpn:
        if t in PRECEDENCE:
            b, a = held.pop(), held.pop()
            sides = [x if level >= PRECEDENCE[t] else f"({x})" for x, level in (a, b)]
            held.append((f" {t.upper()} ".join(sides), PRECEDENCE[t]))
        else:
            held.append((t, 9))
    return held[0][0] if held else ""


def scan(text: str | None) -> dict:
    """Everything about one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(FOLD).split()
    found = matches((b" " + b" ".join(words) + b" ").decode("latin-1")) if words else []
    base = [f for f in found if f.kind == "base"]
    labels, evidence, expressions, asks = {f.value for f in base}, {f.kind for f in base}, [], []
    if any(f.kind in ("tag", "lead", "name", "grant") for f in found):
        reader, past = Reader(raw, words, found), 0
        for f in sorted(found):
            if f.kind == "grant":
                labels.add(f.value)
                evidence.add("grant")
                asks.append(burden(f.value))
            elif f.kind in ("tag", "lead") and f.start >= past:
                tokens, end = reader.statement(f.start + f.length, f.kind == "tag")
                rpn = postfix(tokens)
                if rpn:
                    past = max(past, end)
                    labels |= {t for t in rpn if t not in PRECEDENCE and "exception" not in t}
                    evidence.add("tag" if f.kind == "tag" else "notice")
                    expressions.append(infix(rpn))
                    asks.append(evaluated(rpn))
        for at, f in reader.operands.items():
            if f.kind == "name" and f.value != "bsd":
                labels.add(versioned(f.value, words, at + f.length))
                evidence.add("name")
    asks += [burden(f.value) for f in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((f.start for f in base), default=None),
        "last_word": max((f.start for f in base), default=None),
        "base_labels": ",".join(sorted({f.value for f in base})),
        "labels": ",".join(sorted(labels)),
        "score": round(1 - prod(1 - WEIGHTS[k] for k in sorted(evidence)), 6) if evidence else 0.0,
        "burden": max(asks, default=None),
        "expressions": sorted(set(expressions)),
    }


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, burden int, expressions array<string>"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int32(), pa.list_(pa.string())]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _scanned(batches):
    for batch in batches:
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id")] + [pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES[1:], _TYPES[1:])]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
        released()


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: words, base places and labels, all labels, score, burden and expressions."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_scanned, RESULT)
