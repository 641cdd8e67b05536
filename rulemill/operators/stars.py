"""Greedy stars: in order of id, a row joins the first earlier centre of its block that it is alike, else becomes a centre.

Sequential by definition, yet run in rounds. Each round takes the first ``BATCH`` undecided rows of every block; all earlier
rows are decided, so the batch alone decides who of it is a centre (one bounded task a block). The round's centres then meet
the undecided rest of their blocks, dealt to pieces of bounded size: a row that is alike one joins the least of them, and as
later centres come later in order that is final. Rows of one block never come together in one task, pairs are never rows,
and equal values are decided once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised
from .storage import cut

BATCH, PIECE = 512, 8192
GRAM = 3


class Ratio:
    """2 * matched characters / characters of both, by longest matching blocks. Of three characters in a row that are matched,
    blocks keep all but two at each end, which bounds the ratio from the shared trigrams."""

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least = texts, least
        self.size = np.array([len(t) for t in texts], np.int64)
        self.grams = [self._grams(t) for t in texts]

    @staticmethod
    def _grams(t: str) -> np.ndarray:
        """Sorted trigrams, a repeated one told apart by its number."""
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(c) < GRAM:
            return np.zeros(0, np.uint64)
        g = np.sort((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(first)
        return np.sort(g ^ ((np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def near(self, other: Ratio, i: int) -> np.ndarray:
        """Rows of self that may be alike row i of ``other``."""
        both = self.size + other.size[i]
        return np.flatnonzero(2 * np.minimum(self.size, other.size[i]) >= self.least * both - 1e-9)

    def alike(self, j: int, other: Ratio, i: int) -> bool:
        both = int(self.size[j] + other.size[i])
        if not both:
            return True
        shared = len(np.intersect1d(self.grams[j], other.grams[i], assume_unique=True))
        if 2 * (shared + 2 * both + 2) < 5 * self.least * both - 1e-9:
            return False
        m = SequenceMatcher(None, other.texts[i], self.texts[j])
        return m.quick_ratio() >= self.least and m.ratio() >= self.least


class Words:
    """Jaccard of word sets above ``least``; a row without words is alike none. Rows of each word are listed once, and a row counts what
    others share with it from the lists of its own words; nobody is compared one by one."""

    def __init__(self, texts: list[str], least: float):
        self.sets, self.least = [frozenset(t.split()) for t in texts], least
        self.size = np.array([len(s) for s in self.sets], np.int64)
        number: dict[str, int] = {}
        words = np.array([number.setdefault(w, len(number)) for s in self.sets for w in s], np.int64)
        order = np.argsort(words, kind="stable")
        self.rows = np.repeat(np.arange(len(self.sets)), self.size)[order]
        self.ends, self.number = np.append(0, np.cumsum(np.bincount(words, minlength=len(number)))), number

    def near(self, other: Words, i: int) -> np.ndarray:
        """Exactly the rows of self that are alike row i of ``other``."""
        lists = [self.rows[self.ends[k] : self.ends[k + 1]] for w in other.sets[i] if (k := self.number.get(w)) is not None]
        if not lists:
            return np.zeros(0, np.int64)
        shared = np.bincount(np.concatenate(lists), minlength=len(self.size))
        return np.flatnonzero(shared > np.maximum(0, self.least * (self.size + other.size[i] - shared)))

    def alike(self, j: int, other: Words, i: int) -> bool:
        return True


class Contains:
    """One text holds the other; ``least`` is of no account."""

    def __init__(self, texts: list[str], least: float):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)

    def near(self, other: Contains, i: int) -> np.ndarray:
        return np.flatnonzero(self.size > 0)

    def alike(self, j: int, other: Contains, i: int) -> bool:
        a, b = self.texts[j], other.texts[i]
        return a in b or b in a


MEASURES = {"ratio": Ratio, "words": Words, "contains": Contains}


def _batch(measure: str, least: float):
    """Sequential within one batch of a block: the star of each row, its own id for a centre."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ord")
        m = MEASURES[measure](rows.column("text").to_pylist(), least)
        star = np.full(rows.num_rows, -1)
        for i in range(rows.num_rows):
            if star[i] < 0:
                star[i] = i
                for j in m.near(m, i):
                    if j > i and star[j] < 0 and m.alike(j, m, i):
                        star[j] = i
        return pa.table({"block": rows.column("block"), "ord": rows.column("ord"), "text": rows.column("text"), "star": rows.column("ord").take(pa.array(star))})

    return run


def _against(measure: str, least: float):
    """One piece of a block's undecided rows against the round's centres, in their order."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        star = [None] * rows.num_rows
        if rows.num_rows and centres.num_rows:
            centres = centres.sort_by("ord")
            m, c = (MEASURES[measure](t.column("text").to_pylist(), least) for t in (rows, centres))
            ids, free = centres.column("ord").to_pylist(), np.ones(rows.num_rows, bool)
            for i, own in enumerate(ids):
                near = m.near(c, i)
                for j in near[free[near]]:
                    if m.alike(j, c, i):
                        star[j], free[j] = own, False
        return pa.table({"block": rows.column("block"), "ord": rows.column("ord"), "text": rows.column("text"), "star": pa.array(star, rows.schema.field("ord").type)})

    return run


def greedy_stars(rows: DataFrame, block: list[str], ident: str, text: str, least: float, measure: str = "ratio") -> DataFrame:
    """(ident, star) of every row: the id of the centre it joined, its own for a centre. Order is that of ident, unique and not
    null. ``measure``: ``ratio`` (at least ``least``; texts compared in lower case, trimmed; an empty or null text is alike
    none, itself excepted), ``words`` (above ``least``) or ``contains`` (as written). Rows with nulls in equal block columns share a block."""
    key = F.to_json(F.struct(*block), {"ignoreNullFields": "false"}) if block else F.lit("")
    forms = {"ratio": F.trim(F.lower(F.col(text))), "words": normalised(F.col(text)), "contains": F.col(text)}
    plain = F.coalesce(forms[measure], F.lit(""))
    named = rows.select(key.alias("block"), F.col(ident).alias("ord"), plain.alias("text"))
    kind = rows.schema[ident].dataType.simpleString()
    # rows of one block with equal texts are one: the first stands for all; rows without a text stand for themselves
    named = cut(named.withColumn("alone", F.when(F.col("text") == "", F.col("ord"))))
    lead = named.groupBy("block", "text", "alone").agg(F.min("ord").alias("ord"))
    todo = cut(lead.where("text <> ''").select("block", "ord", "text"))
    schema = f"block string, ord {kind}, text string, star {kind}"
    done = []
    while True:
        sizes = todo.groupBy("block").count().where("count > 1")  # a row alone in its block needs no look
        pieces = sizes.select("block", F.ceil(F.greatest(F.col("count") - BATCH, F.lit(1)) / PIECE).cast("int").alias("pieces"), (F.col("count") > BATCH).alias("more"))
        place = F.row_number().over(Window.partitionBy("block").orderBy("ord"))
        first = todo.withColumn("place", place).where(F.col("place") <= BATCH).join(pieces, "block").select("block", "ord", "text")
        settled = cut(first.groupBy("block").applyInArrow(_batch(measure, least), schema))
        done.append(settled.select("ord", "star"))
        more = cut(pieces.where("more"))
        if not more.head(1):
            break
        centres = settled.where("ord = star").select("block", "ord", "text").join(more, "block")
        centres = centres.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("block", "piece", "ord", "text")
        rest = todo.join(more, "block").join(settled.select("ord"), "ord", "left_anti")
        rest = rest.withColumn("piece", F.pmod(F.xxhash64("ord"), F.col("pieces")).cast("int")).select("block", "piece", "ord", "text")
        met = cut(rest.groupBy("block", "piece").cogroup(centres.groupBy("block", "piece")).applyInArrow(_against(measure, least), schema))
        done.append(met.where("star is not null").select("ord", "star"))
        todo = met.where("star is null").select("block", "ord", "text")
    stars = done[0]
    for d in done[1:]:
        stars = stars.unionAll(d)
    of_text = lead.join(stars, "ord", "left").select("block", "text", "alone", F.coalesce("star", "ord").alias("star"))
    same = [named[c].eqNullSafe(of_text[c]) for c in ("block", "text", "alone")]
    return named.join(of_text, same).select(named["ord"].alias(ident), of_text["star"].alias("star"))
