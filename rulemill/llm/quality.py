"""Quality rules: one threshold table, compiled into one projection. No user functions.

Nulls: a null text counts as empty (no words, every ratio 0, base_failed). Texts without words fail the base rule.
Repeated rows are judged each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, words_of


@dataclass(frozen=True)
class Rule:
    """Pass if ``low <= metric <= high``; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The rules' thresholds.
RULES = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbols_per_word", high=0.3),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.5),
    Rule("ellipsis_line_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
    Rule("alpha_word_share", low=0.6),
)

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les et à des un une du est dans en que pour qui sur pas au plus par ce il avec se sont ou mais "
    "el los las y del al se que una por con para como su lo más o pero sus"
).split()

SYMBOLS = "#*$%&|<>"


def _size(col):
    return F.size(col).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics. Each step is a projection; nothing is shuffled."""
    t = text_or_empty(text)
    d = docs.withColumn("_t", t).withColumn("_w", words_of(F.col("_t")))
    d = d.withColumn("n_words", _size("_w"))
    # windows of three words as (fingerprint, position), sorted: equal windows become neighbours
    wins = F.when(
        F.col("n_words") >= 3,
        F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))),
                lambda i: F.struct(
                    F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")
                ),
            )
        ),
    )
    d = d.withColumn("_s", wins)
    found = F.filter(
        "_s",
        lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]),
    )
    d = d.withColumn("_p", F.sort_array(F.transform(found, lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    filled = F.filter(F.split("_t", "\n"), lambda s: F.length(F.translate(s, " \t\x0b\x0c\r", "")) > 0)
    d = d.withColumn("_l", filled).withColumn("n_lines", _size("_l"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    letters = F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}")))
    edge = F.transform("_w", lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    stops = F.size(F.filter(edge, lambda w: w.isin(*dict.fromkeys(STOP_WORDS))))
    w1, l1 = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return d.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / w1,
            "symbols_per_word": F.col("n_symbols") / w1,
            "stop_word_share": stops / w1,
            "alpha_word_share": letters / w1,
            "dup_line_share": F.col("n_dup_lines") / l1,
            "ellipsis_line_share": F.size(F.filter("_l", lambda s: s.rlike(r"(\.\.\.|…)\s*$"))) / l1,
            "bullet_line_share": F.size(F.filter("_l", lambda s: s.rlike(r"^\s*[-•*]\s"))) / l1,
        }
    ).drop("_t", "_w", "_s", "_p", "_l")


def verdict(rules=RULES):
    """The rule table as one boolean column."""
    ok = F.lit(True)
    for r in rules:
        c = F.col(r.metric)
        if r.low is not None:
            ok = ok & (c >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (c <= F.lit(r.high))
    return ok


def failed_rules(rules=RULES):
    """Names of the rules that a row breaks."""
    parts = []
    for r in rules:
        c = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (c < F.lit(r.low))
        if r.high is not None:
            bad = bad | (c > F.lit(r.high))
        parts.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*parts))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, metrics, base_failed, kept and the names of broken rules."""
    d = measured(docs.select("doc_id", "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", base).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~base & verdict(rules)).alias("kept"),
        failed_rules(rules).alias("broken"),
    )
