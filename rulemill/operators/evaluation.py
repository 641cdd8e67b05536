"""Triage of findings, agreement statistics, votes, coverage verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVER_STRICT = 0.30
#: Verdicts of coverage, best first.
COVERAGE_RANK = {"full": 3, "partial": 2, "none": 1}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, None).otherwise(a / b)


def agreement(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """Confusion matrix, accuracy, Cohen's kappa, precision, recall and F1, in one aggregate. Nulls are left out."""
    t, s = F.col(truth) == 1, F.col(said) == 1
    m = rows.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).agg(
        F.count_if(t & s).alias("tp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & s).alias("fp"), F.count_if(~t & ~s).alias("tn")
    )
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    po = (tp + tn) / n
    pe = ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return m.select("tp", "fn", "fp", "tn", po.alias("agreement"), ratio(po - pe, 1 - pe).alias("kappa"), precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def firing(statuses: DataFrame, lint: str = "lint", status: str = "status") -> DataFrame:
    """Per lint: how often it fires, how often it applies, the share, and whether it looks over-strict."""
    s = F.col(status)
    out = statuses.groupBy(lint).agg(F.count_if(s.isin("error", "warn", "fatal")).alias("fires"), F.count_if(s != "NA").alias("applies"))
    share = ratio(F.col("fires").cast("double"), F.col("applies"))
    return out.withColumn("error_frac", share).withColumn("suspect", F.coalesce(share >= OVER_STRICT, F.lit(False)))


def firing_histogram(rates: DataFrame, width: float = 0.1) -> DataFrame:
    """(bucket, lints, suspects): how many lints fire in a share of the records to which they apply, from bucket * width on; the
    last bucket holds its upper bound. Lints that apply to none are in bucket -1. rates: see ``firing``."""
    last = round(1 / width) - 1
    bucket = F.when(F.col("error_frac").isNull(), -1).otherwise(F.least(F.floor(F.col("error_frac") / width + 1e-9), F.lit(last))).cast("int")
    return rates.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("lints"), F.count_if("suspect").alias("suspects"))


def triaged(findings: DataFrame, lints: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """REAL where another linter agrees, SPURIOUS where the lint is suspect and none does, else UNCERTAIN. findings: cert, lint."""
    out = findings.join(lints.select("lint", "suspect"), "lint", "left")
    if upstream is not None:
        out = out.join(upstream.select("cert", "lint", F.lit(True).alias("agreed")).distinct(), ["cert", "lint"], "left")
    else:
        out = out.withColumn("agreed", F.lit(False))
    verdict = F.when(F.coalesce("agreed", F.lit(False)), "REAL").when(F.coalesce("suspect", F.lit(False)), "SPURIOUS").otherwise("UNCERTAIN")
    return out.withColumn("verdict", verdict).drop("agreed", "suspect")


def verdict_table(verdicts: DataFrame) -> DataFrame:
    """One row a lint with a column for each verdict, zero where it has none."""
    names = ["REAL", "SPURIOUS", "UNCERTAIN"]
    return verdicts.groupBy("lint").pivot("verdict", names).count().fillna(0, names)


def blamed(lints: DataFrame) -> DataFrame:
    """The stage that is to blame for a suspect lint, from its rule's record: rule_text, subject, obligation, precondition, error_frac."""
    text, subject = F.lower(F.coalesce("rule_text", F.lit(""))), F.coalesce("subject", F.lit(""))
    stage = (
        F.when(F.col("rule_text").isNull() | (F.length(text) < 15), "extraction")
        .when(subject == "", "subject")
        .when(F.col("precondition").isNull() & text.rlike(r"\b(if|when|unless|where|only)\b"), "precondition")
        .when(F.col("obligation").isin("SHOULD", "MAY"), "severity")
        .otherwise("predicate")
    )
    return lints.withColumn("blame_stage", stage)


def majority(votes: DataFrame, key: list[str], vote: str) -> DataFrame:
    """Yes only with more than half of the votes; a tie is no."""
    yes = F.count_if(F.col(vote))
    return votes.groupBy(*key).agg(yes.alias("yes"), F.count(vote).alias("votes")).withColumn("verdict", F.col("yes") * 2 > F.col("votes"))


def best_coverage(rows: DataFrame, key: list[str], verdict: str = "verdict") -> DataFrame:
    """full before partial before none, over all batches."""
    rank = F.create_map(*[x for k, v in COVERAGE_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col(verdict)]
    return rows.groupBy(*key).agg(F.max_by(F.col(verdict), rank).alias(verdict))


def never_upgraded(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The later verdict unless it is better than the former: consistency checks may only take coverage away."""
    rank = lambda c: F.create_map(*[x for k, v in COVERAGE_RANK.items() for x in (F.lit(k), F.lit(v))])[c]
    j = before.select(*key, F.col("verdict").alias("_b")).join(after.select(*key, F.col("verdict").alias("_a")), key, "left")
    return j.select(*key, F.when(F.col("_a").isNull() | (rank(F.col("_a")) > rank(F.col("_b"))), F.col("_b")).otherwise(F.col("_a")).alias("verdict"))


def conserved(rows: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Whether a total is the sum of its parts, row by row."""
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return rows.withColumn("conserved", F.col(total) == s)


def candidate_decision(rows: DataFrame) -> DataFrame:
    """auto, manual or rejected for a proposed pattern, by support and precision."""
    d = F.when((F.col("support") >= 10) & (F.col("precision") >= 0.95), "auto").when((F.col("support") >= 3) & (F.col("precision") >= 0.7), "manual").otherwise("rejected")
    return rows.withColumn("decision", d)
