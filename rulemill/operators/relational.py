"""Joins, ranking and set operators that the built-in verbs don't spell out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_ilike


def expand_terms(terms: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """A query's terms with their canonical phrase's aliases; only phrases (aliases of more than one word) are added."""
    out = []
    for t in terms:
        canon = next((c for c, al in aliases.items() if t.lower() == c or t.lower() in al), None)
        out += [t, *[a for a in ([canon, *aliases[canon]] if canon else []) if a != t.lower() and " " in a]]
    return list(dict.fromkeys(out))


def any_term(columns: list[str], terms: list[str]) -> Column:
    """OR over columns and terms; terms are literals, case is ignored."""
    return reduce(or_, [literal_ilike(F.col(c), t) for c in columns for t in terms])


def search(rows: DataFrame, columns: list[str], terms: list[str], where: Column | None, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the matching rows; an offset at or beyond the total gives the first page."""
    found = rows.where(any_term(columns, terms))
    if where is not None:
        found = found.where(where)
    if offset:
        total = found.count()
        offset = offset if offset < total else 0
    return found.orderBy(*order).offset(offset).limit(limit)


def anti(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner; a null key never has one and stays."""
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def with_fallback(main: DataFrame, fallback: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``main`` and those fallback rows whose key it lacks, marked in ``origin``; missing columns are null."""
    rest = anti(fallback, main, keys).withColumn("origin", F.lit(label))
    return main.withColumn("origin", F.lit("main")).unionByName(rest, allowMissingColumns=True)


def best_of(rows: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def range_join(points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points within [lo, hi] as an equi-join on buckets of ``width``: a range goes to every bucket that it touches."""
    p = points.withColumn("_b", F.floor(F.col(value) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "_b").where((F.col(value) >= F.col(lo)) & (F.col(value) <= F.col(hi))).drop("_b")


def interval_pairs(rows: DataFrame, key: str, group: str, lo: str, hi: str, ident: str) -> DataFrame:
    """Pairs of one group and different ``group`` values whose intervals meet; a null bound is open. The comparisons are
    in the join condition, so that only pairs that meet become rows."""
    a, b = rows.alias("a"), rows.alias("b")
    low = F.greatest(F.coalesce(F.col(f"a.{lo}"), F.lit(float("-inf"))), F.coalesce(F.col(f"b.{lo}"), F.lit(float("-inf"))))
    high = F.least(F.coalesce(F.col(f"a.{hi}"), F.lit(float("inf"))), F.coalesce(F.col(f"b.{hi}"), F.lit(float("inf"))))
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & (F.col(f"a.{group}") != F.col(f"b.{group}")) & (low <= high)
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col(f"a.{ident}").alias("left_id"), F.col(f"b.{ident}").alias("right_id"))


def unordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).dropDuplicates([a, b])


def priority_lookup(rows: DataFrame, catalogue: DataFrame, key: str, ident: str) -> DataFrame:
    """Each row's catalogue entry: the same key, else the longest key that is a prefix by segments, else none. Ties go to
    the least id. Prefixes are equi-joined on the row's own ancestors."""
    from ..functions.paths import ancestors

    r = rows.select("*", F.posexplode(ancestors(F.col(key))).alias("_pos", "_anc"))
    entries = catalogue.groupBy(F.col(key).alias("_anc")).agg(F.min(ident).alias("entry"))
    found = r.join(entries, "_anc", "left")
    best = found.groupBy(*rows.columns).agg(F.max_by("entry", F.when(F.col("entry").isNotNull(), F.col("_pos"))).alias("entry"))
    return best


def budgeted(rows: DataFrame, group: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in order while the budget lasts; the first that overflows is kept with what is left of it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(tokens).over(w), F.lit(0))
    return rows.withColumn("given", F.least(F.col(tokens), F.lit(budget) - used)).where("given > 0")


def quotas(rows: DataFrame, priority: str, order: list[Column], shares: dict[int, float], total: int) -> DataFrame:
    """At most a priority's share of ``total`` rows, in order."""
    limit = F.create_map(*[v for k, s in shares.items() for v in (F.lit(k), F.lit(int(total * s)))])[F.col(priority)]
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(priority).orderBy(*order)))
    return ranked.where(F.col("place") <= F.coalesce(limit, F.lit(0)))
