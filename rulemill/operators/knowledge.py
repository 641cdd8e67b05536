"""What documents say beyond their keywords: definitions, cross references, conditions and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, keyword_pattern, normalised
from ..functions.vectors import normalised as unit
from .storage import cut

#: Comparisons that a condition may state, in order of precedence: what a clause matches, its operator, and the operator of
#: its opposite. The first group is the field, the second (if any) the value.
COMPARISONS = (
    (r"^(.+?) (?:is|are) (?:not present|absent|missing)$", "ABSENT", "EXISTS"),
    (r"^(.+?) (?:is|are) (?:present|included|given)$", "EXISTS", "ABSENT"),
    (r"^(.+?) (?:is|are) at least (.+)$", ">=", "<"),
    (r"^(.+?) (?:is|are) at most (.+)$", "<=", ">"),
    (r"^(.+?) (?:exceeds?|(?:is|are) (?:greater|more|longer|larger) than) (.+)$", ">", "<="),
    (r"^(.+?) (?:is|are) (?:less|fewer|shorter|smaller) than (.+)$", "<", ">="),
    (r"^(.+?) (?:contains?|includes?) (.+)$", "CONTAINS", "LACKS"),
    (r"^(.+?) (?:is|are) not (?:equal to )?(.+)$", "!=", "=="),
    (r"^(.+?) ?(?:equals?|= ?|(?:is|are)(?: equal to)?) ?(.+)$", "==", "!="),
)
LIST_ITEM = r"^\s*(?:[•*–-]|\d+[.)]|\([a-z]\)|[a-z]\))\s+(.*)$"


def binding_kinds(text: Column, wording: dict[str, str]) -> Column:
    """Kinds of wording in a sentence that binds without a keyword; a sentence with a keyword has none. ``wording``: a
    regular expression over normalised text for each kind, in the order of the result; what binds in a corpus is an input."""
    plain = normalised(text)
    none = F.array().cast("array<string>")
    if not wording:
        return none
    found = F.array(*[F.when(plain.rlike(w), F.lit(kind)) for kind, w in wording.items()])
    return F.when(text.rlike(keyword_pattern(KEYWORDS)), none).otherwise(F.coalesce(F.array_compact(found), none))


def conditions_of(text: Column) -> Column:
    """Conditions that a sentence states after if, when, where or unless: {field, operator, value}; all hold together. A
    clause ends at a comma, semicolon or full stop before white space; its parts are joined by ``and``; ``unless`` states
    the opposite. A part that compares nothing is left out."""
    plain = F.regexp_replace(normalised(text), r"[.;,]+(?=\s|$)", "|")
    heads = F.regexp_extract_all(plain, F.lit(r"\b(if|when|where|unless)\b ?([^|]*)"), F.lit(1))
    clauses = F.regexp_extract_all(plain, F.lit(r"\b(if|when|where|unless)\b ?([^|]*)"), F.lit(2))
    parts = F.flatten(F.zip_with(heads, clauses, lambda h, c: F.transform(F.split(c, r" and "), lambda p: F.struct((h == "unless").alias("opposite"), F.regexp_replace(F.trim(p), r"^(?:(?:if|when|the|a|an|any|its|this) )+", "").alias("says")))))

    def read(part):
        out = F.lit(None)
        for pattern, operator, opposite in reversed(COMPARISONS):
            says = part["says"]
            value = F.regexp_extract(says, pattern, 2) if pattern.count("(") - pattern.count("(?:") > 1 else F.lit(None).cast("string")
            one = F.struct(F.regexp_extract(says, pattern, 1).alias("field"), F.when(part["opposite"], opposite).otherwise(operator).alias("operator"), value.alias("value"))
            out = F.when(says.rlike(pattern), one).otherwise(out)
        return out

    return F.array_compact(F.transform(parts, read))


def list_items(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, preamble (what stands before the first item), item number and item, for texts with two items or more."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("i"), s.alias("line"), F.regexp_extract(s, LIST_ITEM, 1).alias("item")))
    d = rows.select(*keys, lines.alias("lines")).withColumn("items", F.filter("lines", lambda x: x["item"] != "")).where(F.size("items") > 1)
    before = F.filter("lines", lambda x: x["i"] < F.col("items")[0]["i"])
    d = d.withColumn("preamble", F.trim(F.array_join(F.transform(before, lambda x: F.trim(x["line"])), " ")))
    return d.select(*keys, "preamble", F.posexplode(F.transform("items", lambda x: F.trim(x["item"]))).alias("item_number", "item"))


def definition_lookup(terms: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """term -> the definition of the source with the highest priority (ties by id), by the term itself or what it is an alias of.
    terms: term; definitions: id, term, source, priority, text; aliases: alias, term."""
    of = aliases.select(normalised(F.col("alias")).alias("key"), normalised(F.col("term")).alias("target")).dropDuplicates(["key"])
    asked = terms.select("term").distinct().withColumn("key", normalised(F.col("term"))).join(of, "key", "left")
    known = definitions.select(normalised(F.col("term")).alias("target"), F.struct(F.col("priority"), (-F.col("id")).alias("last"), "source", "text").alias("d")).groupBy("target").agg(F.max("d").alias("d"))
    return asked.withColumn("target", F.coalesce("target", "key")).join(known, "target").select("term", (-F.col("d.last")).alias("definition_id"), "d.source", "d.text")


def cross_references(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, dst): sections that use a term and the section that defines it. sections: id, text; terms: term, section. A section's
    runs of words, as long as some term, are looked up whole among the terms, so that no word that many terms share brings
    sections and terms together, and the texts themselves are not sent."""
    t = cut(terms.select(normalised(F.col("term")).alias("term"), F.col("section").alias("dst")).where("term <> ''").distinct())  # its true size decides the join
    lengths = sorted(r.n for r in t.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    s = sections.where("text is not null").select(F.col("id").alias("src"), words.alias("words"))

    def runs(n):
        at = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
        return F.when(F.size("words") >= n, F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return s.join(t.where("false"), F.lit(True)).select("src", "dst")
    used = s.select("src", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("term"))
    return used.join(t, "term").where("src <> dst").select("src", "dst").distinct()


def group_similarity(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, mean of the cosines of all pairs of its members. No pair is made: the squared length of the sum of unit
    vectors holds all cosines, n of them of a member with itself."""
    u = rows.select(group, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    sums = u.groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return total.select(group, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))


def consistency(rows: DataFrame, key: list[str], match: str) -> DataFrame:
    """Share of rows of a key whose ``match`` holds; a null counts as none."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(match), F.lit(False)).cast("int")).alias("rate"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)

