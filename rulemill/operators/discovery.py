"""Documents to sections, sentences and assertions; duplicates among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, canonical_keyword, keyword_pattern, keywords_in, normalised, sentences_of
from .stars import greedy_stars

#: Headings of Markdown, numbered and plain-text documents.
HEADING = r"^(?:#{1,6}\s+)?(?:(?:Section\s+)?([0-9]+(?:\.[0-9]+)*)\.?\s+|#{1,6}\s+)(\S.*)$"
REPEAT_WITHIN = 10


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = HEADING) -> DataFrame:
    """(key, section_no, section_id, title, text): lines under the last heading; lines before any have section 0. A mark is set
    before each heading and the joined lines are split at the marks (the control character U+0001 is dropped from texts), so
    nothing is shuffled and a text is read once."""
    lines = F.split(F.translate(F.col(text), "\x01", ""), "\n")
    marked = F.array_join(F.transform(lines, lambda s: F.when(s.rlike(heading), F.concat(F.lit("\x01"), s)).otherwise(F.concat(F.lit("\n"), s))), "")

    def section(part, i):
        head = F.when(i == 0, "").otherwise(F.substring_index(part, "\n", 1))
        body = F.substr(part, F.length(head) + 2)
        return F.struct(F.regexp_extract(head, heading, 1).alias("id"), F.trim(F.regexp_extract(head, heading, 2)).alias("title"), F.trim(body).alias("text"))

    return docs.select(key, F.posexplode(F.transform(F.split(marked, "\x01"), section)).alias("section_no", "s")).select(key, "section_no", F.col("s.id").alias("section_id"), F.col("s.title").alias("title"), F.col("s.text").alias("text"))


def sentences(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return rows.select(*keys, F.posexplode(sentences_of(F.col(text))).alias("sentence_index", "sentence"))


def assertions(rows: DataFrame, keys: list[str], sentence: str = "sentence", keywords=KEYWORDS, any_case: bool = False) -> DataFrame:
    """One row for each keyword of a sentence."""
    hit = rows.where(F.col(sentence).rlike(keyword_pattern(keywords, any_case)))
    out = hit.select(*keys, sentence, F.posexplode(keywords_in(F.col(sentence), keywords, any_case)).alias("keyword_index", "keyword"))
    return out.withColumn("canonical", canonical_keyword(F.col("keyword")))


def noise_flag(rows: DataFrame, text: str = "text", least: int = 15) -> DataFrame:
    """Flags rows that are too short, have no letters, or look like a table of contents; no row is dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumn("is_noise", (F.length(t) < least) | ~t.rlike(r"\p{L}") | t.rlike(r"\.{4,}\s*\d+\s*$"))


def context(rows: DataFrame, doc: str, index: str, text: str, width: int = 3) -> DataFrame:
    """Adds the sentences up to ``width`` before and after, the sentence itself included."""
    w = Window.partitionBy(doc).orderBy(index).rowsBetween(-width, width)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def continued(rows: DataFrame, doc: str, index: str, scope: str) -> DataFrame:
    """The last scope that was named before or at a sentence."""
    return rows.withColumn("scope_now", F.last(scope, ignorenulls=True).over(Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)))


def positional_dedupe(rows: DataFrame, doc: str, index: str, text: str, within: int = REPEAT_WITHIN) -> DataFrame:
    """Drops a repeat of a normalised text within ``within`` sentences of its last kept occurrence; a dropped one does
    not move that place. One fold over the sorted places of a text in its document."""
    r = rows.withColumn("_n", normalised(F.col(text)))
    places = r.groupBy(doc, "_n").agg(F.array_sort(F.collect_list(index)).alias("_p"))
    kind = dict(rows.dtypes)[index]
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    def step(acc, i):
        keep = acc["last"].isNull() | (i - acc["last"] > within)
        return F.struct(F.when(keep, i).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"))
    kept = places.select(doc, F.explode(F.aggregate("_p", start, step, lambda a: a["kept"])).alias(index))
    return rows.join(kept.distinct(), [doc, index], "left_semi")


def hash_key(*columns) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def deduped(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    """The row with the least id of each composite hash; only ids and hashes are grouped."""
    h = rows.withColumn("hash", hash_key(*key))
    first = h.groupBy("hash").agg(F.min(ident).alias(ident))
    return h.join(first, ["hash", ident], "left_semi")


def fuzzy_merge(rows: DataFrame, block: list[str], ident: str, text: str, least: float = 0.85) -> DataFrame:
    """(id, star): rows of one block whose texts are alike, greedily in order of id: a row joins the first star whose
    centre it resembles, else becomes one. Blocks share subject, obligation, predicate and references."""
    return greedy_stars(rows, block, ident, text, least).withColumnRenamed(ident, "id")


def merged(rows: DataFrame, stars: DataFrame, ident: str, confidence: str, lists: list[str]) -> DataFrame:
    """One row a star: the row of the highest confidence (least id on ties) with the union of the list columns."""
    j = rows.join(stars.withColumnRenamed("id", ident), ident)
    best = F.struct(F.col(confidence).alias("c"), (-F.col(ident)).alias("i"))
    aggs = [F.max_by(ident, best).alias(ident), F.max(confidence).alias(confidence)] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return j.groupBy("star").agg(*aggs)


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.5) -> DataFrame:
    """Headers and footers: first and last lines that stand on at least a share of a document's pages."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda s: F.trim(s) != "")
    p = pages.withColumn("_l", lines)
    ends = p.where(F.size("_l") > 0).select(doc, page, F.explode(F.array_distinct(F.array(F.element_at("_l", 1), F.element_at("_l", -1)))).alias("line"))
    n = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    found = ends.groupBy(doc, F.regexp_replace("line", r"\d+", "#").alias("line")).agg(F.count_distinct(page).alias("n"))
    return found.join(n, doc).where((F.col("n") >= share * F.col("pages")) & (F.col("n") > 1)).select(doc, "line", "n", "pages")


def table_markdown(rows: Column) -> Column:
    """array<array<string>> -> a Markdown table."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit(""))), " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")
