"""Sentences of texts with tables, lists and formal definitions in them.

Lines are classed, and a line's class says whether it begins a block: an item, the first row of a table, a definition, or
plain text after a blank line or a table begin one; any other line goes on with what is open. As a line either sets the state or
leaves it, what stands before a line matters through its nearest neighbour alone, and a text is cut in one pass: every line
gets a mark for where a block begins, the lines are joined and split at the marks. All of it is built-in functions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\r\f\x0B]"
#: What begins an item of a list: a bullet, a number or a letter with a point or bracket.
ITEM = rf"^{SPACE}*(?:[*+•–-]|\(?[0-9]{{1,3}}[.)]|\(?[a-z]\)|\(?[ivx]+\)){SPACE}+[^ ]"
ROW = rf"^{SPACE}*\|.*\|{SPACE}*$"
RULE = r"^[ \t|:-]*-[ \t|:-]*$"
DEFINITION = r"::="
#: Abbreviations after which a sentence goes on (without their last point).
ABBREVIATIONS = ("e.g", "i.e", "cf", "vs", "No", "Sec", "Fig")
MARK, HELD, PIPE = "\x01", "\x02", "\x03"


def line_class(line: Column) -> Column:
    """b blank, r table row, i item, d definition, p plain."""
    return F.when(F.trim(F.translate(line, "\t\r\f\x0b", "    ")) == "", "b").when(line.rlike(ROW), "r").when(line.rlike(ITEM), "i").when(line.rlike(DEFINITION), "d").otherwise("p")


def blocks_of(text: Column) -> Column:
    """array<string>: blocks in order, the class of each as its first character, then its lines."""
    lines = F.split(F.translate(text, MARK + HELD + PIPE, "   "), "\n")
    classed = F.transform(lines, lambda s: F.struct(line_class(s).alias("c"), s.alias("s")))

    def marked(rows):
        def one(row, i):
            before = F.when(i == 0, "b").otherwise(F.get(rows, i - 1)["c"])
            begins = F.when(row["c"] == "p", before.isin("b", "r")).when(row["c"] == "r", before != "r").otherwise(True)
            return F.when(begins, F.concat(F.lit(MARK), row["c"], row["s"])).otherwise(F.concat(F.lit("\n"), row["s"]))

        return F.array_join(F.transform(rows, one), "")

    # the array of classes is named once; a lambda variable stands for it
    joined = F.transform(F.array(classed), marked)[0]
    return F.filter(F.split(joined, MARK), lambda b: (b != "") & (F.left(b, F.lit(1)) != "b"))


def prose_sentences(text: Column) -> Column:
    """Split after . ! ? and white space, but not after an abbreviation nor before and, or, but."""
    plain = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))
    held = F.regexp_replace(plain, r"\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\. ", "$1." + HELD)
    held = F.regexp_replace(held, r"([.!?]) (and|or|but)\b", "$1" + HELD + "$2")
    return F.filter(F.transform(F.split(F.regexp_replace(held, "([.!?]) ", "$1" + MARK), MARK), lambda s: F.trim(F.replace(s, F.lit(HELD), F.lit(" ")))), lambda s: s != "")


def cells_of(row: Column) -> Column:
    inner = F.regexp_replace(F.replace(F.trim(F.translate(row, "\t\r\f\x0b", "    ")), F.lit("\\|"), F.lit(PIPE)), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.replace(c, F.lit(PIPE), F.lit("|"))))


def row_sentences(table: Column) -> Column:
    """One sentence a row, whole: ``head: cell; head: cell`` where a rule follows the first row, else the cells. Empty cells and
    rows are left out."""
    rows = F.split(table, "\n")
    headed = F.coalesce(F.get(rows, F.lit(1)).rlike(RULE), F.lit(False))
    head = F.when(headed, cells_of(F.get(rows, F.lit(0))))
    body = F.when(headed, F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0)))).otherwise(rows)

    def one(row):
        named = F.transform(cells_of(row), lambda c, i: F.when(c == "", None).otherwise(F.when(F.coalesce(F.get(head, i), F.lit("")) == "", c).otherwise(F.concat(F.get(head, i), F.lit(": "), c))))
        return F.array_join(F.array_compact(named), "; ")

    return F.filter(F.transform(F.filter(body, lambda r: ~r.rlike(RULE)), one), lambda s: s != "")


def definition_sentences(block: Column) -> Column:
    """One a line; a comment that goes on in the next line is one sentence."""
    comment = lambda s: s.rlike(rf"^{SPACE}*--")
    lines = F.split(block, "\n")
    goes_on = lambda s, i: (i > 0) & comment(s) & comment(F.get(lines, i - 1))
    joined = F.array_join(F.transform(lines, lambda s, i: F.when(goes_on(s, i), F.regexp_replace(s, rf"^{SPACE}*--", "")).otherwise(F.concat(F.lit(MARK), s))), "")
    return F.filter(F.transform(F.split(joined, MARK), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f\x0B]+", " "))), lambda s: s != "")


def sentences(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, sentence_index, kind, sentence): kind is prose, item, row or definition. A null or blank text gives none."""
    kinds = {"p": "prose", "i": "item", "r": "row", "d": "definition"}

    def said(block):
        kind, body = F.left(block, F.lit(1)), F.substr(block, F.lit(2))
        found = F.when(kind == "r", row_sentences(body)).when(kind == "d", definition_sentences(body)).otherwise(prose_sentences(body))
        return F.transform(found, lambda s: F.struct(kind.alias("kind"), s.alias("sentence")))

    every = F.flatten(F.transform(blocks_of(F.coalesce(F.col(text), F.lit(""))), said))
    name = F.col("s.kind")
    for k, v in kinds.items():
        name = F.when(F.col("s.kind") == k, v).otherwise(name)
    return rows.select(*keys, F.posexplode(every).alias("sentence_index", "s")).select(*keys, "sentence_index", name.alias("kind"), F.col("s.sentence").alias("sentence"))
