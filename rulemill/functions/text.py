"""Text functions as columns: normalisation, keywords, sentences, references, exceptions, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normative keywords, longest first, and their canonical forms.
KEYWORDS = ("MUST NOT", "SHALL NOT", "SHOULD NOT", "NOT RECOMMENDED", "MUST", "SHALL", "SHOULD", "REQUIRED", "RECOMMENDED", "MAY", "OPTIONAL")
CANONICAL = {"SHALL": "MUST", "SHALL NOT": "MUST NOT", "REQUIRED": "MUST", "RECOMMENDED": "SHOULD", "NOT RECOMMENDED": "SHOULD NOT", "OPTIONAL": "MAY"}
#: Patterns of exceptions by kind.
EXCEPTIONS = {
    "unless": r"(?i)\bunless\b\s+([^.;]+)",
    "only_if": r"(?i)\bonly if\b\s+([^.;]+)",
    "not_apply": r"(?i)\bdoes not apply\b\s*([^.;]*)",
    "except": r"(?i)\bexcept(?:\s+(?:for|when|that|as))?\b\s+([^.;]+)",
    "in_case_of": r"(?i)\bin (?:the )?case of\b\s+([^.;]+)",
    "other_than": r"(?i)\bother than\b\s+([^.;]+)",
    "may_ignore": r"(?i)\bmay be ignored if\b\s+([^.;]+)",
}
#: Patterns of references, first match wins.
REFERENCES = (
    ("rfc_section", r"(?i)\bsection\s+([0-9]+(?:\.[0-9]+)*)\s+of\s+\[?RFC\s?([0-9]{3,5})\]?"),
    ("rfc", r"(?i)\[?\bRFC\s?([0-9]{3,5})\]?"),
    ("etsi", r"\b(?:ETSI\s+)?(?:EN|TS|TR)\s+([0-9]{3}\s[0-9]{3}(?:-[0-9]+)*)"),
    ("section", r"(?i)\bsections?\s+([0-9]+(?:\.[0-9]+)*)"),
    ("appendix", r"(?i)\b(?:appendix|annex)\s+([A-Z])\b"),
)
#: Words that carry no meaning in retrieval.
STOP_WORDS = "the and for are but not you all any can had her was one our out has with this that from they will shall must should may".split()


def normalised(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def cleaned(c: Column) -> Column:
    """Without control characters; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[ \t]+", " "))


def keyword_pattern(keywords=KEYWORDS, any_case: bool = False) -> str:
    return ("(?i)" if any_case else "") + r"\b(" + "|".join(k.replace(" ", r"\s+") for k in keywords) + r")\b"


def keywords_in(c: Column, keywords=KEYWORDS, any_case: bool = False) -> Column:
    """All keywords of a sentence in order; of overlapping ones the longest."""
    found = F.regexp_extract_all(c, F.lit(keyword_pattern(keywords, any_case)), F.lit(1))
    return F.transform(found, lambda k: F.upper(F.regexp_replace(k, r"\s+", " ")))


def canonical_keyword(c: Column) -> Column:
    pairs = [F.lit(x) for kv in CANONICAL.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def sentences_of(c: Column) -> Column:
    """Simple sentence split: after . ! or ? and white space, or at an empty line."""
    parts = F.split(c, r"(?<=[.!?])\s+|\n\s*\n")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def requirements_of(c: Column) -> Column:
    """A sentence split at semicolons and before a conjunction that a modal verb follows."""
    parts = F.split(c, r";\s*|,?\s+(?:and|or)\s+(?=(?:it\s+)?(?:MUST|SHALL|SHOULD|MAY)\b)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def exceptions_of(c: Column) -> Column:
    """Array of (kind, clause)."""
    found = [F.struct(F.lit(k).alias("kind"), F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")).alias("clause")) for k, p in EXCEPTIONS.items()]
    hits = [c.rlike(p) for p in EXCEPTIONS.values()]
    return F.array_compact(F.array(*[F.when(h, s) for h, s in zip(hits, found)]))


def references_of(c: Column) -> Column:
    """Array of (kind, target) over all patterns, in order of their priority, without repeats."""
    parts = []
    for kind, p in REFERENCES:
        groups = 2 if kind == "rfc_section" else 1
        found = F.regexp_extract_all(c, F.lit(p), F.lit(groups))
        if kind == "rfc_section":
            found = F.zip_with(found, F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda rfc, s: F.concat_ws("#", rfc, s))
        parts.append(_tagged(found, kind))
    return F.array_distinct(F.concat(*parts))


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def tokens_of(c: Column, least: int = 3, stop=STOP_WORDS) -> Column:
    """Lower-case alphabetic tokens of a least length without stop words."""
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of white-space token sets; 0 where both are empty."""
    x, y = F.array_distinct(F.split(F.trim(F.lower(a)), r"\s+")), F.array_distinct(F.split(F.trim(F.lower(b)), r"\s+"))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snippet(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """A fourth of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def free_date(c: Column) -> Column:
    """A date in one of the usual forms, else null."""
    forms = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "MMMM d, yyyy": r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "yyyyMMdd": r"^\d{8}$"}
    return F.coalesce(*[F.when(c.rlike(p), F.try_to_date(c, f)) for f, p in forms.items()])


def literal_ilike(c: Column, term: str) -> Column:
    """Case-insensitive containment of a literal; % and _ mean themselves."""
    return F.contains(F.lower(c), F.lit(term.lower()))
