"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Base spans (e-mail, ip, card, phone) come from fixed rules and always stay. Generators propose more candidates of the
same kinds, of any length; the trees score them, those over the kind's threshold that touch no base span are taken
generator by generator, in the order of ``PROPOSED``, if they touch none taken before. Spans of one pattern are sorted
and apart, so every test for overlap is a binary search and a long log is no slower per line than a short one.

Nulls: a null text counts as empty and has no spans. Overlaps between kinds are kept for the base spans; ties go to the
kind listed first. Repeated rows are judged each; very long texts are read whole; an empty table gives no rows; other
columns are kept, but for ``base`` and ``added``. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .pii_model import CONTEXT, DATE, DOMAIN, FEATURES, KINDS, LAYOUT, MARK, RATE, TRUNK, model

#: Base patterns, written so that no long run is scanned twice (possessive; a match starts at the run's start or right
#: after the match before).
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests before the patterns.
NEEDS = {"email": "@", "phone": "+"}
OTHER = r"\s@<>,;:()\""
PROPOSED = [
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{{dot\}}) ?)[A-Za-z0-9-]++)*+"),
    ("email", rf"(?<![^\s<>,;:()\"])[^{OTHER}]++@[^{OTHER}]*[^{OTHER}.!?']"),
    ("ip", r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]++(?<=[0-9A-Fa-f])(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ .-]{0,2}[0-9])++(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ().\/-]{0,3}[0-9])++(?![0-9A-Za-z])"),
]
LEAST_DIGITS = {"card": 13, "phone": 7}  # fewer are no candidate
CHUNK = 1024  # code points that a part of a text is cut from


def once(value, use):
    """``use(value)`` with the value computed once, however often ``use`` reads it within its lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes):
    """Sums of what stands before each element, in blocks: n to the power 1.5 steps."""
    n = F.size(sizes)
    b = F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda k: add(F.slice(sizes, k * b + 1, b)))
    heads = lambda sums: F.transform(sums, lambda _, k: F.when(k == 0, 0).otherwise(add(F.slice(sums, F.lit(1), k))))
    within = lambda i: F.when(i % b == 0, 0).otherwise(add(F.slice(sizes, i - i % b + 1, i % b)))
    return once(blocks, lambda sums: once(heads(sums), lambda head: F.transform(sizes, lambda _, i: F.get(head, F.floor(i / b).cast("int")) + within(i))))


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d):
    def value(i):
        x = F.substring(d, -(i + 1), F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    n = F.length(d)
    seq = F.sequence(F.lit(0), F.least(n, F.lit(64)) - 1)
    return (n > 0) & (n <= 64) & (F.aggregate(F.when(n > 0, seq).otherwise(F.array(F.lit(0))), F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0))) % 10 == 0)


def _valid(kind, m):
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


NONE = "array<struct<s:int,e:int,k:int,m:string,c:string>>"


def located(d: DataFrame, name: str, kind: str, pattern: str, needs, context: bool) -> DataFrame:
    """Adds the array ``name`` of all matches with their places (and the 24 characters before them)."""
    k = KINDS.index(kind)
    d = d.withColumn("_m", F.when(needs, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_gap", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
    pairs = F.transform(F.col("_m"), lambda m, i: F.length(F.get("_gap", i)) + F.length(m))
    d = d.withColumn("_n", F.when(F.size("_m") > 0, pairs))
    d = d.withColumn("_at", F.when(F.size("_m") > 0, running(F.col("_n"))))
    before = lambda i: F.lower(F.right(F.get("_gap", i), F.lit(24))) if context else F.lit("")
    spans = F.transform(
        F.col("_m"),
        lambda m, i: F.struct(
            (F.get("_at", i) + F.length(F.get("_gap", i))).cast("int").alias("s"),
            (F.get("_at", i) + F.get("_n", i)).cast("int").alias("e"),
            F.lit(k).alias("k"),
            m.alias("m"),
            before(i).alias("c"),
        ),
    )
    return d.withColumn(name, F.when(F.size("_m") > 0, spans).otherwise(F.array().cast(NONE))).drop("_m", "_gap", "_n", "_at")


def feature_columns(m, c):
    digits = _digits(m)
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    return [
        F.length(digits),
        F.length(m),
        F.size(F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")),
        F.coalesce(F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda x: F.length(x))), F.lit(0)),
        count(" ./-"),
        count("."),
        count(":"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        count("()"),
        F.regexp_count(m, F.lit(MARK)),
        _luhn(digits).cast("int"),
        *(m.rlike(p).cast("int") for p in (DATE, LAYOUT, TRUNK, DOMAIN)),
        *(c.rlike(p).cast("int") for p in CONTEXT.values()),
    ]


def _tree(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, cut, low, high = tree
    return f"IF(x.{FEATURES[f]} <= {cut!r}D, {_tree(low)}, {_tree(high)})"


def _score(kind: str) -> str:
    """The trees' sum above the kind's threshold, for a candidate ``x``, as SQL."""
    trees, cut = model(kind)
    return f"{RATE!r}D * ({' + '.join(map(_tree, trees))}) - {cut!r}D"


def _end(spans: str, bound: str) -> str:
    """SQL for the end of the last of the sorted, disjoint ``spans`` that starts before ``bound``, by binary search; 0 if none does."""
    mid = "CAST((at_.lo + at_.hi) DIV 2 AS INT)"
    low, high = f"named_struct('lo', {mid} + 1, 'hi', at_.hi)", f"named_struct('lo', at_.lo, 'hi', {mid})"
    step = f"(at_, step_) -> IF(at_.lo < at_.hi, IF(get({spans}, {mid}).s < {bound}, {low}, {high}), at_)"
    found = f"aggregate(sequence(1, length(bin(size({spans})))), named_struct('lo', 0, 'hi', size({spans})), {step}, at_ -> get({spans}, at_.lo - 1).e)"
    return f"IF(size({spans}) = 0, 0, coalesce({found}, 0))"


def _free(tracks) -> str:
    """SQL: whether the span ``x`` overlaps none of the sorted, disjoint spans of each track."""
    return " AND ".join([f"{_end(t, 'x.e')} <= x.s" for t in tracks] or ["true"])


def _place(x):
    return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))


def _kept(kind):
    return F.filter(f"_{kind}", lambda x: _valid(kind, x["m"]))


def _rich(name, kind):
    enough = lambda x: F.length(_digits(x["m"])) >= LEAST_DIGITS.get(kind, 0)
    values = lambda x: [v.cast("double").alias(n) for n, v in zip(FEATURES, feature_columns(x["m"], x["c"]))]
    return F.transform(F.filter(name, enough), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), *values(x)))


def _chosen(name, kind, taken):
    good = f"filter({name}, x -> {_score(kind)} >= 0)"
    return F.expr(f"transform(filter({good}, x -> {_free(taken)}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")


def _found(docs: DataFrame) -> DataFrame:
    """row, _t, base, added and the base spans of each kind (_email and so on)."""
    d = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty().alias("_t"))
    digit = F.col("_t").rlike("[0-9]")
    for kind, pattern in BASE.items():
        needs = F.contains("_t", F.lit(NEEDS[kind])) if kind in NEEDS else digit
        d = located(d, f"_{kind}", kind, pattern, needs, context=False)
        d = d.withColumn(f"_{kind}", F.transform(_kept(kind), _place))
    d = d.withColumn("base", F.array_sort(F.concat(*[f"_{k}" for k in BASE])))
    marked = F.contains("_t", F.lit("@")) | F.col("_t").rlike(r"[(\[{]at[)\]}]")
    tracks, taken = [f"_{k}" for k in BASE], []
    for i, (kind, pattern) in enumerate(PROPOSED):
        needs = marked if kind == "email" else F.contains("_t", F.lit(":")) & digit if kind == "ip" else digit
        d = located(d, f"_p{i}", kind, pattern, needs, context=True)
        d = d.withColumn(f"_p{i}", F.expr(f"filter(_p{i}, x -> {_free(tracks)})"))
        d = d.withColumn(f"_p{i}", _rich(f"_p{i}", kind))
        d = d.withColumn(f"_p{i}", _chosen(f"_p{i}", kind, taken))
        taken.append(f"_p{i}")
    return d.withColumn("added", F.array_sort(F.concat(*taken))).drop(*taken)


def personal_data(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``base`` and ``added``: arrays of spans {s, k, e}, sorted by place; k indexes KINDS."""
    return _found(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("base", "added")], "base", "added")


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, n_added, digest of the base spans, and all spans as text."""
    d = personal_data(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one mark, of the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    tracks = [*(f"_{k}" for k in BASE), "added"]  # each sorted, its spans apart
    d = _found(docs).withColumn("_all", F.array_sort(F.concat("base", "added")))
    before = lambda bound: f"greatest({', '.join(_end(t, bound) for t in tracks)})"
    d = d.withColumn("_first", F.expr(f"filter(_all, (x, i) -> {before('x.s')} <= x.s AND NOT (i > 0 AND get(_all, i - 1).s = x.s))"))
    d = d.withColumn("_marks", F.expr(f"transform(_first, (x, i) -> named_struct('s', x.s, 'k', x.k, 'e', {before('coalesce(get(_first, i + 1).s, 2147483647)')}))"))
    d = d.withColumn("_chunks", F.when(F.size("_marks") > 0, F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def part(a, b):
        lo, hi = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        return F.when(b <= a, "").otherwise(F.substring(F.array_join(F.slice("_chunks", lo + 1, hi - lo + 1), ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int")))

    piece = lambda x, i: F.concat(part(F.coalesce(F.get("_marks", i - 1)["e"], F.lit(0)), x["s"]), F.get(names, x["k"]))
    rest = part(F.element_at("_marks", -1)["e"], F.length("_t"))
    done = F.concat(F.array_join(F.transform("_marks", piece), ""), rest)
    text = F.when(F.size("_marks") > 0, done).otherwise(F.col("row")["text"]).alias("text")
    return d.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
