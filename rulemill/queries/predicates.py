"""Predicate trees over orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import Lint, Vocabulary, lint_columns, parse
from ..plans.vocabulary import Field, col
from ..session import read
from .registry import query

ORDERS = Vocabulary(
    {
        "status": col("o_orderstatus", "string"),
        "priority": col("o_orderpriority", "string"),
        "price": Field("int", lambda: F.floor("o_totalprice").cast("int")),
        "words": Field("string_list", lambda: F.split("o_orderpriority", "[- ]")),
        "date": Field("date", lambda: F.col("o_orderdate").cast("timestamp")),
    },
    {"level": "^[0-9]$", "upper": "^[A-Z]+$"},
)
LINTS = [
    Lint("status_known", parse({"op": "FieldInSet", "args": ["status", ["O", "F"]]})),
    Lint("price_bounds", parse({"op": "FieldNumericInRange", "args": ["price", 1000, 400000]}), parse({"op": "FieldEq", "args": ["status", "F"]}), "SHOULD"),
    Lint("words_shape", parse({"op": "ListAllMatch", "args": ["words", {"op": "Or", "args": [{"op": "ItemMatchesRegex", "args": ["level"]}, {"op": "ItemMatchesRegex", "args": ["upper"]}]}]})),
    Lint("not_specified", parse({"op": "Not", "args": [{"op": "ListAnyMatch", "args": ["words", {"op": "ItemEq", "args": ["NOT"]}]}]}), None, "SHOULD NOT"),
    Lint("recent_open", parse({"op": "When", "args": [{"op": "FieldEq", "args": ["status", "O"]}, {"op": "DateAfter", "args": ["date", "1995-01-01"]}]})),
    Lint("count_words", parse({"op": "And", "args": [{"op": "FieldCount", "args": ["words", 2, 2]}, {"op": "FieldLenInRange", "args": ["priority", 1, 8]}]}), parse({"op": "FieldMatchesRegex", "args": ["status", "upper"]})),
]


@query("""
    with r as (select 'status_known' as lint, case when o_orderstatus in ('O', 'F') then 'pass' else 'error' end as status from orders
    union all select 'price_bounds', case when o_orderstatus <> 'F' then 'NA' when floor(o_totalprice) between 1000 and 400000 then 'pass' else 'warn' end from orders
    union all select 'words_shape', case when len(list_filter(regexp_split_to_array(o_orderpriority, '[- ]'), lambda x: not regexp_matches(x, '^([0-9]|[A-Z]+)$'))) = 0 then 'pass' else 'error' end from orders
    union all select 'not_specified', case when list_contains(regexp_split_to_array(o_orderpriority, '[- ]'), 'NOT') then 'warn' else 'pass' end from orders
    union all select 'recent_open', case when o_orderstatus <> 'O' or o_orderdate > timestamp '1995-01-01' then 'pass' else 'error' end from orders
    union all select 'count_words', case when len(regexp_split_to_array(o_orderpriority, '[- ]')) = 2 and length(o_orderpriority) between 1 and 8 then 'pass' else 'error' end from orders)
    select lint, status, count(*) as n from r group by 1, 2""")
def lint_orders(spark, sf_dir):
    """Six lints in one scan, then their outcomes counted."""
    return lint_columns(read(spark, sf_dir, "orders"), LINTS, ORDERS, "o_orderkey").groupBy("lint", "status").agg(F.count("*").alias("n"))


DOCUMENTS = Vocabulary(
    {
        "lang": col("lang", "string"),
        "source": col("source", "string"),
        "text": col("text", "string"),
        "lines": Field("string_list", lambda: F.split("text", "\n")),
        "n_chars": Field("int", lambda: F.col("n_chars").cast("int")),
    },
    {"capital": "^[A-Z]", "license": "Apache License"},
)
DOC_LINTS = [
    Lint("octets", parse({"op": "FieldLenInRange", "args": ["text", 100, 20000]})),
    Lint("capital_lines", parse({"op": "ListAllMatch", "args": ["lines", {"op": "ItemMatchesRegex", "args": ["capital"]}]}), parse({"op": "FieldEq", "args": ["lang", "en"]})),
    Lint("unique_lines", parse({"op": "ListUnique", "args": ["lines"]}), None, "SHOULD"),
    Lint("no_license", parse({"op": "FieldNotMatchesRegex", "args": ["text", "license"]})),
    Lint("source_listed", parse({"op": "And", "args": [{"op": "FieldNonEmpty", "args": ["source"]}, {"op": "FieldNotInSet", "args": ["source", ["src0", "src1"]]}]})),
    Lint("wild", parse({"op": "WildcardFilter", "args": ["lines", "The ", {"op": "ItemLenIn", "args": [list(range(10, 200))]}]})),
]


@query(r"""
    with d as (select *, string_split(text, chr(10)) as l from documents),
    r as (select 'octets' as lint, case when strlen(text) between 100 and 20000 then 'pass' else 'error' end as status from d
    union all select 'capital_lines', case when lang <> 'en' then 'NA' when len(list_filter(l, lambda x: not regexp_matches(x, '^[A-Z]'))) = 0 then 'pass' else 'error' end from d
    union all select 'unique_lines', case when len(list_distinct(l)) = len(l) then 'pass' else 'warn' end from d
    union all select 'no_license', case when contains(text, 'Apache License') then 'error' else 'pass' end from d
    union all select 'source_listed', case when source <> '' and source not in ('src0', 'src1') then 'pass' else 'error' end from d
    union all select 'wild', case when len(list_filter(l, lambda x: starts_with(x, 'The ') and not (strlen(x) between 10 and 199))) = 0 then 'pass' else 'error' end from d)
    select lint, status, count(*) as n from r group by 1, 2""")
def lint_documents(spark, sf_dir):
    return lint_columns(read(spark, sf_dir, "documents"), DOC_LINTS, DOCUMENTS, "doc_id").groupBy("lint", "status").agg(F.count("*").alias("n"))
