"""The audit of lints over orders: trees against what their names claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..plans import Lint, parse
from ..session import read
from .predicates import ORDERS
from .registry import query

_tree = lambda op, *args: {"op": op, "args": list(args)}
#: The second drops its scope, the third looks at another bound, the fifth's name can't be looked up.
LINTS = [
    Lint("e_finished_price_at_most_250000", parse(_tree("FieldNumericInRange", "price", 0, 250000)), parse(_tree("FieldEq", "status", "F"))),
    Lint("e_open_priority_not_contains_urgent", parse(_tree("FieldNotInSet", "priority", ["1-URGENT"]))),
    Lint("w_price_at_least_5000", parse(_tree("FieldNumericInRange", "price", 2000, 1000000)), None, "SHOULD"),
    Lint("e_status_is_not_p", parse(_tree("FieldNotInSet", "status", ["P"]))),
    Lint("e_words_in_order", parse(_tree("FieldCount", "words", 2, 2))),
    Lint("n_words_at_most_2", parse(_tree("FieldCount", "words", 1, 2)), None, "MAY"),
    Lint("e_words_not_contains_low", parse(_tree("Not", _tree("ListAnyMatch", "words", _tree("ItemEq", "LOW"))))),
]
FIELDS = {"price": audit.Raw("price", "number"), "priority": audit.Raw("o_orderpriority"), "status": audit.Raw("o_orderstatus"), "words": audit.Raw("words", "list")}


def audited_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("price", F.floor("o_totalprice")).withColumn("words", F.split("o_orderpriority", "[- ]"))
    return audit.audited(o, "o_orderkey", LINTS, ORDERS, FIELDS, {"finished": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O"})


AUDIT = """
    o as (select o_orderkey, floor(o_totalprice)::bigint as p, o_orderpriority as r, o_orderstatus as s, regexp_split_to_array(o_orderpriority, '[- ]') as w from orders),
    c as (select o_orderkey, 'e_finished_price_at_most_250000' as lint, s = 'F' and p not between 0 and 250000 as f, 'error' as status, s = 'F' and p > 250000 as d from o
      union all select o_orderkey, 'e_open_priority_not_contains_urgent', r = '1-URGENT', 'error', s = 'O' and contains(lower(r), 'urgent') from o
      union all select o_orderkey, 'w_price_at_least_5000', p not between 2000 and 1000000, 'warn', p < 5000 from o
      union all select o_orderkey, 'e_status_is_not_p', s = 'P', 'error', s = 'P' from o
      union all select o_orderkey, 'e_words_in_order', len(w) <> 2, 'error', null from o
      union all select o_orderkey, 'n_words_at_most_2', len(w) not between 1 and 2, 'info', len(w) > 2 from o
      union all select o_orderkey, 'e_words_not_contains_low', list_contains(w, 'LOW'), 'error', list_contains(w, 'LOW') from o),
    v as (select o_orderkey, lint, case when f then status else 'quiet' end as status, case when f and d is null then 'NOCHECK' when f and d then 'CONFIRMED' when f then 'REFUTED' when d then 'MISSED' end as verdict from c)"""


@query(f"with {AUDIT} select o_orderkey, lint, verdict from v where verdict is not null")
def audit_findings(spark, sf_dir):
    """Every finding with its verdict, and what the lints missed."""
    return audited_orders(spark, sf_dir).select("o_orderkey", "lint", "verdict")


@query(f"""with {AUDIT} select lint, count(*) filter (verdict = 'CONFIRMED') as confirmed, count(*) filter (verdict = 'REFUTED') as refuted, count(*) filter (verdict = 'NOCHECK') as nocheck,
    count(*) filter (verdict = 'MISSED') as missed, round(count(*) filter (verdict = 'CONFIRMED') / nullif(count(*) filter (verdict in ('CONFIRMED', 'REFUTED')), 0)::double, 9) as precision from v where verdict is not null group by lint""")
def audit_summary(spark, sf_dir):
    return audit.audit_table(audited_orders(spark, sf_dir)).withColumn("precision", F.round("precision", 9))
