"""Reasoning queries: lines of orders stand for rules (part: field, supplier: document, flag: predicate, quantity: condition)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reasoning
from ..session import read
from .registry import query

RULES = """
    r as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as standard_id, 'part.' || l_partkey || '.quantity' as subject, l_partkey,
      case l_returnflag when 'R' then 'must_exist' when 'A' then 'must_not_exist' else 'must_equal' end as predicate,
      case when l_linestatus = 'O' then null else l_quantity end as lo, l_quantity + 5 as hi from lineitem)"""


def rules_of(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    p = F.when(F.col("l_returnflag") == "R", "must_exist").when(F.col("l_returnflag") == "A", "must_not_exist").otherwise("must_equal")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("standard_id"), F.concat(F.lit("part."), F.col("l_partkey").cast("string"), F.lit(".quantity")).alias("subject"),
        p.alias("predicate"), F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_quantity")).alias("lo"), (F.col("l_quantity") + 5).alias("hi"),
    )


@query(f"""with {RULES} select distinct 'part.' || a.l_partkey as field, least(a.id, b.id) as left_id, greatest(a.id, b.id) as right_id from r a join r b on a.subject = b.subject
    where a.predicate = 'must_exist' and b.predicate = 'must_not_exist' and a.standard_id <> b.standard_id
      and greatest(coalesce(a.lo, -1e300), coalesce(b.lo, -1e300)) <= least(a.hi, b.hi)""")
def reason_conflicts(spark, sf_dir):
    return reasoning.conflicts(rules_of(spark, sf_dir))


@query("""
    with e as (select o_custkey as field, case o_orderstatus when 'O' then 'min' when 'F' then 'max' else case when o_orderpriority = '1-URGENT' then 'forbid' else 'exact' end end as operation,
      o_totalprice as value, cast(left(o_orderpriority, 1) as int) as priority, o_orderkey as id from orders)
    select field, case when bool_or(operation = 'forbid') then 'forbid' when bool_or(operation = 'exact') then 'exact' else 'range' end as kind,
      max(case when operation = 'min' then value end) as lower, min(case when operation = 'max' then value end) as upper,
      arg_max(value, struct_pack(p := priority, i := -id)) filter (operation = 'exact') as exact,
      coalesce(max(case when operation = 'min' then value end) > min(case when operation = 'max' then value end), false) as empty_range,
      arg_max(id, struct_pack(p := priority, i := -id)) as primary_id, array_to_string(list(id order by priority desc, id), '>') as chain from e group by 1""")
def reason_effective(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    op = F.when(s == "O", "min").when(s == "F", "max").when(p == "1-URGENT", "forbid").otherwise("exact")
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), op.alias("operation"), F.col("o_totalprice").alias("value"), F.left(p, F.lit(1)).cast("int").alias("priority"), F.col("o_orderkey").alias("id"))
    return reasoning.effective_rules(e).drop("critical")


@query("""
    with p as (select l_orderkey as left_id, l_partkey as right_id from lineitem where l_orderkey <> l_partkey),
    q as (select distinct left_id, right_id from p),
    s as (select o_orderkey as id, o_custkey as std, case o_orderstatus when 'O' then 100 when 'F' then 80 else 30 end as pri, o_orderdate as d from orders)
    select q.left_id, q.right_id, case when a.pri <> b.pri then 'source' when a.d <> b.d then 'date' else 'manual' end as how,
      case when a.pri > b.pri then q.left_id when a.pri < b.pri then q.right_id when a.d > b.d then q.left_id when a.d < b.d then q.right_id end as winner_id
    from q join s a on a.id = q.left_id join s b on b.id = q.right_id""")
def reason_resolved(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderstatus") == "O", "CABF-BR").when(F.col("o_orderstatus") == "F", "RFC 5280").otherwise("other")
    rules = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("standard_id"), source.alias("source"), F.col("o_orderdate").alias("publish_date"))
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id")).where("left_id <> right_id").distinct()
    return reasoning.resolved(pairs, rules)


@query("""
    with a as (select p_partkey as id, p_brand || '.' || p_type as subject, p_type as predicate, cast(p_size as varchar) as obligation from part),
    b as (select p_partkey as lint, p_brand || '.' || p_type as subject, p_type as predicate, cast(p_size as varchar) as obligation from part),
    s as (select a.id, b.lint, case when a.subject = b.subject then 0.5 else 0.0 end + case when a.predicate = b.predicate then 0.4 else 0.0 end + case when a.obligation = b.obligation then 0.3 else 0.0 end as score
      from a join b on split_part(a.subject, '.', 1) = split_part(b.subject, '.', 1))
    select id as rule_id, lint as lint_name, round(score::double, 6) as score from (select *, row_number() over (partition by id order by round(score::double, 6) desc, lint) as r from s where round(score::double, 6) >= 0.3) where r = 1""")
def reason_scored_links(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type").alias("subject"), F.col("p_type").alias("predicate"), F.col("p_size").cast("string").alias("obligation"), F.lit(None).cast("string").alias("constraint_value"), "p_size")
    a = p.withColumnRenamed("p_partkey", "id")
    b = p.withColumnRenamed("p_partkey", "lint_name")
    return reasoning.scored_links(a, b).withColumn("score", F.round("score", 6))
