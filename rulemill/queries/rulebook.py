"""Gates, candidates, texts, definitions, references and verdicts: orders, parts and turns stand for rules and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import paths
from ..functions import text as T
from ..operators import discovery, evaluation, graph, knowledge, lintability, reasoning, relational
from ..session import read
from .registry import query

RULES = """
    o as (select o_orderkey as id, case left(o_orderpriority, 1) when '1' then 'MUST' when '2' then 'SHOULD_NOT' when '3' then 'MAY' else 'shall' end as duty, case when o_orderkey % 5 = 0 then 'CA' else 'Certificate' end as who,
      case o_orderkey % 4 when 0 then 'extensions.keyUsage' when 1 then 'phone.x' when 2 then ' Subject.cn' end as subject, case o_orderkey % 3 when 0 then 'encoding_constraint' when 1 then 'comparison' end as category,
      case when o_orderkey % 7 = 0 then 'Validation' when o_orderkey % 7 < 4 then 'Encoding' end as phase, case when o_orderkey % 2 = 0 then 'must_equal' else 'other' end as predicate, o_orderstatus as s from orders)"""


def rules_of(spark, sf_dir):
    o, i = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    p = F.left("o_orderpriority", F.lit(1))
    return o.select(
        i.alias("id"), F.when(p == "1", "MUST").when(p == "2", "SHOULD_NOT").when(p == "3", "MAY").otherwise("shall").alias("obligation"), F.when(i % 5 == 0, "CA").otherwise("Certificate").alias("assertion_subject"),
        F.when(i % 4 == 0, "extensions.keyUsage").when(i % 4 == 1, "phone.x").when(i % 4 == 2, " Subject.cn").alias("subject"), F.when(i % 3 == 0, "encoding_constraint").when(i % 3 == 1, "comparison").alias("rule_category"),
        F.when(i % 7 == 0, "Validation").when(i % 7 < 4, "Encoding").alias("enforcement_phase"), F.when(i % 2 == 0, "must_equal").otherwise("other").alias("predicate"),
        F.concat(F.lit("The order is one. It is kept as "), "o_orderstatus", F.lit(".")).alias("text"),
    )


@query(f"""with {RULES}, r as (select id, list_filter([case when duty = 'MAY' then 'obligation' end, case when who <> 'Certificate' then 'assertion_subject' end, case when subject is null or subject = 'phone.x' then 'subject' end,
      case when category = 'comparison' then 'category' end, case when phase = 'Validation' then 'phase' end, case when s = 'P' then 'not_observable' end], lambda x: x is not null) as r from o)
    select id, len(r) = 0 as lintable, array_to_string(r, ',') as reasons from r""")
def lint_gate(spark, sf_dir):
    """Which rules can be checked on a record, and why the others can't."""
    return lintability.gate(rules_of(spark, sf_dir), [" kept as p "]).select("id", "lintable", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {RULES} select id, predicate = 'must_equal' and who = 'Certificate' and duty <> 'MAY' and coalesce(subject, 'phone.x') <> 'phone.x' and s <> 'F' as observable from o")
def lint_observable(spark, sf_dir):
    return lintability.observable(rules_of(spark, sf_dir), [" as f "]).select("id", "observable")


@query("""
    with r as (select o_orderkey as id, case o_orderkey % 3 when 0 then 'RFC' when 1 then 'CABF-BR' else 'ETSI' end as f, (o_orderkey % 4 + 1) || case when o_orderkey % 5 > 0 then '.' || (o_orderkey % 5) else '' end as s from orders),
    l as (select n_name as n, case when n_nationkey % 2 = 0 then 'RFC' else 'CABF' end as f, (n_nationkey % 3 + 1) || case when n_nationkey % 4 > 0 then '.' || (n_nationkey % 4) || '.7' else '' end as s from nation),
    p as (select r.id, l.n from r join l on (r.f = 'RFC' and l.f = 'RFC' and (r.s = l.s or starts_with(r.s, l.s || '.') or starts_with(l.s, r.s || '.'))) or r.f = 'CABF-BR')
    select id as rule_id, count(*) as lints, min(n) as first from p group by 1""")
def lint_candidates(spark, sf_dir):
    """Lints (nations stand for them) that may cover a rule, by source and section."""
    i, s = F.col("o_orderkey"), F.col("n_nationkey")
    dotted = lambda a, b, tail="": F.concat(a.cast("string"), F.when(b > 0, F.concat(F.lit("."), b.cast("string"), F.lit(tail))).otherwise(""))
    rules = read(spark, sf_dir, "orders").select(i.alias("id"), F.when(i % 3 == 0, "RFC").when(i % 3 == 1, "CABF-BR").otherwise("ETSI").alias("source"), dotted(i % 4 + 1, i % 5).alias("section"))
    lints = read(spark, sf_dir, "nation").select(F.col("n_name").alias("lint_name"), F.when(s % 2 == 0, "RFC").otherwise("CABF").alias("source"), dotted(s % 3 + 1, s % 4, ".7").alias("section"))
    return lintability.coverage_candidates(rules, lints).groupBy("rule_id").agg(F.count("*").alias("lints"), F.min("lint_name").alias("first"))


@query("""
    select p_partkey, unnest([struct_pack(n := 0, id := '', title := '', text := 'About ' || p_name), struct_pack(n := 1, id := '1.2', title := p_name, text := p_type || chr(10) || p_brand), struct_pack(n := 2, id := '', title := 'Last', text := '')], recursive := true) from part""")
def text_sections(spark, sf_dir):
    """Texts made of parts, cut at their headings."""
    text = F.concat(F.lit("About "), "p_name", F.lit("\n1.2 "), "p_name", F.lit("\n"), "p_type", F.lit("\n"), "p_brand", F.lit("\n## Last\n"))
    s = discovery.sections(read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return s.select("p_partkey", F.col("section_no").alias("n"), F.col("section_id").alias("id"), "title", "text")


@query("select conv_id, turn, sha256(string_agg(text, ' ') over (partition by conv_id order by turn rows between 2 preceding and 2 following)) as context_sha256 from conversations")
def text_context(spark, sf_dir):
    """The turns around each turn."""
    c = discovery.context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2)
    return c.select("conv_id", "turn", F.sha2("context", 256).alias("context_sha256"))


@query("""
    select p_partkey, unnest([struct_pack(kind := 'unless', clause := p_name), struct_pack(kind := 'except', clause := p_type), struct_pack(kind := 'other_than', clause := p_brand)], recursive := true) from part""")
def text_exceptions(spark, sf_dir):
    text = F.concat(F.lit("It holds unless "), "p_name", F.lit("; Except for "), "p_type", F.lit(", or other than "), "p_brand", F.lit("."))
    text = F.replace(text, F.lit(", or"), F.lit("; or"))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(T.exceptions_of(text)).alias("e")).select("p_partkey", "e.*")


@query("""
    select p_partkey, unnest([struct_pack(kind := 'rfc_section', target := (p_size + 1000) || '#4.' || p_size), struct_pack(kind := 'rfc', target := (p_size + 1000)::varchar), struct_pack(kind := 'rfc', target := '9' || (p_size + 100)),
      struct_pack(kind := 'section', target := '4.' || p_size), struct_pack(kind := 'appendix', target := 'B')], recursive := true) from part""")
def text_references(spark, sf_dir):
    n = F.col("p_size")
    text = F.concat(F.lit("See section 4."), n.cast("string"), F.lit(" of RFC "), (n + 1000).cast("string"), F.lit(", [RFC9"), (n + 100).cast("string"), F.lit("] and Annex B."))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(T.references_of(text)).alias("r")).select("p_partkey", "r.*")


@query("""
    with d as (select lower(p_name) as term, p_partkey as id, p_brand as source, p_size as priority, p_type as text from part),
    b as (select term, arg_max(struct_pack(id := id, source := source, text := text), struct_pack(p := priority, i := -id)) as d from d group by 1),
    a as (select distinct p_name as term, lower(p_name) as target from part union all select distinct p_name || ' kind', lower(p_name) from part)
    select a.term, b.d.id as definition_id, b.d.source as source, b.d.text as text from a join b on b.term = a.target""")
def know_definitions(spark, sf_dir):
    """Names of parts and their aliases, each with the definition of the highest priority."""
    p = read(spark, sf_dir, "part")
    terms = p.select(F.col("p_name").alias("term")).union(p.select(F.concat("p_name", F.lit(" kind"))))
    definitions = p.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("term"), F.col("p_brand").alias("source"), F.col("p_size").alias("priority"), F.col("p_type").alias("text"))
    aliases = p.select(F.concat("p_name", F.lit("  Kind")).alias("alias"), F.col("p_name").alias("term"))
    return knowledge.definition_lookup(terms, definitions, aliases)


@query("""
    with t as (select lower(p_name) as term, min(p_partkey) as dst from part group by 1), s as (select p_partkey as src, ' ' || lower(p_type || ' ' || p_name || ' ' || p_type) || ' ' as text from part)
    select src, dst from s join t on src <> dst and contains(text, ' ' || term || ' ')""")
def know_cross_references(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    terms = p.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("section"))
    return knowledge.cross_references(p.select(F.col("p_partkey").alias("id"), F.concat_ws("; ", "p_type", "p_name", "p_type").alias("text")), terms)


@query("""
    select p_partkey, 'All of ' || p_brand || ' hold:' as preamble, unnest([struct_pack(item_number := 0, item := p_name), struct_pack(item_number := 1, item := p_type || ' too'), struct_pack(item_number := 2, item := 'last')], recursive := true) from part""")
def know_list_items(spark, sf_dir):
    text = F.concat(F.lit("All of "), "p_brand", F.lit("\nhold:\n - "), "p_name", F.lit("\n  2. "), "p_type", F.lit(" too\n (c) last"))
    return knowledge.list_items(read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"])


@query("""
    with recursive u as (select distinct c_custkey % 97 as term, (c_custkey * 5 + c_nationkey) % 97 as used from customer),
    w as (select term, used, 1 as level from u where term % 10 = 0 union select w.term, u.used, w.level + 1 from w join u on u.term = w.used where w.level < 3)
    select term, used, min(level) as level from w where term <> used or level = 1 group by 1, 2""")
def know_expanded(spark, sf_dir):
    """What a term's definition uses, in up to three steps."""
    uses = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("term"), ((F.col("c_custkey") * 5 + F.col("c_nationkey")) % 97).alias("used")).distinct()
    return graph.expand_definitions(uses.where("term % 10 = 0").select("term").distinct(), uses, 3)


@query("""
    with s as (select o_custkey as lint, case when o_orderpriority = '5-LOW' then 'NA' when o_orderstatus = 'F' then 'error' else 'pass' end as status from orders),
    f as (select lint, count(*) filter (status = 'error') / nullif(count(*) filter (status <> 'NA'), 0)::double as x from s group by 1)
    select case when x is null then -1 else least(floor(x / 0.1 + 1e-9), 9) end::int as bucket, count(*) as lints, count(*) filter (coalesce(x >= 0.3, false)) as suspects from f group by 1""")
def eval_histogram(spark, sf_dir):
    """Customers stand for lints that fire on their orders."""
    status = F.when(F.col("o_orderpriority") == "5-LOW", "NA").when(F.col("o_orderstatus") == "F", "error").otherwise("pass")
    return evaluation.firing_histogram(evaluation.firing(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lint"), status.alias("status"))))


@query("""
    with v as (select o_orderkey as k, case o_orderstatus when 'O' then 'full' when 'F' then 'partial' else 'none' end as b, case o_orderkey % 4 when 0 then 'full' when 1 then 'partial' when 2 then 'none' end as a from orders)
    select k, case when a is null or (case a when 'full' then 3 when 'partial' then 2 else 1 end) > (case b when 'full' then 3 when 'partial' then 2 else 1 end) then b else a end as verdict from v""")
def eval_never_upgraded(spark, sf_dir):
    """A later verdict may only take coverage away."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    before = o.select(k.alias("k"), F.when(F.col("o_orderstatus") == "O", "full").when(F.col("o_orderstatus") == "F", "partial").otherwise("none").alias("verdict"))
    after = o.where(k % 4 < 3).select(k.alias("k"), F.when(k % 4 == 0, "full").when(k % 4 == 1, "partial").otherwise("none").alias("verdict"))
    return evaluation.never_upgraded(before, after, ["k"])


@query("""select p_partkey, case when p_size >= 10 and p_retailprice % 100 >= 95 then 'auto' when p_size >= 3 and p_retailprice % 100 >= 70 then 'manual' else 'rejected' end as decision from part""")
def eval_decision(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("support"), (F.col("p_retailprice") % 100 / 100).alias("precision"))
    return evaluation.candidate_decision(p).select("p_partkey", "decision")


@query("""select p_partkey, case p_size % 3 when 0 then 'DEPENDS_ON' when 1 then 'DEPENDS_ON' else 'CITES' end as relation from part""")
def reason_dependencies(spark, sf_dir):
    n = F.col("p_size") % 3
    text = F.concat("p_name", F.when(n == 0, " is As Defined In ").when(n == 1, " in accordance with ").otherwise(" see "), "p_brand")
    return reasoning.dependencies(read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "relation")


@query("""
    select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_returnflag = 'R' or l_linestatus = 'O' then 'place' end, case when l_linestatus = 'O' then 'time' end], lambda x: x is not null), ',') as missing,
      l_returnflag = 'R' or l_linestatus = 'O' as is_uncertain from lineitem""")
def reason_uncertain(spark, sf_dir):
    """Dimensions that are unknown on a side."""
    known = lambda c, v: F.when(F.col(c) == v, None).otherwise(F.col(c))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", known("l_returnflag", "R").alias("a_place"), known("l_linestatus", "O").alias("b_place"), F.lit("x").alias("a_time"), known("l_linestatus", "O").alias("b_time"))
    return reasoning.missing_dimensions(li, ["place", "time"]).select("l_orderkey", "l_linenumber", F.array_join("missing", ",").alias("missing"), "is_uncertain")


@query("""
    with e as (select o_custkey as field, case o_orderkey % 5 when 0 then 'must_be_critical' when 1 then 'must_not_be_critical' else 'note' end as op, o_orderkey as id from orders where o_orderpriority = '1-URGENT')
    select field, case when bool_or(op <> 'note') then 'critical' else 'single' end as kind, case when bool_or(op = 'must_be_critical') then true when bool_or(op = 'must_not_be_critical') then false end as critical, min(id) as primary_id from e group by 1""")
def reason_critical(spark, sf_dir):
    """Criticality of a field said by several rules: critical wins."""
    i = F.col("o_orderkey")
    op = F.when(i % 5 == 0, "must_be_critical").when(i % 5 == 1, "must_not_be_critical").otherwise("note")
    e = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("field"), op.alias("operation"), F.lit(1.0).alias("value"), F.lit(1).alias("priority"), i.alias("id"))
    return reasoning.effective_rules(e).select("field", "kind", "critical", "primary_id")


@query("""
    select o_orderkey, case when o_orderkey % 3 < 2 then 'part.' || o_custkey end as subject, o_orderpriority as obligation, case when o_orderkey % 3 < 2 then o_orderstatus end as predicate, o_orderkey % 3 = 0 as lintable from orders""")
def json_rules(spark, sf_dir):
    """Rules kept as JSON of two generations; every third text is broken."""
    i = F.col("o_orderkey")
    path = F.concat(F.lit("part."), F.col("o_custkey").cast("string"))
    old = F.to_json(F.struct(F.struct(path.alias("subject"), F.col("o_orderpriority").alias("obligation"), F.col("o_orderstatus").alias("predicate")).alias("ir")))
    new = F.to_json(F.struct(F.struct(F.struct(path.alias("path")).alias("subject"), F.col("o_orderpriority").alias("obligation"), F.col("o_orderstatus").alias("predicate"), F.lit(True).alias("lintable")).alias("ir")))
    bad = F.concat(F.lit('{"ir": {"obligation": "'), "o_orderpriority", F.lit('", "lintable": "maybe"}}'))
    rules = read(spark, sf_dir, "orders").select("o_orderkey", F.when(i % 3 == 0, new).when(i % 3 == 1, old).otherwise(bad).alias("ir_data"))
    return J.generated(rules).select("o_orderkey", "subject", "obligation", "predicate", "lintable")


@query("""
    with p as (select o_orderkey, (o_orderkey % 3 + 1) || case when o_orderkey % 4 > 0 then '.' || (o_orderkey % 4) else '' end as a, (o_custkey % 3 + 1) || case when o_custkey % 4 > 0 then '.' || (o_custkey % 4) || case when o_custkey % 8 > 3 then '1' else '' end else '' end as b from orders)
    select o_orderkey, case when a = b then 'SAME' when starts_with(a, b || '.') or starts_with(b, a || '.') then 'REFINEMENT' when split_part(a, '.', 1) = split_part(b, '.', 1) then 'DISJOINT' else 'INCOMPARABLE' end as relation,
      a = b or starts_with(a, b || '.') or starts_with(b, a || '.') as sections_meet, a = b or starts_with(a, b || '.') as a_within_b from p""")
def path_relations(spark, sf_dir):
    """How two dotted paths relate."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.concat((i % 3 + 1).cast("string"), F.when(i % 4 > 0, F.concat(F.lit("."), (i % 4).cast("string"))).otherwise(""))
    b = F.concat((c % 3 + 1).cast("string"), F.when(c % 4 > 0, F.concat(F.lit("."), (c % 4).cast("string"), F.when(c % 8 > 3, "1").otherwise(""))).otherwise(""))
    o = read(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return o.select("o_orderkey", paths.path_relation(F.col("a"), F.col("b")).alias("relation"), paths.section_prefix(F.col("a"), F.col("b")).alias("sections_meet"), paths.subject_prefix(F.col("a"), F.col("b")).alias("a_within_b"))


@query("""
    with c as (select (s_suppkey % 5)::varchar || case when s_suppkey % 3 > 0 then '.' || (s_suppkey % 7) else '' end as key, min(s_suppkey) as entry from supplier group by 1),
    r as (select o_orderkey, (o_custkey % 6) || '.' || (o_custkey % 8) || '.' || (o_custkey % 2) as key from orders)
    select o_orderkey, coalesce(c3.entry, c2.entry, c1.entry) as entry from r left join c c3 on c3.key = r.key left join c c2 on c2.key = regexp_replace(r.key, '\\.[0-9]+$', '') left join c c1 on c1.key = split_part(r.key, '.', 1)""")
def join_priority(spark, sf_dir):
    """The catalogue entry with the longest prefix of a key."""
    s, c = F.col("s_suppkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    catalogue = read(spark, sf_dir, "supplier").select(F.concat(text(s % 5), F.when(s % 3 > 0, F.concat(F.lit("."), text(s % 7))).otherwise("")).alias("key"), s.alias("id"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", text(c % 6), text(c % 8), text(c % 2)).alias("key"))
    return relational.priority_lookup(rows, catalogue, "key", "id").select("o_orderkey", "entry")
