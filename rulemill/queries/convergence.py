"""Queries of rules said more than once: parts and orders stand for rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convergence, discovery, stars
from ..session import read
from .registry import query

#: Parts as rules: brand and type are the subject's path, sizes the scopes, name and type the text.
PARTS = """
    p as (select p_partkey as id, lower(p_type) as subject, case when p_size % 3 = 0 then 'must_equal' else 'must_include' end as predicate,
      case when p_size % 2 = 0 then 'MUST' else 'SHOULD' end as obligation, case when p_size > 25 then 's' || (p_partkey % 40)::varchar end as scope,
      left(p_name, 5) as "constraint", p_name || ' ' || lower(p_brand) || ' ' || p_size::varchar as text from part)"""


def parts_as_rules(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("subject"), F.when(size % 3 == 0, "must_equal").otherwise("must_include").alias("predicate"),
        F.when(size % 2 == 0, "MUST").otherwise("SHOULD").alias("obligation"), F.when(size > 25, F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string"))).alias("scope"),
        F.left("p_name", F.lit(5)).alias("constraint"), F.concat_ws(" ", "p_name", F.lower("p_brand"), size.cast("string")).alias("text"),
    )


@query(f"""
    with recursive {PARTS},
    w as (select *, list_distinct(string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), ' ')) as w, hash(subject, predicate, obligation) as k from p),
    d as (select *, min(id) over (partition by k, text) as c from (select *, row_number() over (partition by k, scope order by id) as n from w where scope is not null) where n = 1),
    s as (select *, min(id) over (partition by k, text) as c from w where scope is null),
    j as (select d.k, d.id as d, s.id as s, d.c as dc, s.c as sc, len(list_intersect(d.w, s.w)) / (len(d.w) + len(s.w) - len(list_intersect(d.w, s.w)))::double as score
        from d join s on d.subject = s.subject and d.predicate = s.predicate and d.obligation = s.obligation),
    e as (select k, d, s, row_number() over (partition by k order by score desc, dc, sc, d, s) as n from j where score >= 0.5),
    g as (select distinct k, 0::bigint as n, []::bigint[] as ds, []::bigint[] as ss from e
        union all select e.k, e.n, case when list_contains(g.ds, e.d) or list_contains(g.ss, e.s) then g.ds else list_append(g.ds, e.d) end,
            case when list_contains(g.ds, e.d) or list_contains(g.ss, e.s) then g.ss else list_append(g.ss, e.s) end from g join e on e.k = g.k and e.n = g.n + 1),
    t as (select unnest(ds) as "into", unnest(ss) as id from (select k, max_by(ds, n) as ds, max_by(ss, n) as ss from g group by k)),
    l as (select id, k, "constraint" as x, row_number() over (partition by k order by id) as n from s where id not in (select id from t)),
    h as (select distinct k, 0::bigint as n, []::struct(id bigint, x varchar)[] as cs, null::bigint as id, null::bigint as star from l
        union all select l.k, l.n, case when coalesce(len(list_filter(h.cs, lambda c: contains(c.x, l.x) or contains(l.x, c.x))), 0) = 0 then list_append(h.cs, struct_pack(id := l.id, x := l.x)) else h.cs end, l.id,
            coalesce(list_min(list_transform(list_filter(h.cs, lambda c: contains(c.x, l.x) or contains(l.x, c.x)), lambda c: c.id)), l.id) from h join l on l.k = h.k and l.n = h.n + 1)
    select p.id, coalesce(t."into", h.star, p.id) as "into" from p left join t on t.id = p.id left join h on h.id = p.id""")
def converge_rules(spark, sf_dir):
    """Summaries into details by greedy pairs, what is left by constraints that hold each other."""
    return convergence.converged(parts_as_rules(spark, sf_dir)).select("id", "into")


@query("""
    with o as (select o_orderkey as id, o_custkey::varchar as subject, o_orderstatus in ('O', 'F') as lintable, case when o_orderkey % 3 < 2 then 'presence' when o_orderkey % 6 = 2 then 'value' end as "check",
        case left(o_orderpriority, 1) when '1' then 5 when '2' then 4 when '3' then 3 when '4' then 2 else 0 end as s, o_orderpriority as ref from orders),
    l as (select subject, "check", arg_min(id, struct_pack(s := -s, i := id)) as lead from o where lintable and "check" is not null group by 1, 2),
    j as (select o.*, coalesce(lead, id) as "into" from o left join l on l.subject = o.subject and l."check" = o."check" and o.lintable)
    select id, "into", lintable and id = "into" as lintable, case when id <> "into" then 'same ' || "check" || ' as rule ' || "into"::varchar end as reason,
      case when id = "into" then (select string_agg(distinct k.ref, ',' order by k.ref) from j k where k."into" = j.id) else ref end as refs from j""")
def converge_observable(spark, sf_dir):
    """Orders stand for rules: of one customer's with equal checks under different predicates the strongest stays."""
    i, p = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    predicate = F.when(i % 3 == 0, "must_include").when(i % 3 == 1, "must_exist").when(i % 6 == 2, "must_equal").otherwise("other")
    duty = F.when(p == "1", "MUST").when(p == "2", "SHALL").when(p == "3", "SHOULD_NOT").when(p == "4", "MAY").otherwise("NONE")
    rules = read(spark, sf_dir, "orders").select(i.alias("id"), F.col("o_custkey").cast("string").alias("subject"), predicate.alias("predicate"), duty.alias("obligation"), F.col("o_orderstatus").isin("O", "F").alias("lintable"), F.array("o_orderpriority").alias("references"))
    return convergence.same_observable(rules).select("id", "into", "lintable", "reason", F.array_join("references", ",").alias("refs"))


CHILDREN = """
    r as (select l_orderkey * 10 + l_linenumber as id, case l_linenumber % 3 when 0 then 'n' || (l_suppkey % 5) when 1 then 'N' || (l_suppkey % 5) || '.s' || l_suppkey else 'n' || (l_suppkey % 5) || '.s' || l_suppkey || '.q' || l_partkey end as subject,
      l_returnflag as obligation from lineitem)"""


@query(f"""
    with {CHILDREN}, k as (select distinct lower(subject) as path, obligation from r),
    u as (select distinct a.path, b.path as below, a.obligation from k a join k b on a.obligation = b.obligation and starts_with(b.path, a.path || '.')),
    f as (select lower(subject) as path, obligation, min(id) as id from r group by 1, 2),
    t as (select u.path, u.obligation, min(f.id) as child from u join f on f.path = u.below and f.obligation = u.obligation
        where not exists (select 1 from u v where v.path = u.below and v.obligation = u.obligation) group by 1, 2)
    select r.id, coalesce(t.child, r.id) as "into" from r left join t on t.path = lower(r.subject) and t.obligation = r.obligation""")
def converge_children(spark, sf_dir):
    """Lines stand for rules about a nation, its supplier or the supplier's part."""
    s, n = F.col("l_suppkey").cast("string"), (F.col("l_suppkey") % 5).cast("string")
    path = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("n"), n)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("N"), n, F.lit(".s"), s)).otherwise(F.concat(F.lit("n"), n, F.lit(".s"), s, F.lit(".q"), F.col("l_partkey").cast("string")))
    rules = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), path.alias("subject"), F.col("l_returnflag").alias("obligation"))
    return convergence.into_children(rules).select("id", "into")


@query(f"""
    with recursive {PARTS},
    w as (select id, subject, obligation, "constraint" as x, list_distinct(string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), ' ')) as w, row_number() over (partition by subject, obligation order by id) as n from p),
    g as (select distinct subject, obligation, 0::bigint as n, []::struct(id bigint, w varchar[])[] as cs, null::bigint as id, null::bigint as star from w
        union all select w.subject, w.obligation, w.n,
            case when coalesce(len(list_filter(g.cs, lambda c: 3 * len(list_intersect(c.w, w.w)) > len(c.w) + len(w.w))), 0) = 0 then list_append(g.cs, struct_pack(id := w.id, w := w.w)) else g.cs end, w.id,
            coalesce(list_min(list_transform(list_filter(g.cs, lambda c: 3 * len(list_intersect(c.w, w.w)) > len(c.w) + len(w.w)), lambda c: c.id)), w.id)
            from g join w on w.subject = g.subject and w.obligation = g.obligation and w.n = g.n + 1)
    select w.id, arg_min(w.id, struct_pack(l := -length(w.x), i := w.id)) over (partition by g.star) as "into" from w join g on g.id = w.id""")
def converge_synonyms(spark, sf_dir):
    """Greedy stars of rules that share more than half of their words, the longest constraint stays."""
    return convergence.synonyms(parts_as_rules(spark, sf_dir)).select("id", "into")


@query(None)
def merge_fuzzy(spark, sf_dir):
    """Stars of parts of a type whose texts are alike by matched characters; held against a sequential version in tests."""
    d = read(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("text"))
    return discovery.fuzzy_merge(d, ["p_type"], "p_partkey", "text")


@query("""
    with recursive y as (select c_custkey as id, c_mktsegment as b, substr(c_name, length(c_name) - (c_custkey % 3)) as x, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer),
    g as (select distinct b, 0::bigint as n, []::struct(id bigint, x varchar)[] as cs, null::bigint as id, null::bigint as star from y
        union all select y.b, y.n, case when coalesce(len(list_filter(g.cs, lambda c: contains(c.x, y.x) or contains(y.x, c.x))), 0) = 0 then list_append(g.cs, struct_pack(id := y.id, x := y.x)) else g.cs end, y.id,
            coalesce(list_min(list_transform(list_filter(g.cs, lambda c: contains(c.x, y.x) or contains(y.x, c.x)), lambda c: c.id)), y.id) from g join y on y.b = g.b and y.n = g.n + 1)
    select id, star from g where id is not null""")
def merge_contained(spark, sf_dir):
    """Stars of texts one of which holds the other: the last digits of customer names by market segment."""
    c = read(spark, sf_dir, "customer")
    c = c.select("c_custkey", "c_mktsegment", F.expr("substr(c_name, length(c_name) - (c_custkey % 3))").alias("x"))
    return stars.greedy_stars(c, ["c_mktsegment"], "c_custkey", "x", 0.0, "contains").select(F.col("c_custkey").alias("id"), "star")
