"""Scans, filters, joins, aggregates, ranking and set operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import evaluation, relational
from ..session import read
from .registry import query

#: Aliases of search terms.
ALIASES = {"urgent": ["1-urgent", "top priority"], "building": ["building", "building segment"]}
MONEY = "decimal(18,2)"


def money(c):
    return F.sum(F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)).cast("double")


@query("""
    select doc_id, lang, source, n_chars from documents
    where (contains(lower(text), 'the ') or contains(lower(text), 'that') or contains(lower(source), 'the ') or contains(lower(source), 'that'))
      and lang = 'en' and n_chars >= 500
    order by n_chars desc, doc_id limit 25 offset 10""")
def search_documents(spark, sf_dir):
    """Keyword OR tree over columns and terms, filters, stable order, a page (the page is the feature)."""
    terms = relational.expand_terms(["the ", "that"], ALIASES)
    where = (F.col("lang") == "en") & (F.col("n_chars") >= 500)
    return relational.search(read(spark, sf_dir, "documents"), ["text", "source"], terms, where, [F.desc("n_chars"), F.asc("doc_id")], 10, 25).select("doc_id", "lang", "source", "n_chars")


@query("select lang, count(*) as n, sum(case when contains(lower(text), 'that') then 1 else 0 end)::bigint as hits from documents group by lang")
def search_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(relational.any_term(["text"], ["that"])).alias("hits"))


@query("""
    select r_name, n_name, count(*) as customers, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def join_inner(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast(MONEY)).alias("b"))  # aggregated before the join
    j = per.join(n, per.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("r_name", "n_name", "customers", F.col("b").cast("double").alias("balance"))


@query("""
    select o_orderkey, c_name, n_name, l.lines as lines, s.suppliers as suppliers
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    left join (select l_orderkey, count(*) as lines from lineitem where l_returnflag = 'R' group by 1) l on l.l_orderkey = o_orderkey
    left join (select l_orderkey, count(distinct l_suppkey) as suppliers from lineitem where l_quantity > 45 group by 1) s on s.l_orderkey = o_orderkey
    where o_orderpriority = '1-URGENT'""")
def join_chain_left_outer(spark, sf_dir):
    """Inner joins and two outer ones, as for edges with their source and target rules."""
    o, c, n, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    lines = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    sup = li.where("l_quantity > 45").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    j = urgent.join(c, urgent.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    j = j.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").join(sup.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return j.select("o_orderkey", "c_name", "n_name", "lines", "suppliers")


@query("""
    select c_custkey, c_name, null::bigint as orders, 'fallback' as origin from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey)
    union all select o_custkey, null, count(*), 'main' from orders group by o_custkey""")
def anti_join_fallback(spark, sf_dir):
    """Rows that the main set lacks are labelled and added, never dropped."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return relational.with_fallback(o, c, ["c_custkey"], "fallback").select("c_custkey", "c_name", "orders", "origin")


@query("""
    with i as (select l_partkey, l_suppkey, min(l_quantity) as lo, max(l_quantity) as hi from lineitem where l_returnflag = 'R' group by 1, 2)
    select a.l_partkey, a.l_suppkey as left_id, b.l_suppkey as right_id from i a join i b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey
    where greatest(a.lo, b.lo) <= least(a.hi, b.hi)""")
def join_interval_overlap(spark, sf_dir):
    """Theta self-join within a group: intervals that meet, pairs in one order."""
    i = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return relational.interval_pairs(i.withColumn("g", F.col("l_suppkey")), "l_partkey", "g", "lo", "hi", "l_suppkey")


@query("""
    with bands as (select p_size as band, min(p_retailprice) as lo, min(p_retailprice) + 0.5 as hi from part group by p_size)
    select band, count(*) as parts from part, bands where p_retailprice between lo and hi group by band""")
def join_range_buckets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    bands = p.groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("lo")).withColumn("hi", F.col("lo") + 0.5)
    return relational.range_join(p.select("p_retailprice"), bands, "p_retailprice", "lo", "hi", 1.0).groupBy("band").agg(F.count("*").alias("parts"))


@query("""
    with m as (select o_custkey, list(distinct o_orderpriority) as has from orders group by 1)
    select o_custkey, len(has)::int as n, list_has_any(has, ['1-URGENT', '2-HIGH']) as pressing, len(list_filter(['1-URGENT','2-HIGH','3-MEDIUM'], lambda x: not list_contains(has, x)))::int as missing from m""")
def set_conditions(spark, sf_dir):
    """IN / NOT IN sets: overlap and difference of arrays."""
    m = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("has"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return m.select("o_custkey", F.size("has").alias("n"), F.arrays_overlap("has", lit("1-URGENT", "2-HIGH")).alias("pressing"), F.size(F.array_except(lit("1-URGENT", "2-HIGH", "3-MEDIUM"), "has")).alias("missing"))


@query("""
    with h as (select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages),
    e as (select host as key, min(page_id) as entry from h group by 1)
    select h.page_id, (select entry from e where e.key = array_to_string(list_reverse(string_split(h.host, '.')), '.')) as entry_exact,
      h.host from h""")
def join_host_lookup(spark, sf_dir):
    """Lookup of a host by its reversed name: found only where the name is its own reverse."""
    h = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))
    e = h.groupBy(F.col("host").alias("key")).agg(F.min("page_id").alias("entry_exact"))
    r = h.withColumn("key", F.array_join(F.reverse(F.split("host", "[.]")), "."))
    return r.join(e, "key", "left").select("page_id", "entry_exact", "host")


@query("select o_orderpriority, count(*) as n from orders group by 1")
def agg_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
    select l_returnflag, l_linestatus, l_linenumber, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end)::bigint as discounted,
      cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue, round(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*), 6) as avg_quantity
    from lineitem group by 1, 2, 3""")
def agg_conditional(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), money("l_extendedprice").alias("revenue"), F.round(money("l_quantity") / F.count("*"), 6).alias("avg_quantity")
    )


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 30")
def agg_top_groups(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(30)


@query("""
    select day, orders, revenue from (select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue
    from orders group by 1 order by day desc limit 30) order by day""")
def agg_daily_trend(spark, sf_dir):
    """The newest 30 days, oldest first."""
    d = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), money("o_totalprice").alias("revenue"))
    return d.orderBy(F.desc("day")).limit(30).orderBy("day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "orders", "revenue")


@query("""
    select case when starts_with(p_name, 'small') then 'small' when starts_with(p_name, 'red') then 'red' else 'other' end as bucket, count(*) as n from part group by 1""")
def agg_prefix_buckets(spark, sf_dir):
    b = F.when(F.startswith("p_name", F.lit("small")), "small").when(F.startswith("p_name", F.lit("red")), "red").otherwise("other")
    return read(spark, sf_dir, "part").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("""
    select event_type, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total, sum(case when cast(json_extract_string(props, '$.k') as bigint) >= 50 then 1 else 0 end)::bigint as high from events group by 1""")
def agg_json_totals(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k >= 50).alias("high"))


@query("""
    select c_nationkey, count(*) as n, median(c_acctbal) as mid, min(c_acctbal) as low, max(c_acctbal) as high from customer group by 1""")
def agg_group_sizes(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.median("c_acctbal").alias("mid"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("""
    select o_custkey, max(case when o_orderstatus = 'O' then o_totalprice end) as lower_bound, min(case when o_orderstatus = 'F' then o_totalprice end) as upper_bound,
      coalesce(bool_or(o_orderpriority = '1-URGENT'), false) as forbidden, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) as primary_key,
      array_to_string(list(o_orderkey order by o_totalprice desc, o_orderkey), '>') as chain from orders group by 1""")
def agg_merge_rules(spark, sf_dir):
    """Tightest bounds, forbid over allow, pick by priority with a tie-break, and the chain of sources."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("lower_bound"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("upper_bound"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("forbidden"),
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("primary_key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), ">").alias("chain"),
    )


@query("""
    with r as (select user_id as lint, case when event_type = 'error' then 'error' when event_type = 'signup' then 'NA' else 'pass' end as status from events)
    select lint, fires, applies, case when applies = 0 then null else fires / applies::double end as error_frac, coalesce(fires / nullif(applies, 0)::double >= 0.3, false) as suspect
    from (select lint, sum(case when status = 'error' then 1 else 0 end)::bigint as fires, sum(case when status <> 'NA' then 1 else 0 end)::bigint as applies from r group by 1)""")
def triage_firing(spark, sf_dir):
    s = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "NA").otherwise("pass")
    return evaluation.firing(read(spark, sf_dir, "events").select(F.col("user_id").alias("lint"), s.alias("status")))


@query("""
    with v as (select user_id as lint, case event_type when 'error' then 'REAL' when 'click' then 'SPURIOUS' when 'view' then 'UNCERTAIN' end as verdict from events)
    select lint, sum(case when verdict = 'REAL' then 1 else 0 end)::bigint as "REAL", sum(case when verdict = 'SPURIOUS' then 1 else 0 end)::bigint as "SPURIOUS",
      sum(case when verdict = 'UNCERTAIN' then 1 else 0 end)::bigint as "UNCERTAIN" from v group by 1""")
def triage_verdicts(spark, sf_dir):
    v = F.when(F.col("event_type") == "error", "REAL").when(F.col("event_type") == "click", "SPURIOUS").when(F.col("event_type") == "view", "UNCERTAIN")
    return evaluation.verdict_table(read(spark, sf_dir, "events").select(F.col("user_id").alias("lint"), v.alias("verdict")))


@query("""
    with m as (select sum(case when quality = 1 and toxic = 0 then 1 else 0 end) tp, sum(case when quality = 1 and toxic = 1 then 1 else 0 end) fn,
      sum(case when quality = 0 and toxic = 0 then 1 else 0 end) fp, sum(case when quality = 0 and toxic = 1 then 1 else 0 end) tn from labels where quality is not null and toxic is not null),
    d as (select tp::double a, fn::double b, fp::double c, tn::double d, (tp + fn + fp + tn)::double n from m),
    k as (select *, (a + d) / n po, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n) pe from d)
    select a::bigint as tp, b::bigint as fn, c::bigint as fp, d::bigint as tn, round(po, 9) as agreement, round((po - pe) / (1 - pe), 9) as kappa, round(a / (a + c), 9) as precision,
      round(a / (a + b), 9) as recall, round(2 * a / (2 * a + c + b), 9) as f1 from k""")
def evaluate_agreement(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("said", 1 - F.col("toxic"))
    m = evaluation.agreement(rows, "quality", "said")
    return m.select("tp", "fn", "fp", "tn", *[F.round(c, 9).alias(c) for c in ("agreement", "kappa", "precision", "recall", "f1")])


@query("""
    select user_id, sum(case when event_type in ('purchase', 'click') then 1 else 0 end)::bigint as yes, count(*) as votes, sum(case when event_type in ('purchase', 'click') then 1 else 0 end) * 2 > count(*) as verdict from events group by 1""")
def vote_majority(spark, sf_dir):
    v = read(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("purchase", "click").alias("vote"))
    return evaluation.majority(v, ["user_id"], "vote")


@query("""
    select l_orderkey, case max(case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end) when 3 then 'full' when 2 then 'partial' else 'none' end as verdict from lineitem group by 1""")
def coverage_best(spark, sf_dir):
    v = F.when(F.col("l_returnflag") == "A", "full").when(F.col("l_returnflag") == "R", "partial").otherwise("none")
    return evaluation.best_coverage(read(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("verdict")), ["l_orderkey"])


@query("""
    select o_orderpriority, count(*) as total, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as full_n, sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as uncovered,
      sum(case when o_orderstatus not in ('F', 'O') then 1 else 0 end)::bigint as pending, true as conserved from orders group by 1""")
def coverage_conserved(spark, sf_dir):
    """Counts of one scan and the check that they add up."""
    s = F.col("o_orderstatus")
    t = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("full_n"), F.count_if(s == "O").alias("uncovered"), F.count_if(~s.isin("F", "O")).alias("pending"))
    return evaluation.conserved(t, "total", ["full_n", "uncovered", "pending"])


@query("""
    with r as (select user_id, event_id, cast(json_extract_string(props, '$.k') as bigint) as tokens from events),
    u as (select *, coalesce(sum(tokens) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as used from r)
    select user_id, event_id, tokens, least(tokens, 300 - used)::bigint as given from u where least(tokens, 300 - used) > 0""")
def window_budget(spark, sf_dir):
    """Rows in order while a budget lasts, the overflowing one cut."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("tokens"))
    return relational.budgeted(e, "user_id", [F.col("event_id")], "tokens", 300).select("user_id", "event_id", "tokens", "given")


@query("""
    select o_orderpriority, o_orderkey, place from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders)
    where place <= case o_orderpriority when '1-URGENT' then 50 when '2-HIGH' then 30 else 0 end""")
def window_quota(spark, sf_dir):
    """A share of a total for each priority."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    q = relational.quotas(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], {"1-URGENT": 0.5, "2-HIGH": 0.3}, 100)
    return q.select("o_orderpriority", "o_orderkey", "place")


@query("""
    select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as r from lineitem) where r = 1""")
def window_best(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return relational.best_of(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
    select conv_id, turn, last_value(case when role = 'user' then length(text) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row)::int as scope_now from conversations""")
def window_continuation(spark, sf_dir):
    from ..operators.discovery import continued

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text")).alias("scope"))
    return continued(c, "conv_id", "turn", "scope").select("conv_id", "turn", "scope_now")


@query("select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc nulls last, s_suppkey limit 20 offset 5")
def page_null_order(spark, sf_dir):
    """A page with the place of nulls spelled out."""
    return read(spark, sf_dir, "supplier").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").offset(5).limit(20).select("s_suppkey", "s_name", "s_acctbal")


@query("""
    select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem""")
def set_unordered_pairs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return relational.unordered_pairs(li, "a", "b")


@query("select c_mktsegment as value, count(*) as n, count(distinct c_nationkey) as nations, sum(case when c_acctbal < 0 then 1 else 0 end)::bigint as negative from customer group by 1")
def profile_column(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


