"""Queries of the knowledge operators: orders, parts and vectors stand for rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, knowledge
from ..session import read
from .registry import query


@query("select o_custkey, count(*) as n, round(avg(case when o_orderstatus = 'F' then 1 else 0 end), 9) as rate from orders group by 1")
def know_consistency(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return knowledge.consistency(o, ["o_custkey"], "ok").withColumn("rate", F.round("rate", 9))


@query("select p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::double, 9) as score from part")
def know_edit_similarity(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(knowledge.edit_similarity(F.col("p_name"), F.col("p_type")), 9).alias("score"))


@query("""
    with u as (select vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as l from embeddings),
    e as (select label, vec_id, generate_subscripts(v, 1) as i, unnest(v) / l as x from u), s as (select label, i, sum(x) as s from e group by 1, 2),
    n as (select label, count(*) as n from u group by 1)
    select label, n, round((sum(s * s) - n) / (n * (n - 1)), 6) as mean_similarity from s join n using (label) where n > 1 group by 1, n""")
def know_group_similarity(spark, sf_dir):
    """Mean cosine of all pairs of a label."""
    return knowledge.group_similarity(read(spark, sf_dir, "embeddings"), "label", "embedding").where("n > 1").withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("""
    with u as (select min(vec_id) as id, embedding::double[] as v from embeddings group by embedding), n as (select *, sqrt(list_dot_product(v, v)) as l from u),
    s as (select a.id as x, b.id as y, list_dot_product(a.v, b.v) / (a.l * b.l) as score from n a join n b on a.id < b.id)
    select x as left_id, y as right_id, round(score, 6) as score from s where score >= 0.5""")
def similar_anywhere(spark, sf_dir):
    """Cosine pairs of all vectors, without a block, by metric cells."""
    return cells.similar_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5).withColumn("score", F.round("score", 6))


@query("""
    select vec_id, min(vec_id) over (partition by embedding) as class from embeddings""")
def similar_classes(spark, sf_dir):
    """Which vectors are equal."""
    return cells.membership(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("""
    with u as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as l from embeddings),
    s as (select a.label, min(list_dot_product(a.v, b.v) / (a.l * b.l)) as m from u a join u b on a.label = b.label and a.vec_id < b.vec_id group by a.label)
    select label, count(*) as n, round(any_value(m), 6) as min_similarity from u left join s using (label) group by label""")
def know_least_similarity(spark, sf_dir):
    """Least cosine of two vectors of a label."""
    return cells.least_similarity(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("min_similarity", F.round("min_similarity", 6))


@query("""
    select p_partkey, unnest([
        struct_pack(field := lower(p_name), operator := '>', value := p_size::varchar || ' days'), struct_pack(field := lower(p_type), operator := 'EXISTS', value := null),
        struct_pack(field := 'size', operator := '<', value := p_size::varchar), struct_pack(field := lower(p_brand), operator := '==', value := lower(p_type))], recursive := true) from part""")
def know_conditions(spark, sf_dir):
    """Conditions of sentences made of the parts' columns."""
    text = F.concat(F.lit("If the "), "p_name", F.lit(" exceeds "), "p_size", F.lit(" days and its "), "p_type", F.lit(" is present, it MUST be marked, unless size is at least "), "p_size", F.lit("; where "), "p_brand", F.lit(" equals "), "p_type", F.lit("."))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(knowledge.conditions_of(text)).alias("c")).select("p_partkey", "c.*")
