"""Inverted index, scored retrieval, vectors and multi-channel matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from ..functions.vectors import cosine, dot, normalised
from . import cells, documents
from .components import connected
from .graph import maximal_cliques
from .storage import cut

#: Weights of the channels of a match and the bands of its score.
CHANNELS = {"subject": 0.25, "semantic": 0.30, "predicate": 0.20, "keyword": 0.15, "section": 0.10}
BANDS = ((0.85, "exact"), (0.65, "strong"), (0.40, "weak"))


def postings(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(term, key, freq)."""
    return rows.select(*key, F.explode(tokens_of(F.col(text))).alias("term")).groupBy("term", *key).agg(F.count("*").alias("freq"))


def retrieve(index: DataFrame, key: list[str], terms: list[str], k: int) -> DataFrame:
    """The k keys with the largest sum of term frequencies; ties by key."""
    return index.where(F.col("term").isin(*terms)).groupBy(*key).agg(F.sum("freq").alias("score")).orderBy(F.desc("score"), *key).limit(k)


def nearest(rows: DataFrame, ident: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows with the largest cosine to one vector, exactly."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(ident, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), ident).limit(k)


QUERIES, ROWS = 1024, 8192  # vectors of a block


def _best_of_block(ident: str, k: int):
    import numpy as np
    import pyarrow as pa

    def unit(vectors):
        m = np.array(vectors, float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query, found, score = [], [], []
        if asked.num_rows and rows.num_rows:
            ids = np.array(rows.column("id").to_pylist())
            cos = np.round(unit(asked.column("v").to_pylist()) @ unit(rows.column("v").to_pylist()).T, 6)
            for own, values in zip(asked.column("id").to_pylist(), cos):
                top = [i for i in np.lexsort((ids, -values))[: k + 1] if ids[i] != own][:k]
                query += [own] * len(top)
                found += ids[top].tolist()
                score += values[top].tolist()
        kind = rows.schema.field("id").type
        return pa.table({"query_id": pa.array(query, kind), ident: pa.array(found, kind), "score": pa.array(score, pa.float64())})

    return run


def nearest_each(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query_id, ident, score, place): for each query the k other rows with the largest cosine, to six places, exactly; ties by id.

    Queries and rows are dealt to blocks of bounded size; every pair of blocks is one matrix product, of which k rows a query
    are kept, so pairs are never rows and no task grows with the input."""
    part = lambda df, size: max(1, -(-df.count() // size))
    q, r = part(queries, QUERIES), part(rows, ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slim = lambda df: df.select(F.col(ident).alias("id"), F.col(vector).alias("v"), F.xxhash64(ident).alias("h"))
    own = lambda n: F.pmod("h", F.lit(n)).cast("int")
    asked = slim(queries).select("id", "v", own(q).alias("i"), every(r).alias("j"))
    given = slim(rows).select("id", "v", own(r).alias("j"), every(q).alias("i"))
    kind = rows.schema[ident].dataType.simpleString()
    best = asked.groupBy("i", "j").cogroup(given.groupBy("i", "j")).applyInArrow(_best_of_block(ident, k), f"query_id {kind}, {ident} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), ident)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def similar_pairs(rows: DataFrame, ident: str, block: str, vector: str, least: float) -> DataFrame:
    """(left_id, right_id, score) of one block at or above ``least``, by matrix products of pieces of the block; see ``cells``."""
    return cells.pairs_within(rows.select(block, F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")), block, least)


def similar_cliques(rows: DataFrame, ident: str, block: str, vector: str, least: float) -> DataFrame:
    """(component, clique): the maximal groups of rows of a block that are all similar pairs. Rows with equal vectors see the same
    others, so one row stands for them in pairs and searches, and all are written into its groups. A row whose id stands with
    several vectors stands for itself."""
    own = rows.where(F.col(block).isNotNull() & F.col(ident).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    own = cut(own.groupBy(block, vector).agg(F.collect_set(ident).alias("names")))
    each = own.select(block, vector, F.explode("names").alias("id"))
    often = cut(each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("alone")))
    if often.head(1):
        own = cut(each.join(often, "id", "left").groupBy(block, vector, "alone").agg(F.collect_set("id").alias("names")))
    own = own.select(block, vector, F.sort_array("names").alias("names")).withColumn("node", F.col("names")[0])
    unit = normalised(F.col(vector))
    members = cut(own.where(F.size("names") > 1).select("node", "names", (dot(unit, unit) >= least).alias("linked")))
    pairs = cut(similar_pairs(own, "node", block, vector, least).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))
    components = cut(connected(pairs))
    found = maximal_cliques(pairs, components, members=members)
    apart = members.where("linked").join(components.select("node"), "node", "left_anti")
    return found.unionAll(apart.select(F.col("node").cast("long").alias("component"), F.col("names").cast("array<long>").alias("clique")))


def channel_score(columns: dict[str, str | Column] | None = None):
    """Weighted sum of channels, given as columns or their names; a missing channel counts nothing. The semantic channel is a
    cosine in [-1, 1]."""
    c = {k: F.col(v) if isinstance(v, str) else v for k, v in ({k: k for k in CHANNELS} | (columns or {})).items()}
    value = lambda k: (F.coalesce(c[k], F.lit(-1.0)) + 1) / 2 if k == "semantic" else F.coalesce(c[k], F.lit(0.0))
    return sum((value(k) * w for k, w in CHANNELS.items()), F.lit(0.0))


def band(score):
    out = F.lit("none")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def top_matches(scored: DataFrame, left: str, right: str, k: int) -> DataFrame:
    w = Window.partitionBy(left).orderBy(F.desc("score"), right)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_matches(left: DataFrame, right: DataFrame, value: str, classes: list[str], k: int, score, step: float) -> DataFrame:
    """(id, class columns, other, score): of each class that has rows on the right, for every left row, k rows that hold the k
    best of the class, ties by id. left: id, value and the leading ``classes`` that it has itself; right: id, value, classes.

    ``score(own value, other value)`` may use the class columns too and must fall or stay as values part; where it stays (a
    null or NaN on a side, a cap) the least ids are the best. Values that are apart by ``step`` and more beyond each other must
    differ in score, if they do at all, so of the right rows only the nearest cells of that width matter on both sides: k + 1
    each, with the k least ids of a value. They lie side by side in the order of cells, so pairs are never rows."""
    shared = [c for c in classes if c in left.columns]
    usable = lambda c: c.isNotNull() & ~F.isnan(c)
    v = F.col(value).cast("double")
    cell = F.when(F.abs(v) < 1e15, F.floor(v / step).cast("double")).otherwise(v)
    entry = F.struct(F.col("id"), v.alias("v"))
    of_class = lambda *by: F.row_number().over(Window.partitionBy(*classes, *by).orderBy("id"))
    least = right.withColumn("_n", of_class()).where(F.col("_n") <= k).groupBy(*classes).agg(F.collect_list(entry).alias("_least"))
    near = right.where(usable(v)).withColumn("_n", of_class(value)).where(F.col("_n") <= k).groupBy(*classes, cell.alias("_cell")).agg(F.collect_list(entry).alias("_rows"))
    around = F.flatten(F.collect_list("_rows").over(Window.partitionBy(*classes).orderBy("_cell").rowsBetween(-k - 1, k + 1)))
    kind = right.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<id:{kind},v:double>>")
    floor = least.select(*classes, F.lit(float("-inf")).alias("_cell"), none.alias("_rows"))  # so that every left row has a cell below
    cells = near.unionByName(floor).withColumn("_around", around).select(*classes, "_cell", "_around", F.lit(0).alias("_side"))
    asked = left.join(least, [left[c].eqNullSafe(least[c]) for c in shared]).select(left["id"].alias("_id"), v.alias("_v"), *[least[c] for c in classes], "_least")
    asked = asked.withColumn("_cell", F.when(usable(F.col("_v")), F.when(F.abs("_v") < 1e15, F.floor(F.col("_v") / step).cast("double")).otherwise(F.col("_v"))).otherwise(float("-inf")))
    both = cells.unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    below = Window.partitionBy(*classes).orderBy("_cell", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_around", F.last("_around", True).over(below)).where("_side = 1")
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id")  # few bytes, yet much to score
    scored = F.transform(F.array_distinct(F.concat("_around", "_least")), lambda x: F.struct((-score(F.col("_v"), x["v"])).alias("s"), x["id"].alias("id")))
    best = met.select("_id", *classes, F.explode(F.slice(F.sort_array(scored), 1, k)).alias("b"))
    return best.select(F.col("_id").alias("id"), *classes, F.col("b.id").alias("other"), (-F.col("b.s")).alias("score"))


def version_edges(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """(newer_id, older_id): documents (id, source, title, version) of one source with similar titles; see ``documents``."""
    return documents.version_edges(docs, least).select(F.col("source_id").alias("newer_id"), F.col("target_id").alias("older_id"))
