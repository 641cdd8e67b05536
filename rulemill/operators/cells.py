"""Exact similarity over a whole table of vectors, without a given block.

Vectors are made unit; between units a cosine of t is a distance of sqrt(2 - 2 t). A bounded number of pivots splits the
space into cells: a vector lives in the cell of its nearest pivot and visits another cell only where the triangle inequality
allows a resident within reach: not farther from its pivot than twice the reach beyond the own one, nor than the reach
beyond the cell's radius. Pairs are found where the one with the lower cell lives, so each is found once. A cell with many rows is
cut into pieces of bounded size; pairs of pieces are matrix products in tasks of their own, and pieces whose distances to
the pivot are apart by more than the reach don't meet. Equal vectors are one: they can't make a cell hot.

Null and zero vectors, and vectors with null or non-finite components, have no cosine and are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

PIVOTS = 1024  # at most
PIECE = 16384  # rows of a piece
STEP = 256  # rows of a piece that are looked at together
SLACK = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; a row of zeros stays."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def usable(vector):
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda v: v != 0)


def representatives(rows: DataFrame, ident: str, vector: str, within: list[str] | None = None) -> DataFrame:
    """(within.., id, v, copies): equal vectors are one row, with the least id."""
    own = rows.where(usable(F.col(vector))).select(*(within or []), F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return own.groupBy(*(within or []), "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def membership(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, class): the least id with the same vector; rows without a usable vector are a class of their own."""
    key = F.when(usable(F.col(vector)), F.col(vector))
    own = rows.select(F.col(ident).alias("_id"), key.alias("_v"))
    lead = own.where("_v is not null").groupBy("_v").agg(F.min("_id").alias("_lead"))
    return own.join(lead, "_v", "left").select(F.col("_id").alias(ident), F.coalesce("_lead", "_id").alias("class"))


def pivots_of(rows: DataFrame, most: int = PIVOTS, size: int | None = None) -> np.ndarray:
    """A sample by hash, the same for the same rows: the square root of their number, ``most`` at most, and with a ``size`` no
    more than give cells of so many rows: where nothing can be pruned a row is sent to every cell."""
    n = rows.count()
    k = min(most, int(np.sqrt(n)) + 1, n, -(-n // size) if size else n)
    return unit(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(k).select("v").collect()], float).reshape(k, -1)) if k else np.zeros((0, 0))


def _located(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            d = _distances(unit(matrix(batch.column("v"))), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "d"])

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def located(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (.., v) with ``cell`` and ``d``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_located(pivots), f"{schema}, cell int, d double")


def _visits(pivots: np.ndarray, radius: np.ndarray, reach: float):
    """A row for the own cell and one for every cell that may hold a neighbour and has a lower number."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, STEP) for at in range(0, whole.num_rows, STEP)):  # a row may visit every cell
                v = unit(matrix(batch.column("v")))
                d = _distances(v, pivots)
                own = batch.column("cell").to_numpy()
                near = (d <= d[np.arange(len(d)), own][:, None] + 2 * reach + SLACK) & (d <= radius[None, :] + reach + SLACK) & (np.arange(len(pivots))[None, :] < own[:, None])
                near[np.arange(len(d)), own] = True
                at, cell = np.nonzero(near)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(v[at].ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), vectors, pa.array(cell, pa.int32()), pa.array(d[at, cell]), pa.array(cell == own[at])], ["id", "v", "cell", "d", "home"])

    return run


def _pairs(least: float, kind):
    """One pair of pieces: all pairs at or above ``least`` by matrix products of ``STEP`` rows, so that no more cosines and
    pairs are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        left, right = rows.filter(pa.compute.equal(rows.column("side"), 0)), rows.filter(pa.compute.equal(rows.column("side"), 1))
        same = bool(rows.column("same")[0].as_py())
        right = left if same else right
        a, b = unit(matrix(left.column("v"))), unit(matrix(right.column("v")))
        x, y = left.column("id").to_numpy(), right.column("id").to_numpy()
        del rows, left, right
        for at in range(0, len(a) if len(b) else 0, STEP):
            cos = a[at : at + STEP] @ b.T
            hit = ~(cos < least)  # a NaN is above all
            i, j = np.nonzero(hit & (np.arange(len(b))[None, :] > np.arange(at, at + len(cos))[:, None]) if same else hit)
            score, m, n = cos[i, j], x[at + i], y[j]
            if (m == n).any():
                i = np.flatnonzero(m != n)
                score, m, n = score[i], m[i], n[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(m, n), kind), pa.array(np.maximum(m, n), kind), pa.array(score)], ["left_id", "right_id", "score"])

    return run


def pairs_within(rows: DataFrame, block: str, least: float, size: int = PIECE) -> DataFrame:
    """(left_id, right_id, score): all pairs of a block with a cosine of ``least`` or more. rows: the block, id, v; a vector of
    zeros gives zeros; a null id, vector or component is in no pair, nor are vectors of two lengths.

    Every block is dealt to pieces of bounded size by hash, and every two pieces are a task of their own: what a task holds is
    bounded, and a vector is sent once for each piece of its block."""
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.where(F.col(block).isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select(F.col(block).alias("b"), F.size("v").alias("dim"), "id", "v")
    own = cut(own)
    parts = own.groupBy("b", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    own = own.join(parts, ["b", "dim"]).withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    last = F.col("parts") - 1
    left = own.select("b", "dim", F.col("p").alias("i"), F.explode(F.sequence("p", last)).alias("j"), "id", "v", F.lit(0).alias("side"))
    right = own.where("p > 0").select("b", "dim", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.col("p").alias("j"), "id", "v", F.lit(1).alias("side"))
    met = left.unionAll(right).withColumn("same", F.col("i") == F.col("j"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(spread, "b", "dim", "i", "j")  # few bytes, yet much to compute
    return met.groupBy("b", "dim", "i", "j").applyInArrow(_pairs(least, pa.int64() if kind == "bigint" else None), f"left_id {kind}, right_id {kind}, score double")


def pieces_of(rows: DataFrame, by: list[str], size: int = PIECE) -> DataFrame:
    """Adds ``piece``: rows of a cell in order of their distance to the pivot, ``size`` at most to a piece on average, and the
    bounds of the piece's distances. Only cells beyond the size are ordered, by their own histogram of distances."""
    step = 256
    slot = F.least(F.floor(F.col("d") / 2 * step), F.lit(step - 1)).cast("int")  # distances lie between 0 and 2
    rows = rows.withColumn("slot", slot)
    counts = rows.groupBy(*by, "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.withColumn("first", F.floor(before / size).cast("int")).withColumn("parts", F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int"))
    placed = rows.join(plan.select(*by, "slot", "first", "parts"), [*by, "slot"])
    return placed.withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("slot", "first", "parts")


def similar_pairs(rows: DataFrame, ident: str, vector: str, least: float, pivots: int = PIVOTS, size: int = PIECE) -> DataFrame:
    """(left_id, right_id, score): all pairs of different vectors with a cosine of ``least`` or more, as the least ids of
    their classes (see ``membership``)."""
    spark = rows.sparkSession
    own = cut(representatives(rows, ident, vector).select("id", "v"))
    kind = own.schema["id"].dataType.simpleString()
    p = pivots_of(own, pivots, size)
    if not len(p):
        return spark.createDataFrame([], f"left_id {kind}, right_id {kind}, score double")
    reach = float(np.sqrt(max(2 - 2 * least, 0)))
    at = cut(located(own, p))
    radius = np.full(len(p), -np.inf)
    for r in at.groupBy("cell").agg(F.max("d").alias("r")).collect():  # one row a pivot
        radius[r.cell] = r.r
    seen = at.mapInArrow(_visits(p, radius, reach), f"id {kind}, v array<double>, cell int, d double, home boolean")
    seen = cut(pieces_of(seen, ["cell", "home"], size))
    stats = seen.groupBy("cell", "home", "piece").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    a = stats.where("home").select("cell", F.col("piece").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = stats.select(F.col("cell").alias("c"), "home", F.col("piece").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    meets = (F.col("cell") == F.col("c")) & (~F.col("home") | (F.col("a") <= F.col("b"))) & (F.col("b_lo") <= F.col("a_hi") + reach + SLACK) & (F.col("a_lo") <= F.col("b_hi") + reach + SLACK)
    tasks = cut(a.join(b, meets).select("cell", "a", "home", "b", (F.col("home") & (F.col("a") == F.col("b"))).alias("same")))
    left = seen.where("home").select("cell", F.col("piece").alias("a"), "id", "v").join(tasks, ["cell", "a"]).select("cell", "a", "home", "b", "same", F.lit(0).alias("side"), "id", "v")
    right = seen.select("cell", "home", F.col("piece").alias("b"), "id", "v").join(tasks.where("not same"), ["cell", "home", "b"]).select("cell", "a", "home", "b", "same", F.lit(1).alias("side"), "id", "v")
    kinds = pa.int64() if kind == "bigint" else None
    met = left.unionAll(right).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "a", "home", "b")  # few bytes, yet much to compute
    return met.groupBy("cell", "a", "home", "b").applyInArrow(_pairs(least, kinds), f"left_id {kind}, right_id {kind}, score double")


def _farthest(kind):
    """The least cosine between (or within) two pieces of one group."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(pa.compute.equal(rows.column("side"), 0)), rows.filter(pa.compute.equal(rows.column("side"), 1))
        right = left if rows.column("same")[0].as_py() else right
        a, b = unit(matrix(left.column("v"))), unit(matrix(right.column("v"))).T
        low = min(float((a[at : at + STEP] @ b).min()) for at in range(0, len(a), STEP))
        return pa.table({"g": pa.array([rows.column("g")[0].as_py()], kind), "least": pa.array([float(np.clip(low, -1, 1))])})

    return run


def _from_centre(batches):
    """Distances to a centre that stands in the row."""
    for batch in batches:
        d = np.sqrt(np.maximum(2 - 2 * (unit(matrix(batch.column("v"))) * matrix(batch.column("c"))).sum(axis=1), 0))
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("id"), pa.array(d)], ["g", "id", "far"])


def least_similarity(rows: DataFrame, group: str, ident: str, vector: str, pivots: int = PIVOTS, size: int = PIECE) -> DataFrame:
    """(group, n, min_similarity): the least cosine of two members of a group; null for a group of one.

    Two sweeps (from some member to the farthest, from that to its farthest) give a pair to beat. Members are cut into pieces
    by their nearest pivot; two pieces can't hold a farther pair than their pivots' distance and both radii allow, and only
    pieces that may beat the pair found meet, as matrix products."""
    spark = rows.sparkSession
    counts = rows.where(usable(F.col(vector))).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    own = cut(representatives(rows, ident, vector, [group]).select(F.col(group).alias("g"), "id", "v"))
    kind, g_kind = own.schema["id"].dataType.simpleString(), own.schema["g"].dataType.simpleString()
    largest = counts.agg(F.max("n")).first()[0] or 0
    p = pivots_of(own, min(pivots, -(-largest // size)))
    result = lambda found: counts.join(found, counts["g"].eqNullSafe(found["k"]), "left").select(counts["g"].alias(group), "n", F.when(F.col("n") > 1, F.coalesce("least", F.lit(1.0))).alias("min_similarity"))
    if not len(p):
        return result(spark.createDataFrame([], f"k {g_kind}, least double"))

    def farthest(centres):
        """The member farthest from each group's centre, as the next centre, with its distance."""
        j = own.join(centres, own["g"].eqNullSafe(centres["k"])).select(own["g"], "id", "v", "c")
        d = j.mapInArrow(_from_centre, f"g {g_kind}, id {kind}, far double")
        top = d.groupBy("g").agg(F.max(F.struct("far", "id")).alias("t")).select(F.col("g").alias("k"), F.col("t.far").alias("far"), F.col("t.id").alias("top"))
        return cut(own.join(top, own["g"].eqNullSafe(top["k"]) & (own["id"] == top["top"])).select("k", _unit_column("v").alias("c"), "far"))

    start = own.groupBy("g").agg(F.min_by("v", "id").alias("v")).select(F.col("g").alias("k"), _unit_column("v").alias("c"))
    beat = farthest(farthest(cut(start)).select("k", "c")).select("k", "far")
    at = located(own, p)
    at = cut(at.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 16))))
    stats = at.groupBy("g", "cell").agg(F.max("d").alias("r"), F.ceil(F.count("*") / size).cast("int").alias("parts"))
    between = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(_distances(p, p))], "cell int, apart array<double>")  # pivots squared, bounded
    a = stats.join(F.broadcast(between), "cell").select("g", F.col("cell").alias("x"), F.col("r").alias("x_r"), F.col("parts").alias("x_parts"), "apart")
    b = stats.select(F.col("g").alias("h"), F.col("cell").alias("y"), F.col("r").alias("y_r"), F.col("parts").alias("y_parts"))
    pairs = a.join(b, F.col("g").eqNullSafe(F.col("h")) & (F.col("x") <= F.col("y"))).join(beat, F.col("g").eqNullSafe(F.col("k")))
    pairs = pairs.where(F.col("apart")[F.col("y")] + F.col("x_r") + F.col("y_r") + SLACK >= F.col("far"))
    grid = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("y_parts") - 1)))
    grid = cut(grid.where("x < y or i <= j").select(F.col("g").alias("h"), "x", "y", "i", "j", "x_parts", "y_parts", ((F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))).alias("same")))
    side = lambda c, k, n: at.join(grid, at["g"].eqNullSafe(grid["h"]) & (at["cell"] == grid[c]) & (F.pmod(at["part"], grid[n]) == grid[k])).select(at["g"], "x", "y", "i", "j", "same", "v")
    left, right = side("x", "i", "x_parts").withColumn("side", F.lit(0)), side("y", "j", "y_parts").where("not same").withColumn("side", F.lit(1))
    arrow = pa.int64() if g_kind == "bigint" else pa.int32() if g_kind == "int" else pa.string() if g_kind == "string" else None
    met = left.unionAll(right).groupBy("g", "x", "y", "i", "j").applyInArrow(_farthest(arrow), f"g {g_kind}, least double")
    return result(met.groupBy(F.col("g").alias("k")).agg(F.min("least").alias("least")))


def _unit_column(name: str):
    norm = F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(name, lambda x: x / norm)
