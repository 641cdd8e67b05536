"""Vector compression by product quantisation in integers.

Every component x becomes floor(scale * x). Vectors are cut into equal consecutive parts; each part position has a codebook
of a few entries, which Lloyd's rounds move: a round assigns every part to its nearest entry and replaces an entry by the
componentwise floor of its parts' mean. A round is one pass over the stored vectors; a task answers with exact sums and
counts of the entries alone, which Spark adds up, so neither the driver nor a message ever grows with the number of vectors.

The nearest entry is found by partial distances. Dimensions are processed in descending variance of the codebook; all
vectors of a batch meet an entry at once, and a mask drops those whose accumulated distance strictly exceeds their best
complete distance. What is equal stays, so that ties go to the lower index, whatever the order of the search.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. A vector shorter than the
longest counts as filled up with zeros, and so does a length that the parts don't divide; empty vectors are all zeros. A
null vec_id comes last among the starting entries; equal ones (repeated rows) count each, in order of their vectors. With
fewer kept rows than entries, codebooks are that much shorter. Components of any finite size are exact (very large ones in
Python's integers); an error or a sum beyond a long is its largest value. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
HEAVY = 1024  # labels at most that are told to every task; any other holds less than that share of all rows
LIMB = 32
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part, entry, component; ``width`` components a part."""

    entries: list
    width: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()


def kept(df: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that count."""
    kind = df.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))).select("vec_id", "label", vector.alias("embedding"))


def exact_floor(x: float, scale: int) -> int:
    return floor(x) * scale if abs(x) >= 1 << 60 else floor(x * scale)


def integers(vectors: pa.ListArray, dims: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) by row and dimension; Python's integers where a component is beyond ``most``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(vectors), dims))
    if len(flat) == x.size:
        x = flat.reshape(x.shape)
    else:
        x[np.arange(dims)[None, :] < sizes[:, None]] = flat
    if not x.size or np.abs(x).max() * scale < most:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[exact_floor(v, scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def safe(width: int) -> int:
    """Components below it leave squared distances of ``width`` dimensions in 63 bits."""
    return isqrt((1 << 60) // max(width, 1))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; of equal ones the lower index."""
    n, width = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype)
    shift = max(int(abs(book).max()).bit_length() - 60, 0)
    order = np.argsort(-(book >> shift).astype(float).var(axis=0), kind="stable")
    columns, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    # a first complete distance: to an entry close by in the leading dimension
    lead = np.argsort(book[:, 0], kind="stable")
    best = lead[np.minimum(np.searchsorted(book[lead, 0], columns[0]), len(book) - 1)]
    least = ((columns.T - book[best]) ** 2).sum(axis=1)
    for e in range(len(book)):
        at = np.flatnonzero(best != e)
        summed = np.zeros(len(at), x.dtype)
        for j in range(width):
            if not len(at):
                break
            step = columns[j][at] - book[e, j]
            summed = summed + step * step
            stay = summed <= least[at]
            if not stay.all():
                at, summed = at[stay], summed[stay]
        wins = (summed < least[at]) | (best[at] > e)
        least[at[wins]], best[at[wins]] = summed[wins], e
    return best, least


def _assigned(books: Codebooks, batch_vectors):
    """Per part: the integers, the nearest entries and the distances."""
    parts, width = len(books.entries), books.width
    most = safe(width)
    x = integers(batch_vectors, parts * width, books.scale, most)
    plain = x.dtype != object and all(abs(c) < most for part in books.entries for e in part for c in e)
    x = x if plain else x.astype(object)
    for p, part in enumerate(books.entries):
        own = x[:, p * width : (p + 1) * width]
        book = np.array(part, np.int64 if plain else object).reshape(len(part), width)
        yield p, own, *nearest(own, book)


SUMS = "part int, entry int, pos int, limb int, value long"


def _summed(books: Codebooks):
    """Arrow iterator function: exact sums (pos 0 and up) and counts (pos -1) of a partition's entries, in limbs of 32 bits."""

    def run(batches):
        parts, k, width = len(books.entries), len(books.entries[0]), books.width
        total = np.zeros((parts, k, width + 1), object)
        for batch in batches:
            for p, x, entry, _ in _assigned(books, batch.column("embedding")):
                for e in range(k):
                    mine = x[entry == e]
                    if len(mine):
                        total[p, e, 0] += len(mine)
                        total[p, e, 1:] += mine.sum(axis=0).astype(object)
        rows = []
        for (p, e, i), v in np.ndenumerate(total):
            v, limb = int(v), 0
            while v:
                low, v = (v, 0) if -(1 << 31) <= v < 1 << 31 else (v & ((1 << LIMB) - 1), v >> LIMB)
                rows.append((p, e, i - 1, limb, low))
                limb += 1
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        released()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SUMS.split(", ")])

    return run


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: parts x entries x components sums come to the driver, however many vectors there are."""
    sums: dict[tuple, int] = {}
    for r in vectors.select("embedding").mapInArrow(_summed(books), SUMS).groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value")).collect():
        at = (r.part, r.entry, r.pos)
        sums[at] = sums.get(at, 0) + (r.value << (LIMB * r.limb))
    new = [
        [[sums.get((p, e, i), 0) // sums[p, e, -1] for i in range(books.width)] if (p, e, -1) in sums else entry for e, entry in enumerate(part)]
        for p, part in enumerate(books.entries)
    ]
    return Codebooks(new, books.width, books.scale)


def first_codebooks(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the rows with the smallest vec_ids."""
    width = -(-(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    full = [[exact_floor(v, scale) for v in r.embedding] + [0] * (parts * width - len(r.embedding)) for r in rows]
    return Codebooks([[v[p * width : (p + 1) * width] for v in full] for p in range(parts)], width, scale)


def _coded(books: Codebooks):
    def run(batches):
        for batch in batches:
            found = [(entry, least) for _, _, entry, least in _assigned(books, batch.column("embedding"))]
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            code = [row.tobytes().hex() for row in digits]
            error = [min(int(v), LARGEST) for v in sum(least.astype(object) for _, least in found)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
            released()

    return run


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of the kept rows, and the final codebooks. ``entries`` is 256 at most."""
    vectors = stored(kept(df), "vectors")
    books = first_codebooks(vectors, parts, entries, scale)
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.entries[0]:
        return df.sparkSession.createDataFrame([], schema), books
    for _ in range(rounds):
        books = moved(vectors, books)
    return vectors.mapInArrow(_coded(books), schema), books


def decompress(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``restored``: the scaled-down entries that a code names."""
    plan = F.array(*[F.array(*[F.array(*[F.lit(c / books.scale) for c in e]) for e in part]) for part in books.entries])
    digit = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("restored", F.flatten(F.array(*[plan[p][digit(p)] for p in range(len(books.entries))])))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds the errors summed over equal labels, nulls together. Labels with the most rows are told to every task (at most
    ``HEAVY``), so none of those that are joined by a shuffle holds more than 1/HEAVY of all rows."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n"))
    ordered = sums.orderBy(F.desc("n"), "label").limit(HEAVY)
    heavy = F.broadcast(ordered.select(F.col("label").alias("_label"), "label_error"))
    rest = sums.select(F.col("label").alias("_label"), F.col("label_error").alias("_rest"))
    same = codes["label"].eqNullSafe(F.col("_label"))
    hot = codes.join(heavy, same, "inner").drop("_label")
    cold = codes.join(heavy, same, "left_anti").join(rest, same, "inner").drop("_label").withColumnRenamed("_rest", "label_error")
    return hot.unionByName(cold)


def vector_codes(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    codes, books = compress(df)
    return with_label_error(stored(codes, "codes")).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
