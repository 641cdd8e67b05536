"""Language identification: nearest centroid over normalised TF-IDF vectors of letter n-grams.

Document frequencies are counted over all training documents. Several centroids per language come from spherical
k-means on a bounded sample (``SAMPLE`` documents a language at most, the least by a hash of doc_id and text). A document takes the language
of the centroid with the largest cosine, which is its score; it is rejected when that cosine lies below what training
documents of that language and length, held back from their centroids, reach but for few, or when nothing can be said
(null, or no letter). Lengths are powers of two of letters; beginnings of the documents stand for short texts, and the
longest length with enough cosines stands for all above it.

Nulls: a null or letterless text gives ``und`` with score 0 and is rejected; a null lang is not learned from; a null
doc_id counts as the empty text in the fold rule. With nothing to learn from, every document is ``und``. Whole texts
are read, in blocks. Equal cosines go to the language first in order. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LETTER, class_table
from .common import released, small_batches

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
CENTROIDS = 4  # a language
SAMPLE = 500  # labelled documents a language for clustering and for the rejection bounds
PARTS = 64  # of a language, ranked each before they meet
DRAWN = 200_000  # drawn keys, of some 40 bytes, that are broadcast; more are joined by shuffling
BLOCK = 1 << 18  # code points vectorised at once, a longer text alone
ROWS = 256  # rows taken out of an Arrow batch at once
GROUPS = 16  # partial sums of document frequencies that reach the driver
FOLDS = 5  # parts of the sample, each compared with centroids of the others
CUTS = [4 << k for k in range(8)]  # code points of the beginnings that stand for short texts
LOW, LOW_SHORT, SHORT, MARGIN = 0.01, 0.02, 9, 0.6  # a document is rejected below MARGIN of this quantile of held-back cosines; short: under 2^SHORT letters
ENOUGH = 30  # cosines; a length with fewer is joined with the next shorter one
LENGTHS = 40
UNKNOWN = "und"


def counts_of(texts: list[str], dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x dims) and numbers of letters. Other characters separate words."""
    out, letters = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), np.int64)
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK:
            _count(texts[start:i], out[start:i], letters[start:i])
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        _count(texts[start:], out[start:], letters[start:])
    return out, letters


def _count(texts, out, letters):
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in low])
    letter = class_table()[points] == LETTER
    letters += np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters one blank stays
    keep[:-1] |= letter[1:] & ~letter[:-1]
    blank = ~letter & keep
    blank[1:] &= ~(blank[:-1] & keep[:-1])
    keep = letter | blank
    points, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep].astype(np.int64)
    dims, k = out.shape[1], out.shape[1].bit_length() - 1
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            own = owner[: len(h)]
            inside = own == owner[n - 1 :]
            slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - k)).astype(np.int64)
            out += np.bincount((own * dims + slot)[inside], minlength=out.size).reshape(out.shape)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """Unit centroids by cosine; farthest-first start, so that the outcome depends on the data alone."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _bucket(letters: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(letters, 1)).astype(np.int64)


def held_back(x: np.ndarray, letters: np.ndarray, texts: list[str], idf: np.ndarray, centroids: int) -> dict[int, list[float]]:
    """Cosines by length of one language's documents, and of their beginnings, with the centroids of the other folds."""
    found: dict[int, list[float]] = {}
    folds = min(FOLDS, len(x))
    fold = np.arange(len(x)) % folds
    for f in range(folds if folds > 1 else 0):
        c, at = spherical_kmeans(x[fold != f], centroids), np.flatnonzero(fold == f)
        cuts = [texts[i][:k] for i in at for k in CUTS if k < len(texts[i])]
        parts = [(x[at], letters[at])]
        for i in range(0, len(cuts), ROWS):
            counts, n = counts_of(cuts[i : i + ROWS])
            parts.append((weighted(counts, idf), n))
        for v, n in parts:
            for b, cos, m in zip(_bucket(n).tolist(), (v @ c.T).max(axis=1).tolist(), n.tolist()):
                if m:
                    found.setdefault(b, []).append(cos)
    return found


def bounds(found: dict[int, list[float]]) -> np.ndarray:
    """Least accepted cosine by length. It never falls as texts get longer."""
    out, best, more = np.full(LENGTHS, np.nan), np.inf, []
    for b in range(max(found, default=-1), -1, -1):
        more = more + found.get(b, [])
        if len(more) >= ENOUGH or (b == 0 and more and np.isnan(out).all()):
            best = min(best, float(np.quantile(more, LOW_SHORT if b < SHORT else LOW)) * MARGIN)
            out[b], more = best, []
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return out
    # a length without a bound takes that of the next shorter one, or of the least known
    return out[known[np.maximum(np.searchsorted(known, np.arange(LENGTHS), "right") - 1, 0)]]


def _frequencies(batches):
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            texts = [t for t in b.column("text").slice(at, ROWS).to_pylist() if t]
            if texts:
                x, _ = counts_of(texts)
                df += (x > 0).sum(axis=0)
                n += len(x)
    released()
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})


def _summed(group: pa.Table) -> pa.Table:
    df = sum(np.frombuffer(b, np.int64) for b in group.column("df").to_pylist())
    return pa.table({"n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})


def _vectors(batches):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            texts = [t or "" for t in b.column("text").slice(at, 64).to_pylist()]
            x, letters = counts_of(texts)
            begin = pa.array([t[: CUTS[-1] + 1] for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang").slice(at, 64), "letters": pa.array(letters, pa.int64()), "x": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), "begin": begin})


def fold():
    """crc32 of doc_id as text, modulo 3."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))


def drawn(known: DataFrame, sample: int, bounded: bool = False) -> DataFrame:
    """lang and text of ``sample`` rows a language at most: the least by a hash of doc_id and text, first in each of ``PARTS``
    parts, so that no language meets in one task. Equal rows, and those without doc_id, are ranked like others. ``bounded``:
    the caller knows that the drawn keys are few enough to broadcast."""
    keys = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.monotonically_increasing_id().alias("uid"))
    keys = keys.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(PARTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "uid")) <= sample
    for by in (("lang", "part"), ("lang",)):
        keys = keys.withColumn("first", first(*by)).where("first").drop("first")
    # how many rows of a hash are drawn; equal rows are alike, so any of them will do
    kept = keys.groupBy("lang", "h").agg(F.count("*").alias("n")).select(F.col("lang").alias("own"), F.col("h").alias("key"), "n")
    kept = F.broadcast(kept) if bounded else kept
    rows = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).join(kept, F.expr("lang = own and h = key"))
    rows = rows.groupBy("own", "key", "n").agg(F.first("text").alias("text"))
    return rows.select(F.col("own").alias("lang"), "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("lang", "text")


def fit(docs: DataFrame, train=None, sample: int = SAMPLE, centroids: int = CENTROIDS):
    """(languages, idf, centroids, owner of each centroid, least accepted cosine by language and length), or None if there is nothing to learn."""
    small_batches(docs.sparkSession)
    train = fold() != 1 if train is None else train
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    parts = known.select("text").mapInArrow(_frequencies, "n long, df binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).applyInArrow(_summed, "n long, df binary").collect()
    df, n = sum(np.frombuffer(r.df, np.int64) for r in parts), sum(r.n for r in parts)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    rows = drawn(known, sample, len(sizes) * sample <= DRAWN).mapInArrow(_vectors, "lang string, letters long, x binary, begin string").collect()
    languages = sorted(sizes)
    cents, owner, lows = [], [], np.full((len(languages), LENGTHS), np.nan)
    for i, lang in enumerate(languages):
        own = sorted((r for r in rows if r.lang == lang and r.letters > 0), key=lambda r: (r.begin, r.x))  # whatever order they came in
        if not own:
            continue
        x = weighted(np.stack([np.frombuffer(r.x, np.float32) for r in own]), idf)
        c = spherical_kmeans(x, centroids)
        lows[i] = bounds(held_back(x, np.array([r.letters for r in own]), [r.begin for r in own], idf, centroids))
        cents.append(c)
        owner += [i] * len(c)
    if not cents:
        return None
    # a language with a single document has nothing to hold back and takes the least bound of the others
    least = np.where(np.isnan(lows), np.inf, lows).min(axis=0)
    lows = np.where(np.isnan(lows), np.where(np.isfinite(least), least, 0.0), lows)
    return languages, idf, np.concatenate(cents), np.array(owner), lows


def predict(texts: list[str], model):
    """Language, score and rejection of each text."""
    if model is None:
        return [(UNKNOWN, 0.0, True)] * len(texts)
    languages, idf, cents, owner, lows = model
    out = []
    for at in range(0, len(texts), 256):
        counts, letters = counts_of(texts[at : at + 256])
        cos = weighted(counts, idf) @ cents.T
        best = cos.argmax(axis=1)
        value = np.clip(cos[np.arange(len(best)), best], 0, 1)
        low = lows[owner[best], np.minimum(_bucket(letters), LENGTHS - 1)]
        for b, v, n, m in zip(best.tolist(), value.tolist(), letters.tolist(), low.tolist()):
            out.append((languages[owner[b]], v, v < m) if n else (UNKNOWN, 0.0, True))
    return out


def identify(docs: DataFrame, model=None, fitted: bool = False) -> DataFrame:
    """row (a struct of all columns of ``docs``, so that no name can clash), lang_pred, score and rejected. Without
    ``fitted`` the model is learned from ``docs``."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    small_batches(docs.sparkSession)
    if not fitted:
        model = fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMENSIONS numbers
    schema = StructType([StructField("row", docs.schema), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = b.column(0)
            got = predict([t or "" for t in pc.struct_field(rows, "text").to_pylist()], held.value)
            cols = list(zip(*got)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([rows, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=schema.names)
        released()

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs)
    slim = docs.select("doc_id", (fold() == 1).alias("held_out"), "text")
    return identify(slim, model, fitted=True).select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")
