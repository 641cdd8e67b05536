"""Importance resampling towards a target: hashed n-gram buckets of all documents and of all target texts give every
bucket a gain, a document's weight is the mean gain of its features, and a Gumbel key on top draws without replacement.

Counting is DuckDB's, one in-memory instance for each partition: texts are split and unnested, n-grams are built by windows over
the words of a text, and a registered function hashes distinct n-grams by zlib's CRC-32. What a partition finds (the buckets
of each document, and its bucket counts) is spilled to Parquet in the shared folder through Spark, whose commits survive
lost and repeated tasks. Spark merges the counts, scores the spilled documents without reading a text again, and ranks
the highest scores: only the candidates above the cut are sorted, by ranges, so no task sees more than its share.

Defined results: a null text has no words; a document without features weighs 0. A null doc_id is hashed as an empty id
and comes last among equal scores. Repeated doc_ids are rows of their own with the same key; rows of equal score and
doc_id are ordered by their number of features, then arbitrarily. Without documents there are no rows, without a target
all of its counts are 0. Texts are counted whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, released, small_batches, stored, tasks_for

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MEMORY = "600MB"  # of one DuckDB instance


def crc32(features: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(f) for f in features.cast(pa.binary()).to_pylist()], pa.uint32())


def counting_sql(ngram: int, buckets: int) -> str:
    """Over a table ``docs`` (i, text): i, number of features and their buckets."""
    grams = ["select i, word as feature from words"]
    for n in range(2, ngram + 1):
        joined = " || ' ' || ".join(["word"] + [f"lead(word, {k}) over own" for k in range(1, n)])
        grams.append(f"select i, {joined} as feature from words window own as (partition by i order by nth)")
    return f"""
        with split as (select i, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from docs),
        words as (select i, unnest(w) as word, generate_subscripts(w, 1) as nth from split),
        grams as materialized (select i, feature from ({" union all ".join(grams)}) where feature is not null),
        hashed as (select feature, (crc32(feature) % {buckets})::integer as bucket from (select distinct feature from grams))
        select i, list(bucket) as buckets, (select len(w) from split s where s.i = g.i) as n_words
        from grams g join hashed using (feature) group by i"""


SPILL = "kind int, row long, doc_id long, n_words long, buckets array<int>, bucket int, n long"


def _counted(ngram: int, buckets: int):
    """Arrow iterator function over (row, doc_id, text): kind 0 a document with its buckets, kind 1 a bucket of the partition."""

    def run(batches):
        import duckdb

        base = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        base.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        sql, total = counting_sql(ngram, buckets), np.zeros(buckets, np.int64)
        names = [x.split()[0] for x in SPILL.split(", ")]
        for batch in batches:
            n = batch.num_rows
            base.register("docs", pa.table({"i": pa.array(np.arange(n)), "text": batch.column("text")}))
            found = base.sql(sql).to_arrow_table() if n else None
            base.unregister("docs")
            words, lists = np.zeros(n, np.int64), [None] * n
            if found is not None and found.num_rows:
                at = found.column("i").to_numpy()
                words[at] = found.column("n_words").to_numpy()
                chunks = found.column("buckets").combine_chunks()
                flat, ends = chunks.flatten().to_numpy(), chunks.offsets.to_numpy()
                total += np.bincount(flat, minlength=buckets)
                ends = ends - ends[0]
                for k, i in enumerate(at.tolist()):
                    lists[i] = flat[ends[k] : ends[k + 1]]
            sizes = np.array([0 if x is None else len(x) for x in lists], np.int32)
            values = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))
            none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), batch.column("row"), batch.column("doc_id"), pa.array(words), arrays, *none], names)
            released()
        base.close()
        seen = np.flatnonzero(total)
        n = len(seen)
        gone = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n), pa.int32()), gone, gone, gone, pa.nulls(n, pa.list_(pa.int32())), pa.array(seen, pa.int32()), pa.array(total[seen])], names)

    return run


def spilled(df: DataFrame, what: str, ngram: int, buckets: int) -> DataFrame:
    """The counts of all rows of ``df`` (text, and doc_id where there is one), stored."""
    small_batches(df.sparkSession)
    own = df["doc_id"].cast("long") if "doc_id" in df.columns else F.lit(None).cast("long")
    rows = df.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), df["text"].cast("string").alias("text"))
    return stored(rows.mapInArrow(_counted(ngram, buckets), SPILL), what)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket: the parameter bounds what comes to the driver."""
    count = lambda df, s, t: df.where("kind = 1").select("bucket", (F.col("n") * s).alias("s"), (F.col("n") * t).alias("t"))
    merged = count(source, 1, 0).unionAll(count(target, 0, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(merged, "bucket", "left").na.fill(0)
    s, t = (sum(c) for c in zip(*[(r.s, r.t) for r in merged.select("s", "t").collect()] or [(0, 0)]))
    ratio = ((F.col("t") + 1) * F.lit(s + buckets)).cast("double") / ((F.col("s") + 1) * F.lit(t + buckets)).cast("double")
    rows = every.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def scored(source: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of every spilled document."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    docs = source.where("kind = 0").select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b)).alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    key = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return docs.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + key)


def ranked(rows: DataFrame, keep: int) -> DataFrame:
    """Adds ``rank`` (1, 2, ..) to the first ``keep`` rows by score down, doc_id up; null to the others of ``rows``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    dealt = stored(rows.repartitionByRange(tasks_for(rows, 64 << 20), *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, heads = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row a range
        heads.append((r.part, before))
        before += r["count"]
    base = F.broadcast(rows.sparkSession.createDataFrame(heads, "part int, head long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("head")
    return dealt.join(base, "part").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= keep, F.col("rank")).cast("long")).drop("part", "head")


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank (null where it isn't drawn)."""
    source = spilled(docs, "features", ngram, buckets)
    rows = stored(scored(source, gains(source, spilled(target, "target", ngram, buckets), buckets), seed), "scores")
    long = rows.where(F.col("n_words") >= least_words)
    # scores are thousandths of logarithms: their distinct values are bounded by the range of a logarithm of counts, not by the rows
    keep, left, cut = None, 0, None
    counts = sorted(((r.score, r["count"]) for r in long.groupBy("score").count().collect()), reverse=True)
    keep = left = percent * sum(n for _, n in counts) // 100
    for cut, n in counts:
        if left <= n:
            break
        left -= n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not keep:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = F.coalesce((F.col("n_words") >= least_words) & (F.col("score") >= cut), F.lit(False))
    out = ranked(rows.where(drawn), keep).select(*columns, "rank")
    return out.unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
