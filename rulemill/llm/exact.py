"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per input partition with at most ``counters`` entries, name the frequent digests; an exact
count over the data verifies them. Their winners (at most ``counters`` rows) are broadcast, so rows of frequent digests
are decided where they are read; the rest is shuffled by digest, where every group is small.

Nulls: a null text is the empty text; a null doc_id is smaller than any other. Of repeated rows with the same doc_id
and text one stays. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored, text_or_empty

#: Entries of a summary, and rows of the broadcast at most. A digest with more than 2/(COUNTERS+1) of the rows is found for certain.
COUNTERS = 1024


def misra_gries(counters: int):
    """Arrow iterator function: one bounded summary (digest, n) for each partition."""

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                key, n = pair["values"].as_py(), pair["counts"].as_py()
                held[key] = held.get(key, 0) + n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> list[str]:
    """At most ``counters`` digests, with every one that holds over 2/(counters+1) of the rows."""
    parts = digests.select("digest").mapInArrow(misra_gries(counters), "digest string, n long")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    return [r.digest for r in top.collect()]


def exact_groups(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``rows``: uid, doc_id, digest (stored). Adds keep_uid, keep_id and group_size."""
    spark = rows.sparkSession
    keep, size = F.max(F.struct("doc_id", "uid")), F.count("*")
    schema = "digest string, keep_id long, keep_uid long, group_size long"
    names = frequent(rows, counters)
    near = spark.createDataFrame([(n,) for n in names], "digest string")
    verified = (
        rows.join(F.broadcast(near), "digest", "left_semi").groupBy("digest").agg(keep.alias("k"), size.alias("group_size")).where("group_size > 1")
        .select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.uid").alias("keep_uid"), "group_size").collect()
    )
    winners = F.broadcast(spark.createDataFrame(verified, schema))
    hot = rows.join(winners, "digest")
    w = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select("digest", "uid", "doc_id", keep.over(w).alias("k"), size.over(w).alias("group_size"))
    rest = rest.select("digest", "uid", "doc_id", F.col("k.doc_id").alias("keep_id"), F.col("k.uid").alias("keep_uid"), "group_size")
    return hot.select(rest.columns).union(rest)


def digests(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest, stored: all that deduplication moves."""
    digest = F.sha2(lower_ascii(text_or_empty()).cast("binary"), 256)
    return stored(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")), "digests")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(digests(docs), counters).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def without_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay. The text is moved once, to meet the kept (doc_id, digest)."""
    rows = digests(docs)
    kept = exact_groups(rows, counters).where("uid = keep_uid").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(lower_ascii(text_or_empty()).cast("binary"), 256).alias("digest"))
    found = own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own["digest"] == kept["_digest"]), "left_semi")
    if rows.groupBy("doc_id", "digest").count().where("count > 1").head(1):  # rows repeated with their doc_id
        found = found.dropDuplicates(["doc_id", "digest"])
    return found.select("row.*")
