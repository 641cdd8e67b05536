"""Certificate logs: stored answers of a log's get-entries, read by ranges of indexes.

Batches lie in a table of Parquet files partitioned by ``block`` (index / BLOCK), so a range of indexes reads its blocks
alone; every store that Spark reads will do. An entry is decoded by the layout of RFC 6962 (sections 3.1 to 3.4 and 4.6).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 100_000  # entries of a block
STORED = "log_index long, leaf_input string, extra_data string, block long"
ENTRY = "log_index long, kind string, logged_at timestamp, role string, chain_index int, der binary, sha256 string"


def store_batches(batches: DataFrame, path: str) -> None:
    """Appends answers (start, entries: array of leaf_input and extra_data in base64) to a log's table."""
    rows = batches.select("start", F.posexplode("entries").alias("i", "e")).select((F.col("start") + F.col("i")).alias("log_index"), "e.leaf_input", "e.extra_data")
    rows.withColumn("block", F.floor(F.col("log_index") / BLOCK)).write.mode("append").partitionBy("block").parquet(path)


def _take(buf: bytes, at: int) -> tuple[bytes, int]:
    """A field with a length of three bytes, and where it ends."""
    end = at + 3 + int.from_bytes(buf[at : at + 3], "big")
    if at + 3 > len(buf) or end > len(buf):
        raise ValueError("cut short")
    return buf[at + 3 : end], end


def _chain(buf: bytes, at: int) -> list[bytes]:
    body, _ = _take(buf, at)
    out, at = [], 0
    while at < len(body):
        cert, at = _take(body, at)
        out.append(cert)
    return out


def decoded_entry(leaf: bytes, extra: bytes) -> tuple[int, str, list[bytes]] | None:
    """Milliseconds, kind, and the logged certificate with its chain; null for what is no such entry. A precertificate itself
    stands in the extra data."""
    try:
        if len(leaf) < 12 or leaf[0] or leaf[1]:
            return None
        kind = int.from_bytes(leaf[10:12], "big")
        if kind == 0:
            cert, _ = _take(leaf, 12)
            chain = _chain(extra, 0) if extra else []
        elif kind == 1:
            cert, at = _take(extra, 0)
            chain = _chain(extra, at) if at < len(extra) else []
        else:
            return None
    except ValueError:
        return None
    return int.from_bytes(leaf[2:10], "big"), ("x509", "precert")[kind], [cert, *chain]


def _decoded(batches):
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for index, leaf, extra in zip(*(batch.column(n).to_pylist() for n in ("log_index", "leaf", "extra"))):
            found = decoded_entry(leaf or b"", extra or b"")
            if found:
                ms, kind, certs = found
                rows += [(index, kind, ms * 1000, "chain" if i else f"logged_{kind}", i, der, hashlib.sha256(der).hexdigest()) for i, der in enumerate(certs)]
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def decoded(stored: DataFrame) -> DataFrame:
    """One row a certificate: the logged one (chain_index 0) and its chain. Entries that can't be decoded give none."""
    raw = stored.select("log_index", F.try_to_binary("leaf_input", F.lit("base64")).alias("leaf"), F.try_to_binary(F.coalesce("extra_data", F.lit("")), F.lit("base64")).alias("extra"))
    return raw.mapInArrow(_decoded, ENTRY)


def log_entries(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Certificates of the entries from ``start`` to before ``end``; blocks outside are not read."""
    rows = spark.read.schema(STORED).parquet(path).where((F.col("block") >= start // BLOCK) & (F.col("log_index") >= start))
    if end is not None:
        rows = rows.where((F.col("block") <= (end - 1) // BLOCK) & (F.col("log_index") < end))
    return decoded(rows)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream; where it stopped is kept by the query's checkpoint, so that a new run goes on from there."""
    return decoded(spark.readStream.schema(STORED).parquet(path))


def unique_certificates(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first entry of each certificate (least log_index, then chain_index), without those whose sha256 is known already. Only
    digests and places are grouped."""
    place = F.struct("log_index", "chain_index")
    first = entries.groupBy("sha256").agg(F.min(place).alias("p")).select("sha256", "p.*")
    if known is not None:
        first = first.join(known.select("sha256").distinct(), "sha256", "left_anti")
    return entries.join(first, ["sha256", "log_index", "chain_index"], "left_semi").dropDuplicates(["sha256", "log_index", "chain_index"])


def missing_ranges(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(first, last): what of a range isn't stored yet, to be fetched next. Blocks are looked at one by one, a task each."""
    from pyspark.sql import Window

    rows = spark.read.schema(STORED).parquet(path).where(F.col("block").between(start // BLOCK, (end - 1) // BLOCK)).where(F.col("log_index").between(start, end - 1))
    have = rows.select("block", "log_index").distinct()
    low, high = F.greatest(F.col("block") * BLOCK, F.lit(start)), F.least((F.col("block") + 1) * BLOCK, F.lit(end)) - 1
    ends = spark.range(start // BLOCK, (end - 1) // BLOCK + 1).select(F.col("id").alias("block"))
    edge = ends.select("block", (low - 1).alias("log_index")).union(ends.select("block", (high + 1).alias("log_index")))
    every = have.union(edge)
    after = F.lead("log_index").over(Window.partitionBy("block").orderBy("log_index"))
    return every.withColumn("after", after).where(F.col("after") > F.col("log_index") + 1).select((F.col("log_index") + 1).alias("first"), (F.col("after") - 1).alias("last"))
