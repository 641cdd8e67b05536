"""A training corpus from ``documents``: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's docs. All but the last keep the columns of ``documents``. Null texts have no language and
leave in the first stage; a null doc_id is compared as a value. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import dropped, stored, table
from rulemill.llm.exact import without_copies
from rulemill.llm.langid import identify
from rulemill.llm.ngram_join import ngram_join
from rulemill.llm.packing import pack_documents
from rulemill.llm.pii import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects."""
    return identify(docs).where(~F.col("rejected")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows equal in doc_id and text, one."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the least doc_id stays."""
    kept = ngram_join(docs, n=5, percent=80).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language id", language), ("exact dedup", exact), ("n-gram jaccard join", near), ("personal data", private), ("packing", pack)]
#: Language vectors, shingle joins and tokens cannot be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            dropped(last)  # nothing reads a stage's table once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
