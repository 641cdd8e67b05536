"""Readers for rule documents, certificates, lint sources and test expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines become rows of nulls with the line in ``_corrupt_record`` when the schema names it."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def pem_certificates(spark: SparkSession, path: str) -> DataFrame:
    """(path, der): PEM files, every block of a file a row, decoded without Python."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pem").load(path)
    block = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\s]+)-----END CERTIFICATE-----"), F.lit(1))
    return files.select("path", F.posexplode(block).alias("block", "b64")).select("path", "block", F.unbase64(F.regexp_replace("b64", r"\s+", "")).alias("der"))


def lint_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(path, lint_name, citation, source) of lint source files."""
    t = text_documents(spark, path)
    f = lambda name: F.regexp_extract("text", rf'{name}:\s*"((?:[^"\\]|\\.)*)"', 1)
    return t.select("path", f("Name").alias("lint_name"), f("Citation").alias("citation"), F.regexp_extract("text", r"Source:\s*lint\.(\w+)", 1).alias("source")).where("lint_name <> ''")


def test_expectations(spark: SparkSession, path: str) -> DataFrame:
    """(path, lint, cert, status): expectations that test files state next to each other, in the order they stand."""
    t = text_documents(spark, path)
    certs = F.regexp_extract_all("text", F.lit(r'"([\w./-]+\.pem)"'), F.lit(1))
    status = F.regexp_extract_all("text", F.lit(r"lint\.(Pass|NA|Error|Warn|Notice|Fatal|NE)\b"), F.lit(1))
    lint = F.regexp_extract("text", r'TestLint\("([\w-]+)"', 1)
    return t.select("path", lint.alias("lint"), F.explode(F.arrays_zip(certs.alias("cert"), status.alias("status"))).alias("e")).select("path", "lint", "e.cert", F.lower("e.status").alias("status"))


def changed(current: DataFrame, known: DataFrame) -> DataFrame:
    """(url, content) rows whose url and SHA-256 aren't known yet."""
    c = current.withColumn("sha256", F.sha2("content", 256))
    return c.join(known.select("url", "sha256").distinct(), ["url", "sha256"], "left_anti")


def overwrite_partition(rows: DataFrame, path: str, key: str) -> None:
    """Rows of the given keys replace what is stored under them; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def markdown_report(title: str, parts: dict[str, DataFrame], rows: int = 100) -> str:
    """A report of small tables, at most ``rows`` rows of each."""
    out = [f"# {title}"]
    for name, df in parts.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out) + "\n"
