"""Sources and sinks: file inventories, receipts, tolerant ledgers, insert-if-absent and content-addressed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S


def scan(spark: SparkSession, root: str, glob: str | None = None, skip: str = r"/(\.git|node_modules|__pycache__)/") -> DataFrame:
    """path, bytes, sha256, loc of each file under root; unwanted directories are left out by a path filter."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.col("content").cast("string")
    return reader.load(root).where(~F.col("path").rlike(skip)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), S.line_count(text).alias("loc"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a last line that a crash has torn is left out, any other bad line stays as a row with _bad set."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"), F.col("content").cast("string").endswith("\n").alias("whole"), F.size(F.split(F.col("content").cast("string"), "\n")).alias("n"))
    rows = raw.where("text <> ''").withColumn("row", F.from_json("text", schema)).withColumn("_bad", ~S.valid_json(F.col("text")))
    return rows.where(~(F.col("_bad") & ~F.col("whole") & (F.col("line") == F.col("n") - 1))).select("path", "line", "row.*", "_bad")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming that are to be appended: new keys, one row each."""
    return incoming.dropDuplicates(key).join(existing.select(key), key, "left_anti")


def conflicts(existing: DataFrame, incoming: DataFrame, key: str, body: str) -> DataFrame:
    """Keys whose body differs from the stored one."""
    return incoming.select(key, F.col(body).alias("new")).join(existing.select(key, F.col(body).alias("old")), key).where(~F.col("new").eqNullSafe(F.col("old"))).select(key).distinct()


def write_archive(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """A digest of each row, for a check after a restore."""
    return df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))


def markdown_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each `## ` heading with its first file:line reference and weakness number."""
    parts = texts.select(key, F.posexplode(F.split(text, r"(?m)^## ")).alias("n", "part")).where("n > 0")
    return parts.select(key, "n", F.regexp_extract("part", r"^([^\n]*)", 1).alias("title"), F.regexp_extract("part", r"([\w./-]+\.\w+):([0-9]+)", 1).alias("file"), F.expr(r"try_cast(nullif(regexp_extract(part, '([\\w./-]+\\.\\w+):([0-9]+)', 2), '') as int)").alias("line"), F.regexp_extract("part", r"(?i)(CWE-[0-9]+)", 1).alias("cwe"))
