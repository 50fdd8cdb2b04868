"""The corpus pipeline: toxicity, near duplicates, decontamination, pseudonyms, packing; each stage is written as Parquet and read again by the next.

Every stage but the last gives the columns of documents: a filtering stage gives the rows it keeps as they were, the pseudonyms change the text alone.
Null and empty texts pass the filters; they are packed as the closing id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, documents, fresh, staged
from tallyloom.llm.decontamination import without_contaminated
from tallyloom.llm.jaccard import one_of_each
from tallyloom.llm.packing import op1_packing
from tallyloom.llm.pii import pseudonymise
from tallyloom.llm.toxicity import labels_of, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    bounded_batches(spark)
    return without_toxic(docs, labels_of(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    bounded_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark windows."""
    bounded_batches(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format; n_chars is of the new text."""
    count, kinds = fresh(docs.columns, "n_pii", "kinds")
    out = pseudonymise(docs, count_col=count, kinds_col=kinds)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(count, kinds)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as fixed windows of tokens."""
    bounded_batches(spark)
    return op1_packing(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packing)]

#: Trained models, similarity classes and tokenizers are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
