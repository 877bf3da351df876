"""A corpus pipeline: five stages, each of which works on all rows that the one before it kept.

In every stage: null texts count as empty and stay null, null ids are ids of their own, texts of any length are read whole, repeated
rows are judged alike (near_duplicates keeps one of them), an empty table stays empty, and all columns of documents stay as they are,
whatever their names; names beginning with two underscores are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.bpe import encode_texts
from curatrix.llm.decontaminate import benchmark_items, contamination, decontaminate
from curatrix.llm.pii import mask_pii
from curatrix.llm.simhash import drop_near_duplicates
from curatrix.llm.common import BROADCAST_BYTES
from curatrix.llm.toxicity import fit_toxicity, toxicity_score
from curatrix.session import settled, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is 0.5 or more go."""
    score = toxicity_score(fit_toxicity(docs, table(spark, sf_dir, "labels")), spark)
    return docs.where(score(F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    items = benchmark_items(benchmark, "item_id", "text", BROADCAST_BYTES)
    if items is None:
        return decontaminate(docs, benchmark, remove="documents").select(docs.columns)
    return docs.where(contamination(items, 10, spark)(F.col("text"))["n_hit"] == 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    made = mask_pii(docs)
    return made.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: doc_id, n_tokens, ids, and the text that the ids decode to."""
    return encode_texts(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("bpe", bpe)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
