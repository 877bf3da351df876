"""The registered queries of the llm operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.decontaminate import ORACLE as DECONTAMINATION
from curatrix.llm.embedding_dedup import ORACLE as EMBEDDING_DEDUP
from curatrix.llm.resampling import ORACLE as RESAMPLING
from curatrix.llm.spelling import ORACLE as SPELLING
from curatrix.llm.warc import ORACLE as WARC
from curatrix.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.pii import find_pii

    made = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.toxicity import score_toxicity

    made = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "held_out", "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.decontaminate import decontaminate

    made = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.quality import score_quality

    made = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "held_out", "score", "keep")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.bpe import encode_texts

    made = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.warc import shared_folder, write_and_read_archive

    return write_and_read_archive(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.resampling import importance_resample

    return importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {"op3_embedding_dedup": EMBEDDING_DEDUP, "op5_decontaminate": DECONTAMINATION, "op11_spelling_variants": SPELLING, "op12_warc": WARC, "op13_importance_resampling": RESAMPLING}
