"""Embedding and feature caches: Parquet by id with a manifest row, and resumable batch inference."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.hashing import feature_fingerprint, table_fingerprint


class CacheMismatch(ValueError):
    """The cache isn't that of the rows it is asked for."""


def write_cache(vectors: DataFrame, path: str, model: str = "", complete: bool = True, mode: str = "", image_index: int = -1) -> None:
    """(id, embedding) under path/vectors and its manifest under path/manifest: ids, dimensions, model, mode of extraction, picture's number."""
    vectors.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    written = vectors.sparkSession.read.parquet(f"{path}/vectors")
    manifest = table_fingerprint(written, ["id"]).withColumns({"dimensions": F.lit(dimension(written)), "complete": F.lit(complete), "model": F.lit(model), "mode": F.lit(mode), "image_index": F.lit(image_index)})
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def dimension(vectors: DataFrame) -> int:
    row = vectors.select(F.size("embedding").alias("d")).limit(1).collect()
    return row[0]["d"] if row else 0


def read_cache(spark: SparkSession, path: str, expected: DataFrame | None = None, **identity) -> DataFrame:
    """(id, embedding) of a complete cache whose ids are exactly those of expected and whose manifest has the given identity (model, mode, image_index)."""
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest is None or not manifest["complete"]:
        raise CacheMismatch("the cache isn't complete")
    for name, value in identity.items():
        if manifest.asDict().get(name) != value:
            raise CacheMismatch(f"the cache has another {name}: {manifest.asDict().get(name)!r}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if expected is not None:
        wanted = table_fingerprint(expected.select(F.col("id").cast("string").alias("id")), ["id"]).first()
        if (wanted["fingerprint"], wanted["rows"]) != (manifest["fingerprint"], manifest["rows"]):
            raise CacheMismatch("the cache holds other ids")
    return vectors


def combine_caches(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Vectors of aligned caches, joined by id end to end; ids must be the same in all of them."""
    if not others:
        raise ValueError("two caches at least")
    out = first.select("id", "embedding")
    for k, other in enumerate(others):
        side = other.select("id", F.col("embedding").alias(f"__e{k}"))
        out = out.join(side, "id", "full_outer").select("id", F.when(F.col("embedding").isNotNull() & F.col(f"__e{k}").isNotNull(), F.concat("embedding", f"__e{k}")).alias("embedding"))
    return out.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.lit("the caches hold different ids"))))


#: One row of a resumable run's state: an attempt at a batch that is written whole.
STATE = "batch int, attempt string, rows long"


def run_resumable(rows: DataFrame, infer: Callable[[DataFrame], DataFrame], path: str, key: str = "id", batches: int = 8) -> DataFrame:
    """infer over rows in batches; a rerun takes up what is missing. One row for each key.

    A batch, which follows from the key, is written to a folder of its own attempt, and only then does a line of the state name that
    attempt: the one file that the line is appears at once. Reading goes by the state alone, so what a dead run left half-written
    or whole but unnamed is neither lost (the batch is done again) nor doubled (its old attempt is never read). Rows that are
    new since a batch was done become a further attempt at it. Rows that repeat a key, or have none, count once.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")
    for b in range(batches):
        part = rows.where(bucket == b).dropDuplicates([key])
        done = finished(spark, path, b)
        if done is not None:
            known = done.select(F.col(key).alias("__known"))
            part = part.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
            if not part.limit(1).count():
                continue
        attempt = uuid.uuid4().hex
        infer(part).write.parquet(f"{path}/attempts/{attempt}")
        commit_attempt(spark, path, b, attempt)
    return finished(spark, path)


def commit_attempt(spark: SparkSession, path: str, batch: int, attempt: str) -> None:
    """Name an attempt in the state, with the number of its rows as they are read back."""
    n = spark.read.parquet(f"{path}/attempts/{attempt}").count()
    spark.createDataFrame([(batch, attempt, n)], STATE).coalesce(1).write.mode("append").json(f"{path}/state")


def run_state(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, rows) of what is done so far; empty before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(STATE).json(f"{path}/state")
    except AnalysisException:
        return spark.createDataFrame([], STATE)


def finished(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame | None:
    """The rows of the attempts that the state names, of one batch or all; None if there are none."""
    state = run_state(spark, path)
    named = [r["attempt"] for r in (state if batch is None else state.where(F.col("batch") == batch)).collect()]
    return spark.read.parquet(*[f"{path}/attempts/{a}" for a in sorted(named)]) if named else None


def cached_features(cards: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str, models: list[str]) -> DataFrame:
    """compute(cards), kept under root by a fingerprint of ids, texts, pictures and the models' names; computed once for equal contents."""
    name = feature_fingerprint(cards, models).first()["fingerprint"]
    path = f"{root}/features-{name}"
    done = existing(cards.sparkSession, path)
    if done is None:
        compute(cards).write.mode("overwrite").parquet(path)
        done = cards.sparkSession.read.parquet(path)
    return done


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018  resolves the path
        return df
    except AnalysisException:
        return None
