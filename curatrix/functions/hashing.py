"""Fingerprints and hashed features."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered_digest(df: DataFrame, order: list[Column], piece: Column) -> DataFrame:
    """(digest, rows): SHA-256 over the pieces in an order.

    A digest of a sequence is made one byte after another, so its last step is one task; but that reads rows which others sorted, part by
    part, and holds a batch of them at a time. Parts must come in their order, or it fails.
    """

    def run(batches):
        digest, rows, part = hashlib.sha256(), 0, -1
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number < part:
                    raise ValueError("parts of the order were read out of turn")
                part, rows = number, rows + 1
                digest.update((value or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([rows], pa.int64())], ["digest", "rows"])

    keyed = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)], piece.alias("piece"))
    keys = [f"k{i}" for i in range(len(order))]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "piece")
    made = ordered.coalesce(1).mapInArrow(run, "digest string, rows long")
    return made.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))


def id_fingerprint(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """(fingerprint, rows): SHA-256 over the ids, each followed by NUL, in the given order; nulls add nothing. Use table_fingerprint where any order will do."""
    own = F.col(id_col).cast("string")
    return _ordered_digest(df, [F.col(order), own], F.concat(own, F.lit("\0"))).select(F.col("digest").alias("fingerprint"), "rows")


def table_fingerprint(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """(fingerprint, rows) of 20 hex digits, independent of row order: row digests are added up in a tree, never gathered."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(5)]
    summed = df.agg(F.count("*").alias("rows"), *parts)
    return summed.select(F.substring(F.sha2(F.concat_ws("/", F.lit(salt), F.col("rows").cast("string"), *[F.col(f"p{k}").cast("string") for k in range(5)]), 256), 1, 20).alias("fingerprint"), "rows")


def feature_fingerprint(cards: DataFrame, models: list[str]) -> DataFrame:
    """(fingerprint, rows) of what features depend on: ids, texts, pictures and the names of the models, whatever the row order."""
    return table_fingerprint(cards, [c for c in ("id", "text", "images") if c in cards.columns], "|".join(models))


def short_hash(df: DataFrame, id_col: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of the ids joined in ascending order."""
    own = F.col(id_col).cast("string")
    return _ordered_digest(df.where(own.isNotNull()), [own], own).select(F.substring("digest", 1, 16).alias("short_hash"))


def _slots(text: str, dim: int) -> list[tuple[int, float]]:
    out = []
    for token in text.casefold().split():
        number = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        out.append((number % dim, 1.0 if number & 1 else -1.0))
    return out


def signed_hash(c: Column, dim: int = 64) -> Column:
    """One signed slot per non-empty value, by a 64-bit digest; its lowest bit is the sign."""

    def made(values: pa.Array) -> pa.Array:
        rows = []
        for v in values.to_pylist():
            row = [0.0] * dim
            if v:
                number = int.from_bytes(hashlib.blake2b(v.casefold().encode(), digest_size=8).digest(), "big")
                row[number % dim] = 1.0 if number & 1 else -1.0
            rows.append(row)
        return pa.array(rows, pa.list_(pa.float64()))

    made.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(made, "array<double>")(c.cast("string"))


def token_hash_vector(c: Column, dim: int = 64) -> Column:
    """Signed token counts in dim slots, scaled to unit length: the stand-in text encoder."""

    def made(values: pa.Array) -> pa.Array:
        rows = []
        for v in values.to_pylist():
            row = [0.0] * dim
            for slot, sign in _slots(v or "", dim):
                row[slot] += sign
            size = sum(x * x for x in row) ** 0.5
            rows.append([x / size for x in row] if size else row)
        return pa.array(rows, pa.list_(pa.float64()))

    made.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(made, "array<double>")(c.cast("string"))
