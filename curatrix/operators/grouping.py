"""Entity groups: rows that share a key are one entity; components over all key families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.operators.components import connected_components
from curatrix.session import settled

#: Buckets fuller than this say nothing about identity (placeholders, templates).
MOST_TEXT, MOST_IMAGE, SHORTEST_KEY = 1000, 20, 8


def entity_keys(title: Column, text: Column, signature: Column | None = None) -> dict[str, tuple[Column, int]]:
    """Key families with the largest bucket that links: title, full text, head, tail, first image."""
    full = X.group_key(text)
    keys = {"title": (X.group_key(title), MOST_TEXT), "full_text": (full, MOST_TEXT), "text_head": (X.head_key(full), MOST_TEXT), "text_tail": (X.tail_key(full), MOST_TEXT)}
    return keys | ({"first_image": (signature, MOST_IMAGE)} if signature is not None else {})


def key_buckets(df: DataFrame, row_id: str, keys: dict[str, tuple[Column, int]]) -> DataFrame:
    """(row, kind, key, most) of keys of at least eight characters; the key is its digest, so long texts aren't shuffled.

    Keys are columns of their own before they are digested: what the families share is computed once, and each key once for its length and digest.
    """
    keyed = df.select(F.col(row_id).alias("row"), *[key.alias(f"__{kind}") for kind, (key, _) in keys.items()])
    digest = lambda k: F.when(F.length(k) >= SHORTEST_KEY, F.unhex(F.sha2(k, 256)))
    digested = keyed.select("row", *[digest(F.col(f"__{kind}")).alias(f"__{kind}") for kind in keys])
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"__{kind}").alias("key"), F.lit(most).alias("most")) for kind, (_, most) in keys.items()])
    return digested.select("row", F.explode(each).alias("k")).select("row", "k.*").where("key is not null")


def bucket_edges(buckets: DataFrame) -> DataFrame:
    """(src, dst) from every row of a bucket that links to its smallest row. The digests are written once, as both sides need them."""
    buckets = settled(buckets)
    sized = buckets.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("row").alias("dst"), F.first("most").alias("most")).where("n > 1 and n <= most")
    return buckets.join(sized.select("kind", "key", "dst"), ["kind", "key"]).where("row <> dst").select(F.col("row").alias("src"), "dst")


def entity_groups(df: DataFrame, row_id: str, keys: dict[str, tuple[Column, int]], more_edges: list[DataFrame] | None = None) -> DataFrame:
    """(row_id, entity_group): the smallest row reachable over shared keys and further (src, dst) edges; a row without links is its own group."""
    edges = reduce(DataFrame.unionByName, [bucket_edges(key_buckets(df, row_id, keys)), *(e.select("src", "dst") for e in more_edges or [])])
    found = connected_components(edges).withColumnRenamed("id", row_id)
    return df.select(row_id).join(found, row_id, "left").select(row_id, F.coalesce("component", F.col(row_id)).alias("entity_group"))


def equal_pairs(df: DataFrame, row_id: str, key: str) -> DataFrame:
    """(src, dst), src < dst, of rows with the same key: each row with the smallest of its key, which spans the same components as all pairs."""
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row_id).alias("src"), F.count("*").alias("n")).where("n > 1")
    return df.join(least, key).where(F.col(row_id) > F.col("src")).select("src", F.col(row_id).alias("dst"))


def write_groups(groups: DataFrame, path: str) -> None:
    """(row id, entity_group) kept for later splits."""
    groups.write.mode("overwrite").parquet(path)


def with_written_groups(df: DataFrame, path: str, row_id: str) -> DataFrame:
    """df with the entity_group written at path; a row that has none fails the query, as a split would leak."""
    kept = df.sparkSession.read.parquet(path)
    lacking = F.raise_error(F.concat(F.lit("no entity group for "), F.coalesce(F.col(row_id).cast("string"), F.lit("null")))).cast(kept.schema["entity_group"].dataType)
    return df.drop("entity_group").join(kept, row_id, "left").withColumn("entity_group", F.coalesce("entity_group", lacking))
