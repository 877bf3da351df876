"""SimHash near-duplicates (operator 9): covering locality-sensitive hashing of 64-bit fingerprints.

Every bit gets a vector of r + 1 bits. For each of the 2^(r+1) - 1 non-zero vectors v, the mask of v keeps the
bits whose vector has an odd product with v. For any r differing bits some v is orthogonal to all of
their vectors, so that mask sees none of them: every pair within radius r collides in some table, with
certainty. Inside a bucket fingerprints agree on the mask's bits; a bucket over the bound is dealt
again by covering masks over the bits that are still free, which keeps the certainty and leaves half
the free bits each time, until fewer bits are free than a full bucket would need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_BYTES, settled, short_batches, texts_udf
from curatrix.operators.components import connected_components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: bit i is set if it is set in over half the hashes of the word shingles."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : min(n, at + _BLOCK)].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions so that any radius of them avoid some mask whole."""
    size = radius + 1
    made = []
    for v in range(1, 1 << size):
        # Bit number i carries the vector 1 + i mod (2^size - 1): all non-zero vectors, in turn.
        made.append(sum(1 << bit for i, bit in enumerate(bits) if ((1 + i % ((1 << size) - 1)) & v).bit_count() % 2))
    return made


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its component) inside one bucket, without the smallest themselves."""
    fps = np.sort(fps)
    raw = fps.view(np.uint64)
    near = np.zeros((len(raw), len(raw)), dtype=bool)
    for i in range(len(raw)):
        near[i] = np.bitwise_count(raw ^ raw[i]) <= radius
    label = np.arange(len(raw))
    while True:
        lower = np.where(near, label[None, :], len(raw)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(int(fps[i]), int(fps[k])) for i, k in enumerate(label) if i != k]


def linked_fingerprints(distinct: DataFrame, radius: int = 3, most: int = 2048) -> DataFrame:
    """(src, dst) edges over distinct fingerprints (column fp, long) that span their components at the radius.

    most bounds the fingerprints of a bucket that one task compares; a fuller bucket is dealt again.
    """
    session = distinct.sparkSession
    everything = (1 << 64) - 1

    def within(batches):
        for batch in batches:
            found = [pair for members in batch.column(0).to_pylist() for pair in _links(np.array(members, dtype=np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["src", "dst"])

    edges = session.createDataFrame([], "src long, dst long")
    # was: the bits on which the members of a full bucket agree already
    full, agreed = distinct.select("fp", F.lit(0).cast("long").alias("was")), [0]
    while agreed:
        steps = [(signed(was), signed(was | m)) for was in agreed for m in covering_masks([b for b in range(64) if not was >> b & 1], radius)]
        masks = F.create_map(*[x for was in agreed for x in (F.lit(signed(was)), F.array(*[F.lit(now) for w, now in steps if w == signed(was)]))])
        dealt = full.select("fp", F.explode(masks[F.col("was")]).alias("fixed")).withColumn("key", F.col("fp").bitwiseAND(F.col("fixed")))
        sized = settled(dealt.groupBy("fixed", "key").agg(F.count("*").alias("n")).where("n > 1"))
        small = dealt.join(sized.where(F.col("n") <= most), ["fixed", "key"]).groupBy("fixed", "key").agg(F.collect_list("fp").alias("m"))
        edges = edges.unionByName(small.select("m").mapInArrow(within, "src long, dst long"))
        if not sized.where(F.col("n") > most).limit(1).count():
            break
        full = settled(dealt.join(sized.where(F.col("n") > most), ["fixed", "key"]).select("fp", F.col("fixed").alias("was")).distinct())
        agreed = [r[0] & everything for r in full.select("was").distinct().collect()]  # at most 15 in the first step, each as full as a bucket may not be
    return edges


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fp, root, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most radius
    differing bits; equal fingerprints are linked; root names the group by its smallest fingerprint.
    Null and empty texts have fingerprint zero and link like any other. A null doc_id never becomes a
    component_id unless its group has no other. Repeated rows give repeated results; an empty table
    gives none. Texts of any length are hashed whole, in blocks of shingles; further columns are left out.
    """
    short_batches(docs.sparkSession)
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text))["fp"].alias("fp")))
    classes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(linked_fingerprints(classes.select("fp"), radius))
    rooted = classes.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(answer, "fp", "left").select("doc_id", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprints(text):
    return texts_udf(lambda x: (signed(fingerprint(x)),), "fp long", {"fp": pa.int64()})(text)


def _bounded(ids: DataFrame):
    """ids with a broadcast hint if their count proves them small enough."""
    return F.broadcast(ids) if ids.count() * 24 <= BROADCAST_BYTES else ids


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group left: that of its smallest doc_id (a null one if it has no other).

    Columns stay as they are. Of rows that repeat a doc_id within a group one stays.
    """
    groups = settled(simhash_groups(docs, doc_id, text, radius))
    repeated = settled(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id")))
    dropped = settled(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")))
    if not repeated.limit(1).count():
        return docs.join(_bounded(dropped), F.col(doc_id) == F.col("__id"), "left_anti")
    same = F.col(doc_id).eqNullSafe(F.col("__id"))
    once = docs.join(_bounded(repeated.unionByName(dropped).distinct()), same, "left_anti")
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    again = docs.join(_bounded(repeated), same, "left_semi").withColumn("__of", _fingerprints(F.col(text))["fp"])
    again = again.join(kept, same & (F.col("__of") == F.col("__fp"))).dropDuplicates(["__id", "__root"])
    return once.unionByName(again.drop("__of", "__id", "__fp", "__root"))
