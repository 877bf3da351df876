"""Sharding (operator 10): a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on the ring at many points, documents at one point each. A document belongs to the next
shard point clockwise; where that shard is full, it goes on clockwise to the first shard with room. The
capacities add up to the number of rows and differ by one at most, so the row counts do too. A
document's place only changes through the arcs next to a changed point and through what overflows.

Only the arcs' row counts reach the driver (shards x virtual nodes numbers, whatever the input); it
walks the arcs once and decides how many of each arc's rows, in ring order, go to which shard. Ranks
within an arc come from counts of fine ring cells plus a window over one cell, so no task ever sorts
more than one cell.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import settled


def ring_points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order; points come from SHA-256 of the shard's name and the replica."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(virtual):
            point, salt = None, 0
            while point is None or point in taken:
                digest = hashlib.sha256(f"shard-{shard}/{replica}/{salt}".encode()).digest()
                point, salt = int.from_bytes(digest[:4], "big"), salt + 1
            taken[point] = shard
    return sorted(taken.items())


def bounded_walk(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) of each stretch of an arc's rows that one shard takes.

    First every arc fills its own shard as far as the capacity goes; then what is left of each arc, in
    ring order, goes on clockwise to the shards that have room.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    stretches, left = [], []

    def give(arc: int, rank: int, n: int, shard: int) -> int:
        take = min(n - rank, room[shard] - used[shard])
        if take > 0:
            stretches.append((arc, rank, rank + take, shard, used[shard]))
            used[shard] += take
        return rank + max(0, take)

    for arc, n in enumerate(counts):
        if (rank := give(arc, 0, n, points[arc][1])) < n:
            left.append((arc, rank, n))
    open_points = [i for i, (_, s) in enumerate(points) if used[s] < room[s]]
    for arc, rank, n in left:
        while rank < n:
            at = bisect.bisect_right(open_points, arc) % len(open_points)
            shard = points[open_points[at]][1]
            rank = give(arc, rank, n, shard)
            if used[shard] == room[shard]:
                open_points = [i for i in open_points if points[i][1] != shard]
    return stretches


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, virtual: int = 64, cell_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    size is the text's UTF-8 bytes (null: none) plus 16, text_crc32 the unsigned CRC-32 of its UTF-8
    bytes (null: of no bytes). law is "rows": shard counts differ by one at most; slots are gapless from
    0 in each shard; grown_shard is null under this law. The ring point is a hash of the doc_id alone (null
    ones share a point); ties stand in order of doc_id, checksum and size. A key on very many rows fills
    several cells, told apart by checksum and then by where the rows are stored, and spreads over
    the clockwise shards as their room allows. Rows equal in everything may swap places, which changes
    nothing. An empty table gives an empty result; texts of any length count whole; further columns are left out.
    """
    session = docs.sparkSession
    points = ring_points(shards, virtual)
    ends = [p for p, _ in points]
    # The arc of a place: points before its 12-bit prefix, and those inside the prefix that lie before it.
    prefixes = [(q, bisect.bisect_left(ends, q << 20), [p for p in ends if p >> 20 == q]) for q in range(1 << 12)]
    prefixes = F.broadcast(session.createDataFrame(prefixes, "prefix long, base int, inside array<long>"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        place.alias("place"),
        F.spark_partition_id().alias("part"),
    )
    rows = rows.join(prefixes, F.shiftright("place", 20) == F.col("prefix"))
    arc = (F.col("base") + F.size(F.filter("inside", lambda p: p < F.col("place")))) % len(points)
    rows = settled(rows.select("doc_id", "size", "text_crc32", "place", "part", arc.alias("arc")))
    shift = 32 - min(32, max(4, (rows.count() // cell_rows + 1).bit_length()))
    rows = rows.withColumn("cell", F.shiftright("place", shift))
    cells = settled(rows.groupBy("arc", "cell").agg(F.count("*").alias("n")))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("arc", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(offsets, ["arc", "cell"])
    if cells.where(F.col("n") > 4 * cell_rows).limit(1).count():
        full = F.col("n") > 4 * cell_rows
        placed = placed.withColumn("fine", F.when(full, F.struct(F.shiftright("text_crc32", 20).alias("c"), F.col("part").alias("p"))))
        fine = placed.where(full).groupBy("arc", "cell", "fine").agg(F.count("*").alias("m"))
        inner = Window.partitionBy("arc", "cell").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
        fine = fine.select("arc", "cell", "fine", F.coalesce(F.sum("m").over(inner), F.lit(0)).alias("ahead"))
        placed = placed.join(fine, ["arc", "cell", "fine"], "left").withColumn("offset", F.col("offset") + F.coalesce("ahead", F.lit(0)))
        own = Window.partitionBy("arc", "cell", "fine")
    else:
        own = Window.partitionBy("arc", "cell")
    ranked = placed.withColumn("rank", F.col("offset") + F.row_number().over(own.orderBy("place", "doc_id", "text_crc32", "size")) - 1)
    counts = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    stretches = bounded_walk(points, [counts.get(i, 0) for i in range(len(points))], shards)
    stretches = F.broadcast(session.createDataFrame(stretches, "to_arc int, low long, high long, shard int, first long"))
    made = ranked.join(stretches, (F.col("arc") == F.col("to_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
