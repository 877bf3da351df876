"""Embedding near-duplicates (operator 3): lattice hashing.

Every unit vector is projected at random to blocks of eight dimensions, each block is decoded to its
nearest point of the lattice E8, and the points of a table's blocks make up its cell. A vector stands in its
home cell and in the neighbouring cells whose lattice points come next; two vectors meet where one of
them is at home. Cosines of those that meet are verified in double precision.

Equal vectors are one class, with a weight. A cell over the block size is compared block by block; a
task returns a count and one edge for each vector of a block, never its pairs. A pair that meets in
several cells counts in the first only. The setting is for cosine 0.9 and holds the chance that a pair
meets at 0.99 or more there, and higher above it. It is the same for tables of every size, so whether two vectors
link depends on them alone.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_BYTES, settled
from curatrix.operators.components import connected_components


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors of even sum: round, and where the sum is odd turn the worst rounding over."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the nearer of those in D8 and in D8 + 1/2."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    """The hash tables for vectors of one dimension."""

    def __init__(self, dim: int, blocks: int, scale: float, probes: int, tables: int, seed: int = 20):
        self.dim, self.blocks, self.probes, self.tables = dim, blocks, probes, tables
        rng = np.random.default_rng(seed)
        width = 8 * blocks
        wide = max(dim, width)
        self.maps = [np.linalg.qr(rng.normal(size=(wide, width)))[0][:dim] * scale * np.sqrt(wide / 64) for _ in range(tables)]
        self.codes = rng.integers(-(1 << 62), 1 << 62, size=(tables, width))
        self.salts = rng.integers(-(1 << 62), 1 << 62, size=tables)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) cell codes, the home cell first."""
        n = len(unit)
        out = np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            y = (unit @ self.maps[t]).reshape(n * self.blocks, 8)
            point = nearest_e8(y)
            with np.errstate(over="ignore"):
                home = ((point * 2).astype(np.int64).reshape(n, -1) * self.codes[t]).sum(axis=1) + self.salts[t]
                step = (ROOTS * 2).astype(np.int64) @ self.codes[t].reshape(self.blocks, 8).T  # (240, blocks)
                gain = ((y - point) @ ROOTS.T).reshape(n, self.blocks * len(ROOTS))
                top = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
                out[:, t, 0] = home
                out[:, t, 1:] = home[:, None] + step.T.reshape(-1)[top]
        return out


def settings(*_: int) -> dict:
    """The one setting, whatever the size: fine enough that chance partners stay few, with as few cells a vector as the recall allows."""
    return {"blocks": 2, "scale": 3.75, "probes": 4, "tables": 11}


def _units(vectors: np.ndarray) -> np.ndarray:
    wide = np.asarray(vectors, dtype=np.float64)
    wide = wide / np.maximum(np.abs(wide).max(axis=1, keepdims=True), 1e-300)  # so that no square overflows
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of cell arrays (pairs, tables, 1 + probes): the cell in which each pair meets first."""
    here = (a[:, :, :1] == b).any(axis=2)  # a's home among b's cells
    there = (b[:, :, :1] == a).any(axis=2)
    table = (here | there).argmax(axis=1)
    rows = np.arange(len(a))
    home_a, home_b = a[rows, table, 0], b[rows, table, 0]
    low, high = np.minimum(home_a, home_b), np.maximum(home_a, home_b)
    low_ok = np.where(home_a <= home_b, here[rows, table], there[rows, table])
    return np.where(low_ok, low, high)


def _block(unit: np.ndarray, home: np.ndarray, side: np.ndarray, weight: np.ndarray, cell: int, threshold: float, lattice: Lattice, across: bool):
    """(linked weight counted in this cell, root index) of each member; root of what the block's links connect."""
    n = len(unit)
    count, label = np.zeros(n, dtype=np.int64), np.arange(n)
    near = (unit @ unit.T) >= threshold
    near &= home[:, None] | home[None, :]
    if across:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    if not len(i):
        return count, label
    who, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    cells = lattice.cells(unit[who])
    at_i, at_j = place[: len(i)], place[len(i) :]
    for k in range(0, len(i), 50_000):
        part = slice(k, k + 50_000)
        mine = _first_meeting(cells[at_i[part]], cells[at_j[part]]) == cell
        np.add.at(count, i[part][mine], weight[j[part][mine]])
        np.add.at(count, j[part][mine], weight[i[part][mine]])
    return count, _components(i, j, n)


def _small_blocks(units: np.ndarray, rows: np.ndarray, home: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float):
    """(number of the block, member, member) of all links within blocks of few members; blocks of one size are multiplied side by side.

    Members are places in rows, which name the rows of units.
    """
    found = [(np.empty(0, np.int64),) * 3]
    for size in np.unique(sizes).tolist():
        blocks = np.flatnonzero(sizes == size)
        upper = np.triu(np.ones((size, size), dtype=bool), 1)
        step = max(1, (1 << 22) // (size * max(size, units.shape[1])))
        for k in range(0, len(blocks), step):
            part = blocks[k : k + step]
            members = starts[part][:, None] + np.arange(size)
            x, at_home = units[rows[members]], home[members]
            near = (np.matmul(x, x.transpose(0, 2, 1)) >= threshold) & (at_home[:, :, None] | at_home[:, None, :]) & upper
            b, i, j = np.nonzero(near)
            found.append((part[b], members[b, i], members[b, j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each of n vertices' component under the edges a - b."""
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


class _Known:
    """Units of a bank's vectors, and cells of those that were asked for while they take no more than 32 MB."""

    def __init__(self, lattice: Lattice, units: np.ndarray):
        self.lattice, self.units = lattice, units
        per = lattice.tables * (1 + lattice.probes)
        self.have = np.zeros(len(units), dtype=bool) if len(units) * per * 8 <= 32 << 20 else None
        self.cells = np.empty((len(units), lattice.tables, 1 + lattice.probes), dtype=np.int64) if self.have is not None else None

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        if self.have is None:
            return self.lattice.cells(self.units[rows])
        new = rows[~self.have[rows]]
        if len(new):
            self.cells[new] = self.lattice.cells(self.units[new])
            self.have[new] = True
        return self.cells[rows]


#: Blocks of at most so many members are compared side by side.
SMALL = 96
_banks: dict[int, tuple] = {}


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, block: int = 768) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows whose vector has a cosine of at least the threshold; component_id is the
    smallest vec_id reachable over links, kept tells whether it is the row's own. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; the others link within their
    dimension, each dimension with a join of its own. Repeated rows count as rows; a null vec_id
    stands for itself where its component has no other; further columns are left out; an empty table gives an empty one. The tables
    are set for thresholds of 0.9 and above.
    """
    e = F.col(embedding)
    sound = e.isNotNull() & (F.size(e) > 0) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(e, lambda x: x != 0)
    key = F.when(sound, F.unhex(F.md5(F.array_join(e.cast("array<string>"), ",").cast("binary"))))
    rows = settled(vectors.select(F.col(vec_id).alias("vec_id"), key.alias("key"), F.size(e).alias("dim")))
    dims = [r["dim"] for r in rows.where("key is not null").select("dim").distinct().orderBy("dim").collect()]
    alone = rows.withColumn("component_id", F.col("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), "component_id", F.lit(True).alias("kept"))
    if not dims:
        return alone
    answers = [_links_within(vectors, vec_id, e, sound, key, dim, threshold, block) for dim in dims]
    made = rows.join(reduce(DataFrame.unionByName, answers), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return made.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links_within(vectors: DataFrame, vec_id: str, e, sound, key, dim: int, threshold: float, block: int) -> DataFrame:
    """(key, component_id, n_links) of the sound vectors of one dimension."""
    session = vectors.sparkSession
    value = e if vectors.select(e.alias("e")).dtypes[0][1] == "array<float>" else e.cast("array<double>")  # single precision stays as short as it came
    grouped = vectors.where(sound & (F.size(e) == dim)).groupBy(key.alias("key")).agg(F.min(vec_id).alias("least"), F.count("*").alias("weight"), F.first(value).alias("v"))
    classes = settled(grouped.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    lattice = Lattice(dim, **settings())

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                cells = lattice.cells(_units(v)).reshape(len(v), -1)
                ends = pa.array(np.arange(len(v) + 1) * cells.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(cells.reshape(-1)))], ["cid", "cells"])

    # A row a vector is written; its cells are dealt once, and the cells' sizes and members come off the same exchange (which takes that both read both columns).
    hashes = settled(classes.select("cid", "v").mapInArrow(hashed, "cid long, cells array<long>"))
    code = F.col("cid") * 2 + (F.col("place") % (1 + lattice.probes) == 0).cast("long")  # the vector and whether it is at home
    codes = hashes.select("cid", F.posexplode("cells").alias("place", "cell")).select("cell", code.alias("code")).repartition("cell")
    sized = codes.groupBy("cell").agg(F.count("code").alias("n"), F.max(F.col("code").bitwiseAND(1)).alias("any_home")).where("n > 1 and any_home = 1").select("cell", "n")
    parts = F.ceil(F.col("n") / block).cast("int")
    met = codes.join(sized, "cell").select("cell", F.shiftrightunsigned("code", 1).alias("cid"), (F.col("code").bitwiseAND(1) == 1).alias("home"), parts.alias("parts"))
    met = met.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shipped = n * dim * 4 > BROADCAST_BYTES
    member = ["cid", "home", "side"]
    if shipped:
        met = met.join(classes.select("cid", "weight", "v"), "cid")
        member += ["weight", "v"]
        bank = None
    else:
        got = classes.select("cid", "weight", "v").toArrow()  # n * dim is under the bound
        order = np.argsort(got["cid"].to_numpy())
        bank = session.sparkContext.broadcast((got["cid"].to_numpy()[order], got["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order].astype(np.float64), got["weight"].to_numpy()[order]))
    blocks = met.groupBy("cell", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q")).agg(F.collect_list(F.struct(*member)).alias("m")).where(F.size("m") > 1)

    def linked(batches):
        for batch in batches:
            cells, p, q = (batch.column(k).to_numpy() for k in range(3))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values
            cid, home, side = (np.asarray(inner.field(k).to_numpy(zero_copy_only=False)) for k in range(3))
            if bank is None:
                weight = inner.field(3).to_numpy()
                ids, first, rows = np.unique(cid, return_index=True, return_inverse=True)
                vectors = np.asarray(inner.field(4).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                known = _Known(lattice, _units(vectors[first]))
            else:
                if id(bank.value) not in _banks:
                    _banks.clear()
                    _banks[id(bank.value)] = (bank.value, _Known(lattice, _units(bank.value[1])))
                ids, known = bank.value[0], _banks[id(bank.value)][1]
                rows = np.searchsorted(ids, cid)
                weight = bank.value[2][rows]
            starts, sizes = ends[:-1], np.diff(ends)
            small = np.flatnonzero((sizes <= SMALL) & (p == q))
            block_of, a, b = _small_blocks(known.units, rows, home, starts[small], sizes[small], threshold)
            out_id, out_n, out_root = [], [], []
            if len(a):
                who, place = np.unique(rows[np.concatenate([a, b])], return_inverse=True)
                i, j = place[: len(a)], place[len(a) :]
                own, count = known.cells_of(who), np.zeros(len(who), dtype=np.int64)
                for k in range(0, len(a), 50_000):
                    part = slice(k, k + 50_000)
                    mine = _first_meeting(own[i[part]], own[j[part]]) == cells[small[block_of[part]]]
                    np.add.at(count, i[part][mine], weight[b[part][mine]])
                    np.add.at(count, j[part][mine], weight[a[part][mine]])
                out_id.append(ids[who])
                out_n.append(count)
                out_root.append(ids[who[_components(i, j, len(who))]])
            for k in np.flatnonzero((sizes > SMALL) | (p != q)).tolist():
                s = slice(ends[k], ends[k + 1])
                count, label = _block(known.units[rows[s]], home[s], side[s], weight[s], cells[k], threshold, lattice, p[k] != q[k])
                some = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
                if len(some):
                    out_id.append(cid[s][some])
                    out_n.append(count[some])
                    out_root.append(cid[s][label[some]])
            flat = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_id, out_n, out_root)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["src", "n", "dst"])

    found = settled(blocks.select("cell", "p", "q", "m").mapInArrow(linked, "src long, n long, dst long"))
    totals = found.groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.select("src", "dst")).withColumnRenamed("id", "cid")
    named = classes.select("key", "cid", "least", "weight").join(groups, "cid", "left").join(totals, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))

ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN least ON v.vec_id = least.id
"""
