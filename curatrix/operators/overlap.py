"""Near texts of a small side in a large one: frequencies of the small side's terms alone, then of those of the few rows that may be near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.session import settled

#: Bytes of the small side's texts, and of the texts that may be near, up to which their terms go to all tasks; code points worked on at once.
SMALL, _AT_ONCE = 4 << 20, 1 << 20
#: Numbers up to which a table tells which are known.
_TABLE = 1 << 24


def spaced(text: Column) -> Column:
    """Lower-cased, words between single spaces, one at either end: the form that Grams reads."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), F.lit(" "))


class Grams:
    """Numbers of the padded character n-grams (neartext.char_terms) of some spaced texts: those that have no blank but at their ends.

    An n-gram is its first n - 1 characters' number and a character, so numbers are exact whatever the alphabet.
    """

    def __init__(self, texts: list[str], n: tuple[int, int] = (3, 5)):
        self.n, self.codes, self.offsets, self.size = n, [], [], 0
        self.alphabet, self.tables = np.unique(self._points(texts)), {}
        for _ in self._levels(self._points(texts), grow=True):
            pass

    @staticmethod
    def _points(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def _rank(self, k: int, span: int, values: np.ndarray) -> np.ndarray:
        """Places of values among the sorted ones of level k (0: the alphabet), -1 where they are missing; by a table if the span of both is small."""
        known = self.codes[k - self.n[0]] if k else self.alphabet
        if not len(known):
            return np.full(len(values), -1)
        if span > _TABLE:
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            return np.where(known[at] == values, at, -1)
        if k not in self.tables:
            self.tables[k] = np.full(span + 1, -1, dtype=np.int32)  # the last place is that of -1
            inside = known >= 0
            self.tables[k][known[inside]] = np.flatnonzero(inside)
        return self.tables[k][values].astype(np.int64)

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}

    def _levels(self, points: np.ndarray, grow: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, numbers) of the n-grams of each size, -1 for unknown ones."""
        low, high = self.n
        letters, filled, base = self._rank(0, 0x110000, points) + 1, points != 32, len(self.alphabet) + 1
        at = np.arange(max(0, len(points) - low + 1))
        for j in range(1, low - 1):
            at = at[filled[at + j]]
        ranks = letters[at]
        for j in range(1, low):
            ranks = ranks * base + letters[at + j]
        span = base**low
        for k in range(low, high + 1):
            if k > low:
                span = len(self.codes[k - 1 - low]) * base
                keep = (at + k - 1 < len(points)) & filled[np.minimum(at + k - 2, len(points) - 1)]
                at, ranks = at[keep], ranks[keep]
                ranks = np.where(ranks >= 0, ranks * base + letters[at + k - 1], -1)
            if grow:
                self.codes.append(np.unique(ranks))
                self.offsets.append(self.size)
                self.size += len(self.codes[-1])
            ranks = self._rank(k, span, ranks)
            yield at, np.where(ranks >= 0, ranks + self.offsets[k - low], -1)

    def numbers(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, numbers of its n-grams, repeats and unknown ones (-1) included) of each text."""
        sizes = [len(t) for t in texts]
        at = 0
        while at < len(texts):
            end, total = at + 1, sizes[at]
            while end < len(texts) and total + sizes[end] <= _AT_ONCE:
                total += sizes[end]
                end += 1
            starts = np.cumsum([0, *sizes[at:end]])
            levels = [(np.searchsorted(places, starts), found) for places, found in self._levels(self._points(texts[at:end]))]
            for k in range(end - at):
                yield at + k, np.concatenate([found[cut[k] : cut[k + 1]] for cut, found in levels])
            at = end


def frequencies(texts: DataFrame, grams) -> np.ndarray:
    """In how many of the texts (t, spaced) each of the broadcast n-grams stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Grams = grams.value
        total = np.zeros(own.size, dtype=np.int64)
        for batch in batches:
            for _, found in own.numbers(batch.column(0).to_pylist()):
                total[found[found >= 0]] += 1  # once, however often a number stands there
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["k", "n"])

    made = texts.select("t").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row an n-gram
    out = np.zeros(grams.value.size, dtype=np.int64)
    out[made["k"].to_numpy()] = made["n"].to_numpy()
    return out


def _weights(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, weights) of a text's known n-grams."""
    own, tf = np.unique(found[found >= 0], return_counts=True)
    return own, (1 + np.log(tf)) * idf[own]


class _Items:
    """Vectors of the small side, and its rows by their rarest terms: without any of them the others fall short of the threshold."""

    def __init__(self, grams: Grams, texts: list[str], df: np.ndarray, idf: np.ndarray, threshold: float):
        self.idf, self.vectors, self.first = idf, [], {}
        for k, found in grams.numbers(texts):
            own, w = _weights(found, idf)
            w /= np.sqrt((w * w).sum()) or 1.0
            self.vectors.append((own, w))
            order = np.lexsort((own, df[own]))
            rest = np.sqrt(np.cumsum((w[order] ** 2)[::-1])[::-1])
            for g in own[order][rest >= threshold - 1e-9].tolist():
                self.first.setdefault(g, []).append(k)
        self.rare = np.zeros(grams.size + 1, dtype=bool)  # the last one is for unknown n-grams
        self.rare[list(self.first)] = True


def small_side_matches(both: DataFrame, large: Column, small: DataFrame, threshold: float) -> DataFrame | None:
    """(id): rows of the small side with a row of the large one at or above the threshold, by TF-IDF of padded character 3-5-grams over both (id, t).

    large tells the large side's rows of both, small (id, t) is the small side. None where texts that have to go to all tasks exceed SMALL bytes.
    Products need only terms of both sides, so the small side's frequencies give them, and a lower bound of the large side's lengths; rows
    whose products reach the threshold with it get their lengths from frequencies of all their terms.
    """
    spark = both.sparkSession
    bytes_of = lambda d: d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    none = spark.createDataFrame([], "id string")
    if bytes_of(small) > SMALL:
        return None
    items = small.select("id", "t").collect()  # bounded
    n = both.count()
    if not items or not n:
        return none
    names, texts = [r[0] for r in items], [r[1] for r in items]
    own = Grams(texts)
    grams = spark.sparkContext.broadcast(own)
    df = frequencies(both, grams)
    idf = np.log((1 + n) / (1 + df)) + 1
    known = spark.sparkContext.broadcast(_Items(own, texts, df, idf, threshold))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one = grams.value, known.value
        for batch in batches:
            ids, ks, dots = [], [], []
            names = batch.column(0).to_pylist()
            for row, found in table.numbers(batch.column(1).to_pylist()):
                some = found[one.rare[found]]
                if not len(some):
                    continue
                terms, w = _weights(found, one.idf)
                unknown = int((found < 0).sum())
                least = (w * w).sum() + ((1 + np.log(unknown)) ** 2 if unknown else 0)  # no inverse frequency is below 1
                dense = np.zeros(table.size)
                dense[terms] = w
                for k in sorted({k for g in np.unique(some).tolist() for k in one.first[g]}):
                    dot = float(dense[one.vectors[k][0]] @ one.vectors[k][1])
                    if dot >= (threshold - 1e-9) * np.sqrt(least):
                        ids.append(names[row])
                        ks.append(k)
                        dots.append(dot)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ks, pa.int32()), pa.array(dots, pa.float64())], ["id", "k", "dot"])

    rows = both.where(large).select("id", "t")
    met = settled(rows.mapInArrow(meet, "id string, k int, dot double"))
    near = settled(rows.join(F.broadcast(met.select("id").distinct()), "id", "left_semi")) if met.count() <= 1 << 20 else settled(rows.join(met.select("id").distinct(), "id", "left_semi"))
    if bytes_of(near) > SMALL:
        return None
    candidates = [r[0] for r in near.select("t").distinct().collect()]  # bounded
    if not candidates:
        return none
    wide = spark.sparkContext.broadcast(Grams(candidates))
    shared = spark.sparkContext.broadcast(np.log((1 + n) / (1 + frequencies(both, wide))) + 1)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [float(np.sqrt((_weights(found, shared.value)[1] ** 2).sum())) for _, found in wide.value.numbers(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.float64())], ["id", "size"])

    sized = near.mapInArrow(lengths, "id string, size double")
    found = met.join(sized, "id").where(F.col("dot") / F.col("size") >= threshold - 1e-12).select("k").distinct()
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, id string")), "k").select("id")
