"""Quality classifier (operator 6): co-training of two views.

One classifier reads the text's content, the other the page's metadata (language, source, length and line layout, but no
character of the text). Each labels the unlabelled rows of a pool that it is most sure of, and the other learns from
them, over a few rounds. Both are then calibrated on labelled rows that neither learned from, and their log-odds are added
and calibrated on further such rows to score every document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.boosting import Boosted, Isotonic, held_out, labelled_sample, sample_by_hash
from curatrix.llm.common import short_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Classes of byte: 0 other signs, 1 lower case, 2 upper case, 3 digits, 4 the space, 5 parts of longer characters.
_BYTE_CLASS = np.array([5 if b >= 128 else 4 if b == 32 else 3 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 0 for b in range(256)], dtype=np.uint8)
CONTENT, META = 18, 22


def content_features(text: str) -> list[float]:
    """Of the words: variety, repetition, length, case, signs attached, stop-word share; of the bytes: their classes and compression."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * CONTENT
    distinct = set(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
    plain = {t for t in distinct if t.isalpha()}
    upper = {t for t in distinct if len(t) > 1 and t.isupper()}
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    most = max(counts.values())
    pairs = len(set(zip(tokens, tokens[1:]))) if n > 1 else 0
    words = sum(counts[t] for t in plain)
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    classes = np.bincount(_BYTE_CLASS[raw], minlength=6) / len(raw)
    return [
        len(distinct) / n, most / n, pairs / max(1, n - 1), float(lengths.mean()), float(lengths.std()), words / n, sum(counts[t] for t in upper) / n,
        sum(c for t, c in counts.items() if len(t) <= 3) / n, sum(c for t, c in counts.items() if t[-1:] in ".!?") / n, sum(c for t, c in counts.items() if not _WORD.search(t)) / n, np.log1p(n),
        *classes.tolist(), len(zlib.compress(data, 1)) / len(data),
    ]


def meta_features(text: str, lang: str, source: str) -> list[float]:
    """Of the page: eight hash bits each of its language and its source, length, number of lines, their sizes and repeats."""
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines], dtype=np.float64)
    bits = [float(zlib.crc32(value.encode()) >> k & 1) for value in (lang, source) for k in range(8)]
    return [*bits, np.log1p(len(text)), np.log1p(len(lines)), float(sizes.mean()), float(sizes.std()), len(set(lines)) / len(lines), float((sizes == 0).mean())]


def _columns(frame: DataFrame, text: str, lang: str, source: str):
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in frame.columns else F.lit("")
    return blank(text), blank(lang), blank(source)


class CoTrained:
    """Both views' models and calibrations."""

    def fit(self, content: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 4, take: int = 200, sure: float = 0.9) -> CoTrained:
        """y is 0, 1, or -1 for the unlabelled pool."""
        known = y >= 0
        self.constant = None
        if known.sum() == 0 or min((y[known] == 0).sum(), (y[known] == 1).sum()) < 4:
            self.constant = float(y[known].mean()) if known.any() else 0.5
            return self
        views = (content, meta)
        # A fifth of the labelled rows is kept from both learners: half of it calibrates the views, half their sum.
        rank = np.cumsum(known) - 1
        checking = known & (rank % 5 == 4)
        of_views, of_sum = (checking & (rank // 5 % 2 == k) for k in (0, 1))
        if not of_sum.any():
            of_views = of_sum = checking if checking.any() else known
        labels = [np.where(known & ~checking, y, -1).astype(np.float64) for _ in views]
        for _ in range(rounds):
            margins = []
            for x, own in zip(views, labels, strict=True):
                rows = own >= 0
                margins.append(Boosted(trees=40).fit(x[rows], own[rows]).margin(x))
            added = 0
            for k, margin in enumerate(margins):
                other = labels[1 - k]
                p = 1 / (1 + np.exp(-margin))
                free = (other < 0) & ~checking & ~known
                share = (y[known] == 1).mean()  # pseudo-labels come in the proportion of the labels
                for label, confidence, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                    rows = np.flatnonzero(free & (confidence >= sure))
                    best = rows[np.argsort(-confidence[rows], kind="stable")][: max(1, int(take * part))]
                    other[best] = label
                    added += len(best)
            if not added:
                break
        self.models, self.maps = [], []
        for x, own in zip(views, labels, strict=True):
            rows = own >= 0
            model = Boosted(trees=60).fit(x[rows], own[rows])
            self.models.append(model)
            self.maps.append(Isotonic().fit(model.margin(x[of_views]), y[of_views].astype(np.float64)))
        both = self._odds(content[of_sum], meta[of_sum])
        self.final = Isotonic().fit(both, y[of_sum].astype(np.float64))
        return self

    def _odds(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        total = np.zeros(len(content))
        for x, model, calibrated in zip((content, meta), self.models, self.maps, strict=True):
            p = np.clip(calibrated(model.margin(x)), 0.01, 0.99)
            total += np.log(p / (1 - p)) + 0.02 * model.margin(x)  # the margin orders rows within a step
        return total

    def __call__(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(content), self.constant)
        return np.clip(self.final(self._odds(content, meta)), 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", lang: str = "lang", source: str = "source", sample_rows: int = 10_000, pool_rows: int = 10_000) -> CoTrained:
    """Fitted on at most sample_rows labelled rows, none of them held out, and pool_rows unlabelled ones (both chosen by hash).

    An id that repeats in docs counts once, with its smallest row, so the rows that reach the driver are bounded by both limits.
    """
    short_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.struct(*[c.alias(n) for c, n in zip(_columns(docs, text, lang, source), ("t", "a", "b"), strict=True)]).alias("row"))
    seen = labels.select(F.col(doc_id).alias("__id")).where("__id is not null").distinct()
    sample = labelled_sample(docs, labels, doc_id, text, label, sample_rows).select(F.col("doc_id").alias("__id"), "y")
    pool = keyed.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().join(seen, "__id", "left_anti")
    wanted = sample.unionByName(sample_by_hash(pool, "__id", pool_rows, 3).select("__id", F.lit(-1).alias("y")))
    chosen = keyed.join(F.broadcast(wanted), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("row").alias("row"))

    def rows(batches):
        for batch in batches:
            ids, ys, texts, langs, sources = (batch.column(k).to_pylist() for k in range(5))
            made = [[*content_features(t), *meta_features(t, a, b)] for t, a, b in zip(texts, langs, sources, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(made, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = chosen.select(F.col("doc_id").cast("string"), F.col("y").cast("int"), "row.t", "row.a", "row.b").mapInArrow(rows, "id string, y int, x array<double>")
    got = sorted((r["id"], r["y"], r["x"]) for r in got.collect())
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(-1, CONTENT + META)
    return CoTrained().fit(x[:, :CONTENT], x[:, CONTENT:], np.array([r[1] for r in got], dtype=np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", lang: str = "lang", source: str = "source", sample_rows: int = 10_000, pool_rows: int = 10_000) -> DataFrame:
    """docs with held_out, score (chance of quality 1) and keep (score >= 0.5) added (same names are replaced).

    Null texts count as empty and are scored, long ones whole; null or absent languages and sources count as empty. Repeated rows
    score alike, an empty table stays empty, further columns stay as they are. Without four labelled rows of either label every
    score is their mean label (0.5 without any).
    """
    fitted = fit_quality(docs, labels, doc_id, text, label, lang, source, sample_rows, pool_rows)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        columns = [x.to_pylist() for x in (texts, langs, sources)]
        content = np.array([content_features(t) for t in columns[0]], dtype=np.float64).reshape(-1, CONTENT)
        meta = np.array([meta_features(*r) for r in zip(*columns, strict=True)], dtype=np.float64).reshape(-1, META)
        return pa.array(shared.value(content, meta), pa.float64())

    score.__annotations__ = {"texts": pa.Array, "langs": pa.Array, "sources": pa.Array, "return": pa.Array}
    made = docs.withColumn("__score", F.arrow_udf(score, "double").asNondeterministic()(*_columns(docs, text, lang, source)))
    return made.withColumns({"held_out": held_out(F.col(doc_id)), "score": F.col("__score"), "keep": F.col("__score") >= 0.5}).drop("__score")
