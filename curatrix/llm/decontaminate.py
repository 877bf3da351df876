"""Benchmark decontamination (operator 5): a hash set of normalised test n-grams against every document window.

Words are runs of letters and digits after A-Z are lower-cased (every byte from 0x80 up counts as a
letter). A window is n consecutive words of an item; an item of fewer words, but not none, is one window.
The set is broadcast to the tasks, which scan the whole text: windows whose words all occur in some
item are hashed, looked up, and verified word by word. A set over the byte bound isn't broadcast: the
windows of both sides then meet in a shuffle join on their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_BYTES, settled, sha256_hex, short_batches, texts_udf, worker_state

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Columns that the join form adds for itself and drops again.
_ROW, _PLACES = "__decontaminate_row", "__decontaminate_places"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], n: int) -> Iterator[tuple[int, list[bytes]]]:
    """(start, words) of each window of an item."""
    if words:
        for i in range(max(1, len(words) - n + 1)):
            yield i, words[i : i + n]


class GramSet:
    """The windows of all items, by length: sorted hashes to reject by, word tuples to verify with."""

    def __init__(self, items: list[tuple], n: int):
        self.vocabulary: dict[bytes, int] = {}
        grams: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            for _, window in windows_of(words_of(text), n):
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in window)
                grams.setdefault(len(key), {}).setdefault(key, set()).add(item)
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, size=len(self.vocabulary) + 1, dtype=np.uint64)
        self.by_length = {}
        for length, found in sorted(grams.items()):
            keys = np.array(list(found), dtype=np.int64)
            self.by_length[length] = (np.unique(self._hash(keys)), {k: tuple(v) for k, v in found.items()})

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.uint64)
        for column in keys.T:
            out = out * _PRIME + self.codes[column]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """(a mask of hit words, items with an occurring window)."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for length, (hashes, grams) in self.by_length.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            keys = ids[at[:, None] + np.arange(length)]
            h = self._hash(keys)
            where = np.searchsorted(hashes, h)
            for k in np.flatnonzero(hashes[np.minimum(where, len(hashes) - 1)] == h):
                if (found := grams.get(tuple(keys[k].tolist()))) is not None:
                    hit[at[k] : at[k] + length] = True
                    items.update(found)
        return hit, items


def _gram_set(shared) -> GramSet:
    return worker_state(shared.value, lambda v: GramSet(*v))


def items_digest(items) -> str:
    """Of the ids in order; an item without an id counts as one, but has none to put in."""
    return sha256_hex(",".join(sorted(str(i) for i in items if i is not None)).encode())


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the stretches of hit words, found on the folded bytes and mapped back."""
    data = text.encode()
    folded = data.translate(_FOLD)
    starts, ends, at = [], [], 0
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    spans, i = [], 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            spans.append((int(points[starts[i]]), int(points[ends[j]])))
            i = j
        i += 1
    return spans


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def benchmark_items(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> list[tuple] | None:
    """The benchmark's rows, or None if its texts exceed the bound for a broadcast."""
    size = benchmark.agg(F.sum(F.octet_length(text) + F.lit(64)).alias("b")).first()["b"] or 0
    if size * 12 > most_bytes:  # ids, tuples and sets take about this many times the text
        return None
    return [(r[0], r[1]) for r in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).collect()]


def contamination(items: list[tuple], n: int, session, remove: bool = False) -> Callable[[Column], Column]:
    """Column function: text -> struct(n_words, n_hit, n_items, items_sha256 [, cleaned])."""
    short_batches(session)
    shared = session.sparkContext.broadcast((items, n))

    def per_text(x: str) -> tuple:
        words = words_of(x)
        hit, found = _gram_set(shared).scan(words)
        out = (len(words), int(hit.sum()), len(found), items_digest(found))
        return (*out, _cut(x, _spans(x, hit)) if hit.any() else x) if remove else out

    ddl = "n_words long, n_hit long, n_items long, items_sha256 string" + ", cleaned string" * remove
    fields = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string()}
    return texts_udf(per_text, ddl, fields | ({"cleaned": pa.string()} if remove else {}))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, remove: str | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated added (same names are replaced).

    remove="documents" leaves contaminated rows out, remove="spans" cuts the hit words from their
    texts (null texts stay null). Null and empty texts have no words and are never contaminated; long ones
    are scanned whole; repeated rows are judged each; an empty table stays empty. Repeated items count once by their item_id, items
    without an id count as one item that the digest leaves out; an empty benchmark hits nothing. Further columns stay as
    they are. With the benchmark over most_bytes the shuffle form answers alike.
    """
    rows = benchmark_items(benchmark, item, item_text, most_bytes)
    names = ["n_words", "n_hit", "n_items", "items_sha256"]
    if rows is None:
        made = _joined(docs, benchmark, text, item, item_text, n, remove == "spans")
    else:
        scan = contamination(rows, n, docs.sparkSession, remove == "spans")
        made = docs.withColumn(_ROW, scan(F.col(text))).withColumns({c: F.col(f"{_ROW}.{c}") for c in names})
        if remove == "spans":
            made = made.withColumn(text, F.when(F.col("n_hit") > 0, F.col(f"{_ROW}.cleaned")).otherwise(F.col(text)))
        made = made.drop(_ROW)
    made = made.withColumn("contaminated", F.col("n_hit") > 0)
    return made.where("not contaminated") if remove == "documents" else made


def _cut_places(texts: pa.Array, places: pa.Array) -> pa.Array:
    """Texts without the words at these places; null places leave a text as it is."""
    out = []
    for x, at in zip(texts.to_pylist(), places.to_pylist(), strict=True):
        if x is not None and at:
            hit = np.zeros(len(words_of(x)), dtype=bool)
            hit[at] = True
            x = _cut(x, _spans(x, hit))
        out.append(x)
    return pa.array(out, pa.string())


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, n: int, cut: bool = False, filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same columns by a join on window digests, for benchmarks too large to broadcast. cut removes the hit words from the texts.

    The first eight bytes of the items' digests are broadcast as a filter if filter_bytes allows (8 million windows); beyond that every
    window of the documents goes into the join.
    """
    lengths = settled(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("t")))

    def digest(words: list[bytes]) -> bytes:
        return hashlib.sha256(b" ".join(words)).digest()

    def of_items(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(i, len(w), digest(w)) for i, t in zip(ids, texts, strict=True) for _, w in windows_of(words_of(t), n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], ["item", "len", "gram"])

    grams = settled(lengths.select(F.col("item").cast("string"), "t").mapInArrow(of_items, "item string, len int, gram binary").distinct())
    sizes = sorted(r[0] for r in grams.select("len").distinct().collect())
    codes = None
    if grams.count() * 8 <= filter_bytes:  # eight bytes a window tell nearly all others apart, so that only hits are shuffled
        heads = grams.select(F.substring("gram", 1, 8).alias("head")).distinct().toArrow()["head"].to_pylist()
        codes = docs.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(heads), dtype=">u8").astype(np.uint64)))
    keyed = settled(docs.withColumn(_ROW, F.monotonically_increasing_id()))

    def of_texts(batches):
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                for k in sizes:
                    grams = [digest(words[i : i + k]) for i in range(len(words) - k + 1)]
                    at = np.arange(len(grams))
                    if codes is not None and len(grams):
                        head = np.frombuffer(b"".join(grams), dtype=">u8")[::4].astype(np.uint64)
                        known = codes.value
                        at = at[known[np.minimum(np.searchsorted(known, head), len(known) - 1)] == head] if len(known) else at[:0]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([grams[i] for i in at.tolist()], pa.binary())], [_ROW, "len", "at", "gram"])

    found = keyed.select(_ROW, F.col(text).cast("string")).mapInArrow(of_texts, f"{_ROW} long, len int, at int, gram binary").join(grams, ["len", "gram"])
    found = settled(found.select(_ROW, "len", "at", "item"))
    items = found.select(_ROW, "item").distinct().groupBy(_ROW).agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    hits = found.select(_ROW, F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("w")).distinct().groupBy(_ROW).agg(F.count("*").alias("n_hit"), *([F.collect_list("w").alias(_PLACES)] if cut else []))
    count = texts_udf(lambda x: (len(words_of(x)),), "n long", {"n": pa.int64()})
    made = keyed.drop("n_words", "n_hit", "n_items", "items_sha256").join(items.join(hits, _ROW), _ROW, "left")
    made = made.withColumns({"n_words": count(F.col(text))["n"], "n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", F.lit(sha256_hex(b"")))}).drop(_ROW)
    return made.withColumn(text, F.arrow_udf(_cut_places, "string")(F.col(text).cast("string"), _PLACES)).drop(_PLACES) if cut else made


ORACLE = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM item_grams),
doc_grams AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, doc_grams.k, i, item_id FROM doc_grams JOIN item_grams ON doc_grams.k = item_grams.k AND doc_grams.gram = item_grams.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
