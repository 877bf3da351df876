"""Spelling variant grouping (operator 11): a symmetric-delete join.

Every word emits itself and its distinct single deletions; words meet where these are equal, and a pair is near if it
differs by exactly one inserted, deleted or replaced code point. Keys are 64-bit sums over (code point, place), so all
deletions of a word cost one pass over it, however long it is, and a row is three numbers; words come back by their id to
be verified. Two near words share exactly one such string: an equal string of theirs is what is left without the place in which they
differ. So a pair stands once, and words that share a string are at most an alphabet's worth for each of its places.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.checksums import CRC_TABLE, crc32_sql
from curatrix.llm.common import settled, short_batches

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Distinct words, and characters of them, that a task holds before it hands its counts on.
_HELD_WORDS, _HELD_CHARACTERS = 200_000, 16 << 20
#: Code points that are turned into keys at once.
_BLOCK = 1 << 18


def lower_run(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def altered(prefix: int, word: str, modulus: int) -> str:
    """word, or word without one code point if the modulus divides the checksum that begins with prefix."""
    h = zlib.crc32(word.encode(), prefix)
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str, text: str, modulus: int, shortest: int) -> DataFrame:
    """(word, n): occurrences of each word of at least `shortest` code points in all texts; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        characters = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, whole in zip(batch.column(0), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                runs: Counter = Counter()
                for raw, n in Counter(m.group() for m in _RUN.finditer(whole.as_py() or "") if m.end() - m.start() >= shortest).items():
                    runs[lower_run(raw)] += n
                for run, n in runs.items():
                    word = altered(prefix, run, modulus)
                    if len(word) >= shortest:
                        characters += 0 if word in held else len(word)
                        held[word] += n
                if len(held) >= _HELD_WORDS or characters >= _HELD_CHARACTERS:
                    yield out()
                    characters = 0
        yield out()

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each code point and place."""
    x = codes.astype(np.uint64) + (places.astype(np.uint64) << np.uint64(21)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the word, place) of each word (place -1) and of each distinct string that lacks one of its code points.

    Leaving out any of a run of equal code points gives the same string, so only the run's first place counts.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - firsts[owner]
    here, moved = _mixed(codes, place), _mixed(codes, place - 1)
    sums_here = np.concatenate([[np.uint64(0)], np.cumsum(here, dtype=np.uint64)])
    sums_moved = np.concatenate([[np.uint64(0)], np.cumsum(moved, dtype=np.uint64)])
    ends = firsts + sizes
    at = np.arange(len(codes))
    without = sums_here[at] - sums_here[firsts[owner]] + sums_moved[ends[owner]] - sums_moved[at + 1]
    first_of_run = (place == 0) | (codes != np.concatenate([codes[:1], codes[:-1]]))
    whole = sums_here[ends] - sums_here[firsts]
    keys = np.concatenate([whole, without[first_of_run]])
    return keys.view(np.int64), np.concatenate([np.arange(len(words)), owner[first_of_run]]), np.concatenate([np.full(len(words), -1), place[first_of_run]])


def _keys(words: DataFrame) -> DataFrame:
    """(key, id, place) rows of a table of (id, word)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(words):
                end, characters = at, 0
                while end < len(words) and (end == at or characters + len(words[end]) <= _BLOCK):
                    characters += len(words[end])
                    end += 1
                key, number, place = deletion_keys(words[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:end][number]), pa.array(place)], ["key", "id", "place"])
                at = end

    return words.select("id", "word").mapInArrow(make, "key long, id long, place long")


def _without(word: Column, place: Column) -> Column:
    """The string that a key stands for."""
    return F.when(place < 0, word).otherwise(F.concat(F.substr(word, F.lit(1), place.cast("int")), F.substr(word, (place + 2).cast("int"))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(id_a, word_a, n_a, id_b, word_b, n_b), id_a < id_b: each pair of words of (id, word, n) at distance exactly one, once."""
    keys = settled(_keys(words))
    met = keys.select("key", F.col("id").alias("id_a"), F.col("place").alias("place_a")).join(keys.select("key", F.col("id").alias("id_b"), F.col("place").alias("place_b")), "key")
    met = met.where((F.col("id_a") < F.col("id_b"))).drop("key")
    for side in "ab":
        met = met.join(words.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), f"id_{side}")
    a, b = F.col("word_a"), F.col("word_b")
    same = _without(a, F.col("place_a")) == _without(b, F.col("place_b"))
    return met.where(same & (F.levenshtein(a, b, 1) == 1)).drop("place_a", "place_b")


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, to) with every `to` followed to the last: each round a row takes the `to` of its `to`, so chains halve."""
    links = settled(links)
    for _ in range(most_rounds):
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        after = settled(links.join(onward, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        links = after.select("id", "to")
        if not after.where("moved").limit(1).count():
            return links
    raise RuntimeError(f"forms not followed to their ends after {most_rounds} rounds")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of at least `shortest` code points and `least` occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; a run whose checksum with its doc_id is
    a multiple of the modulus loses one code point. n_near counts the words at distance exactly one. form is the near word of highest n
    (ties: the smallest in code-point order) if its n is at least ratio times the word's, else null, as form_n is; ratio is over 1, so
    n grows along forms and they never run in circles. root follows forms to the last, and is the word itself without one.

    Null and empty texts have no words; a null doc_id counts as an empty one. Rows that repeat count each time. An
    empty table gives none. Texts and words of any length are taken whole; further columns are left out.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in circles")
    words = word_counts(docs, doc_id, text, modulus, shortest).where(F.col("n") >= least)
    words = settled(words.withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(words)
    ways = F.explode(F.array(*[F.struct(F.col(f"id_{x}").alias("id"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(f"word_{y}").alias("word"), F.col(f"id_{y}").alias("id")).alias("near")) for x, y in ("ab", "ba")]))
    best = pairs.select(ways.alias("w")).groupBy("w.id").agg(F.count("*").alias("n_near"), F.min("w.near").alias("near"))
    formed = settled(words.join(best, "id", "left").withColumn("formed", F.coalesce(-F.col("near.less") >= ratio * F.col("n"), F.lit(False))))
    followed = roots(formed.where("formed").select("id", F.col("near.id").alias("to")))
    ends = followed.join(words.select(F.col("id").alias("to"), F.col("word").alias("end")), "to").select("id", "end")
    when = lambda value: F.when(F.col("formed"), value)
    made = formed.join(ends, "id", "left")
    return made.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), when(F.col("near.word")).alias("form"), when(-F.col("near.less")).alias("form_n"), F.coalesce("end", "word").alias("root"))


#: The same in SQL: deletions at one place of both words stand for replacements.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, other := other)) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 5 * w.n THEN top.other END AS form, CASE WHEN -top.less >= 5 * w.n THEN -top.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS open FROM formed
  UNION ALL SELECT w.word, coalesce(f.form, w.root), f.form IS NOT NULL FROM walk w JOIN formed f ON w.root = f.word WHERE w.open)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON f.word = w.word AND NOT w.open
"""
