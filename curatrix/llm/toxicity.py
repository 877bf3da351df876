"""Toxicity (operator 4): gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon of insults, their nearness to the second person and to each other,
capitals, punctuation, and obfuscation (digits or signs inside letters, letters set apart). The lexicon
is a seed list plus the words and word beginnings that set toxic training rows apart; what a near copy of
another training row says counts once. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.boosting import Calibrated, held_out, labelled_sample
from curatrix.llm.common import Memo, settled, short_batches, worker_state
from curatrix.llm.cutting import buffers, parts_of, tokens_of

#: Insults that the lexicon starts from (fixed values).
SEED = (
    "idiot idiots moron morons stupid dumb loser losers scum trash clown clowns pathetic worthless disgusting imbecile jerk "
    "idiota estúpido imbécil basura payaso asqueroso patético idiote débile connard ordure crétin minable "
    "dumm dummkopf blödmann abschaum trottel wertlos ekelhaft arschloch"
).split()
#: Second-person words (fixed values).
SECOND = set("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("0134578@$!|", "oieastbasii")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_PARTS = re.compile(r"[\W_]+")
_REPEATS = re.compile(r"(.)\1{2,}")
_MARKS = ".,;:?!\"'()"  # signs at a word's ends that hide nothing
#: Kinds of byte, as bits: 1 upper case, 2 lower case, 4 digits, 8 other signs, 16 and 32 the marks ! and ?.
_BYTE_KINDS = np.array([(65 <= b <= 90) + 2 * (97 <= b <= 122) + 4 * (48 <= b <= 57) + 8 * (32 < b < 127 and not chr(b).isalnum()) + 16 * (b == 33) + 32 * (b == 63) for b in range(256)], dtype=np.uint8)
PREFIXES = (4, 5, 6)
FEATURES = 19


def spellings(token: str) -> tuple[list[str], list[str]]:
    """(plain words of the token, what it may stand for if signs, digits or repeats hide a word)."""
    core = _EDGE.sub("", token.lower())
    plain = [p for p in _PARTS.split(core) if p]
    hidden = []
    if _INNER.search(core) or _EDGE.search(token.lower().strip(_MARKS)):
        hidden = [_INNER.sub("", token.lower().translate(_LEET)), _INNER.sub("", core)]
    hidden.append(_REPEATS.sub(r"\1", core))
    return plain, [h for h in hidden if h and h not in plain]


class Lexicon:
    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.starts = {p[: PREFIXES[0]] for p in prefixes}
        self.codes = Memo(self._code, 150_000)

    def weight(self, word: str) -> float:
        own = self.words.get(word, 0.0)
        if word[: PREFIXES[0]] in self.starts:
            own = max([own, *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])
        return own

    def _code(self, token: str) -> float:
        """weight + 64 * second person + 128 * capitals + 256 * obfuscated hit + 512 * one letter, as one number."""
        core, hit = token.lower().strip(_MARKS), 0
        if core.isalpha():  # one plain word, in which only repeats can hide another
            weight, second = self.weight(core), core in SECOND
            hidden = [_REPEATS.sub(r"\1", core)] if not weight and _REPEATS.search(core) else ()
        else:
            plain, hidden = spellings(token)
            weight, second = max([self.weight(w) for w in plain], default=0.0), any(p in SECOND for p in plain)
        if not weight and hidden and (weight := max(self.words.get(h, 0.0) for h in hidden)):
            hit = 1
        return min(weight, 60.0) + 64 * second + 128 * (len(token) > 2 and token.isupper()) + 256 * hit + 512 * (len(token) == 1 and token.isalpha())

    def features(self, text: str) -> np.ndarray:
        return self.features_of(pa.array([text], pa.string()))[0]

    def features_of(self, texts: pa.Array) -> np.ndarray:
        """A row of features for each text, all zero for one without tokens. Each distinct token of the batch is looked up once."""
        tokens, first = tokens_of(texts)
        tokens = tokens.dictionary_encode()
        known, places = tokens.dictionary, tokens.indices.to_numpy()
        codes = np.array([self.codes[t] for t in known.to_pylist()], dtype=np.float64)[places]
        flags = codes.astype(np.int64) >> 6
        weight = codes - (flags << 6)
        n = np.diff(first)
        full = np.flatnonzero(n > 0)
        out = np.zeros((len(n), FEATURES))
        if not len(full):
            return out
        begins, n = first[:-1][full], n[full]
        owner = np.repeat(np.arange(len(full)), n)
        spaced = np.zeros(len(full), dtype=np.int64)
        apart = np.flatnonzero(flags & 8)
        if len(apart) >= 4:
            for run in np.split(apart, np.flatnonzero((np.diff(apart) > 1) | (np.diff(owner[apart]) > 0)) + 1):
                if len(run) >= 4 and (w := self.words.get("".join(known[int(places[i])].as_py() for i in run).lower(), 0.0)):
                    weight[run[0]] = max(weight[run[0]], w)
                    spaced[owner[run[0]]] += 1
        raw, offsets = buffers(texts)
        at, size = offsets[:-1][full], np.diff(offsets)[full]
        kind = _BYTE_KINDS[raw]
        count = lambda mask: np.add.reduceat(mask, at, dtype=np.int64)  # noqa: E731  # bytes between the texts there are none
        upper, lower, digits, signs, shouts, asks = (count(kind & bit > 0) for bit in (1, 2, 4, 8, 16, 32))
        of_text = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64)
        second, capitals, hidden = (of_text(flags & bit > 0) for bit in (1, 2, 4))
        hidden = hidden + spaced
        hits = np.flatnonzero(weight > 0)
        numbers = np.zeros((len(full), 7))  # hits, sum and maximum of weights, distinct, near, close together
        for rows in np.split(hits, np.flatnonzero(np.diff(owner[hits])) + 1) if len(hits) else ():
            k, strong = owner[rows[0]], weight[rows]
            near = gap = 0.0
            if second[k]:
                own = begins[k] + np.flatnonzero(flags[begins[k] : begins[k] + n[k]] & 1)
                where = np.searchsorted(own, rows)
                near = float((np.minimum(np.abs(rows - own[np.maximum(where - 1, 0)]), np.abs(rows - own[np.minimum(where, len(own) - 1)])) <= 5).sum())
            if len(rows) > 1:
                gap = float((np.diff(rows) <= 20).sum())
            numbers[k] = len(rows), strong.sum(), strong.max(), len(set(places[rows].tolist())), near, gap, 0
        found, total, highest, distinct, near, gap, _ = numbers.T
        out[full] = np.stack([
            np.log1p(found), found / n, total / n, highest, np.log1p(total), distinct, near, near / n, gap, second / n,
            upper / np.maximum(1, upper + lower), capitals / n, shouts / n, asks / n, signs / size, digits / size, hidden, hidden / n, np.log1p(n),
        ], axis=1)
        return out


def _units(text: str) -> set[str]:
    """Words, and word beginnings marked by a star, of a text."""
    words = {w for token in set(text.split()) for w in spellings(token)[0]}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def learned_lexicons(sample: DataFrame, least: int = 8, ratio: float = 12.0, most: int = 2000) -> list[Lexicon]:
    """Lexicons of the rows with an odd key, of those with an even key, and of all, each for use where its rows weren't.

    A lexicon holds the seed words plus the units whose document rate in toxic rows is ratio times that in the others.
    sample is bounded; its units are counted in each task and summed by unit. At most `most` units of each lexicon reach the driver.
    """
    names = [f"n{half}{y}" for half in (0, 1) for y in (0, 1)]

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for key, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for u in _units(text or ""):
                    seen.setdefault(u, [0, 0, 0, 0])[2 * (key % 2) + y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))], ["unit", *names])

    size = {(r["half"], r["y"]): r["n"] for r in sample.groupBy((F.col("key") % 2).alias("half"), "y").agg(F.count("*").alias("n")).collect()}
    counted = sample.select("key", "text", "y").mapInArrow(count, "unit string, " + ", ".join(f"{c} long" for c in names)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in names])
    counted = settled(counted.where(F.col("n01") + F.col("n11") > 2))
    made = []
    for halves in ((1,), (0,), (0, 1)):
        words, prefixes = {w: 3.0 for w in SEED}, {}
        clean, toxic = (sum(size.get((half, y), 0) for half in halves) for y in (0, 1))
        if toxic:
            in_clean, in_toxic = (sum((F.col(f"n{half}{y}") for half in halves), F.lit(0)) for y in (0, 1))
            odds = F.ln((in_toxic + 0.5) / (toxic + 1)) - F.ln((in_clean + 0.5) / (max(1, clean) + 1))
            kept = counted.where(in_toxic >= max(3, min(least, toxic // 20))).select("unit", odds.alias("odds")).where(F.col("odds") >= float(np.log(ratio)))
            for r in kept.orderBy(F.desc("odds"), "unit").limit(most).collect():
                if r["unit"].endswith("*"):
                    prefixes[r["unit"][:-1]] = r["odds"]
                else:
                    words[r["unit"]] = max(words.get(r["unit"], 0.0), r["odds"])
        made.append(Lexicon(words, prefixes))
    return made


def _near_key(text: str | None, width: int = 5) -> int:
    """Smallest hash among the hashes of the five-word shingles: most near copies of a text share it, other texts don't."""
    words = (text or "").lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + width])) >> 1 for i in range(max(1, len(words) - width + 1))), default=0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 16_000) -> tuple[Lexicon, Calibrated]:
    """Lexicon and calibrated model from at most sample_rows labelled rows that aren't held out.

    Of rows that share a near-copy key and a label, that of the smallest id hash stays, so the fit is a function of the
    tables' contents, however they are partitioned.
    """
    short_batches(docs.sparkSession)
    key = F.arrow_udf(_near_keys, "long")
    sample = labelled_sample(docs, labels, doc_id, text, label, sample_rows).withColumn("key", key("text"))
    sample = settled(sample.groupBy("key", "y").agg(F.min_by("text", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("text")))
    # The lexicon that a half's features use comes from the other half, as an unseen text's does.
    *halves, whole = learned_lexicons(sample)
    shared = docs.sparkSession.sparkContext.broadcast([(x.words, x.prefixes) for x in halves])

    def rows(batches):
        both = [Lexicon(*x) for x in shared.value]
        for batch in batches:
            keys, texts, ys = (batch.column(k) for k in range(3))
            half = np.array([k % 2 for k in keys.to_pylist()], dtype=np.int64)
            made = np.zeros((len(half), FEATURES))
            for k in (0, 1):
                made[half == k] = both[k].features_of(texts.take(pa.array(np.flatnonzero(half == k))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(made.tolist(), pa.list_(pa.float64())), ys], ["key", "x", "y"])

    got = sorted((r["key"], r["y"], r["x"]) for r in sample.select("key", "text", "y").mapInArrow(rows, "key long, x array<double>, y int").collect())
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(-1, FEATURES)
    y = np.array([r[1] for r in got], dtype=np.float64)
    return whole, Calibrated().fit(x, y)


def _near_keys(texts: pa.Array) -> pa.Array:
    return pa.array([_near_key(t) for t in texts.to_pylist()], pa.int64())


def toxicity_score(fitted: tuple[Lexicon, Calibrated], session):
    """Column function: text -> score from 0 to 1."""
    lexicon, model = fitted
    shared = session.sparkContext.broadcast((lexicon.words, lexicon.prefixes, model))

    def score(texts: pa.Array) -> pa.Array:
        fit = shared.value[2]
        own = worker_state(shared.value, lambda v: Lexicon(v[0], v[1]))
        x = [own.features_of(part) for part in parts_of(texts)]
        return pa.array(np.clip(fit(np.concatenate(x)), 0.0, 1.0) if x else [], pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(score, "double").asNondeterministic()
    return lambda column: made(column.cast("string"))


_near_keys.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 16_000) -> DataFrame:
    """docs with held_out, score and predicted added (same names are replaced).

    Null and empty texts are scored as texts without words, texts of any length whole; an empty table stays empty. Repeated rows
    score alike. With fewer than two training rows of either label every score is the training rows' mean label (0 without any).
    """
    score = toxicity_score(fit_toxicity(docs, labels, doc_id, text, label, sample_rows), docs.sparkSession)
    made = docs.withColumn("__score", score(F.col(text)))
    return made.withColumns({"held_out": held_out(F.col(doc_id)), "score": F.col("__score"), "predicted": (F.col("__score") >= 0.5).cast("int")}).drop("__score")
