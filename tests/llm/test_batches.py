"""Batch-wise cutting, merging and features against plain per-text versions."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import bpe, cutting, toxicity, token_counts
from curatrix.llm.common import WHITE_SPACE
from curatrix.llm.merging import byte_letters

LETTERS = "ab é\n\t   x　' 中\x1c \x85.  's'll're1²½ªЖ́😀"


def some_texts(seed, n=4000):
    rng = random.Random(seed)
    return [*("".join(rng.choice(LETTERS) for _ in range(rng.randrange(14))) for _ in range(n)), "", None, " ", "a", "'s", "x's"]


def library_pretokens(name):
    from tokenizers import Tokenizer

    own, byte = Tokenizer.from_file(public_tokenizers.path(name)).pre_tokenizer, {c: b for b, c in enumerate(byte_letters())}
    return lambda text: [bytes(byte[x] for x in piece) for piece, _ in own.pre_tokenize_str(text)]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pretokens_equal_the_library(name, spaced):
    plain, texts = library_pretokens(name), some_texts(1)
    every = [f"a{chr(p)}b1{chr(p)}2.{chr(p)}." for p in range(1, 0x20000, 7) if not 0xD800 <= p < 0xE000]
    for rows in (texts, texts[50:60], every):
        units, first, hard = cutting.pretokens(pa.array([*texts[:50], *rows], pa.string()).slice(50), spaced)
        units = [u.encode() for u in units.to_pylist()]
        for k, text in enumerate(rows):
            assert hard[k] or units[first[k] : first[k + 1]] == plain(text or ""), text
    assert [len(x) for x in cutting.pretokens(pa.array([], pa.string()), spaced)] == [0, 1, 0]


def test_tokens_are_stretches_between_white_space():
    texts = some_texts(2)
    units, first = cutting.tokens_of(pa.array(texts))
    units = units.to_pylist()
    for k, text in enumerate(texts):
        assert units[first[k] : first[k + 1]] == re.findall(f"[^{WHITE_SPACE}]+", text or "")


def test_parts_cover_all_texts():
    texts = pa.array(["a" * n for n in (0, 5, 100, 3, 3, 0, 0, 50)] + [None])
    for most in (1, 7, 1000):
        parts = list(cutting.parts_of(texts, most))
        assert pa.concat_arrays(parts).equals(texts) and all(len(p) == 1 or len("".join(filter(None, p.to_pylist()))) <= most for p in parts)


def test_side_by_side_merges_equal_one_by_one():
    rules, rng = bpe.rules(bpe.word_path(None)), random.Random(3)
    words = ["".join(rng.choice("abcdehinorst'é") for _ in range(rng.choice([1, 2, 5, 9, 30, 64, 65, 90]))) for _ in range(600)]
    raw, offsets = cutting.buffers(pa.array(words))
    ids, counts = rules.pairs.merge(raw, offsets[:-1], np.diff(offsets))
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, word in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == rules.merge(word), word


def test_automaton_finds_all_words_side_by_side():
    words = {w: [i, i + 1] for i, w in enumerate(["nation", "station", "stations", "ration", "a", "é", "éa", "ab"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    asked = [*words, "nat", "nations", "b", "éab", "x" * 300]
    raw, offsets = cutting.buffers(pa.array(asked))
    ranks = lexicon.find_all(raw, offsets[:-1], np.diff(offsets))
    ids, counts = lexicon.ids_of(ranks[ranks >= 0])
    assert (ranks >= 0).tolist() == [w in words for w in asked] and ids.tolist() == [i for w in words.values() for i in w] and set(counts) == {2}
    empty = bpe.Lexicon(bpe.Lexicon.compile({}))
    assert (empty.find_all(raw, offsets[:-1], np.diff(offsets)) == -1).all()


def test_lengths_survive_a_full_cache():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lengths = token_counts.Lengths(path, {" the": 1}, most=3)
    for units in (["qq", " zq", "xqz", " the"], ["qq", "wq"], ["a", "b", "c", "d", "e" * 100]):
        assert lengths.of(pa.array(units)).tolist() == [token_counts.text_length(path, u) for u in units]
        assert len(lengths.cache) <= 4


def plain_features(lexicon, text):
    """The features of one text, token by token."""
    tokens = re.findall(f"[^{WHITE_SPACE}]+", text or "")
    n, out = len(tokens), np.zeros(toxicity.FEATURES)
    if not n:
        return out
    weight, second, capitals, hidden, letters = [], [], 0, 0, []
    for t in tokens:
        plain, maybe = toxicity.spellings(t)
        w = max([lexicon.weight(p) for p in plain], default=0.0)
        if not w and (w := max([lexicon.words.get(h, 0.0) for h in maybe], default=0.0)):
            hidden += 1
        weight.append(min(w, 60.0))
        second.append(any(p in toxicity.SECOND for p in plain))
        capitals += len(t) > 2 and t.isupper()
        letters.append(len(t) == 1 and t.isalpha())
    i = 0
    while i < n:
        j = i
        while j < n and letters[j]:
            j += 1
        if j - i >= 4 and (w := lexicon.words.get("".join(tokens[i:j]).lower())):
            weight[i], hidden = max(weight[i], w), hidden + 1
        i = max(j, i + 1)
    hits, own = [k for k in range(n) if weight[k] > 0], [k for k in range(n) if second[k]]
    total, near = sum(weight[k] for k in hits), sum(min(abs(k - s) for s in own) <= 5 for k in hits) if own else 0
    gap = sum(b - a <= 20 for a, b in zip(hits, hits[1:]))
    count = lambda low, high: sum(low <= c <= high for c in text)
    upper, lower, digits, size = count("A", "Z"), count("a", "z"), count("0", "9"), len(text.encode())
    signs = sum("!" <= c < "\x7f" for c in text) - upper - lower - digits
    return np.array([
        np.log1p(len(hits)), len(hits) / n, total / n, max([weight[k] for k in hits], default=0), np.log1p(total), len({tokens[k] for k in hits}), near, near / n, gap, len(own) / n,
        upper / max(1, upper + lower), capitals / n, text.count("!") / n, text.count("?") / n, signs / size, digits / size, hidden, hidden / n, np.log1p(n),
    ])


def test_toxicity_features_equal_plain_ones():
    rng = random.Random(4)
    some = ["you", "idiot", "i", "d", "o", "t", "id1ot", "I.D.I.O.T", "stupiiid", "zorgface", "BIG", "a1", "!!", "?", "été", "x,", "du", "(wow)", "3", "***z", "ok…", "²"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(800)] + ["i d i o t", "", " ", None, "i d", "i o t"]
    lexicon = toxicity.Lexicon({"idiot": 3.0, "stupid": 2.0}, {"zorg": 2.5})
    made = lexicon.features_of(pa.array(texts))
    assert np.allclose(made, [plain_features(lexicon, t) for t in texts], rtol=1e-12, atol=0)


def test_toxicity_is_a_function_of_the_tables(spark):
    rng = random.Random(5)
    plain = [f"bla{k}" for k in range(40)]
    rows = []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(12)] + (["zorghead", "idiot"] if i % 3 == 0 else [])
        rows.append((i, " ".join(w), i % 3 == 0))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join([*w, "copy", "here"]), i % 3 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "another text of a repeated id"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    run = lambda d, l: sorted((r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score_toxicity(d, l).collect())  # noqa: E731, E741
    once = run(docs.coalesce(1), labels.coalesce(1))
    assert run(docs.repartition(5, "text"), labels.repartition(3, "toxic")) == once and len(once) == len(rows) + 2
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_samples_by_hash_are_bounded_and_stable(spark):
    from curatrix.llm.boosting import sample_by_hash

    rows = spark.range(5000).withColumnRenamed("id", "k")
    order = [r["k"] for r in rows.orderBy(F.pmod(F.xxhash64("k", F.lit(42)), F.lit(1 << 40))).collect()]
    for most in (0, 10, 400, 4999, 9000):
        assert [r["k"] for r in sample_by_hash(rows.repartition(7), "k", most).collect()] == order[:most]


def test_both_decontamination_forms_agree_on_odd_rows(spark):
    from curatrix.llm.decontaminate import _joined, decontaminate

    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item, 5, 6), (2, None, 7, 8), (2, None, 7, 8), (3, f"x {item} mid short item", 1, 2)], "doc_id long, text string, row int, item int")
    bench = spark.createDataFrame([(None, item), (None, "short item"), (4, item), (4, item), (9, None)], "item_id long, text string")
    one, two = (sorted(map(str, decontaminate(docs, bench, most_bytes=size).select("doc_id", "row", "item", "n_words", "n_hit", "n_items", "items_sha256").collect())) for size in (64 << 20, 1))
    assert one == two and len(one) == 4
    assert decontaminate(docs.limit(0), bench, most_bytes=1).count() == 0 and decontaminate(docs, bench.limit(0), most_bytes=-1).where("contaminated").count() == 0
    bare = (docs, bench, "text", "item_id", "text", 10)
    assert sorted(map(str, _joined(*bare, filter_bytes=0).select("doc_id", "n_hit", "items_sha256").collect())) == sorted(map(str, _joined(*bare).select("doc_id", "n_hit", "items_sha256").collect()))


def test_quality_with_odd_tables(spark):
    from curatrix.llm.quality import score_quality

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma.", "delta", "of", "to"]) for _ in range(60)) if i % 3 else "## $$ 1 1 1 1 " * 9, "en", 9, True) for i in range(180)]
    rows += [(5, "x " * 30000, "de", 1, None), (5, None, None, 2, None), (9000, "", None, 3, None), (9001, "unlabelled text of words", "fr", 4, None), (None, None, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, keep boolean")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1)], "doc_id long, quality int")
    run = lambda d: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["keep"]) for r in score_quality(d, labels).collect())
    once = run(docs.coalesce(1))
    assert run(docs.repartition(5, "text")) == once and len(once) == len(rows) and all(0 <= r[2] <= 1 for r in once)
    right = [r[3] == (r[1] % 3 > 0) for r in once if 150 <= r[1] < 180]
    assert sum(right) / len(right) > 0.9
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in score_quality(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_ring_walk_equals_one_by_one():
    """Bounded loads, one key after another and point by point round the ring, against the walk over arcs."""
    from curatrix.llm import sharding

    for seed in range(6):
        rng = random.Random(seed)
        shards = 6
        points = sharding.ring_points(shards, 8)
        counts = [rng.choice([0, 0, 1, 5, 40]) for _ in points]
        total = sum(counts)
        room = [total // shards + (s < total % shards) for s in range(shards)]
        expected, waiting = {}, []
        for arc, n in enumerate(counts):
            for key in range(n):
                shard = points[arc][1]
                if room[shard]:
                    room[shard] -= 1
                    expected[arc, key] = shard
                else:
                    waiting.append((arc, key))
        for arc, key in waiting:
            at = arc
            while not room[points[at % len(points)][1]]:
                at += 1
            room[points[at % len(points)][1]] -= 1
            expected[arc, key] = points[at % len(points)][1]
        walk = sharding.bounded_walk(points, counts, shards)
        assert {(arc, key): shard for arc, low, high, shard, _ in walk for key in range(low, high)} == expected
        for s in range(shards):
            slots = sorted(first + k for _, low, high, shard, first in walk if shard == s for k in range(high - low))
            assert slots == list(range(len(slots)))
