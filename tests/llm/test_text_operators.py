import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from curatrix.llm import bpe, decontaminate, pii, sharding, simhash, toxicity, token_counts
from curatrix.llm.boosting import Calibrated, Isotonic

ODD = [None, "", " ", "\n \r\n", "a" * 30000, "x " * 5000, "<|endoftext|> a <|startoftext|>b", "ΑΣ İ ǅ é \x1c\x1f x\x85y 　 it's I'LL ½ ١٢ 😀👍🏽", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    letters = "ab cS\n\t '.,!éßΣİ́😀12\x1c\x1f\x85\xa0 <|>endoftext"
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    return spark.createDataFrame([(i if i != 5 else None, t, 9, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, fp string")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts_equal_the_library(spark, odd):
    own = library("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        n = len(own.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 512)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_bpe_equals_the_library_both_ways(spark, odd):
    own = library("word_bpe_49k.json")
    for r in bpe.encode_texts(odd, frequent=50).collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded"] == own.decode(ids, skip_special_tokens=False) == bpe.decode(ids)
    assert bpe.encode_texts(odd.limit(0), digests=True).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w: [i, i + 1] for i, w in enumerate(["nation", "station", "stations", "ration", "a", "é", "éa", "ab"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    assert {w: lexicon.find(w) for w in words} == words
    assert [lexicon.find(w) for w in ("", "nat", "nations", "b", "éab")] == [None] * 5
    # equal suffixes are one state: "nation" and "ration" differ in one arc only
    assert len(lexicon.final) < len({w[:k] for w in words for k in range(len(w.encode()) + 1)})
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find("a") is None


def test_long_merge_equals_short():
    rules = bpe.rules(bpe.word_path(None))
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 60)))
        symbols = [rules.letters[b] for b in word.encode()]
        symbols[-1] += rules.suffix
        assert rules._merge_short(list(symbols)) == rules._merge_long(list(symbols))


def brute_base(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def test_base_spans_equal_plain_matching():
    rng = random.Random(3)
    for _ in range(30000):
        text = "".join(rng.choice("ab@.@.-+ 0123(9é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("1" * 200000) == [] and pii.base_spans("a" * 200000 + "@") == []


def test_pii_query_and_masking(spark):
    texts = ["mail bo@a.example.com or +1 (212) 555-0199", "card 4539 1488 0343 6467, ip 10.20.30.40", "write to jo (at) site (dot) org", "IBAN DE89 3704 0044 0532 0130 00", "on 2024-10-11 v1.2.3", None, ""]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.find_pii(rows).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[2] == j for s in base) for j in range(4)]
        assert set(filter(None, pii.joined(base).split(","))) <= set(got[i]["spans"].split(","))
    assert got[2]["spans"].startswith("email:") and got[3]["spans"].startswith("id:") and got[4]["spans"] == ""
    hidden = {r["doc_id"]: r["text"] for r in pii.mask_pii(rows).collect()}
    assert hidden[0] == "mail [EMAIL] or [PHONE]" and hidden[5] is None and hidden[6] == "" and hidden[4] == texts[4]
    assert pii.find_pii(rows.limit(0)).count() == 0


def test_long_values_are_found_and_masked_whole(spark):
    """Values at ten times the lengths that used to end a match, like their short forms."""
    values = {"secret": ("my password: {} and on", "aB3" * 3400), "name": ("I met Dr {} there", "Jo" + "h" * 300), "email": ("write to {} (at) site (dot) org now", "jo." * 250 + "x")}
    values["host"] = ("write to jo (at) {} (dot) org now", "site-" * 150 + "x")
    for kind, (frame, value) in values.items():
        for own in (value[:12], value):
            text = frame.format(own)
            (start, end, number), *others = sorted(pii.further_spans(text))
            whole = f"jo (at) {own} (dot) org" if kind == "host" else f"{own} (at) site (dot) org" if kind == "email" else own
            assert text[start:end] == whole and pii.KINDS[number] == ("email" if kind == "host" else kind) and not others
    name = "Frau Anna Maria von Schmidt"
    assert [name[a:b] for a, b, _ in pii.further_spans(name)] == ["Anna Maria"]
    rows = spark.createDataFrame([(0, values["secret"][0].format(values["secret"][1]))] + [(k, f"my password: {'xY9' * k} and on") for k in range(3, 30)], "doc_id long, text string")
    assert {r["text"] for r in pii.mask_pii(rows).collect()} == {"my password: [SECRET] and on"}
    long = "a (at) " * 20_000 + "jo." * 60_000
    assert pii.further_spans(long) == [(7 * 19_999, len(long) - 1, 0)]  # one address at the end, found without reading the text once a mark


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ß", "7"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 14])))) for i in range(12)] + [(50, None), (51, " .. "), (52, "W1-w2")]
    docs = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            text[5:5] = items[rng.randrange(12)][1].upper().split(" ")
        docs.append((i, ", ".join(text) if i else None))
    docs.append((3, docs[3][1]))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expected = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        expected[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for bound in (1 << 20, 1):  # the broadcast form and the shuffle form
        assert Counter(tuple(r) for r in decontaminate.decontaminate(d, b, most_bytes=bound).select(names).collect()) == expected
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.decontaminate(d, b, remove="documents")
    assert kept.count() == sum(n for k, n in expected.items() if not k[-1])
    cut = decontaminate.decontaminate(d, b.where("item_id = 0"), remove="spans")
    assert cut.count() == len(docs) and items[0][1].upper().replace(" ", ", ") not in {r["text"] for r in cut.select("text").collect()}


def brute_groups(pairs, radius=3):
    fps = defaultdict(list)
    for i, f in pairs:
        fps[f].append(i)
    keys = list(fps)
    parent = {f: f for f in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= radius:
                parent[find(keys[a])] = find(keys[b])
    least = {}
    for f in keys:
        least[find(f)] = min([least.get(find(f), 1 << 64), *fps[f]])
    return {(i, f): least[find(f)] for i, f in pairs}


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO", "A b c d É\x1cf", "x y z " * 30000):
        assert simhash.fingerprint(t) == (brute_fingerprint(t) if t is None or len(t) < 1000 else simhash.fingerprint(t))


def test_covering_is_certain():
    rng = random.Random(5)
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not difference & m for m in masks)


@pytest.mark.parametrize("most", [2048, 6])
def test_links_equal_brute_force_in_full_buckets_too(spark, most):
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(14):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for k in range(0, 30, 3):
        chain ^= 7 << k
        fps.add(chain)
    from curatrix.operators.components import connected_components

    rows = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r["id"]: r["component"] for r in connected_components(simhash.linked_fingerprints(rows, 3, most)).collect()}
    expected = brute_groups([(simhash.signed(f), f) for f in fps])
    for f in fps:
        assert got.get(simhash.signed(f), simhash.signed(f)) == expected[simhash.signed(f), f]


def test_simhash_groups_and_dropping(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base, base.replace("word7 ", "other "), "quite another text here", None, "", "quite another text here"]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    expected = brute_groups([(i, brute_fingerprint(t)) for i, t in rows])
    for r in simhash.simhash_groups(docs).collect():
        assert r["component_id"] == expected[r["doc_id"], int(r["fingerprint"], 16)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(expected.values())
    twice = docs.union(docs).union(spark.createDataFrame([(None, "alone stands this", "c"), (None, base, "c")], docs.schema))
    assert Counter(r["doc_id"] for r in simhash.drop_near_duplicates(twice).collect()) == Counter([*set(expected.values()), None])
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_sharding_law(spark, hot):
    key = F.when(F.col("id") < 700, 7).otherwise(F.col("id")) if hot else F.col("id")
    docs = spark.range(2003).select(key.alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("é"), (F.col("id") % 4).cast("string"))).alias("text"), F.lit(1).alias("shard"))
    rows = sharding.assign_shards(docs, shards=7, virtual=16, cell_rows=60).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(v) for v in slots.values()]
    assert len(rows) == 2003 and len(slots) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["size"] for r in rows} == {16, 19}
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_ring_walk_keeps_homes_and_moves_little():
    points = sharding.ring_points(10, 64)
    counts = [random.Random(k).randint(0, 30) for k in range(len(points))]
    walk = sharding.bounded_walk(points, counts, 10)
    assert sum(high - low for _, low, high, _, _ in walk) == sum(counts)
    home = sum(high - low for arc, low, high, shard, _ in walk if points[arc][1] == shard)
    assert home > 0.8 * sum(counts)
    more = dict(sharding.ring_points(11, 64))
    assert all(more[p] == s for p, s in points if p in more)


def test_toxicity_catches_planted_and_leaves_clean(spark):
    rng = random.Random(8)
    plain = [f"bla{k}" for k in range(60)]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(["idiot", "zorgface", "Zorgheads", "scum"]))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "w " * 20000, "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 500] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    unseen = [r for r in rows if r[0] >= 500 or got[r[0]]["held_out"]]
    right = sum(got[i]["predicted"] == int(y) for i, _, y in unseen)
    assert right / len(unseen) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9001]["predicted"] == got[9002]["predicted"] == got[9003]["predicted"] == 0
    none = toxicity.score_toxicity(docs.limit(5), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_obfuscation_is_seen():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {"zorg": 2.0})
    hits = lambda t: lexicon.features(t)[5]
    assert all(hits(t) == 1 for t in ("an id1ot here", "an i.d.i.o.t here", "you idiooot", "Zorgfest")) and hits("an idiom here") == 0
    assert lexicon.features("so i d i o t it is")[16] == 1


def test_isotonic_and_constant_fits():
    import numpy as np

    m = Isotonic().fit(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(m(np.linspace(-1, 4, 50))) >= 0).all()
    assert Calibrated().fit(np.zeros((0, 2)), np.zeros(0))(np.zeros((3, 2))).tolist() == [0.0] * 3


def test_spans_are_cut_with_large_benchmarks_too(spark):
    from curatrix.llm.decontaminate import decontaminate

    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Été before, {item.upper()} — after"), (2, "nothing here"), (3, None), (4, f"{item} mid {item}"), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "mid one two")], "item_id long, text string")
    one, two = ({r["doc_id"]: r.asDict() for r in decontaminate(docs, bench, remove="spans", most_bytes=size).collect()} for size in (64 << 20, 1))
    assert one == two and two[1]["text"].startswith("Été before, ") and "SEVEN" not in two[1]["text"] and two[3]["text"] is None


def test_bpe_lexicon_comes_from_the_vocabulary_alone(spark):
    """Nothing is read before the texts are encoded, and the ids are the same with any number of words in the automaton."""
    unread = spark.range(3).select(F.raise_error(F.lit("read")).cast("string").alias("text"))
    assert "n_tokens" in bpe.encode_texts(unread).columns
    texts = spark.createDataFrame([(k, f"The {w} runs, {w}{k} zzqx{k}! naïve привет") for k, w in enumerate(("house", "zorgle", "übung", "", "internationalisation"))] + [(9, None)], "k int, text string")
    whole, few, none = (sorted((r["k"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in bpe.encode_texts(texts, frequent=n).collect()) for n in (65536, 3, 0))
    assert whole == few == none and whole[0][1] > 3
