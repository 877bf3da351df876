"""Operators 11 to 13 against plain versions, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import resampling, spelling, warc

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def word_documents():
    rng = random.Random(5)
    stems = ["nation", "nations", "nattion", "natoin", "Élégant", "elegant", "station", "banana", "bananna", "bannana", "aaaaaa", "aaaaaaa", "aaaaaab", "x" * 400, "x" * 399 + "y"]
    weights = [60, 9, 5, 5, 8, 30, 40, 50, 6, 6, 30, 5, 4, 9, 1]
    docs = [(i, " ".join(rng.choices(stems, weights, k=40)).replace(" nation", rng.choice([" NATION", "×nation", " nation"])), "w") for i in range(60)]
    return [*docs, (60, None, None), (61, "", "w"), (None, "station station stations", "w"), (3, docs[3][1], "w"), (62, "short, words; 12345678", "w"), (63, "nation-" * 3000, None), (64, "planet " * 260 + "planets " * 40 + "planetsy " * 8, "w")]


def plain_variants(docs, least=5, ratio=5):
    n = Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    near_of = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], len(near_of[w]), form[w], n.get(form[w]), root(w)) for w in n}


def test_spelling_variants_equal_a_plain_version(spark):
    docs = word_documents()
    made = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string, word string"))
    want = plain_variants(docs)
    assert {tuple(r) for r in made.select("word", "n", "n_near", "form", "form_n", "root").collect()} == want
    assert made.count() == len(want) > 8
    assert any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want if r[3])  # chains of two forms and more
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string, word string"), ratio=1)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    docs = word_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string")
    whole = {tuple(r) for r in spelling.word_counts(frame, "doc_id", "text", 199, 6).collect()}
    plain = Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = spelling.altered(zlib.crc32(f"{'' if doc is None else doc}:".encode()), run.translate(LOWER), 199)
            plain[word] += len(word) >= 6
    assert whole == {(w, n) for w, n in plain.items() if n}


def test_deletion_keys_are_equal_only_for_equal_strings():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(400)]
    keys, owner, place = spelling.deletion_keys(words)
    strings = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner, place, strict=True)]
    assert len(set(zip(keys.tolist(), strings, strict=True))) == len(set(keys.tolist())) == len(set(strings))
    for i, w in enumerate(words):
        own = [s for s, o, p in zip(strings, owner, place, strict=True) if o == i and p >= 0]
        assert len(own) == len(set(own)) and set(own) == {w[:k] + w[k + 1 :] for k in range(len(w))}
    long = "ab" * 200_000
    assert len(spelling.deletion_keys([long])[0]) == 400_001  # a row a place, and no string of them


def page_rows():
    return [
        (1, "http://a/1", "<p>same</p>", "k"), (2, "http://a/2", "<p>same</p>", "k"), (3, "http://a/3", "<p>same</p>", None), (4, "http://b", "", "k"), (5, None, None, "k"),
        (6, "http://c\r\nWARC-Type: revisit", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "k"), (7, "http://d", "é\x00\r\n\r\nß😀" * 40_000, "k"), (8, "http://e", "one", "k"), (8, "http://e", "one", "k"),
        (None, "http://f", "null id", "k"), (None, "http://f", "one", "k"),
    ]


def plain_archive(rows):
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        first = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if page == first else "revisit", None if page == first else first))
    return Counter(out)


@pytest.fixture
def archive(spark, tmp_path):
    frame = spark.createDataFrame(page_rows(), "page_id long, url string, html string, warc_type string").repartition(3)
    made = warc.write_and_read_archive(frame, str(tmp_path / "crawl"))
    return made, tmp_path / "crawl"


def test_archive_equals_a_plain_version(spark, archive, tmp_path):
    assert Counter(map(tuple, archive[0].collect())) == plain_archive(page_rows())
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_and_read_archive(empty, str(tmp_path / "none")).count() == 0


def test_archive_reads_back_payloads_and_headers(spark, archive):
    read = spark.read.format("warc").load(str(archive[1]))
    rows = read.where("warc_type = 'response'").collect()
    payloads = {r["record_id"]: bytes(r["payload"]).decode() for r in rows}
    assert payloads["urn:page:7"] == page_rows()[6][2] and payloads["urn:page:6"] == page_rows()[5][2]
    assert {r["target_uri"] for r in rows if r["record_id"] == "urn:page:6"} == {"http://c WARC-Type: revisit"}
    assert all(r["http_headers"]["content-length"] == str(len(bytes(r["payload"]))) for r in rows)
    revisits = read.where("warc_type = 'revisit'").collect()
    assert all(r["payload"] is None and r["headers"]["warc-profile"] == warc.PROFILE for r in revisits)


def test_filters_reach_the_source(spark, archive):
    read = spark.read.format("warc").schema("warc_type string, record_id string, content_length long").load(str(archive[1]))
    some = read.where("warc_type in ('revisit', 'request') and record_id like 'urn:page:%' and content_length > 0")
    left = [line for line in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter (" in line]
    assert len(left) == 1 and "content_length" in left[0] and "warc_type" not in left[0] and "record_id" not in left[0]  # the source took the other two
    assert {r["record_id"] for r in some.collect()} == {"urn:page:1", "urn:page:2", "urn:page:4", "urn:page:"}


def test_reader_decides_on_headers_and_passes_over_the_rest(tmp_path, monkeypatch):
    rows = [{"warc_type": kind, "record_id": f"urn:{i}", "payload": b"x" * 3_000_000, "refers_to": "urn:0"} for i, kind in enumerate(("response", "revisit", "response"))]
    raw = b"".join(gzip.decompress(warc.record_bytes(r)) for r in rows)
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc.record_bytes(r) for r in rows))
    (tmp_path / "notes.txt").write_text("no archive")
    from pyspark.sql.types import _parse_datatype_string as parsed  # noqa: PLC0415

    read = []
    block = warc.Stream.block
    monkeypatch.setattr(warc.Stream, "block", lambda self, size: read.append(size) or block(self, size))
    source = warc.WarcDataSource({"path": str(tmp_path)})
    reader = source.reader(parsed("warc_type string, payload binary"))
    equal = warc.D.EqualTo(("warc_type",), "revisit")
    other = warc.D.GreaterThan(("content_length",), 5)
    assert list(reader.pushFilters([equal, other])) == [other]
    (part,) = reader.partitions()
    assert len(part.paths) == 2
    found = [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert found == [{"warc_type": "revisit", "payload": None}] * 2 and max(read) < 1000
    read.clear()
    reader = source.reader(parsed("record_id string"))
    assert [row["record_id"] for batch in reader.read(part) for row in batch.to_pylist()] == ["urn:0", "urn:1", "urn:2"] * 2 and not read
    assert len(warc.WarcDataSource({"path": str(tmp_path), "partition_bytes": "1"}).reader(parsed("record_id string")).partitions()) == 2


def test_files_that_no_manifest_lists_are_not_read(spark, archive):
    before = spark.read.format("warc").load(str(archive[1])).count()
    (archive[1] / "curatrix-dead-1.warc.gz").write_bytes(warc.record_bytes({"warc_type": "response", "record_id": "urn:x", "payload": b"left by a lost task"}))
    assert spark.read.format("warc").load(str(archive[1])).count() == before
    (archive[1] / "foreign.warc.gz").write_bytes(warc.record_bytes({"warc_type": "response", "record_id": "urn:y", "payload": b"another crawler's"}))
    assert spark.read.format("warc").load(str(archive[1])).count() == before + 1


def test_damaged_archives_fail(tmp_path):
    good = gzip.decompress(warc.record_bytes({"warc_type": "response", "record_id": "urn:1", "payload": b"abc"}))
    from pyspark.sql.types import _parse_datatype_string as parsed  # noqa: PLC0415

    for name, raw in (("cut", good[:-8]), ("other", b"HELLO\r\n" + good), ("changed", good.replace(b"abc", b"abd"))):
        (tmp_path / f"{name}.warc").write_bytes(raw)
        reader = warc.WarcDataSource({"path": str(tmp_path / f"{name}.warc"), "verify": "true"}).reader(parsed("payload binary"))
        with pytest.raises(ValueError):
            list(reader.read(reader.partitions()[0]))


def target_rows(seed, n, extra):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "delta-9", "épée", "x", *[f"w{k}" for k in range(30)]]
    made = [(i, " ".join(rng.choices(words[: 8 + i % 28], k=rng.randint(1, 60))), 1) for i in range(n)]
    return made + extra


DOCS = target_rows(3, 150, [(150, None, 1), (151, "", 1), (152, " .,;!", 1), (None, "alpha " * 25, 1), (7, "beta " * 30, 1), (7, "beta " * 30, 1), (153, "w1 w2 " * 20_000, 1)])
GOAL = target_rows(4, 12, [(90, None, 1), (91, "", 1)])


def plain_resample(docs, goal, orders=1, buckets=10_000, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text, *_ in docs:
        s.update(features(text)[1])
    for _, text, *_ in goal:
        t.update(features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for doc, text, *_ in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 100), (2, 10_000, 0)])
def test_resampling_equals_a_plain_version(spark, orders, buckets, percent):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, weight int").repartition(5)
    goal = spark.createDataFrame(GOAL, "doc_id long, text string, weight int")
    made = resampling.importance_resample(docs, goal, orders=orders, buckets=buckets, percent=percent)
    assert Counter(map(tuple, made.collect())) == plain_resample(DOCS, GOAL, orders, buckets, percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, weight int")
    assert resampling.importance_resample(none, docs).count() == 0
    assert Counter(map(tuple, resampling.importance_resample(docs, none).collect())) == plain_resample(DOCS, [])


def test_ranks_run_through_the_parts(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("doc_id"), (F.col("id") % 3).alias("score"))
    made = resampling.ranked(rows, 1000, 900, "score", "doc_id", part_rows=90).collect()
    ordered = sorted((r for r in made if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ordered] == list(range(1, 901)) and len(made) == 1000
    keys = [(-r["score"], r["doc_id"]) for r in ordered]
    assert keys == sorted(keys)
    assert "Exchange SinglePartition" not in resampling.features_of(rows.select(F.col("doc_id").alias("row"), F.lit("a b").alias("text")), 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert np.isclose(len(ordered), 900)
