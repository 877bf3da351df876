"""Behaviour that once was wrong or slow: JSON round trips, look-ups, schema versions, near-text classes."""

import pytest

from curatrix.operators import neartext as N
from curatrix.operators import relational as R
from curatrix.operators import schema as S
from curatrix.sources import tables as T


def test_json_round_trip_and_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}\nx" if k else None) for k in range(5)], "id int, text string")
    path = str(tmp_path / "t.json")
    T.write_table(rows, path)
    assert {(r["id"], r["text"]) for r in T.read_table(spark, path).select("id", "text").collect()} == {(r["id"], r["text"]) for r in rows.collect()}
    for k, text in enumerate(('[{"id": 1}, {"id": 2}]', '[\n {"id": 1},\n {"id": 2}\n]', '{"id": 1}\n{"id": 2}\n')):
        (tmp_path / f"a{k}.json").write_text(text)
        assert sorted(r["id"] for r in T.read_table(spark, str(tmp_path / f"a{k}.json")).collect()) == [1, 2]
    (tmp_path / "one.json").write_text('{\n "id": 7\n}')
    assert [r["id"] for r in T.read_table(spark, str(tmp_path / "one.json")).collect()] == [7]


def test_lookup_fails_on_absent_keys(spark):
    rows, known = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1.5)], "k string, v double")
    assert {r["k"]: r["v"] for r in R.lookup(rows, known, "k", "v", 0.5).collect()} == {"a": 1.5, "b": 0.5}
    assert R.lookup(rows.where("k = 'a'"), known, "k", "v").first()["v"] == 1.5
    with pytest.raises(Exception, match="no v for k b"):
        R.lookup(rows, known, "k", "v").collect()


def test_schema_versions_are_checked_in_mappings_too(spark):
    raw = spark.createDataFrame([("t",)], "title string")
    with pytest.raises(ValueError, match="schema_version"):
        S.adapt(raw, {"schema_version": 2, "columns": {"title": "title"}})
    with pytest.raises(ValueError, match="columns"):
        S.adapt(raw, {"schema_version": 1})
    assert S.adapt(raw, '{"schema_version": 1, "columns": {"title": "title"}}').first()["text"] == "[TITLE] t"


def test_near_text_classes_and_pairs(spark):
    texts = ["a b c d e f g h", "h g f e d c b a", "a b c d e f g h i", "other words here", "a b c d e f g h", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors = N.tfidf(docs, "id", N.word_terms(docs["text"]))
    pairs = {(r["a"], r["b"]): r["similarity"] for r in N.near_text_pairs(vectors, 0.8).collect()}
    assert set(pairs) == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)} and pairs[0, 1] == pytest.approx(1) and pairs[2, 4] == pytest.approx(pairs[0, 2])
    got = {r["id"]: (r["class"], r["n_links"]) for r in N.near_text_classes(vectors, 0.8).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 4: (0, 3), 2: (2, 3), 3: (3, 0)}
    members, links = N.near_text_links(vectors, 0.8)
    assert links.count() == 1 and members.count() == 5


def test_contained_items_equal_plain_search(spark):
    import random

    rng = random.Random(9)
    words = ["aa", "ab", "abc", "b", "bc", "c"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, line(rng.randint(0, 12))) for i in range(60)] + [(99, None), (1, "aa abc b")]
    items = [(i, line(rng.randint(1, 4))[rng.randint(0, 1) :]) for i in range(25)] + [(50, None), (51, "")]
    d, b = spark.createDataFrame(docs, "doc_id int, t string"), spark.createDataFrame(items, "item_id int, b string")
    expected = sorted((i, k) for i, t in docs for k, x in items if t is not None and x and x in t)
    for most in (1 << 20, 200):
        if most == 200:
            b = b.where("size(split(b, ' ')) > 2")
            expected = [(i, k) for i, k in expected if len(dict(items)[k].split(" ")) > 2]
        got = sorted(map(tuple, N.contained_items(d, b, "doc_id", "item_id", "t", "b", most).collect()))
        assert sorted(set(got)) == sorted(set(expected)) and len(got) >= len(set(expected))


def test_running_sums_cross_cells(spark):
    from curatrix.operators import metrics as Me

    values = [0.1, 0.1001, 0.5, 0.99, -3.0, 1e9, -1e9, 0.1, None]
    df = spark.createDataFrame([(v, k % 2, k + 1) for k, v in enumerate(values)], "s double, g int, x int")
    for by in ([], ["g"]):
        for r in Me.running_sums(df, "s", ["x"], by, then="x").collect():
            same = [(v, k + 1) for k, v in enumerate(values) if not by or k % 2 == r["g"]]
            ahead = sum(x for v, x in same if (r["s"] is None or (v is not None and v > r["s"])) and v is not None) + sum(x for v, x in same if v == r["s"] and x <= r["x"])
            assert (r["run_x"], r["all_x"]) == (ahead, sum(x for _, x in same))


def test_known_categories_and_grids(spark):
    from curatrix.functions import text as X
    from curatrix.operators import metrics as Me
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1, 1, 0.9), ("b", 0, 0, 0.2), ("b", 1, 0, 0.4)], "category string, label int, prediction int, score double")
    assert {r["category"]: r["f1"] for r in Me.category_f1(rows, known=("a", "b")).collect()} == {"a": 1.0, "b": 0.0, "official_score": 0.5}
    for known, message in ((("a",), "unknown category: b"), (("a", "b", "c"), "has no rows")):
        with pytest.raises(Exception, match=message):
            Me.category_f1(rows, known=known).collect()
    assert Me.grid_threshold(rows, [0.5, 0.3, 0.35]).first().asDict() == {"threshold": 0.3, "f1": 1.0}
    assert Me.misses_outside(rows.withColumn("t", F.lit("a word")), F.col("t"), ("word",)).count() == 0
    made = spark.createDataFrame([(["1", "0"],), ([],), (None,)], "l array<string>").select(X.binary_label(F.col("l")).alias("y")).collect()
    assert [r["y"] for r in made] == [1, None, None]


def test_documents_reports_and_feature_caches(spark, tmp_path):
    import json

    from curatrix.sources import cache as C

    T.write_document(spark, {"a": {"b": 1.5}}, str(tmp_path / "m"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())) == {"a": {"b": 1.5}}
    df = spark.createDataFrame([("1", "x", ["p"])], "id string, text string, images array<string>")
    T.write_reports({"all": df, "none": df.limit(0)}, str(tmp_path / "r"))
    assert T.read_table(spark, str(tmp_path / "r/all.csv")).first()["images"] == '["p"]' and T.read_table(spark, str(tmp_path / "r/none.csv")).count() == 0
    calls = []

    def compute(cards):
        calls.append(1)
        return cards.select("id")

    for cards, models in ((df, ["m"]), (df, ["m"]), (df, ["n"]), (df.withColumn("text", df["id"]), ["m"])):
        assert C.cached_features(cards, compute, str(tmp_path / "f"), models).count() == 1
    assert len(calls) == 3
    C.write_cache(spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>"), str(tmp_path / "c"), model="m", mode="joint", image_index=2)
    assert C.read_cache(spark, str(tmp_path / "c"), model="m", mode="joint", image_index=2).count() == 1
    with pytest.raises(C.CacheMismatch, match="image_index"):
        C.read_cache(spark, str(tmp_path / "c"), image_index=0)


def test_column_profile_reads_every_row(spark):
    from curatrix.operators import schema as S

    rows = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "", None)], "id long, Title string, `odd.name` int")
    got = {r["column"]: (r["role"], r["rows"], r["filled"]) for r in S.column_profile(rows).collect()}
    assert got == {"id": ("id", 3, 3), "Title": ("title", 3, 2), "odd.name": (None, 3, 0)}
    assert {(r["column"], r["rows"], r["filled"]) for r in S.column_profile(rows.limit(0)).collect()} == {(c, 0, 0) for c in rows.columns}
