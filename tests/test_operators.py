import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import estimators as E
from curatrix.operators import grouping as G
from curatrix.operators import images as I
from curatrix.operators import metrics as Me
from curatrix.operators import neartext as N
from curatrix.operators import relational as R
from curatrix.operators import schema as S
from curatrix.operators import splits as Sp
from curatrix.operators import vectors as V
from curatrix.operators.components import connected_components


def test_infer_columns():
    roles, unclear = S.infer_columns(["item_id", "name", "description", "image_urls", "target"])
    assert roles == {"id": "item_id", "title": "name", "description": "description", "images": "image_urls", "label": "target"} and not unclear
    assert S.infer_columns(["name", "product_name"])[1]


def test_adapt(spark):
    raw = spark.createDataFrame([(1, "Чай", "100 г", "a.jpg|https://x/y.jpg", "ok")], "sku int, name string, desc string, pics string, answer string")
    schema = {"columns": {"id": "sku", "title": "name", "description": "desc", "images": "pics", "label": "answer"}, "text_fields": ["title", "description"]}
    row = S.adapt(raw, schema, base="/data").first()
    assert row["text"] == "[TITLE] Чай [DESCRIPTION] 100 г" and row["images"] == ["/data/a.jpg", "https://x/y.jpg"] and row["labels"] == ["ok"] and row["id"] == "1"
    with pytest.raises(ValueError, match="leakage"):
        S.adapt(raw, {"columns": {"title": "name"}, "text_fields": ["title", "label"]})
    clash = S.adapt(spark.createDataFrame([("raw", "t")], "text string, title string"), {"columns": {"title": "title"}, "text_fields": ["title"]}).first()
    assert clash["raw__text"] == "raw" and clash["text"] == "[TITLE] t" and clash["id"] == "0"


def test_positive_threshold_golden_and_brute(spark):
    small = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.3), (1, 0.9)], "label int, score double")
    row = Me.positive_threshold(small).first()
    assert 0.1 < row["threshold"] <= 0.3 and row["f1"] == pytest.approx(0.8)
    rng = np.random.default_rng(17)
    y, p = rng.integers(0, 2, 137), np.round(rng.random(137), 3)
    candidates = np.unique(np.r_[Me.POSITIVE_GRID, p])
    f1 = np.array([2 * (y[p >= t] == 1).sum() / max(1, (p >= t).sum() + y.sum()) for t in candidates])
    best = np.flatnonzero(np.isclose(f1, f1.max(), atol=1e-12))
    expected = candidates[best[np.abs(candidates[best] - 0.5).argmin()]]
    row = Me.positive_threshold(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double")).first()
    assert row["threshold"] == pytest.approx(expected) and row["f1"] == pytest.approx(f1.max())


def test_category_f1(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 0, 1, 0, 0], [1, 0, 0, 1, 1, 0], "AAABBB")), "label int, prediction int, category string")
    assert {r["category"]: round(r["f1"], 6) for r in Me.category_f1(rows).collect()} == {"A": 0.666667, "B": 0.666667, "official_score": 0.666667}


def test_components_chain_and_permutation(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    expected = {i: 0 for i in range(51)} | {100: 100, 101: 100}
    for edges in (chain, [(b, a) for a, b in reversed(chain)]):
        got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == expected
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_entity_groups(spark):
    rows = spark.createDataFrame([(1, "Одинаковый товар"), (2, "Одинаковый товар!"), (3, "Другой товар"), (4, None), (5, "")], "id long, title string")
    got = {r["id"]: r["entity_group"] for r in G.entity_groups(rows, "id", G.entity_keys(F.col("title"), F.col("title"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_full_buckets_do_not_link(spark):
    rows = spark.range(30).select("id", F.lit("same signature").alias("s"))
    got = G.entity_groups(rows, "id", {"first_image": (F.col("s"), 20)})
    assert got.where("id <> entity_group").count() == 0


@pytest.fixture(scope="module")
def sellers(spark):
    return spark.createDataFrame([(i, ["ok", "bad"][i % 2], f"s{i // 2}") for i in range(20)], "id int, target string, seller string")


def test_holdout_keeps_groups(spark, sellers):
    made = Sp.holdout(sellers, "seller", "target", 0.2, 42, 8)
    assert made.count() == 20
    assert Sp.shared_groups(made.where("split = 'train'"), made.where("split = 'valid'"), "seller").count() == 0
    assert made.where("split = 'valid'").select("seller").distinct().count() == 2
    with pytest.raises(R.Violation):
        Sp.holdout(sellers.withColumn("seller", F.lit("")), "seller", "target")


def test_greedy_folds(spark, sellers):
    rows = spark.createDataFrame([(g, a, b) for g, a, b in zip("aabbcc", [1, 0, 1, 0, 1, 1], [0, 1, 0, 1, 0, 1])], "group string, x int, y int")
    folds = {r["group"]: r["fold"] for r in Sp.greedy_folds(rows, "group", [F.col("x"), F.col("y")], 2).collect()}
    assert set(folds) == set("abc") and set(folds.values()) == {0, 1}
    with pytest.raises(R.Violation):
        Sp.greedy_folds(rows, "group", [F.col("x")], 9)


def test_leakage_blocks_self(spark, sellers):
    counts = R.overlap_counts(sellers, sellers, {"ids": F.col("id")})
    assert R.leakage_verdict(counts).first()["status"] == "BLOCKED"
    assert R.leakage_verdict(R.overlap_counts(sellers, sellers.where("false"), {"ids": F.col("id")})).first()["status"] == "READY"


def test_coverage(spark):
    for ids, ok in (([1, 2, 3], True), ([1, 1, 2], False)):
        assert R.coverage(spark.createDataFrame([(i,) for i in ids], "id int"), "id").first()["complete"] is ok


def test_aligned_join_rejects(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, p double")
    assert R.aligned_join(a, b, "id", "p").agg(F.sum("p")).first()[0] == pytest.approx(1.2)
    for bad in (b.where("id = 1"), b.union(b)):
        with pytest.raises(Exception, match="missing|unique"):
            R.aligned_join(a, bad, "id", "p").collect()


def test_submission_validator(spark):
    from curatrix.functions.constants import RESULT_PATTERN

    good = "<комментарий>" + "x" * 60 + "<вердикт>бан"
    rows = spark.createDataFrame([(0, "a", good), (1, "b", good + "\n"), (2, "b", good)], "pos int, id string, result string")
    found = R.validate_submission(rows, spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, id string"), RESULT_PATTERN).first()
    assert (found["duplicate_or_null_ids"], found["bad_format"], found["out_of_place"]) == (1, 1, 1)


def test_knn_margin_golden_and_forms_agree(spark):
    bank = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0)], "id long, embedding array<float>, label int")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [-1.0, 0.0])], "id long, embedding array<float>")
    for made in (V.knn_margin(q, bank), V.knn_margin_sql(q, bank), V.knn_margin(q, bank, most_bytes=40)):
        got = {r["id"]: (r["margin"], r["nearest"], r["nearest_label"]) for r in made.collect()}
        assert got == {10: (1.0, 1.0, 1), 11: (-2.0, 1.0, 0)}
    with pytest.raises(R.Violation):
        V.knn_margin(q, bank.where("label = 0"))


def test_near_pairs_equal_brute_force(spark):
    base = [f"alpha{i} beta{i % 7} gamma{i % 3} common words here again {i}" for i in range(40)]
    texts = base + [t + " tail" for t in base[:10]] + base[:5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors = N.tfidf(rows, "id", N.char_terms(F.col("text"), (3, 4)))
    dense: dict = {}
    for r in vectors.collect():
        dense.setdefault(r["id"], {})[r["term"]] = r["w"]
    for threshold in (0.6, 0.9):
        brute = {(a, b) for a in dense for b in dense if a < b and sum(w * dense[b].get(t, 0) for t, w in dense[a].items()) >= threshold}
        assert {(r["a"], r["b"]) for r in N.near_text_pairs(vectors, threshold).collect()} == brute and brute


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [5, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "id int, v array<double>")
    mean, axes = V.fit_principal(rows, "v", 1)
    assert abs(axes[0][0]) > 0.95
    got = np.array([r["projected"] for r in V.remove_components(rows, "v", (mean, axes)).orderBy("id").collect()])
    assert np.allclose(got @ axes[0], 0, atol=1e-9)


def test_weighted_draws_follow_weights(spark):
    groups = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "group string, weight double")
    n = {r["group"]: r["count"] for r in R.weighted_draws(groups, 2000).groupBy("group").count().collect()}
    assert sum(n.values()) == 2000 and 0.7 < n["a"] / 2000 < 0.8


def test_fold_scores_and_label_encoding(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i % 2, i % 3, [float(i % 2) + float(rng.normal(scale=0.3)), 1.0]) for i in range(60)], "id int, label int, fold int, v array<double>")
    made = E.out_of_fold(E.with_vector(rows, "v"), "fold", "label", 3, scale=True)
    assert made.count() == 60 and Me.roc_auc(made, "label", "score").first()[0] > 0.95
    indexed, _, classes = E.encode_labels(rows.withColumn("c", F.when(F.col("label") == 1, "b").otherwise("a")), "c")
    assert classes == ["a", "b"]
    with pytest.raises(R.Violation):
        E.encode_labels(rows.withColumn("c", F.lit("a")), "c")


def test_picture_geometry(spark):
    r = spark.range(1).select(I.capped_size(F.lit(2000), F.lit(1000), 500_000).alias("s"), I.tiling(F.lit(1200), F.lit(400)).alias("t")).first()
    assert r["s"]["width"] % 28 == 0 and r["s"]["width"] * r["s"]["height"] <= 500_000
    assert (r["t"]["columns"], r["t"]["rows"], r["t"]["tiles"]) == (3, 1, 4)
    assert I.decode(spark.createDataFrame([(bytearray(b"no picture"),)], "content binary")).first()["picture"]["broken"]


def test_lexical_union_counts_words_and_characters_outside_the_fold(spark):
    rows = spark.createDataFrame([(0, "Café cafe bar", 0), (1, "bar tea", 1), (2, "tea for two", 1), (3, None, 0)], "id int, text string, fold int")
    statistics = E.lexical_statistics(rows, "id", F.col("text"), "fold")
    made = E.lexical_union(rows, "id", F.col("text"), statistics, 2, 0, {"word": 100, "char": 100})
    got = {r["id"]: r["features"] for r in made.collect()}
    assert len(got) == 4 and all(v.size == 200 for v in got.values())
    word = {i: [(k, w) for k, w in zip(v.indices, v.values) if k < 100] for i, v in got.items()}
    char = {i: [(k, w) for k, w in zip(v.indices, v.values) if k >= 100] for i, v in got.items()}
    assert len(word[0]) == 1 and len(word[1]) == 3 and not word[3]  # of fold 0 only "bar" is in the vocabulary
    assert all(abs(sum(w * w for _, w in v) - 1) < 1e-9 for part in (word, char) for i, v in part.items() if i < 3)
    idf = {"bar": np.log(3 / 2) + 1, "bar tea": np.log(3 / 2) + 1, "tea": np.log(3 / 3) + 1}
    size = sum(x * x for x in idf.values()) ** 0.5
    assert sorted(w for _, w in word[1]) == pytest.approx(sorted(x / size for x in idf.values()))
    whole = E.lexical_statistics(rows, "id", F.col("text"), "fold").where("kind = 'word' and term = 'cafe'").first()
    assert (whole["df"], whole["total"]) == (1, 2)
    assert E.lexical_terms("Ab c", "char") == {" a": 1, "ab": 1, "b ": 1, " ab": 1, "ab ": 1, " ab ": 1, " c": 1, "c ": 1, " c ": 1}
