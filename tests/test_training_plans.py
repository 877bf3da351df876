"""Loading, training, artefacts, retrieval in blocks, draws, pictures and logs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import constants as K
from curatrix.operators import encoders as En
from curatrix.operators import grouping as G
from curatrix.operators import images as Im
from curatrix.operators import ocr as O
from curatrix.operators import relational as R
from curatrix.operators import vectors as V
from curatrix.plans import artifacts as Ar
from curatrix.plans import scoring as Pl
from curatrix.plans import training as Tr
from curatrix.sources import tables as T


def cards_of(spark, n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        labels = [c for c, take in (("fire", i % 2 == 0), ("food", i % 3 == 0)) if take]
        words = [rng.choice("abcdefgh") for _ in range(6)] + ["lighter"] * ("fire" in labels) + ["soup"] * ("food" in labels)
        rows.append((str(i), " ".join(words), labels, f"g{i % 20}"))
    return spark.createDataFrame(rows, "id string, text string, labels array<string>, group string")


def test_load_train_predict(spark, tmp_path):
    path = str(tmp_path / "cards.jsonl")
    spark.createDataFrame([("1", "Lighter", "fire|food", "g"), ("2", "Soup", "", "h")], "id string, title string, label string, group string").coalesce(1).write.json(path)
    cards, schema = Tr.load_cards(spark, path)
    got = {r["id"]: (r["text"], r["labels"], r["group"]) for r in cards.collect()}
    assert got == {"1": ("[TITLE] Lighter", ["fire", "food"], "g"), "2": ("[TITLE] Soup", [], "h")} and schema["columns"]["label"] == "label"
    rows = cards_of(spark)
    train, valid = rows.where("substring(group, 2) < '5'"), rows.where("substring(group, 2) >= '5'")
    out = str(tmp_path / "model")
    metrics = {r["metric"]: float(r["value"]) for r in Tr.train_cards(train, valid, out).collect()}
    assert metrics["macro_f1"] > 0.95
    said = {r["id"]: r["labels_json"] for r in Tr.predict_cards(valid, out).collect()}
    right = [said[r["id"]] == r["j"] for r in valid.select("id", Tr.labels_json(F.col("labels")).alias("j")).where("j <> '[]'").collect()]
    assert sum(right) / len(right) > 0.9
    with pytest.raises(R.Violation, match="both sides"):
        Tr.train_cards(train, rows, out)
    with pytest.raises(R.Violation, match="two classes"):
        Tr.train_cards(train.withColumn("labels", F.array(F.lit("one"))), valid, out)


def test_group_oof_leaves_no_row_out(spark, tmp_path):
    rows, out = cards_of(spark), str(tmp_path / "oof")
    metrics = {r["metric"]: float(r["value"]) for r in Tr.group_oof(rows, out, folds=3).collect()}
    assert metrics["macro_f1"] > 0.9
    scores, folds = spark.read.parquet(f"{out}/scores"), spark.read.parquet(f"{out}/folds")
    assert scores.count() == 160 == scores.select("id").distinct().count() and folds.count() == 20 and folds.select("fold").distinct().count() == 3


DECISIONS = {K.FLAMMABLE: {"vlm_threshold": 0.5, "lexical_threshold": 0.3, "blend_alpha_vlm": 0.25, "blend_strategy": "logit_margin", "blend_threshold": 0.5}}


def test_artefacts_change_only_what_they_say(spark):
    base = Ar.artifact(DECISIONS, K.KNN, None, ())
    ruled = Ar.with_title_rules(base, K.SHIPPED_RULES)
    assert ruled["decisions"] == base["decisions"] and ruled["title_rules"] == list(K.SHIPPED_RULES) and Ar.with_title_rules(ruled, K.SHIPPED_RULES) == ruled
    plain, headed = Ar.rules_only(ruled), Ar.with_head(ruled, K.HEAD)
    assert plain["knn"] is None and plain["title_rules"] == ruled["title_rules"] and headed["head"] == K.HEAD
    with pytest.raises(R.Violation, match="changed"):
        Ar.rules_only(base | {"knn": None})
    cards = spark.createDataFrame([("1", K.FLAMMABLE, "Уголь древесный 3 кг", 0.1, 0.1, -0.05), ("2", K.FLAMMABLE, "Чай", 0.9, 0.9, 0.02)], "id string, category string, title string, lexical_probability double, vlm_probability double, margin double")
    got = {r["id"]: r["prediction"] for r in Ar.apply_artifact(cards, ruled, K.FLAMMABLE).collect()}
    assert got == {"1": 1, "2": 1}
    assert {r["id"]: r["prediction"] for r in Ar.apply_artifact(cards, base, K.FLAMMABLE).collect()}["1"] == 0


def test_outer_reselection_equals_one_fold_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, int(i % 4 == 0), min(0.99, max(0.01, 0.3 + 0.4 * (i % 4 == 0) + rng.uniform(-0.3, 0.3))), rng.uniform(0.05, 0.95)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, fold int, y int, vlm double, lexical double")
    made = {r["fold"]: r for r in Ar.outer_reselection(df, "y", "fold", 3, "vlm", "lexical").collect()}
    assert set(made) == {0, 1, 2} and all(r["tp"] + r["fn"] == 10 for r in made.values())
    assert all(0 <= r["alpha"] <= 1 and r["f1"] > 0.4 for r in made.values())
    some = Ar.embedding_set_report(df.select(F.lit("all").alias("category"), "fold", "y", F.array("vlm", "lexical").alias("v")).transform(lambda d: __import__("curatrix.operators.estimators", fromlist=["x"]).with_vector(d, "v")), "fold", "y", "category", 3, c=1.0).first()
    assert some["average_precision"] > 0.5


def test_retrieval_in_blocks_equals_the_broadcast_form(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 3 == 0), i % 4) for i in range(90)] + [(95, [0.0] * 6, 0, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int, f int")
    for fold in (None, "f"):
        one, two = ({r["id"]: r.asDict() for r in V.knn_margin(df, df, query_fold=fold, ref_fold=fold, most_bytes=size).collect()} for size in (1 << 20, 1500))
        assert set(one) == set(two) == {r[0] for r in rows}
        for k, r in one.items():
            assert two[k]["nearest_label"] == r["nearest_label"] and two[k]["margin"] == pytest.approx(r["margin"]) and two[k]["nearest"] == pytest.approx(r["nearest"])
    one, two = (sorted(map(tuple, V.most_similar(df, df, 3, exclude_own=True, most_bytes=size).select("id", "place", "ref_id").collect())) for size in (1 << 20, 900))
    assert one == two and len(one) == 3 * 91
    shown = V.with_examples(df.select("id"), V.most_similar(df.where("id < 2"), df, 2, exclude_own=True), df, ["label", "f"])
    got = {r["id"]: r["examples"] for r in shown.collect()}
    assert len(got) == 91 and len(got[0]) == 2 and got[50] == []


def test_draws_are_half_and_half(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}", int(i % 5 == 0), (i % 10) / 10) for i in range(100)], "id int, g string, y int, h double")
    got = R.balanced_draws(rows, 201, "g", F.col("y") == 1, F.col("h"), "id").collect()
    assert sorted(r["draw"] for r in got) == list(range(201)) and sum(r["positive"] for r in got) == 101
    known = {r["id"]: (r["g"], r["y"]) for r in rows.collect()}
    assert all(known[r["id"]] == (r["group"], int(r["positive"])) for r in got)


def test_groups_and_logs_and_leaks(spark, tmp_path):
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id int, entity_group int")
    G.write_groups(groups, str(tmp_path / "g"))
    assert {r["entity_group"] for r in G.with_written_groups(groups.select("id"), str(tmp_path / "g"), "id").collect()} == {1}
    with pytest.raises(Exception, match="no entity group for 3"):
        G.with_written_groups(spark.createDataFrame([(3,)], "id int"), str(tmp_path / "g"), "id").collect()
    (tmp_path / "log.csv").write_text('id,score\na,1\nb,"2, or so"\nb,3\n')
    assert T.experiment_log(spark, str(tmp_path / "log.csv")).first().asDict() == {"rows": 3, "columns": 2, "duplicate_keys": 1, "ragged_rows": 0}
    (tmp_path / "bad.csv").write_text("id,score\na,1\nb,2,3\nc\n")
    assert T.experiment_log(spark, str(tmp_path / "bad.csv")).first()["ragged_rows"] == 2
    a = spark.createDataFrame([("1", "one text that is long enough here", "h1", "p1")], "id string, text string, content_hash string, perceptual_hash string")
    b = spark.createDataFrame([("2", "another text, long enough as well", "h2", "p1")], a.schema)
    counts = Pl.leakage_report(a, b, near=None)
    assert {r["check"]: r["overlap"] for r in counts.collect()} == {"ids": 0, "texts": 0, "content_hashes": 0, "perceptual_hashes": 1}
    assert Pl.leakage_exit_code(counts) == 2 and Pl.leakage_exit_code(counts.where("overlap = 0")) == 0
    assert [r["k"] for r in R.available_in_all("k", *[spark.createDataFrame([(x,) for x in v], "k int") for v in ((1, 2, 2, 3), (2, 3), (3, 2, 9))]).orderBy("k").collect()] == [2, 3]


def test_encoders_and_ocr(spark):
    cards = spark.createDataFrame([("1", "a b", ["x", "y"]), ("2", "", [])], "id string, text string, images array<string>")
    decoded = spark.createDataFrame([("x", (100, 50, "d", "s", [3.0] + [0.0] * 7 + [4.0], False)), ("y", (None, None, None, None, None, True))], f"path string, picture struct<{Im.FIELDS}>")
    own: En.Encoder = En.StandIn(16)
    assert own.texts(cards).count() == 2
    got = {r["id"]: r for r in own.pictures(cards, decoded).collect()}
    assert got["1"]["embedding"][0] == pytest.approx(0.6) and got["1"]["present"] and got["1"]["broken"] == 1
    assert got["2"]["embedding"] == [0.0] * 9 and not got["2"]["present"] and got["2"]["stats"] == [0.0] * 4
    seen = O.recognised(cards, spark.createDataFrame([("1", "Хлопушка"), ("1", "18+"), ("3", "x")], "id string, ocr_text string")).select(O.ocr_vector(F.col("ocr_text")).alias("v")).collect()
    assert len(seen) == 1 and seen[0]["v"][0] == 1.0 and sum(seen[0]["v"]) == 2.0


def test_multimodal_training_end_to_end(spark):
    rng = random.Random(8)
    rows = []
    for i in range(96):
        y, category = int(i % 3 == 0), K.CATEGORIES[i % 2]
        text = " ".join([rng.choice(["red", "blue", "green", "plain"]) for _ in range(5)] + (["danger"] if y and rng.random() < 0.8 else []))
        rows.append((str(i), category, text, y, (i // 2) % 2, [y + rng.uniform(-0.8, 0.8), rng.uniform(-1, 1)]))
    cards = spark.createDataFrame(rows, "id string, category string, text string, y int, fold int, embedding array<double>")
    oof, decisions = Pl.train_multimodal(cards, "y", "fold", 2, limits={"word": 200, "char": 200})
    made = {r["category"]: r for r in decisions.collect()}
    assert oof.count() == 96 and set(made) == set(K.CATEGORIES) and all(r["oof_f1"] > 0.7 and 0 <= r["blend_alpha_vlm"] <= 1 for r in made.values())
    models, frozen = Pl.refit_multimodal(cards, "y", decisions)
    assert frozen is decisions and set(models) == set(K.CATEGORIES)
    with pytest.raises(R.Violation, match="frozen"):
        Pl.refit_multimodal(cards.withColumn("category", F.lit("new")), "y", decisions)
    errors = Pl.baseline_errors(oof.withColumn("score", F.col("lexical_probability")), decisions.select("category", F.col("lexical_threshold").alias("threshold")), "y", 3).collect()
    assert errors and all(r["place"] <= 3 and (r["error"] == "FN") == (r["y"] == 1) for r in errors)
