import importlib
import os

import pytest
from pyspark.sql import functions as F

from curatrix.functions import constants as K
from curatrix.operators import fusion as Fu
from curatrix.plans import registry
from curatrix.plans import scoring as Pl
from curatrix.sources import cache as C
from curatrix.sources import tables as T
from curatrix.streaming.scoring import score_stream

SMALL = "/root/testdata/sf0.001"


def test_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q" , b\nline'), (2, None)], "id int, text string")
    for kind in ("csv", "jsonl", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        T.write_table(rows, path, single=True)
        got = {r["id"]: r["text"] for r in T.read_table(spark, path).select("id", "text").collect()}
        assert got[1] == 'a "q" , b\nline' and got[2] is None
    (tmp_path / "t.json").write_text('[{"id": 1}, {"id": 2}]')
    assert T.read_table(spark, str(tmp_path / "t.json")).count() == 2
    with pytest.raises(ValueError):
        T.read_table(spark, "x.xlsx")


def test_image_discovery(spark, tmp_path):
    os.makedirs(tmp_path / "images/42")
    for name in ("2.JPG", "1.jpg", "ignore.txt"):
        (tmp_path / "images/42" / name).write_bytes(b"x")
    found = T.discover_images(spark, str(tmp_path / "images")).collect()
    assert [r["id"] for r in found] == ["42"] and [p.rsplit("/", 1)[1] for p in found[0]["images"]] == ["1.jpg", "2.JPG"]
    assert T.content_hashes(spark, str(tmp_path / "images")).select("sha256").distinct().count() == 1


def test_cache_checks_ids(spark, tmp_path):
    v = spark.createDataFrame([("1", [1.0, 2.0]), ("2", [3.0, 4.0])], "id string, embedding array<double>")
    C.write_cache(v, str(tmp_path / "c"))
    assert C.read_cache(spark, str(tmp_path / "c"), v.select("id")).count() == 2
    with pytest.raises(C.CacheMismatch):
        C.read_cache(spark, str(tmp_path / "c"), v.limit(1).select("id"))
    other = spark.createDataFrame([("1", [5.0]), ("2", [6.0])], "id string, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in C.combine_caches(v, other).collect()} == {"1": [1, 2, 5], "2": [3, 4, 6]}
    with pytest.raises(Exception, match="different ids"):
        C.combine_caches(v, other.limit(1)).collect()


def test_resumable_run(spark, tmp_path):
    rows, path, calls = spark.range(40).select(F.col("id").cast("string").alias("id")), str(tmp_path / "r"), []

    def infer(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part.withColumn("p", F.length("id"))

    with pytest.raises(RuntimeError):
        C.run_resumable(rows, infer, path, batches=4)
    done = C.run_resumable(rows, infer, path, batches=4)
    assert done.count() == 40 and done.select("id").distinct().count() == 40


def test_layers_override_in_order(spark):
    cards = spark.createDataFrame([("1", K.FLAMMABLE, "Уголь древесный", 0.01, 0.01, 0.01), ("2", K.SUPPLEMENT, "Уголь древесный", 0.01, 0.01, 0.9)], "id string, category string, title string, lexical_probability double, vlm_probability double, head_probability double")
    decisions = spark.createDataFrame([(c, 0.5, 0.5, 0.25, "raw_probability", 0.5) for c in K.CATEGORIES], "category string, vlm_threshold double, lexical_threshold double, blend_alpha_vlm double, blend_strategy string, blend_threshold double")
    got = {r["id"]: (r["prediction"], r["probability"]) for r in Pl.score_cards(cards, decisions).collect()}
    assert got["1"] == (1, 1.0) and got["2"][0] == 0 and got["2"][1] == pytest.approx(0.01)
    with pytest.raises(Exception, match="unknown category"):
        Fu.apply_decisions(cards.withColumn("category", F.lit("x")), decisions).collect()


def test_leakage_report(spark):
    rows = spark.createDataFrame([("1", "alpha beta gamma delta epsilon"), ("2", "one two three four five six")], "id string, text string")
    report = {r["check"]: r["overlap"] for r in Pl.leakage_report(rows, rows).collect()}
    assert report == {"ids": 2, "texts": 2, "near_texts": 0}


def test_stream_is_idempotent(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    rows.write.parquet(source)
    stream = lambda: score_stream(spark.readStream.schema(rows.schema).parquet(source), lambda d: d.withColumn("s", F.col("n") * 2), out, mark)
    stream().awaitTermination()
    spark.createDataFrame([("b", 2), ("c", 3)], rows.schema).write.mode("append").parquet(source)
    stream().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r["id"], r["s"]) for r in got.collect()) == [("a", 2), ("b", 4), ("c", 6)]


def _oracle(duck, sql, names):
    cursor = duck.execute(sql)
    at = [d[0] for d in cursor.description]
    assert sorted(at) == sorted(names)
    return [tuple(row[at.index(n)] for n in sorted(names)) for row in cursor.fetchall()]


@pytest.mark.parametrize("name", ["category_f1", "threshold_macro_f1", "average_precision", "roc_auc", "fold_category_rollup", "group_key_norm", "result_format", "exact_duplicate_buckets", "knn_margin", "blend_best", "group_holdout_search", "strict_json_contract"])
def test_queries_equal_their_oracles(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events", "part", "benchmark", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    made = registry.QUERIES[name](spark, SMALL)
    shape = lambda rows: sorted((tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in rows), key=repr)
    assert shape(tuple(r[c] for c in sorted(made.columns)) for r in made.collect()) == shape(_oracle(duck, registry.ORACLES[name], made.columns))


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nested_audit_has_all_outer_folds(spark):
    assert sorted(r["fold"] for r in registry.QUERIES["nested_audit"](spark, SMALL).collect()) == [0, 1, 2, 3, 4]


def test_knn_margin_whole_equals_its_oracle(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    made = registry.QUERIES["knn_margin_whole"](spark, SMALL)
    rows = [tuple(r[c] for c in sorted(made.columns)) for r in made.collect()]
    assert sorted(rows) == sorted(_oracle(duck, registry.ORACLES["knn_margin_whole"], made.columns))
    assert len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()


def test_prototype_margin_has_a_literal_bank(spark):
    assert len(K.PROTOTYPES_POSITIVE) == len(K.PROTOTYPES_NEGATIVE) == 23
    made = registry.QUERIES["prototype_margin_texts"](spark, SMALL)
    assert made.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and made.where("margin is not null").count() > 0


def test_near_text_overlap_meets_misspelt_words(spark, tmp_path):
    import random

    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghijklmnoprstu") for _ in range(9)) for _ in range(45)]
    for name, key, last in (("documents", "doc_id", words[-1]), ("benchmark", "item_id", words[-1][:-1] + "z")):
        spark.createDataFrame([(1, " ".join([*words[:-1], last]))], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert registry.QUERIES["near_text_overlap"](spark, str(tmp_path)).first()["overlap"] == 1
