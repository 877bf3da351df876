"""Loading, training, predicting and group-wise out-of-fold runs in one call each, with their artefacts as tables.

An artefact is a folder of Spark tables and models: model/<k>, decisions (class, threshold), config.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.hashing import token_hash_vector
from curatrix.operators import estimators as E
from curatrix.operators import metrics as Me
from curatrix.operators import schema as S
from curatrix.operators import splits as Sp
from curatrix.operators.relational import Violation, require_none
from curatrix.session import settled
from curatrix.sources.tables import read_table


def load_cards(spark: SparkSession, path: str, schema: str | Mapping | None = None, base: str = "", require_label: bool = False) -> tuple[DataFrame, dict]:
    """(cards, schema): a table scanned, its schema document read or inferred, and its rows adapted. Nothing is run but what the format needs."""
    raw = read_table(spark, path)
    made = S.load_schema(schema, raw.columns)
    return S.adapt(raw, made, base, require_label), made


def labels_json(labels: Column) -> Column:
    """A label list as JSON text, sorted, null as the empty list."""
    return F.to_json(F.array_sort(F.coalesce(labels, F.array().cast("array<string>"))))


def _features(cards: DataFrame, dim: int) -> DataFrame:
    return E.with_vector(cards.withColumn("__v", token_hash_vector(F.col("text"), dim)), "__v").drop("__v")


def _classes(cards: DataFrame) -> list[str]:
    """The distinct labels in order; a label set is small by nature, but more than a thousand labels is an error of the schema."""
    found = [r[0] for r in cards.select(F.explode("labels").alias("c")).distinct().orderBy("c").limit(1001).collect()]
    if len(found) < 2:
        raise Violation("training needs two classes")
    if len(found) > 1000:
        raise Violation("over a thousand classes: is the label column right?")
    return found


def one_vs_rest(train: DataFrame, classes: list[str], c: float = 4.0) -> dict[str, LogisticRegressionModel]:
    """A balanced logistic model for each class of (labels, features); a class whose rows all agree has none."""
    models = {}
    for name in classes:
        own = train.withColumn("label", F.array_contains("labels", name).cast("int"))
        if own.select("label").distinct().count() == 2:
            weighted = E.balanced_weights(own, "label")
            models[name] = E.logistic(c, own.count()).fit(weighted)
    return models


def class_scores(df: DataFrame, models: dict[str, LogisticRegressionModel], classes: list[str]) -> DataFrame:
    """df with scores, an array over the classes in order; a class without a model scores 0."""
    for k, name in enumerate(classes):
        df = E.positive_probability(models[name].transform(df), f"__p{k}") if name in models else df.withColumn(f"__p{k}", F.lit(0.0))
    columns = [f"__p{k}" for k in range(len(classes))]
    return df.withColumn("scores", F.array(*columns)).drop(*columns)


def _long(scored: DataFrame, classes: list[str]) -> DataFrame:
    each = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c, k: F.struct(c.alias("class"), F.col("scores")[k].alias("score"), F.array_contains("labels", c).cast("int").alias("y")))
    return scored.select("id", F.explode(each).alias("e")).select("id", "e.*")


def train_cards(train: DataFrame, valid: DataFrame, output: str, dim: int = 256, c: float = 4.0) -> DataFrame:
    """(section, metric, value) of validation; the artefact goes to output. Cards need text and labels (see load_cards).

    One model a class; a class's threshold is the one of best positive F1 on the validation rows, who are in no group of train.
    """
    spark = train.sparkSession
    if "group" in train.columns and "group" in valid.columns:
        require_none(Sp.shared_groups(train.where("`group` <> ''"), valid, "group"), "groups on both sides")
    classes = _classes(train)
    rows = settled(_features(train, dim).select("id", "labels", "features"))
    models = one_vs_rest(rows, classes, c)
    scored = settled(class_scores(_features(valid, dim).select("id", "labels", "features"), models, classes).select("id", "labels", "scores"))
    cuts = settled(Me.positive_threshold(_long(scored, classes), "y", "score", ["class"]))
    for k, name in enumerate(classes):
        if name in models:
            models[name].write().overwrite().save(f"{output}/model/{k}")
    cuts.coalesce(1).write.mode("overwrite").json(f"{output}/decisions")
    config = {"classes": classes, "fitted": [n in models for n in classes], "dim": dim}
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/config")
    decided = _long(scored, classes).join(F.broadcast(cuts.select("class", "threshold")), "class").withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))
    from curatrix.operators.reports import long_metrics

    return long_metrics(Me.multilabel_summary(decided, "id"), "validation")


def predict_cards(cards: DataFrame, output: str) -> DataFrame:
    """(id, scores, labels_json) by the artefact at output: all classes at or above their thresholds, or the likeliest if none is."""
    spark = cards.sparkSession
    config = json.loads(spark.read.text(f"{output}/config").first()["value"])
    classes = config["classes"]
    models = {n: LogisticRegressionModel.load(f"{output}/model/{k}") for k, n in enumerate(classes) if config["fitted"][k]}
    cuts = {r["class"]: r["threshold"] for r in spark.read.json(f"{output}/decisions").collect()}
    scored = class_scores(_features(cards, config["dim"]).select("id", "features"), models, classes)
    chosen = F.filter(F.transform(F.array(*[F.lit(n) for n in classes]), lambda n, k: F.when(F.col("scores")[k] >= F.array(*[F.lit(float(cuts[x])) for x in classes])[k], n)), lambda n: n.isNotNull())
    likeliest = F.array(F.array(*[F.lit(n) for n in classes])[F.array_position("scores", F.array_max("scores")).cast("int") - 1])
    return scored.select("id", "scores", labels_json(F.when(F.size(chosen) > 0, chosen).otherwise(likeliest)).alias("labels_json"))


def group_oof(cards: DataFrame, output: str, folds: int = 5, dim: int = 256, c: float = 4.0, seed: int = 42) -> DataFrame:
    """(section, metric, value) of out-of-fold scores over folds of complete groups; output gets folds, scores and metrics as tables.

    Folds are greedily balanced over the labels; every card must have a group, and every fold's model sees no row of it.
    """
    from curatrix.operators.reports import long_metrics

    classes = _classes(cards)
    assigned = settled(Sp.greedy_folds(cards, "group", [F.array_contains("labels", n).cast("int") for n in classes], folds, seed))
    rows = settled(_features(cards, dim).join(assigned, "group").select("id", "group", "fold", "labels", "features"))
    parts = None
    for k in range(folds):
        made = class_scores(rows.where(F.col("fold") == k), one_vs_rest(rows.where(F.col("fold") != k), classes, c), classes).select("id", "group", "fold", "labels", "scores")
        parts = made if parts is None else parts.unionByName(made)
    scored = settled(parts)
    cuts = Me.positive_threshold(_long(scored, classes), "y", "score", ["class"])
    decided = _long(scored, classes).join(F.broadcast(cuts.select("class", "threshold")), "class").withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))
    metrics = settled(long_metrics(Me.multilabel_summary(decided, "id"), "out_of_fold"))
    assigned.write.mode("overwrite").parquet(f"{output}/folds")
    scored.select("id", "fold", labels_json(F.col("labels")).alias("labels_json"), "scores").write.mode("overwrite").parquet(f"{output}/scores")
    metrics.coalesce(1).write.mode("overwrite").json(f"{output}/metrics")
    return metrics
