"""Fusing scores, applying frozen decisions and overrides, and searching blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import constants as K
from curatrix.functions import maths as M
from curatrix.functions import text as X
from curatrix.operators.metrics import macro_threshold, positive_threshold
from curatrix.operators.selection import order_statistics


def blend_probability(strategy: Column, alpha: Column, vlm: Column, vlm_threshold: Column, lexical: Column, lexical_threshold: Column) -> Column:
    return F.when(strategy == "raw_probability", M.raw_blend(alpha, vlm, lexical)).otherwise(M.logit_blend(alpha, vlm, vlm_threshold, lexical, lexical_threshold))


def apply_decisions(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """df with probability and prediction by its category's frozen decision; an unknown category fails the query.

    decisions: category, vlm_threshold, lexical_threshold, blend_alpha_vlm, blend_strategy, blend_threshold (a row a category).
    """
    joined = df.join(F.broadcast(decisions), "category", "left")
    known = F.when(F.col("blend_threshold").isNull(), F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null")))).cast("double"))
    p = F.coalesce(known, blend_probability(F.col("blend_strategy"), F.col("blend_alpha_vlm"), F.col("vlm_probability"), F.col("vlm_threshold"), F.col("lexical_probability"), F.col("lexical_threshold")))
    made = joined.withColumn("probability", p).withColumn("prediction", (F.col("probability") >= F.col("blend_threshold")).cast("int"))
    return made.drop(*[c for c in decisions.columns if c != "category"])


def _override(df: DataFrame, where: Column, probability: Column, prediction: Column) -> DataFrame:
    made = df.withColumn("__p", probability)
    return made.withColumn("prediction", F.when(where, F.coalesce(prediction, F.col("prediction"))).otherwise(F.col("prediction"))).withColumn("probability", F.when(where, F.coalesce("__p", "probability")).otherwise(F.col("probability"))).drop("__p")


def apply_knn(df: DataFrame, category: str = K.FLAMMABLE, settings: dict | None = None) -> DataFrame:
    """Rows of one category: probability mixed with the retrieval margin (column margin)."""
    s = settings or K.KNN
    p = M.knn_blend(F.col("probability"), F.col("margin"), s["knn_threshold"], s["base_threshold"], s["margin_scale"], s["knn_alpha"])
    return _override(df, (F.col("category") == category) & F.col("margin").isNotNull(), p, (F.col("__p") >= s["blend_threshold"]).cast("int"))


def apply_nearest(df: DataFrame, category: str, threshold: float) -> DataFrame:
    """Rows whose nearest reference is similar enough take its label. Off in the shipped decisions."""
    return _override(df, (F.col("category") == category) & (F.col("nearest") >= threshold), F.col("nearest_label").cast("double"), F.col("nearest_label").cast("int"))


def apply_head(df: DataFrame, category: str = K.FLAMMABLE, settings: dict | None = None) -> DataFrame:
    """Rows of one category: probability mixed with the linear head's (column head_probability)."""
    s = settings or K.HEAD
    p = M.head_blend(F.col("probability"), F.col("head_probability"), s["alpha_head"])
    return _override(df, (F.col("category") == category) & F.col("head_probability").isNotNull(), p, (F.col("__p") >= s["blend_threshold"]).cast("int"))


def exact_title_table(df: DataFrame, title: Column, label: str, least: int = 2) -> DataFrame:
    """(title_key, label) of normalised titles with at least `least` rows that all have one label."""
    per = df.select(X.title_key(title).alias("title_key"), F.col(label).alias("y")).where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n"), F.count_distinct("y").alias("k"), F.min("y").alias("label"))
    return per.where((F.col("n") >= least) & (F.col("k") == 1)).select("title_key", "n", "label")


def apply_exact_titles(df: DataFrame, table: DataFrame, category: str) -> DataFrame:
    """Rows whose title the table knows take its label. Off in the shipped decisions."""
    joined = df.withColumn("title_key", X.title_key(F.col("title"))).join(table.select("title_key", F.col("label").alias("__l")), "title_key", "left").drop("title_key")
    return _override(joined, (F.col("category") == category) & F.col("__l").isNotNull(), F.col("__l").cast("double"), F.col("__l").cast("int")).drop("__l")


def apply_title_rules(df: DataFrame, category: str = K.FLAMMABLE, names=K.SHIPPED_RULES) -> DataFrame:
    """Rows whose normalised title matches a rule take the last such rule's label."""
    label = X.title_rule_label(X.title_key(F.col("title")), names=names)
    made = df.withColumn("__l", label)
    return _override(made, (F.col("category") == category) & F.col("__l").isNotNull(), F.col("__l").cast("double"), F.col("__l").cast("int")).drop("__l")


def blend_grid(df: DataFrame, label: str, vlm: str, lexical: str, vlm_threshold: Column, lexical_threshold: Column, by: list[str] | None = None, steps: int = 20) -> DataFrame:
    """(by..., alpha, strategy, threshold, f1) for every weight 0..1 and both strategies.

    A row becomes 2 * (steps + 1) scored rows, which stream into the sweep; the grid is a fixed number.
    """
    by = by or []
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.array(F.struct((k / steps).alias("alpha"), F.lit("logit_margin").alias("strategy")), F.struct((k / steps).alias("alpha"), F.lit("raw_probability").alias("strategy"))))))
    spread = df.withColumn("g", grid).select("*", "g.alpha", "g.strategy")
    p = blend_probability(F.col("strategy"), F.col("alpha"), F.col(vlm), vlm_threshold, F.col(lexical), lexical_threshold)
    return positive_threshold(spread.withColumn("__s", F.round(p, 12)), label, "__s", [*by, "alpha", "strategy"], grid=[])


def best_blend(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best row of a blend grid: highest F1, then the weight nearest one half, then the strategy by name, then the weight."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc("f1"), F.round(F.abs(F.col("alpha") - 0.5), 12), "strategy", "alpha")
    return grid.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def blend_search(df: DataFrame, label: str, dense: str, lexical: str, steps: int = 40) -> DataFrame:
    """(alpha, threshold, f1) by macro F1 over steps + 1 weights."""
    spread = df.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / steps)))
    return macro_threshold(spread.withColumn("__s", F.round(M.raw_blend(F.col("alpha"), F.col(dense), F.col(lexical)), 12)), label, "__s", ["alpha"])


def knn_grid(df: DataFrame, label: str, probability: str, margin: str, base_threshold: float, alphas=(0.1, 0.2, 0.3, 0.4, 0.5), scales=(0.01, 0.02, 0.05), quantiles=(0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """(knn_alpha, margin_scale, center, threshold, f1) over a grid of weights, scales and margin quantiles."""
    from curatrix.operators.metrics import curve_threshold

    centres = sorted({x for x in order_statistics(df, F.col(margin), list(quantiles))[1] if x is not None})
    combos = F.explode(F.array(*[F.struct(F.lit(a).alias("knn_alpha"), F.lit(s).alias("margin_scale")) for a in alphas for s in scales]))
    spread = df.withColumn("center", F.explode(F.array(*[F.lit(x) for x in centres]).cast("array<double>"))).withColumn("g", combos).select("*", "g.*")
    p = M.sigmoid((1 - F.col("knn_alpha")) * (M.logit(F.col(probability)) - M.logit(F.lit(base_threshold))) + F.col("knn_alpha") * (F.col(margin) - F.col("center")) / F.col("margin_scale"))
    return curve_threshold(spread.withColumn("__s", F.round(p, 12)), label, "__s", ["knn_alpha", "margin_scale", "center"])


def fixed_decision(df: DataFrame, probabilities: str, classes: list[str], thresholds: list[float] | None = None) -> Column:
    """Single label: the first most probable class; multi label: all classes at or above their thresholds."""
    from curatrix.functions.arrays import first_maximum

    names = F.array(*[F.lit(c) for c in classes])
    if thresholds is None:
        return F.array(F.get(names, first_maximum(F.col(probabilities))))
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    chosen = F.zip_with(F.zip_with(F.col(probabilities), cuts, lambda p, t: p >= t), names, lambda ok, n: F.when(ok, n))
    return F.filter(chosen, lambda n: n.isNotNull())
