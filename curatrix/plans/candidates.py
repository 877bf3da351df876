"""Evaluations of candidate signals: what an out-of-fold score of another kind adds to the base score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import maths as M
from curatrix.operators import encoders as En
from curatrix.operators import estimators as E
from curatrix.operators import lexical as L
from curatrix.operators import vectors as V
from curatrix.operators.metrics import curve_threshold

#: Weights of a candidate that are tried.
WEIGHTS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


def field_lexical_scores(cards: DataFrame, label: str, fold: str, folds: int, name: str, **settings) -> DataFrame:
    """(id, score): out of fold, the lexical model of one view of title and description (estimators.lexical_view)."""
    made = L.lexical_out_of_fold(cards, label, fold, folds, E.lexical_view(F.col("title"), F.col("description"), name), **settings)
    return made.select("id", "score")


def hidden_state_scores(cards: DataFrame, states: Column, mask: Column, label: str, fold: str, folds: int, c: float = 0.03) -> DataFrame:
    """(id, score): out of fold, a standardised linear head over the masked mean of each card's token states, by category."""
    pooled = E.with_vector(cards.select("id", "category", label, fold, En.masked_mean(states, mask).alias("__pooled")).where("__pooled is not null"), "__pooled")
    parts = [E.out_of_fold(pooled.where(F.col("category") == r[0]), fold, label, folds, c=c, scale=True).select("id", "score") for r in pooled.select("category").distinct().orderBy("category").collect()]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def prototype_scores(cards: DataFrame, prototypes: DataFrame, scale: float = 0.05) -> DataFrame:
    """(id, score): the logistic share of each card's margin between the nearest positive and negative rule prototype (id, embedding, label) of a category.

    Nothing is trained, so no fold is left out. Cards whose category lacks prototypes of either label have no score.
    """
    met = V.knn_margin_sql(cards.select("id", "category", "embedding"), prototypes, exclude=F.col("q.category") != F.col("r.category"))
    return met.select("id", M.sigmoid(F.col("margin") / scale).alias("score"))


def candidate_grid(rows: DataFrame, label: str, base: str, candidates: list[str], by: list[str] | None = None, weights=WEIGHTS) -> DataFrame:
    """(by..., candidate, weight, threshold, f1): the best F1 of each candidate's blends with the base score, on log odds.

    candidates are columns of probabilities; where one is null the base stands alone. The row of candidate "" and weight 0 is the base itself.
    """
    by = by or []
    none = F.struct(F.lit("").alias("candidate"), F.lit(0.0).alias("weight"), F.col(base).cast("double").alias("p"))
    each = [F.struct(F.lit(c).alias("candidate"), F.lit(float(w)).alias("weight"), F.col(c).cast("double").alias("p")) for c in candidates for w in weights]
    spread = rows.select(*by, label, F.col(base).alias("__base"), F.explode(F.array(none, *each)).alias("x")).select(*by, label, "__base", "x.*")
    mixed = M.sigmoid((1 - F.col("weight")) * M.logit(F.col("__base")) + F.col("weight") * M.logit(F.coalesce("p", "__base")))
    return curve_threshold(spread.withColumn("__s", F.round(mixed, 12)), label, "__s", [*by, "candidate", "weight"])


def candidate_report(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., candidate, weight, threshold, f1, gain): each candidate's best blend (ties: the smaller weight) and what it adds to the base's F1."""
    by = by or []
    best = grid.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "candidate").orderBy(F.desc("f1"), "weight"))).where("__k = 1").drop("__k")
    alone = best.where("candidate = ''").select(*by, F.col("f1").alias("__alone"))
    made = best.join(F.broadcast(alone), by) if by else best.crossJoin(F.broadcast(alone))
    return made.where("candidate <> ''").select(*by, "candidate", "weight", "threshold", "f1", (F.col("f1") - F.col("__alone")).alias("gain"))
