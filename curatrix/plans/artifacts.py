"""Decision artefacts as documents: built from one another by edits that leave the frozen decisions alone, and audited outside."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import estimators as E
from curatrix.operators import fusion as Fu
from curatrix.operators import metrics as Me
from curatrix.operators.relational import Violation

#: What an artefact's document holds; decisions are frozen once written.
PARTS = ("decisions", "knn", "head", "title_rules")


def artifact(decisions: dict, knn: dict | None = None, head: dict | None = None, title_rules: tuple = ()) -> dict:
    """A document with a fingerprint over its parts."""
    made = {"decisions": decisions, "knn": knn, "head": head, "title_rules": list(title_rules)}
    return made | {"fingerprint": fingerprint(made)}


def fingerprint(document: dict) -> str:
    return hashlib.sha256(json.dumps({k: document.get(k) for k in PARTS}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def verified(document: dict) -> dict:
    if document.get("fingerprint") != fingerprint(document):
        raise Violation("the artefact was changed after it was written")
    return document


def with_title_rules(base: dict, names: tuple[str, ...]) -> dict:
    """The base with these title rules after its own; the decisions stay as they are."""
    base = verified(base)
    return artifact(base["decisions"], base["knn"], base["head"], tuple(dict.fromkeys([*base["title_rules"], *names])))


def rules_only(base: dict) -> dict:
    """The base without retrieval and head: blend and title rules alone."""
    base = verified(base)
    return artifact(base["decisions"], None, None, tuple(base["title_rules"]))


def with_head(base: dict, head: dict) -> dict:
    base = verified(base)
    return artifact(base["decisions"], base["knn"], head, tuple(base["title_rules"]))


def apply_artifact(cards: DataFrame, document: dict, category: str) -> DataFrame:
    """cards (category, title, both probabilities, margin and head_probability where used) scored by the document's layers in order."""
    document = verified(document)
    rows = [(name, *(float(d[k]) for k in ("vlm_threshold", "lexical_threshold", "blend_alpha_vlm")), d["blend_strategy"], float(d["blend_threshold"])) for name, d in document["decisions"].items()]
    table = cards.sparkSession.createDataFrame(rows, "category string, vlm_threshold double, lexical_threshold double, blend_alpha_vlm double, blend_strategy string, blend_threshold double")
    made = Fu.apply_decisions(cards, table)
    if document["knn"]:
        made = Fu.apply_knn(made, category, document["knn"])
    if document["head"]:
        made = Fu.apply_head(made, category, document["head"])
    return Fu.apply_title_rules(made, category, tuple(document["title_rules"])) if document["title_rules"] else made


def outer_reselection(df: DataFrame, label: str, fold: str, folds: int, vlm: str, lexical: str, by: list[str] | None = None) -> DataFrame:
    """(fold, by..., alpha, strategy, threshold, tp, fp, fn, f1): each outer fold judged by the blend that the other folds choose.

    Thresholds of both scores, weight, strategy and the blend's threshold are all chosen again without the fold.
    """
    by = by or []
    parts = []
    for k in range(folds):
        rest, own = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        cuts = [Me.positive_threshold(rest, label, s, by).select(*by, F.col("threshold").alias(f"__{s}")) for s in (vlm, lexical)]
        both = cuts[0].join(cuts[1], by) if by else cuts[0].crossJoin(cuts[1])
        join = lambda d, b=both: d.join(F.broadcast(b), by) if by else d.crossJoin(F.broadcast(b))
        best = Fu.best_blend(Fu.blend_grid(join(rest), label, vlm, lexical, F.col(f"__{vlm}"), F.col(f"__{lexical}"), by), by).select(*by, "alpha", "strategy", "threshold")
        scored = join(own)
        scored = scored.join(F.broadcast(best), by) if by else scored.crossJoin(F.broadcast(best))
        p = Fu.blend_probability(F.col("strategy"), F.col("alpha"), F.col(vlm), F.col(f"__{vlm}"), F.col(lexical), F.col(f"__{lexical}"))
        decided = scored.withColumn("prediction", (F.round(p, 12) >= F.col("threshold")).cast("int"))
        parts.append(decided.groupBy(*by, "alpha", "strategy", "threshold").agg(*Me.confusion_counts(F.col(label), F.col("prediction"))).withColumn(fold, F.lit(k)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(fold, *by, "alpha", "strategy", "threshold", "tp", "fp", "fn", Me._f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def embedding_set_report(df: DataFrame, fold: str, label: str, category: str, folds: int, c: float = 0.03) -> DataFrame:
    """(category, threshold, f1, average_precision) of out-of-fold scores on `features`, one model a category and fold."""
    parts = []
    for r in df.select(category).distinct().orderBy(category).collect():
        scored = E.out_of_fold(df.where(F.col(category) == r[0]), fold, label, folds, c=c)
        parts.append(Me.positive_threshold(scored, label, "score").join(Me.average_precision(scored, label, "score")).select(F.lit(r[0]).alias(category), "threshold", "f1", "average_precision"))
    return reduce(DataFrame.unionByName, parts)


def seed_averaged_head(df: DataFrame, row_id: str, group: str, label: str, seeds: tuple[int, ...], folds: int = 5, c: float = 0.03) -> DataFrame:
    """(row_id, score): out-of-fold scores of a standardised logistic head, averaged over fold assignments by seed."""
    from curatrix.operators.reports import ensemble_average
    from curatrix.operators.splits import hash_fold

    runs = []
    for seed in seeds:
        own = df.withColumn("__fold", hash_fold(F.col(group), folds, seed))
        runs.append(E.out_of_fold(own, "__fold", label, folds, c=c, scale=True).select(row_id, "score"))
    return ensemble_average(runs, row_id, "score")
