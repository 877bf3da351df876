"""Text recognised on pictures: joined to cards, turned into flags, and judged as a correction of uncertain scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import constants as K
from curatrix.operators.metrics import positive_threshold
from curatrix.operators.reports import uncertainty_boost


def recognised(cards: DataFrame, ocr: DataFrame, text: str = "ocr_text") -> DataFrame:
    """cards with the recognised text of their id; only cards that have one. Several texts of an id are joined in order."""
    per = ocr.where(F.col(text).isNotNull()).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias(text))
    return cards.join(per, "id")


def ocr_flags(text: Column, names: Mapping[str, str] = K.OCR_FEATURES) -> dict[str, Column]:
    """One 0/1 column for each pattern that occurs in the lower-cased text; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: low.rlike(pattern).cast("double") for name, pattern in names.items()}


def ocr_vector(text: Column, names: Mapping[str, str] = K.OCR_FEATURES) -> Column:
    """The flags as one array, in the patterns' order."""
    return F.array(*ocr_flags(text, names).values())


def boosted_f1(df: DataFrame, label: str, score: str, signal: Column, zones: list[tuple[float, float]]) -> DataFrame:
    """(low, high, tp, fp, fn): counts if rows of each zone of scores with the signal were raised to 1, at the scores' own best threshold."""
    from curatrix.operators.metrics import confusion_counts

    cut = positive_threshold(df, label, score).select("threshold")
    rows = df.crossJoin(F.broadcast(cut)).withColumn("prediction", (F.col(score) >= F.col("threshold")).cast("int"))
    out = None
    for low, high in zones:
        made = rows.withColumn("prediction", uncertainty_boost(score, signal, low, high)).agg(*confusion_counts(F.col(label), F.col("prediction"))).select(F.lit(low).alias("low"), F.lit(high).alias("high"), "tp", "fp", "fn")
        out = made if out is None else out.unionByName(made)
    return out
