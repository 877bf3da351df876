"""Audits, diagnostics and difficulty slices, each as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import arrays as A
from curatrix.operators.selection import exact_quantiles


def audit_summary(df: DataFrame, row_id: str, text: Column, images: Column | None = None) -> DataFrame:
    """One row: rows, duplicate_ids, empty_text, no_image, duplicate_texts (rows beyond the first of each text)."""
    none = F.lit(None).cast("long") if images is None else F.count_if(F.size(images) == 0)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)  # texts themselves needn't be shuffled
    return df.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct(row_id)).alias("duplicate_ids"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("empty_text"),
        none.alias("no_image"), (F.count("*") - F.count_distinct(digest)).alias("duplicate_texts"),
    )


def quantiles(df: DataFrame, value: Column, at=(0.0, 0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """One row p0, p50, ...: exact quantiles with linear interpolation, by refined histograms."""
    return exact_quantiles(df, value, {f"p{q * 100:g}": q for q in at})


def label_distribution(df: DataFrame, labels: str) -> DataFrame:
    """(label, n, rate) over exploded labels; rate is per row."""
    rows = df.agg(F.count("*").alias("rows"))
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rows)).select("label", "n", (F.col("n") / F.col("rows")).alias("rate"))


def stratum_counts(df: DataFrame, stratum: Column, split: Column) -> DataFrame:
    """(stratum, all_rows, train_rows, valid_rows)."""
    return df.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("all_rows"), F.count_if(split == "train").alias("train_rows"), F.count_if(split == "valid").alias("valid_rows"))


def long_metrics(df: DataFrame, section: str) -> DataFrame:
    """A one-row table as (section, metric, value)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("m")).select(F.lit(section).alias("section"), "m.*")


def diagnostics(df: DataFrame, row_id: str, label: str, prediction: str, confidence: str, k: int = 100) -> dict[str, DataFrame]:
    """The k most confident errors, false positives and false negatives; ties by id. Empty tables keep their columns."""
    order = [F.desc(confidence), F.asc(row_id)]
    wrong = df.where(F.col(label) != F.col(prediction))
    return {"errors": wrong.orderBy(*order).limit(k), "false_positives": wrong.where(F.col(label) == 0).orderBy(*order).limit(k), "false_negatives": wrong.where(F.col(label) == 1).orderBy(*order).limit(k)}


def difficulty(df: DataFrame, probabilities: str, single: bool = True) -> DataFrame:
    """df with uncertainty_margin: distance of the two top classes, or the smallest distance to 0.5 of any class."""
    p = F.col(probabilities)
    return df.withColumn("uncertainty_margin", A.top_margin(p) if single else A.half_margin(p))


def most_uncertain(df: DataFrame, row_id: str, k: int = 100) -> DataFrame:
    return df.orderBy(F.asc("uncertainty_margin"), F.asc(row_id)).limit(k)


def conflicts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows whose two modalities decide differently (arrays: in any class)."""
    return df.where(~a.eqNullSafe(b))


def fold_distribution(df: DataFrame, fold: str, label: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(fold, rows, pos, neg) and (group, folds) with each group's sorted folds."""
    per = df.groupBy(fold).agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return per, df.groupBy(group).agg(F.array_sort(F.collect_set(fold)).alias("folds"))


def uncertainty_boost(probability: str, signal: Column, low: float, high: float) -> Column:
    """Prediction raised to 1 where the probability lies in [low, high) and the signal is there."""
    return F.when((F.col(probability) >= low) & (F.col(probability) < high) & signal, 1).otherwise(F.col("prediction"))


def ensemble_average(runs: list[DataFrame], key: str, score: str) -> DataFrame:
    """(key, score) averaged over runs with different seeds."""
    return reduce(DataFrame.unionByName, [r.select(key, score) for r in runs]).groupBy(key).agg(F.avg(score).alias(score))


def rank_share(df: DataFrame, value: str, label: str, out: str = "rank_share") -> DataFrame:
    """df with the share of the rows of the same label whose value is at most the row's.

    Values are counted first, and their running sums are made in cells of their range, so a label with nearly all rows is
    spread over tasks. Null values and labels are values of their own, the smallest.
    """
    from curatrix.operators.metrics import running_sums

    counts = df.groupBy(F.struct(label).alias("__label"), F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    shares = running_sums(counts, "__value", ["__n"], ["__label"], descending=False).select("__label", "__value", (F.col("run___n") / F.col("all___n")).alias(out))
    return df.join(shares, F.struct(label).eqNullSafe(F.col("__label")) & F.col(value).eqNullSafe(F.col("__value"))).drop("__label", "__value")
