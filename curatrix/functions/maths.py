"""Probability arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column, floor: float = 1e-5) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def two_class(l0: Column, l1: Column) -> Column:
    """Probability of class 1 from two logits."""
    return 1 / (1 + F.exp(l0 - l1))


def raw_blend(alpha: Column, a: Column, b: Column) -> Column:
    return alpha * a + (1 - alpha) * b


def logit_blend(alpha: Column, a: Column, a_threshold: Column, b: Column, b_threshold: Column) -> Column:
    """Blend of log-odds, each measured from its own threshold."""
    return sigmoid(alpha * (logit(a) - logit(a_threshold)) + (1 - alpha) * (logit(b) - logit(b_threshold)))


def knn_blend(p: Column, margin: Column, knn_threshold: float, base_threshold: float, margin_scale: float, knn_alpha: float) -> Column:
    """Log-odds above the base threshold mixed with the scaled similarity margin above its own."""
    base = logit(p) - logit(F.lit(base_threshold))
    return sigmoid((1 - knn_alpha) * base + knn_alpha * (margin - knn_threshold) / margin_scale)


def head_blend(p: Column, head: Column, alpha: float) -> Column:
    return sigmoid((1 - alpha) * logit(p) + alpha * logit(head))
