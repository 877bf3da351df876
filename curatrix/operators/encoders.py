"""Encoders behind one interface, and the pooling of token states.

An encoder turns rows into one vector each, in Arrow batches inside the tasks. The stand-in ones need no model:
hashed tokens for texts, pixel statistics for pictures. A model's encoder implements the same two methods.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import arrays as A
from curatrix.functions.hashing import token_hash_vector
from curatrix.operators.images import card_pictures


class Encoder(Protocol):
    def texts(self, cards: DataFrame) -> DataFrame:
        """(id, embedding) of the cards' texts."""

    def pictures(self, cards: DataFrame, decoded: DataFrame) -> DataFrame:
        """(id, embedding, stats, present, broken) of the cards' pictures; zeros where none decodes."""


class StandIn:
    """Deterministic vectors without a model."""

    def __init__(self, dim: int = 64, most_pictures: int = 5):
        self.dim, self.most_pictures = dim, most_pictures

    def texts(self, cards: DataFrame) -> DataFrame:
        return cards.select("id", token_hash_vector(F.col("text"), self.dim).alias("embedding"))

    def pictures(self, cards: DataFrame, decoded: DataFrame) -> DataFrame:
        return card_pictures(cards, decoded, self.most_pictures, unit=True).withColumnRenamed("features", "embedding")


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean of the token states (an array of equally long arrays) whose mask is 1; zeros where none is."""
    pairs = F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1)
    kept = F.transform(pairs, lambda x: A.doubles(x["s"]))
    zero = F.transform(states[0], lambda x: F.lit(0.0))
    return F.aggregate(kept, zero, lambda total, s: F.zip_with(total, s, lambda a, b: a + b), lambda total: F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def last_token(states: Column, mask: Column) -> Column:
    """The state of the last token whose mask is 1; null where none is."""
    at = F.array_max(F.transform(mask, lambda m, k: F.when(m == 1, k)))
    return A.doubles(F.get(states, at))
