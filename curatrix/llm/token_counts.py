"""Token counts (operator 1): map-side two-tier look-up of pre-token lengths.

Tier one is a broadcast hash table with the token counts of frequent pre-tokens: those that the vocabulary
holds whole, and the most frequent ones of a bounded sample. Tier two is a bounded cache in each Python worker,
filled by merging a batch's unknown pre-tokens side by side. No pre-token is ever shuffled, and there is no
pass over the corpus but the one that counts.

A batch of texts is cut into pre-tokens on its bytes, and each distinct one is looked up once a batch.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import batch_udf, sampled_units, worker_state
from curatrix.llm.cutting import buffers, parts_of, pretokens
from curatrix.llm.merging import PairMerger, byte_letters

_tokenizers: dict[str, object] = {}
_mergers: dict[str, PairMerger] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def merger(path: str) -> PairMerger:
    if path not in _mergers:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        _mergers[path] = PairMerger(model["vocab"], model["merges"])
    return _mergers[path]


def text_length(path: str, text: str) -> int:
    return len(tokenizer(path).encode(text, add_special_tokens=False).ids)


def specials(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before it is cut into pre-tokens."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def merged_lengths(path: str, units: pa.Array) -> np.ndarray:
    """Tokens of each pre-token by the vocabulary's merges."""
    raw, offsets = buffers(units)
    return merger(path).merge(raw, offsets[:-1], np.diff(offsets))[1]


def length_table(df: DataFrame, text: str, path: str, frequent: int) -> dict[str, int]:
    """Tier one: pre-tokens that are whole in the vocabulary, and at most `frequent` of a sample's."""
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    whole = set()
    for token in tokenizer(path).get_vocab(with_added_tokens=False):
        try:
            whole.add(bytes(byte[x] for x in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character
    units = pa.array(sorted(whole))
    found, first, hard = pretokens(units, True)
    whole = {u for u, n, h in zip(units.to_pylist(), np.diff(first).tolist(), hard.tolist(), strict=True) if n == 1 and not h}
    table = sorted(whole.union(sampled_units(df, text, lambda texts: pretokens(texts, True)[0], frequent)))
    return dict(zip(table, merged_lengths(path, pa.array(table, pa.string())).tolist(), strict=True))


class Lengths:
    """Both tiers. The second holds at most `most` pre-tokens and starts afresh when it is full."""

    def __init__(self, path: str, table: dict[str, int], most: int = 400_000):
        self.path, self.table, self.most, self.cache = path, table, most, {}

    def of(self, units: pa.Array) -> np.ndarray:
        """Lengths of distinct pre-tokens."""
        words, table, cache = units.to_pylist(), self.table, self.cache
        found = [table.get(w) or cache.get(w, 0) for w in words]  # no pre-token has 0 tokens
        out = np.array(found, dtype=np.int64)
        missing = np.flatnonzero(out == 0)
        if len(missing):
            out[missing] = merged_lengths(self.path, units.take(pa.array(missing)))
            if len(cache) + len(missing) > self.most:
                cache.clear()
            cache.update((words[k], n) for k, n in zip(missing.tolist(), out[missing].tolist(), strict=True) if len(words[k]) <= 64)
        return out


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 512, frequent: int = 65536) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit) added to every row.

    Null and empty texts have 0 bytes and 0 tokens; an empty table stays empty. Repeated rows are counted each; columns that df
    already has under the added names are replaced, all others stay. Texts of any length are counted whole. A text that holds an added
    token's string (which may span pre-tokens) or a character that Unicode versions class differently is encoded whole by the tokenizer.
    path must name a byte-level tokenizer file without a normaliser.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    table = df.sparkSession.sparkContext.broadcast(length_table(df, text, path, frequent))
    added = specials(path)

    def part(texts: pa.Array, lengths: Lengths) -> np.ndarray:
        units, first, whole = pretokens(texts, True)
        units = units.dictionary_encode()
        counts = np.concatenate([[0], np.cumsum(lengths.of(units.dictionary)[units.indices.to_numpy()])])[first]
        out = np.diff(counts)
        for s in added:
            whole = whole | pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(whole).tolist():
            out[k] = text_length(path, texts[k].as_py())
        return out

    def count(texts: pa.Array) -> pa.StructArray:
        lengths = worker_state(table.value, lambda known: Lengths(path, known))
        n = [part(x, lengths) for x in parts_of(texts)]
        sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
        return pa.StructArray.from_arrays([sizes, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], ["n_bytes", "n_tokens"])

    made = df.withColumn("__count", batch_udf(count, "n_bytes long, n_tokens long")(F.col(text)))
    return made.withColumns({"n_bytes": F.col("__count.n_bytes"), "n_tokens": F.col("__count.n_tokens"), "over_limit": F.col("__count.n_tokens") > limit}).drop("__count")
