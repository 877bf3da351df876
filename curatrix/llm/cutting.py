"""Cutting a batch of texts on its UTF-8 bytes: the pieces lie in one buffer, and equal ones are met once through a dictionary."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, HARD = range(5)
#: Code points with the Unicode property White_Space (fixed values).
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction (fixed values).
_CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _class_table() -> np.ndarray:
    """Class of each code point of the first two planes; unassigned ones are hard, as libraries' Unicode versions differ there."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([HARD if (c := unicodedata.category(chr(p))) == "Cn" else kinds.get(c[0], OTHER) for p in range(1 << 17)], dtype=np.uint8)
    table[_WHITE] = SPACE
    return table


_CLASS = _class_table()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; nulls count as empty."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def parts_of(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """The array in slices of at most `most` bytes, or of one text, so that a batch of long texts takes bounded memory."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def classes_of(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = _CLASS[raw]  # right for ASCII
    for low, high, size, bits in ((0xC0, 0xE0, 2, 31), (0xE0, 0xF0, 3, 15), (0xF0, 0x100, 4, 7)):
        lead = np.flatnonzero((raw >= low) & (raw < high))
        if len(lead):
            point = (raw[lead] & bits).astype(np.int64)
            for k in range(1, size):
                point = point << 6 | raw[lead + k] & 63
            found = np.where(point < len(_CLASS), _CLASS[np.minimum(point, len(_CLASS) - 1)], HARD)
            for k in range(size):
                kind[lead + k] = found
    return kind


def _units(raw: np.ndarray, cut: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(units, number of the first one of each text and of the end) for a mask of the bytes that begin a unit."""
    begins = np.flatnonzero(cut)
    ends = np.append(begins, len(raw)).astype(np.int32)
    made = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
    return made, np.searchsorted(begins, offsets)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(stretches between white space, number of the first one of each text and of the end)."""
    raw, offsets = buffers(texts)
    solid = classes_of(raw) != SPACE
    cut = solid.copy()
    cut[1:] &= ~solid[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    cut[starts] = solid[starts]
    return _units(raw[solid], cut[solid], np.concatenate([[0], np.cumsum(solid)])[offsets])


def pretokens(texts: pa.Array, spaced: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pre-tokens, number of the first one of each text and of the end, texts with a hard character).

    Contractions, runs of letters, of numbers and of other characters. spaced: a space before a run belongs to it,
    and other white space makes pre-tokens as `\\s+(?!\\S)|\\s` does. Else white space is left out, and each
    number stands alone. Texts with a hard character are cut as if it were another character; they need other means.
    """
    raw, offsets = buffers(texts)
    kind = classes_of(raw)
    starts = offsets[:-1][np.diff(offsets) > 0]
    hard = np.diff(np.searchsorted(np.flatnonzero(kind == HARD), offsets)) > 0
    kind[kind == HARD] = OTHER
    cut = np.empty(len(raw), dtype=bool)
    if len(raw):
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[starts] = True
    runs = np.flatnonzero(cut & (kind != SPACE))  # a run of one class begins here
    if spaced and len(runs):
        after = runs[1:] if runs[0] == 0 else runs
        first = np.zeros(len(raw), dtype=bool)
        first[starts] = True
        after = after[(kind[after - 1] == SPACE) & ~first[after]]
        last = after - 1
        while len(moved := np.flatnonzero((raw[last] & 0xC0) == 0x80)):  # back to the first byte of the last white-space character
            last[moved] -= 1
        cut[last] = True
        cut[after[raw[after - 1] == 0x20]] = False
    elif len(runs):
        cut |= (kind == NUMBER) & ((raw & 0xC0) != 0x80)
    quotes = np.flatnonzero((raw == 0x27) & cut)
    if len(quotes):
        ends = offsets[np.searchsorted(offsets, quotes, side="right")]
        for tail in _CONTRACTED:
            at = quotes[quotes + len(tail) < ends]
            for k, letter in enumerate(tail):
                at = at[raw[at + 1 + k] == letter]
            cut[at + 1] = False
            after = at + 1 + len(tail)
            cut[after[after < len(raw)]] = True
    if not spaced:
        solid = kind != SPACE
        offsets = np.concatenate([[0], np.cumsum(solid)])[offsets]
        raw, cut = raw[solid], cut[solid]
    return (*_units(raw, cut, offsets), hard)
