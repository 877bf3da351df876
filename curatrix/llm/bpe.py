"""BPE encoding and decoding (operator 8): a minimal acyclic transducer as the lexicon.

The words that the vocabulary holds whole are compiled, in sorted order, into an automaton whose equal
suffixes are shared; each transition carries a count of the words below it, so a walk
yields the word's rank and with it the word's ids (a minimal perfect hash with outputs). Its arrays are laid out in
one block that every worker maps into memory. A batch of texts is cut into words on its bytes, all distinct words
walk the automaton side by side, and those that it lacks are merged by the rules of the vocabulary, side by side too.
"""

from __future__ import annotations

import array
import heapq
import json
import mmap
import os
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import WHITE_SPACE, batch_udf, sha256_hex, short_batches, worker_state
from curatrix.llm.cutting import buffers, parts_of, pretokens
from curatrix.llm.merging import PairMerger, byte_letters

_SPACES = re.compile(f"[{WHITE_SPACE}]+")
_BYTES = [bytes([b]) for b in range(256)]


class WordBpe:
    """The rules of one vocabulary file: normalisation, words, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.pairs = PairMerger(self.vocab, model["merges"], self.suffix)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.none = len(self.ranks)
        self.names = {i: token for token, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", WHITE_SPACE))
        self.letters = byte_letters()
        ids = range(max(self.names) + 1)
        self.number_of, self.name_of = pa.array([str(i) for i in ids]), pa.array([self.names.get(i, "") for i in ids])

    def normal(self, text: str) -> str:
        return _SPACES.sub(" ", self.folded(text))

    @staticmethod
    def folded(text: str) -> str:
        """The normal form but for white space, which belongs to no word."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()  # per character: no final sigma

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text in stretches, those of an added token with its id."""
        if self.cut is None:
            return [(text, None)]
        return [(x, self.added.get(x)) for x in self.cut.split(text) if x]

    def merge(self, word: str) -> list[int]:
        """The word's ids: always the pair of lowest rank first, leftmost among equals."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return [self.vocab[s] for s in (self._merge_short(symbols) if len(symbols) <= 64 else self._merge_long(symbols))]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        rank, none = self.ranks.get, self.none
        pairs = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(pairs):
                pairs[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same off a heap, so that a very long word takes n log n steps."""
        n, rank = len(symbols), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = left + right, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return [s for s in symbols if s]


class Lexicon:
    """A minimal acyclic automaton over UTF-8 bytes with a list of ids for each word.

    Layout, all little-endian unsigned 32-bit: header (states, arcs, words, ids, root), first arc of each
    state (+1), whether a state ends a word, arc targets, words skipped before an arc, first id of each
    word (+1), ids; then a byte for each arc, its label.
    """

    @staticmethod
    def compile(entries: dict[str, list[int]]) -> bytes:
        keys = sorted((w.encode(), w) for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        below: list[int] = []
        path: list[list] = [[False, []]]  # of the last key: [final, [(label, target)]]; open arcs have no target yet

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                below.append(node[0] + sum(below[t] for _, t in node[1]))
            return register[key]

        last = b""
        for key, _ in keys:
            common = len(os.path.commonprefix([last, key]))
            for depth in range(len(last), common, -1):
                target = freeze(path.pop())
                path[-1][1].append((last[depth - 1], target))
            path.extend([False, []] for _ in range(len(key) - common))
            path[-1][0] = True
            last = key
        for depth in range(len(last), 0, -1):
            target = freeze(path.pop())
            path[-1][1].append((last[depth - 1], target))
        root = freeze(path[0])
        first, final, labels, targets, skips = [0], [], [], [], []
        for ends, arcs in states:
            passed = int(ends)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                skips.append(passed)
                passed += below[target]
            final.append(int(ends))
            first.append(len(labels))
        starts, ids = [0], []
        for _, word in keys:
            ids.extend(entries[word])
            starts.append(len(ids))
        head = [len(states), len(labels), len(keys), len(ids), root]
        return array.array("I", [*head, *first, *final, *targets, *skips, *starts, *ids]).tobytes() + bytes(labels)

    def __init__(self, block: bytes):
        """Map the block into memory that belongs to no file of any folder."""
        fd = os.memfd_create("lexicon")
        try:
            os.truncate(fd, max(len(block), 4))
            with mmap.mmap(fd, max(len(block), 4)) as writer:
                writer[: len(block)] = block
            self.map = mmap.mmap(fd, max(len(block), 4), prot=mmap.PROT_READ)
        finally:
            os.close(fd)
        whole = memoryview(self.map)
        states, arcs, words, ids, self.root = whole[:20].cast("I")
        at, parts = 20, []
        for n in (states + 1, states, arcs, arcs, words + 1, ids):
            parts.append(whole[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.final, self.targets, self.skips, self.starts, self.ids = parts
        self.labels = at  # where the label bytes begin
        # The same arrays as numpy sees them, and the arcs by state and label, in which order they lie.
        self.view = [np.frombuffer(x, np.uint32) for x in parts]
        self.arcs = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.view[0])) << 8 | np.frombuffer(whole[at : at + arcs], np.uint8)

    def find(self, word: str) -> list[int] | None:
        """The word's ids, or None if the automaton doesn't accept it."""
        state, rank, seek, labels, first = self.root, 0, self.map.find, self.labels, self.first
        for label in word.encode():
            arc = seek(_BYTES[label], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            rank += self.skips[arc]
            state = self.targets[arc]
        if not self.final[state]:
            return None
        return list(self.ids[self.starts[rank] : self.starts[rank + 1]])

    def find_all(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ranks of the words raw[start : start + size], -1 where the automaton accepts none; all words take a step at a time."""
        _, final, targets, skips, _, _ = self.view
        out, words = np.full(len(starts), -1, dtype=np.int64), np.arange(len(starts))
        state, rank, depth = np.full(len(starts), self.root, dtype=np.int64), np.zeros(len(starts), dtype=np.int64), 0
        while len(words):
            ends = sizes[words] == depth
            if ends.any():
                whole = ends & (final[state] == 1)
                out[words[whole]] = rank[whole]
                words, state, rank = words[~ends], state[~ends], rank[~ends]
            if not len(self.arcs):
                break
            key = state << 8 | raw[starts[words] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            on = self.arcs[arc] == key
            words, arc = words[on], arc[on]
            state, rank, depth = targets[arc].astype(np.int64), rank[on] + skips[arc], depth + 1
        return out

    def ids_of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of these ranks one after another, number of ids of each)."""
        starts, ids = self.view[4:]
        return _ranges(ids.astype(np.int32), starts[ranks].astype(np.int64), starts[ranks + 1].astype(np.int64) - starts[ranks])


def _ranges(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[start : start + size] of all ranges one after another, sizes)."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


_rules: dict[str, WordBpe] = {}


def rules(path: str) -> WordBpe:
    if path not in _rules:
        _rules[path] = WordBpe(path)
    return _rules[path]


def word_path(path: str | None) -> str:
    return path or public_tokenizers.path("word_bpe_49k.json")


def build_lexicon(path: str, frequent: int = 65536) -> bytes:
    """The automaton of the vocabulary's whole words: at most `frequent`, those of the lowest ids, which its training met most often.

    It comes from the vocabulary alone and reads no texts. Words that it lacks are merged by the rules, with the same ids.
    """
    own = rules(path)
    byte = {letter: b for b, letter in enumerate(own.letters)}
    words: set[str] = set()
    for token in sorted((t for t in own.vocab if t.endswith(own.suffix)), key=own.vocab.get):
        if len(words) >= frequent:
            break
        try:
            words.add(bytes(byte[x] for x in token[: len(token) - len(own.suffix)]).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character
    ordered = pa.array(sorted(w for w in words if w), pa.string())
    raw, offsets = buffers(ordered)
    ids, counts = own.pairs.merge(raw, offsets[:-1], np.diff(offsets))
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return Lexicon.compile({w: ids[at[k] : at[k + 1]].tolist() for k, w in enumerate(ordered.to_pylist())})


def _folded(texts: pa.Array, own: WordBpe) -> pa.Array:
    return pa.array([own.folded(x) if x else "" for x in texts.to_pylist()], pa.string())


class Encoder:
    """Encodes batches of texts with one vocabulary and one automaton."""

    def __init__(self, path: str, block: bytes):
        self.own, self.lexicon = rules(path), Lexicon(block)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after another, number of ids of each)."""
        raw, offsets = buffers(words)
        starts, sizes = offsets[:-1], np.diff(offsets)
        ranks = self.lexicon.find_all(raw, starts, sizes)
        known, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        counts = np.zeros(len(words), dtype=np.int64)
        parts = ((known, self.lexicon.ids_of(ranks[known])), (unseen, self.own.pairs.merge(raw, starts[unseen], sizes[unseen])))
        for rows, (_, n) in parts:
            counts[rows] = n
        ids, at = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, (found, n) in parts:
            ids[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return ids, counts

    def by_hand(self, text: str) -> list[int]:
        """Ids of one text with strings of added tokens, or with characters that Unicode versions class differently."""
        ids: list[int] = []
        for piece, special in self.own.pieces(text):
            if special is not None:
                ids.append(special)
            else:
                for word in self.own.words.findall(self.own.normal(piece)):
                    ids.extend(self.own.merge(word))
        return ids

    def encode(self, texts: pa.Array, lists: bool) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids of each text, its ids as a list or joined by a space, the decoded text)."""
        words, first, odd = pretokens(_folded(texts, self.own), False)
        for s in self.own.added:
            odd = odd | pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        words = words.dictionary_encode()
        codes = words.indices.to_numpy()
        ids, counts = self.of_words(words.dictionary)
        starts = np.cumsum(counts) - counts
        total = np.concatenate([[0], np.cumsum(counts[codes])])[first]
        n = np.diff(total)
        bounds = pa.array(np.append(starts, len(ids)), pa.int32())

        def joined(names: pa.Array) -> pa.Array:
            of_word = pc.binary_join(pa.ListArray.from_arrays(bounds, names.take(pa.array(ids))), " ")
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), of_word.take(pa.array(codes))), " ")

        if lists:
            out = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(_ranges(ids, starts[codes], counts[codes])[0], pa.int32()))
        else:
            out = joined(self.own.number_of)
        decoded = joined(self.own.name_of)
        if odd.any():
            hand = {k: self.by_hand(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
            n[list(hand)] = [len(x) for x in hand.values()]
            of_hand = lambda k: hand[k] if lists else " ".join(map(str, hand[k]))
            out = pa.array([of_hand(k) if k in hand else x for k, x in enumerate(out.to_pylist())], out.type)
            decoded = pa.array([" ".join(self.own.names[i] for i in hand[k]) if k in hand else x for k, x in enumerate(decoded.to_pylist())], pa.string())
        return n, out, decoded


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids: the vocabulary has no decoder, so its tokens are joined by spaces."""
    names = rules(word_path(path)).names
    return " ".join(names[i] for i in ids if i in names)


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([sha256_hex(x.encode()) for x in texts.to_pylist()], pa.string())


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, digests: bool = False, frequent: int = 65536) -> DataFrame:
    """df with n_tokens and either ids (array<int>) and decoded, or, with digests, their SHA-256 digests.

    Null and empty texts have no ids; an empty table stays empty. Strings of added tokens inside a text become those tokens.
    Repeated rows are encoded each; columns that df already has under the added names are replaced, all others stay. Very long
    texts are encoded whole.
    """
    path = word_path(path)
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(build_lexicon(path, frequent))
    kinds = [pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()]

    def encode(texts: pa.Array) -> pa.StructArray:
        encoder = worker_state(shared.value, lambda block: Encoder(path, block))
        columns: list[list[pa.Array]] = [[], [], []]
        for part in parts_of(texts):
            n, ids, decoded = encoder.encode(part, not digests)
            for column, made in zip(columns, (pa.array(n, pa.int64()), *((_digests(ids), _digests(decoded)) if digests else (ids, decoded))), strict=True):
                column.append(made)
        return pa.StructArray.from_arrays([pa.concat_arrays(c) if c else pa.array([], kind) for c, kind in zip(columns, kinds, strict=True)], ["n", "i", "d"])

    names = {"n_tokens": "n", "ids_sha256" if digests else "ids": "i", "decoded_sha256" if digests else "decoded": "d"}
    ddl = f"n long, i {'string' if digests else 'array<int>'}, d string"
    made = df.withColumn("__bpe", batch_udf(encode, ddl)(F.col(text)))
    return made.withColumns({name: F.col(f"__bpe.{field}") for name, field in names.items()}).drop("__bpe")
