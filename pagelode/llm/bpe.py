"""Byte-level BPE as an automaton over tokens (problem 7).

Its states are the start and "the last token was t"; an arc labelled u leads from state t
to state u. A merge (x, y) closes exactly the arcs t -> u across whose border it would
fire: x on the right edge of t's merge tree, y on the left edge of u's, both still
unmerged when the merge's turn comes. What remains accepts, of every byte string, one
token sequence: the BPE encoding.

The automaton is not written out: 50,000 tokens would have 2.5 thousand million arcs. What
is compiled from the merge list is each merge's turn and each token's merge tree; a merge's
gadget is the set of arcs that these two close, and whether an arc is open is decided when
it is first met and then looked up. A word is encoded in one pass from left to right. Every
prefix has exactly one open path, and the pass keeps its last arc; reading the arcs back
emits the labels. Vocabulary files are read where they lie and only parsed once per Python
worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"
START = -1
LATE = 1 << 60
#: Words whose encodings a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

# Fixed value: the pre-tokenizer's pattern of the public byte-level vocabulary.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files spell each byte: itself if printable Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of one vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = dict(vocab)
        self.labels = {i: b for b, i in vocab.items()}
        #: (left token, right token) of each merge -> its turn.
        self.turn: dict[tuple[int, int], int] = {}
        self.tree: dict[int, tuple[int, int, int]] = {}
        for turn, pair in enumerate(merges):
            self._add(turn, *pair)
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._arcs: dict[tuple[int, int], bool] = {}
        self._words: dict[bytes, list[int]] = {}
        # A token that the merges never produce from its own bytes can stand on no path.
        self._ends: dict[bytes, int] = {}
        lengths: dict[bytes, set[int]] = {}
        for b, i in self.ids.items():
            if len(b) == 1 or i in self.tree:
                self._ends[b] = i
                if len(b) > 1:
                    lengths.setdefault(b[-2:], set()).add(len(b))
        #: The last two bytes of an arc's label -> the lengths it can have, longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def _add(self, turn: int, left: bytes, right: bytes) -> None:
        """Notes what one merge's gadget is made of: its turn and the tree of the token it makes."""
        pair = self.ids[left], self.ids[right]
        self.turn.setdefault(pair, turn)
        self.tree.setdefault(self.ids[left + right], (*pair, turn))

    def _edge(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Nodes on one edge of a token's merge tree, each with the turn at which it is merged away."""
        if token not in known:
            out, node, gone = [], token, LATE
            while True:
                out.append((node, gone))
                if node not in self.tree:
                    break
                gone = self.tree[node][2]
                node = self.tree[node][side]
            known[token] = out
        return known[token]

    def arc(self, state: int, token: int) -> bool:
        """Whether the arc is open: no merge fires across the border of the two tokens.

        On equal turns the left border wins: the same merge runs from left to right.
        """
        if state == START:
            return True
        key = state, token
        got = self._arcs.get(key)
        if got is None:
            turn = self.turn
            got = True
            for x, x_gone in self._edge(state, 1, self._right):
                for y, y_gone in self._edge(token, 0, self._left):
                    k = turn.get((x, y))
                    if k is not None and k < x_gone and k <= y_gone:
                        got = False
                        break
                if not got:
                    break
            if len(self._arcs) > 4 * REMEMBERED:
                self._arcs.clear()
            self._arcs[key] = got
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        n = len(word)
        last, start = [START] * (n + 1), [0] * (n + 1)
        ends, arc, lengths = self._ends, self.arc, self.lengths
        for end in range(1, n + 1):
            for length in (*lengths.get(word[end - 2 : end], ()), 1) if end > 1 else (1,):
                begin = end - length
                if begin < 0:
                    continue
                token = ends.get(word[begin:end])
                if token is not None and arc(last[begin] if begin else START, token):
                    last[end], start[end] = token, begin
                    break
            else:
                raise ValueError(f"no path for byte {word[end - 1]}")
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in SPLIT.findall(text):
            ids += self.encode_word(word.encode("utf-8", "replace"))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


def load_automaton(folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> MergeAutomaton:
    """The automaton of a vocabulary file in the ``tokenizers`` JSON form."""
    letters = byte_letters()
    spell = lambda s: bytes(letters[c] for c in s)
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        model = json.load(f)["model"]
    special = {s for s in model["vocab"] if any(c not in letters for c in s) or s.startswith("<|")}
    vocab = {spell(s): i for s, i in model["vocab"].items() if s not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return MergeAutomaton(vocab, [(spell(a), spell(b)) for a, b in pairs])


class _Words(dict):
    """word -> its ids as little-endian int32 bytes."""

    def __init__(self, automaton: MergeAutomaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        got = np.asarray(self.automaton.encode_word(word.encode("utf-8", "replace")), dtype="<i4").tobytes()
        self[word] = got
        return got


_loaded: dict[tuple[str, str], _Words] = {}


def _worker_words(folder: str, name: str) -> _Words:
    if (folder, name) not in _loaded:
        _loaded[folder, name] = _Words(load_automaton(folder, name))
    return _loaded[folder, name]


def encode_bytes(words: _Words, text: str | None) -> bytes:
    return b"".join(map(words.__getitem__, SPLIT.findall(text))) if text else b""


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids) of every row; null and empty texts give an empty list, blank ones are encoded. A narrow plan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(folder, name)
        for batch in batches:
            parts = [encode_bytes(words, t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, dtype=np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(docs: DataFrame, keep: tuple[str, ...], text: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """The ``keep`` columns and ``tokens``; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(folder, name)
        for batch in batches:
            n = [len(encode_bytes(words, t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=names)

    names = [*[f"k{i}" for i in range(len(keep))], "tokens"]
    kinds = [docs.schema[k].dataType.simpleString() for k in keep]
    rows = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("text"))
    schema = ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], "tokens bigint"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "tokens")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, text) back from ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _worker_words(folder, name).automaton
        for batch in batches:
            texts = [None if ids is None else automaton.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), "ids")
    return rows.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
