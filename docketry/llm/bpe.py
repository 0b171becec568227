"""Byte-level BPE of a public rank file, one segment tree for each distinct word.

The leaves of the tree are the ranks of a word's adjacent pairs; its root is
the leftmost pair of the lowest rank. Each merge changes three leaves, so a
word of n bytes takes O(n log n) even if it is one run of a million letters.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker before it starts afresh; a bound on memory only.
REMEMBERED = 1 << 18
FLUSH_IDS = 1 << 20

_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The token ids of one word: merge the leftmost pair of lowest rank until none is left."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    if n > 1:
        width = 1
        while width < n - 1:
            width *= 2
        # a node holds rank * n + position: the smaller is the lower rank, then the more to the left
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * n + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k //= 2
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least

        def rate(i: int, j: int) -> int:
            rank = ranks.get(parts[i] + parts[j])
            return _NONE if rank is None else rank * n + i

        while (best := tree[1]) < _NONE:
            i = best % n
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                put(i, rate(i, k))
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                put(h, rate(h, i))
    return tuple(ranks[p] for p in parts if p is not None)


class Encoder(dict):
    """Word -> ids, filled as words come up."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.words = read_ranks(data), regex.compile(pattern).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = merge_word(word.encode("utf-8", "replace"), self.ranks)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else array("i")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """This worker's encoder for a broadcast rank file."""
    data = shared.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def share_ranks(spark, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The rank file as a broadcast (under 1 MB, whatever the data)."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_table(docs: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id_col, ids) for each row of docs, repeated rows as often as they come.

    Empty and null texts give an empty list; a null id stays null; whole texts
    are read, whatever their length; no special token is ever produced.
    """
    shared = share_ranks(docs.sparkSession, folder, name)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            keys, texts = batch.columns
            flat, ends, first = array("i"), array("i", [0]), 0
            for row, text in enumerate(texts):  # one Python string at a time, never a list of all
                flat += encoder.encode(text.as_py())
                ends.append(len(flat))
                if len(flat) > FLUSH_IDS or row == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)) if len(flat) else pa.array([], pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys[first : row + 1], ids], names=[id_col, "ids"])
                    flat, ends, first = array("i"), array("i", [0]), row + 1

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
