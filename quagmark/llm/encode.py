"""Byte-level byte-pair encoding of whole texts with the vocabulary of a public tokenizer.

A text is cut into words by the tokenizer's pattern. A word's symbols form a doubly linked list; a priority queue holds the
possible merges by rank and place, the best is applied, its neighbours are queued anew, and entries whose symbols have changed
since are skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"

# The pattern by which the byte-level tokenizers cut a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter by which vocabulary files write each byte: itself if it is visible, else the next letter from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Encoder:
    """Ids of texts, and texts of ids. Words are remembered, at most ``remember`` of them."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], pattern: str = WORDS, remember: int = 100_000):
        self.vocabulary, self.pattern, self.remember = vocabulary, pattern, remember
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}

    @classmethod
    def from_file(cls, path: str | Path) -> Encoder:
        """The tokenizer of a JSON file of the tokenizers library."""
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "remember": self.remember, "merges": self.merges}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @cached_property
    def words(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def first_ids(self) -> list[int]:
        return [self.vocabulary[c] for c in byte_letters()]

    @cached_property
    def known(self) -> dict[str, array]:
        return {}

    @cached_property
    def strings(self) -> dict[int, bytes]:
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        return {i: bytes(byte_of[c] for c in s) for s, i in self.vocabulary.items() if all(c in byte_of for c in s)}

    def merge(self, word: bytes) -> array:
        """The ids of one word."""
        ids = [self.first_ids[b] for b in word]
        n = len(ids)
        if n > 1:
            merges = self.merges
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            queue = []
            for k in range(n - 1):
                found = merges.get((ids[k], ids[k + 1]))
                if found:
                    queue.append((found[0], k, ids[k], ids[k + 1], found[1]))
            heapq.heapify(queue)
            while queue:
                _, k, left, right, merged = heapq.heappop(queue)
                m = after[k]
                if ids[k] != left or m < 0 or ids[m] != right:
                    continue
                ids[k], ids[m] = merged, -1
                after[k] = far = after[m]
                if far >= 0:
                    before[far] = k
                    found = merges.get((merged, ids[far]))
                    if found:
                        heapq.heappush(queue, (found[0], k, merged, ids[far], found[1]))
                near = before[k]
                if near >= 0:
                    found = merges.get((ids[near], merged))
                    if found:
                        heapq.heappush(queue, (found[0], near, ids[near], merged, found[1]))
        return array("i", [i for i in ids if i >= 0])

    def encode(self, text: str | None) -> array:
        """The ids of a text, without special tokens; none for null and for the empty text."""
        out = array("i")
        if text:
            known, remember = self.known, self.remember
            for word in self.words(text):
                ids = known.get(word)
                if ids is None:
                    ids = self.merge(word.encode())
                    if len(word) <= 64:
                        if len(known) >= remember:
                            known.clear()
                        known[word] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


def encoder(path: str | Path = f"{TOKENIZERS}/byte_bpe_50k.json") -> Encoder:
    return Encoder.from_file(path)


def encoded(docs: DataFrame, doc_id: str, text: str, tokenizer: Encoder) -> DataFrame:
    """(doc_id, ids): one row per row of ``docs``, with the ids of the whole text; an empty list for null and empty texts.

    No shuffle; further columns are not read. The vocabulary (a file of fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            ids, ends = array("i"), [0]
            for t in b[1]:
                ids += own.encode(t.as_py())
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b[0], lists], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(work, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: Encoder) -> DataFrame:
    """(doc_id, n_tokens): the length of each whole text in tokens; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([len(own.encode(t.as_py())) for t in b[1]], pa.int32())], names=["doc_id", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(work, f"doc_id {kind}, n_tokens int")
