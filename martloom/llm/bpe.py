"""BPE encoding and decoding (5): byte-level BPE with forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be bridged by a merge, so a cut
between the two is certain. Texts are split by the vocabulary's own word pattern; each word is cut at its
certain cuts; the fragments are merged on their own and their ids put together again. Fragments and words
repeat, so a task keeps their ids in two bounded tables, emptied when full.

The vocabulary is a public file, read on the driver from a path that is a parameter, and broadcast: its size
is that of the file.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from martloom.llm.common import prepared, slices, strings, texts_of

# The word pattern of byte-level BPE files that say `use_regex`.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of the tables of words and of fragments; longer entries are not kept.
TABLE, LONGEST = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """The vocabulary of one file, and ids of texts by it. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, file: str):
        self.file = file

    def __getstate__(self) -> dict:
        return {"file": self.file}

    @cached_property
    def _tables(self) -> tuple[list[bytes], dict[tuple[int, int], tuple[int, int]], list[int], dict[str, int]]:
        read = json.loads(self.file)
        alphabet, vocab = byte_alphabet(), read["model"]["vocab"]
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, number in vocab.items():
            tokens[number] = bytes(alphabet[c] for c in token) if token not in special else token.encode()
        for token, number in special.items():
            tokens[number] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        single = [0] * 256
        for c, b in alphabet.items():
            single[b] = vocab[c]
        return tokens, merges, single, special

    @cached_property
    def inside(self) -> np.ndarray:
        """inside[a, b]: byte b follows byte a inside some token."""
        seen = np.zeros((256, 256), bool)
        for token in self._tables[0]:
            seen[list(token[:-1]), list(token[1:])] = True
        return seen

    @cached_property
    def _joined(self) -> list[bytes]:
        """The same for each first byte, as 256 bytes of 0 and 1."""
        return [row.tobytes() for row in self.inside]

    @cached_property
    def _words(self) -> dict[str, bytes]:
        return _Table(self._word)

    @cached_property
    def _fragments(self) -> dict[bytes, bytes]:
        return _Table(self._merge)

    @cached_property
    def _find(self):
        return regex.compile(WORD_PATTERN).findall, regex.compile("|".join(map(regex.escape, sorted(self._tables[3], key=len, reverse=True))) or r"(?!)")

    def cut(self, word: bytes) -> list[bytes]:
        """The fragments between certain cuts."""
        joined, out, start = self._joined, [], 0
        for k in range(1, len(word)):
            if not joined[word[k - 1]][word[k]]:
                out.append(word[start:k])
                start = k
        return [*out, word[start:]]

    def _word(self, word: str) -> bytes:
        table = self._fragments
        return b"".join([table[f] for f in self.cut(word.encode())])

    def _merge(self, fragment: bytes) -> bytes:
        """Merges the lowest rank first, the leftmost of equals, with a heap over a linked list."""
        _, merges, single, _ = self._tables
        ids = [single[b] for b in fragment]
        if len(ids) > 1:
            after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
            heap = [(*merges[pair], k, *pair) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in merges]
            heapq.heapify(heap)
            while heap:
                _, merged, k, a, b = heapq.heappop(heap)
                right = after[k]
                if ids[k] != a or right >= len(ids) or ids[right] != b:
                    continue
                ids[k], ids[right] = merged, -1
                after[k] = following = after[right]
                if following < len(ids):
                    before[following] = k
                    if (pair := (merged, ids[following])) in merges:
                        heapq.heappush(heap, (*merges[pair], k, *pair))
                if (left := before[k]) >= 0 and (pair := (ids[left], merged)) in merges:
                    heapq.heappush(heap, (*merges[pair], left, *pair))
            ids = [i for i in ids if i >= 0]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words, (find, special) = self._words, self._find
        out, at = [], 0
        for mark in special.finditer(text):
            out += map(words.__getitem__, find(text, at, mark.start()))
            out.append(np.array([self._tables[3][mark[0]]], "<u4").tobytes())
            at = mark.end()
        out += map(words.__getitem__, find(text, at))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self._tables[0]
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class _Table(dict):
    """Remembers what a function gave, for short keys, up to TABLE of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= TABLE:
                self.clear()
            self[key] = made
        return made


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: of each whole text, as bytes of little-endian unsigned 32-bit integers.

    The file's special tokens are recognised in a text. Null counts as empty and has no ids. Rows, repeated or not,
    are encoded one by one; an empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(Bpe(Path(path).read_text()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for piece in slices(batch):
                ids = [bpe.encode(t) for t in strings(piece.column("text"))]
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return texts_of(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `text`, the text of `ids`, special tokens included. Null ids count as none."""
    spark = encoded.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(Bpe(Path(path).read_text()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for piece in slices(batch, "ids"):
                texts = pa.array([bpe.decode(i or b"") for i in piece.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "n_tokens", "ids")), texts], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
