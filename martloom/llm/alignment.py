"""Cross-tokenizer alignment (12): which tokens of one tokenizer cover which tokens of another, by shared cuts.

Both tokenizers cut the same bytes. Where tokens of both end, the two sequences can be cut; what lies between
two neighbouring cuts is a group. Cuts are found by divide and conquer: in an interval, the end of the middle
token of A is looked up among the ends of B by bisection, then ends ever further from the middle, until one is
shared; both halves are searched in the same way, and an interval without a shared end inside is a leaf, a group.
The intervals of all texts of a step go through each round together, so a round is a few array operations.

Two tokens are linked if their bytes overlap. How many documents hold a pair of ids linked is counted over the
corpus, and each document's links are weighed by it, in three passes:

1. every text is encoded and aligned once; written are the document's sums and its distinct pairs with their number;
2. pairs are counted, first inside the tasks, and the highest count of each id of A is found;
3. the most frequent pairs, as many as `frequent` at most, go to all tasks, which settles most links where they
   are; only rarer pairs are joined by pair, so no key of that join is frequent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.bpe import WORD_PATTERN, byte_alphabet
from martloom.llm.common import prepared, slices, texts_of
from martloom.workspace import Workspace

#: Pairs whose counts every task gets, 17 bytes each.
FREQUENT = 1_000_000
#: Pairs that a task gathers before it counts them, and distinct pairs that it holds.
GATHERED, HELD = 4_000_000, 2_000_000


class Tokenizer(Protocol):
    """Ids of texts, and the bytes that each id stands for."""

    def encode(self, texts: Sequence[str]) -> list[list[int]]: ...

    @property
    def token_bytes(self) -> list[bytes]: ...


class ByteTokenizer:
    """A byte-level BPE file, special tokens as plain text, over a blank and the text."""

    def __init__(self, file: str):
        self.file = file

    def __getstate__(self) -> dict:
        return {"file": self.file}

    @cached_property
    def _ranks(self) -> dict[bytes, int]:
        read = json.loads(self.file)
        model, split = read["model"], read["pre_tokenizer"] or {}
        plain = {"normalizer": read["normalizer"], "pre-tokenizer": split.get("type") != "ByteLevel", "blank in front": split.get("add_prefix_space"), "no words": not split.get("use_regex", True)}
        plain |= {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
        if odd := [k for k, v in plain.items() if v]:
            raise ValueError(f"this tokenizer file has settings that are not supported: {odd}")
        alphabet = byte_alphabet()
        special = {t["content"] for t in read["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + len(alphabet) != len(ranks):
            raise ValueError("ids of this tokenizer file do not follow its merges")
        return ranks

    @cached_property
    def _encoding(self):
        import tiktoken

        return tiktoken.Encoding("from-file", pat_str=WORD_PATTERN, mergeable_ranks=self._ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        encode = self._encoding.encode_ordinary
        return [encode(" " + t) for t in texts]

    @cached_property
    def token_bytes(self) -> list[bytes]:
        out = [b""] * (1 + max(self._ranks.values()))
        for token, number in self._ranks.items():
            out[number] = token
        return out


class PieceTokenizer:
    """A sentencepiece model, which puts the blank in front by itself."""

    def __init__(self, model: bytes):
        self.model = model

    def __getstate__(self) -> dict:
        return {"model": self.model}

    @cached_property
    def _pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._pieces.encode(list(texts), num_threads=1)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        pieces = self._pieces
        names = [pieces.id_to_piece(k) for k in range(pieces.get_piece_size())]
        return [bytes([int(n[3:5], 16)]) if pieces.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_to: np.ndarray) -> np.ndarray:
    """Indices into `a_ends` of the tokens whose end is also an end of B, in order.

    Ends ascend; `a_to` has the index after the last token of each text, where both always end. Text by text, an
    interval is the tokens low to high of A, and the end of high - 1 is known to be a cut.
    """
    found = [a_to - 1]
    low, high = np.concatenate([[0], a_to[:-1]]), a_to.copy()
    while len(low):
        inner = high - low - 1 > 0  # ends strictly inside
        low, high = low[inner], high[inner]
        middle = (low + high - 1) // 2
        cut = np.full(len(low), -1)
        asking, out = np.arange(len(low)), 0
        while len(asking):
            step = max(1, out)  # look at distances out to out + step - 1 on both sides
            distance = np.arange(out, out + step)
            tried = np.concatenate([middle[asking][:, None] - distance, middle[asking][:, None] + distance], axis=1)
            inside = (tried >= low[asking][:, None]) & (tried < high[asking][:, None] - 1)
            ends = a_ends[np.where(inside, tried, 0)]
            at = np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)
            hit = inside & (b_ends[at] == ends)
            some = hit.any(axis=1)
            nearest = np.where(hit, np.abs(tried - middle[asking][:, None]), out + step).argmin(axis=1)
            cut[asking[some]] = tried[np.flatnonzero(some), nearest[some]]
            out += step
            left = ~some & ((middle[asking] - out >= low[asking]) | (middle[asking] + out < high[asking] - 1))
            asking = asking[left]
        has = cut >= 0
        low, cut, high = low[has], cut[has], high[has]
        found.append(cut)
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut + 1, high])
    return np.sort(np.concatenate(found))


def _texts(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a table (large_binary) one after the other, as bytes, and where each begins (one more at the end)."""
    taken = table.take(pa.array(ids))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2]).cast("B"), np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]


class Aligner:
    """Aligns the tokens of two tokenizers over the same bytes, a blank and the text."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b

    def __getstate__(self) -> dict:
        return {"a": self.a, "b": self.b}

    @cached_property
    def _bytes(self) -> tuple[pa.Array, pa.Array]:
        return pa.array(self.a.token_bytes, pa.large_binary()), pa.array(self.b.token_bytes, pa.large_binary())

    @cached_property
    def _names(self) -> pa.Array:
        """Ids in decimal with what may follow them: A with a comma, A with a bar, B with a comma, B with a semicolon."""
        a, b = (range(len(t)) for t in self._bytes)
        return pa.array([f"{k}{after}".encode() for ids, marks in ((a, ",|"), (b, ",;")) for after in marks for k in ids], pa.large_binary())

    def _tokens(self, which: int, texts: list[str], wanted: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and ends of the tokens of each text, and whether their bytes are the text's."""
        encoded = (self.a, self.b)[which].encode(texts)
        size = np.array([len(e) for e in encoded], np.int64)
        ids = np.concatenate([np.array(e, np.int64) for e in encoded]) if len(encoded) else np.zeros(0, np.int64)
        joined, at = _texts(self._bytes[which], ids)
        to = np.cumsum(size)
        cuts = list(zip((to - size).tolist(), to.tolist(), strict=True))
        same = np.array([joined[at[s] : at[e]] == w for (s, e), w in zip(cuts, wanted, strict=True)], bool)
        return [ids[s:e] for s, e in cuts], [at[s + 1 : e + 1] - at[s] for s, e in cuts], same

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs, ascending, as
        64-bit integers (id of A, id of B), with the number of each as 32-bit integers."""
        own = [t or "" for t in texts]
        wanted = [b" " + t.encode() for t in own]
        a_ids, a_ends, a_same = self._tokens(0, own, wanted)
        b_ids, b_ends, b_same = self._tokens(1, own, wanted)
        held = np.flatnonzero(a_same & b_same & np.array([bool(t) for t in own], bool))
        n = len(texts)
        counts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        digests, pairs, times = [""] * n, [b""] * n, [b""] * n
        if len(held):
            size = np.array([len(wanted[k]) for k in held], np.int64)
            base = np.cumsum(size) - size
            a, b = (np.concatenate([ids[k] for k in held]) for ids in (a_ids, b_ids))
            a_end, b_end = (np.concatenate([ends[k] + s for k, s in zip(held, base, strict=True)]) for ends in (a_ends, b_ends))
            a_to, b_to = (np.cumsum([len(ids[k]) for k in held]) for ids in (a_ids, b_ids))
            cuts = shared_cuts(a_end, b_end, a_to)
            b_cuts = np.searchsorted(b_end, a_end[cuts])
            named, at, group_to = self._groups(a, b, cuts, b_cuts, a_to)
            # a link is a stretch of bytes between two neighbouring ends of either
            ends = np.union1d(a_end, b_end)
            left, right = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
            links = a[left].astype(np.uint64) << np.uint64(32) | b[right].astype(np.uint64)
            link_to = np.searchsorted(ends, base + size, "right")
            starts = {"n_a": a_to, "n_b": b_to, "n_groups": np.searchsorted(cuts, a_to - 1, "right"), "n_links": link_to}
            for name, to in starts.items():
                counts[name][held] = np.diff(to, prepend=0)
            before = np.concatenate([[0], link_to[:-1]])
            for j, k in enumerate(held):
                digests[k] = hashlib.sha256(named[at[group_to[j]] : at[group_to[j + 1]] - 1]).hexdigest()
                kinds, number = np.unique(links[before[j] : link_to[j]], return_counts=True)
                pairs[k], times[k] = kinds.tobytes(), number.astype("<i4").tobytes()
        columns = [*(pa.array(c) for c in counts.values()), pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*counts, "groups_sha256", "pairs", "times"])

    def _groups(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, a_to: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The groups' ids as text, where each id begins in it, and where the ids of each text begin."""
        many_a, many_b = (len(t) for t in self._bytes)
        a_name, b_name = a.copy(), b + 2 * many_a
        a_name[a_cuts] += many_a
        b_name[b_cuts] += many_b
        # tokens of A stand behind all tokens of B in earlier groups, tokens of B behind their own group's of A
        a_group, b_group = np.searchsorted(a_cuts, np.arange(len(a))), np.searchsorted(b_cuts, np.arange(len(b)))
        b_before = np.concatenate([[0], b_cuts[:-1] + 1])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[a_group]] = a_name
        order[np.arange(len(b)) + a_cuts[b_group] + 1] = b_name
        named, at = _texts(self._names, order)
        last = np.searchsorted(a_cuts, a_to - 1)
        return named, at, np.concatenate([[0], a_cuts[last] + b_cuts[last] + 2])


_ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of documents to (pair, n), counted as far as one task sees them."""
    held, number, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        kinds, at = np.unique(np.concatenate([held, *waiting]), return_inverse=True)
        return kinds, np.bincount(at, np.concatenate([number, np.ones(size, np.int64)]), len(kinds)).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(number)], names=["pair", "n"])

    for batch in batches:
        for row in batch.column("pairs"):
            waiting.append(np.frombuffer(row.as_buffer(), np.uint64))
            size += len(waiting[-1])
            if size >= GATHERED:
                held, number = merged()
                waiting, size = [], 0
                if len(held) >= HELD:
                    yield out()
                    held, number = held[:0], number[:0]
    held, number = merged()
    yield out()


def _pair_counts(ws: Workspace, aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents, and whether no other pair of the same id of A is in more."""
    counts = aligned.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = ws.save(counts, "pair-counts").df.withColumn("a", F.shiftrightunsigned("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids
    return ws.save(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "weighed").df


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """The pairs in at least 2^k documents, for the least k that leaves no more than `most` of them; and the others."""
    size = F.floor(F.log2("n")).cast("int").alias("size")
    by_size = {r["size"]: r["count"] for r in counts.groupBy(size).count().collect()}  # 64 rows at most
    least, total = 64, 0
    while least and total + by_size.get(least - 1, 0) <= most:
        least -= 1
        total += by_size.get(least, 0)
    told = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    pair = told.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(pair)
    rest = counts.where(F.floor(F.log2("n")) < least)
    return pair[order], told.column("n").to_numpy()[order], told.column("best").to_numpy(zero_copy_only=False)[order], rest


@dataclass(frozen=True)
class Aligned:
    """documents: doc_id, row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. counts: pair (the id of
    A above the lower 32 bits, the id of B in them), n documents, best."""

    documents: DataFrame
    counts: DataFrame


def align(
    docs: DataFrame,
    a: Tokenizer,
    b: Tokenizer,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    frequent: int = FREQUENT,
) -> Aligned:
    """Aligns every whole text under both tokenizers.

    A text that is null or empty, or whose bytes one of the tokenizers does not give back after a blank, has no
    tokens: zeros and an empty digest. Each input row gives a row and is a document of its own for the counts,
    repeated rows too. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ws = prepared(spark)
    shared = spark.sparkContext.broadcast(Aligner(a, b))  # as large as the two files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                done = shared.value.align(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), *done.columns], names=["doc_id", "row", *done.schema.names])

    aligned = texts_of(docs, id_col, text_col, row_col).mapInArrow(run, _ALIGNED)
    aligned = ws.save(aligned.withColumn("rid", F.monotonically_increasing_id()), "aligned").df
    counts = _pair_counts(ws, aligned)
    *table, rest = _frequent(counts, frequent)
    known = spark.sparkContext.broadcast(tuple(table))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the frequent pairs of each document, and its other pairs."""
        pair, n, best = known.value
        for batch in batches:
            for piece in slices(batch, "pairs"):
                lists = [np.frombuffer(r.as_buffer(), np.uint64) for r in piece.column("pairs")]
                own = np.concatenate([np.zeros(0, np.uint64), *lists])
                number = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r.as_buffer(), "<i4") for r in piece.column("times"))])
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
                hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                sums = []
                for worth in (best, n):
                    each = np.where(hit, worth[at], 0) * number.astype(np.int64) if len(pair) else np.zeros(len(own), np.int64)
                    total = np.zeros(len(lists), np.int64)
                    np.add.at(total, row, each)
                    sums.append(total)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(lists)))]).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(own[~hit].view(np.int64)), pa.array(number[~hit].astype(np.int32))], names=["pair", "times"])
                columns = [*(piece.column(c) for c in own_columns), *(pa.array(s) for s in sums), pa.ListArray.from_arrays(pa.array(ends), rare)]
                yield pa.RecordBatch.from_arrays(columns, names=[*own_columns, "n_best", "count_sum", "rare"])

    own_columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = f"{_ALIGNED.split(', pairs')[0]}, rid long, n_best long, count_sum long, rare array<struct<pair:long,times:int>>"
    settled = ws.save(aligned.mapInArrow(settle, schema), "settled").df
    asked = settled.where(F.size("rare") > 0).select("rid", F.explode("rare").alias("link")).select("rid", "link.pair", "link.times")
    answered = asked.join(rest, "pair").groupBy("rid")
    answered = answered.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    documents = settled.drop("rare").join(answered, "rid", "left")
    documents = documents.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    documents = documents.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    out = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Aligned(documents.select(*out), counts)


def read_byte_tokenizer(path: str) -> ByteTokenizer:
    """A tokenizers file, read on the driver."""
    return ByteTokenizer(Path(path).read_text())


def read_piece_tokenizer(path: str) -> PieceTokenizer:
    """A sentencepiece model, read on the driver."""
    return PieceTokenizer(Path(path).read_bytes())
