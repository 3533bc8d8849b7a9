"""Quality rules (8): compression bands after base rules.

A text's zstandard ratio, compressed over original bytes, tells repetition (low) and noise (high). It depends on
the length, so the limits do. The whole text must be inside the band of its length, and every chunk of a text of
more than one chunk inside the band of the chunk's length; the last chunk ends where the text ends. So a repetitive or
incompressible stretch that fills a chunk, as any of twice its length does, is seen however long the rest is. Base rules come first: too few words, or too many words in five-word windows that come back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from martloom.llm.common import prepared, slices, split_words, texts_of, window_hashes, word_hashes

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = r"[#*$%&|<>]"
LEVEL = 3
CHUNK_BYTES = 8_192
#: (bytes from, least ratio, greatest ratio). Short texts compress badly, whatever they say: their bands are wide.
BANDS: tuple[tuple[int, float, float], ...] = (
    (0, 0.0, 9.0),
    (64, 0.25, 1.20),
    (256, 0.28, 0.95),
    (1_024, 0.25, 0.74),
    (4_096, 0.22, 0.70),
    (16_384, 0.18, 0.66),
)

_COLUMNS = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, ratio double, least_chunk double, greatest_chunk double, kept boolean"""


def band(size: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(bands) if size >= start)


def ratios(text: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK_BYTES) -> tuple[float, list[float]]:
    """Of the whole text, and of its chunks if it is longer than one: all are whole, the last ends with the text and
    may overlap the one before. An empty text has 1."""
    rate = lambda part: len(compressor.compress(part)) / len(part)
    if not text:
        return 1.0, []
    if len(text) <= chunk:
        return rate(text), []
    starts = [*range(0, len(text) - chunk, chunk), len(text) - chunk]
    return rate(text), [rate(text[k : k + chunk]) for k in starts]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(words: pa.Array, at: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of n words that are found twice or more in it."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    coded = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    marks = np.zeros(len(words) + 1, np.int64)
    if len(words) >= n:
        rolled = window_hashes(word_hashes(words) ^ (owner.astype(np.uint64) << np.uint64(40)), n)
        starts = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :])
        starts = starts[np.argsort(rolled[starts], kind="stable")]
        equal = rolled[starts[1:]] == rolled[starts[:-1]]
        pairs = np.flatnonzero(equal)
        a, b = starts[pairs], starts[pairs + 1]
        same = (owner[a] == owner[b]) & np.all([coded[a + k] == coded[b + k] for k in range(n)], axis=0)
        if np.all(same):
            twice = np.unique(np.concatenate([a, b]))
        else:  # equal hashes of different windows: compare all windows by their words
            windows = np.stack([owner[starts], *(coded[starts + k] for k in range(n))], axis=1)
            _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
            twice = starts[counts[inverse.reshape(-1)] > 1]
        marks[twice] += 1
        np.subtract.at(marks, twice + n, 1)
    return _sums((np.cumsum(marks[:-1]) > 0).astype(np.int64), at)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier one."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    coded = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, coded = owner[real], coded[real]
    distinct = np.unique(owner * (len(lines) + 1) + coded) // (len(lines) + 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def _judge(bands, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for piece in slices(batch):
                texts = pc.fill_null(piece.column("text"), "")
                words, at = split_words(texts)
                n_words = np.diff(at)
                repeated = repeated_words(words, at)
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                whole, least, greatest, inside = [], [], [], []
                for text in pc.cast(texts, pa.binary()).to_pylist():
                    ratio, parts = ratios(text, compressor, chunk)
                    low, high = band(len(text), bands)
                    part_low, part_high = band(chunk, bands)
                    whole.append(ratio)
                    least.append(min(parts, default=None))
                    greatest.append(max(parts, default=None))
                    inside.append(low <= ratio <= high and all(part_low <= p <= part_high for p in parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(n_words),
                        pa.array(_sums(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), at)),
                        pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()),
                        pa.array(duplicate_lines(texts)),
                        pa.array(repeated),
                        pa.array(failed),
                        pa.array(whole),
                        pa.array(least, pa.float64()),
                        pa.array(greatest, pa.float64()),
                        pa.array(~failed & np.array(inside, bool)),
                    ],
                    names=[c.split()[0] for c in _COLUMNS.split(",")],
                )

    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: the base counts, the ratios, and whether it is kept.

    Null counts as empty, which has no words and fails. Repeated rows are judged one by one; an empty table gives an
    empty result; other columns are not looked at. One pass over the texts, nothing moves.
    """
    prepared(docs.sparkSession)
    return texts_of(docs, id_col, text_col).select("doc_id", "text").mapInArrow(_judge(tuple(bands), chunk), _COLUMNS)
