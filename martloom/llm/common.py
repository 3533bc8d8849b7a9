"""What the text operators share: typed input columns, bounded slices of Arrow batches, joins of
a wide table with a small one, words and hashes of words as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.workspace import Workspace

#: Bytes of text that one step inside a task works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of an Arrow batch. Texts may be long, so batches hold fewer rows than Spark's default.
BATCH_ROWS = 1_000
#: A table is broadcast only if a count finds no more rows than this. Its rows are narrow.
BROADCAST_ROWS = 1_000_000
#: Narrow rows that a task holds, where a bound on their number is known.
TASK_ROWS = 250_000
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def prepared(spark: SparkSession) -> Workspace:
    """A workspace of its own, in a session whose Arrow batches fit long texts.

    Python workers on this machine find the package where it lies; a cluster gets it with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    return Workspace(spark)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Only (doc_id, text, row), whatever else the table has and however its columns are called.

    `row` is carried along, so that results can be joined to rows whose ids are null or repeat; null if not given.
    """
    row = docs[row_col].cast("long") if row_col else F.lit(None).cast("long")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), row.alias("row"))


def lower_ascii(column: str):
    return F.translate(column, UPPER, LOWER)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def join_small(wide: DataFrame, small: DataFrame, rows: int, on: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a wide table with a narrow one whose rows were counted. Beyond `most` both sides move."""
    return wide.join(F.broadcast(small) if rows <= most else small.hint("merge"), on, how)


def in_few(df: DataFrame, most: int) -> DataFrame:
    """A table of no more than `most` narrow rows in as many tasks, and files, as they need, whatever the shuffle had."""
    return df.coalesce(max(1, -(-most // TASK_ROWS)))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece has more text than `limit`, unless it is a single row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size.astype(np.int64)), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def strings(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one more entry at the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[at - at[0]]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    coded = words.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64)
    of_word = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return of_word[coded.indices.to_numpy()]


def scrambled(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on; positions too close to the end are left out."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _ODD
        out += hashes[k : k + count]
    return scrambled(out)
