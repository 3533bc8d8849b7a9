"""Exact dedup (9): documents sorted by content, equal neighbours, one row of each group stays.

Sampled splitters range-partition the normalised texts, each partition is sorted (Spark's sort spills),
so equal texts are adjacent, and a pass over the sorted rows compares each whole text with the one before.
The range key is a short head of the text, a hash of the whole and the id: splitters stay small, and a
group that holds a third of all rows fills many partitions. A group that goes on in the next partition is
put together from the first and last run of each partition, two rows a partition, matched by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import lower_ascii, prepared, texts_of

#: Characters of the text in the range key.
HEAD = 32

_RUNS = """doc_id long, row long, part int, run long, run_rows long, run_keep long, leads boolean, edge boolean,
    text_sha256 string"""


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to runs of equal texts. A run is held back until it ends: its ids, not its texts."""
    part, run = TaskContext.get().partitionId(), 0
    open_text, open_ids, open_rows = None, [], 0

    def rows(ids: pa.StructArray, size: np.ndarray, sha: list[str], edge: list[bool]) -> pa.RecordBatch:
        start = np.cumsum(size) - size
        each = pa.array(np.repeat(np.arange(len(size)), size))
        leads = np.zeros(len(ids), bool)
        leads[start] = True
        return pa.RecordBatch.from_arrays(
            [
                ids.field("doc_id"),
                ids.field("row"),
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(run + each.to_numpy()),
                pa.array(size).take(each),
                ids.field("doc_id").take(pa.array(start)).take(each),
                pa.array(leads),
                pa.array(edge).take(each),
                pa.array(sha).take(each),
            ],
            names=["doc_id", "row", "part", "run", "run_rows", "run_keep", "leads", "edge", "text_sha256"],
        )

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for batch in batches:
        if not batch.num_rows:
            continue
        text, ids = batch.column("norm"), batch.select(["doc_id", "row"]).to_struct_array()
        same = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[text[0].as_py() != open_text], ~same]))
        if not len(starts):
            open_ids.append(ids)
            open_rows += len(ids)
            continue
        open_ids.append(ids[: starts[0]])
        open_rows += int(starts[0])
        ended = [open_text] if open_text is not None else []
        sizes = [open_rows] if ended else []
        ended += text.take(pa.array(starts[:-1])).to_pylist()
        sizes = np.array([*sizes, *np.diff(starts)], np.int64)
        if len(ended):
            edge = [run + k == 0 for k in range(len(ended))]
            yield rows(pa.concat_arrays([*open_ids, ids[starts[0] : starts[-1]]]), sizes, [sha(t) for t in ended], edge)
            run += len(ended)
        open_text, open_ids, open_rows = text[int(starts[-1])].as_py(), [ids[starts[-1] :]], len(ids) - int(starts[-1])
    if open_text is not None:
        yield rows(pa.concat_arrays(open_ids), np.array([open_rows]), [sha(open_text)], [True])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", row_col: str | None = None
) -> DataFrame:
    """One row per document: doc_id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. `keep` is "smallest" or
    "largest" and names the id that stays; a null id stays only if the group has no other. Of repeated rows
    (same id and text) one stays. An empty table gives an empty result. Other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    spark = docs.sparkSession
    ws = prepared(spark)
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    keyed = texts_of(docs, id_col, text_col, row_col).select("doc_id", "row", norm.alias("norm"))
    keyed = keyed.select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("mark"))
    order = F.asc_nulls_last("doc_id") if keep == "smallest" else F.desc_nulls_last("doc_id")
    placed = keyed.repartitionByRange("head", "mark", order).sortWithinPartitions("head", "mark", "norm", order, "row")
    runs = ws.save(placed.select("doc_id", "row", "norm").mapInArrow(_runs, _RUNS), "runs").df

    along = Window.orderBy("part", "run")
    edges = runs.where("edge AND leads").select("part", "run", "run_rows", "run_keep", "text_sha256")
    goes_on = F.coalesce(F.col("text_sha256") == F.lag("text_sha256").over(along), F.lit(False))
    edges = edges.withColumn("goes_on", goes_on.cast("int")).withColumn("chain", F.sum(1 - F.col("goes_on")).over(along))
    best = Window.partitionBy("chain").orderBy(
        F.asc_nulls_last("run_keep") if keep == "smallest" else F.desc_nulls_last("run_keep"), "part"
    )
    whole = Window.partitionBy("chain")
    edges = edges.select(
        "part",
        "run",
        F.sum("run_rows").over(whole).alias("all_rows"),
        F.first("run_keep").over(best).alias("all_keep"),
        (F.row_number().over(best) == 1).alias("wins"),
    )
    joined = runs.join(F.broadcast(edges), ["part", "run"], "left")  # two rows a partition
    own = F.col("wins").isNull()
    return joined.select(
        "doc_id",
        "row",
        F.when(own, F.col("run_keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        (F.col("leads") & F.coalesce("wins", F.lit(True))).alias("kept"),
        "text_sha256",
    )
