"""Global row numbers and ranks that no single task has to compute.

A window without `partitionBy` moves its whole input into one task. Here rows are cut
into ranges of the sort order, as many as the rows ask for, each range is numbered on
its own, and what lies in the earlier ranges is added. A small input is one range and
goes the same way. Ranges are written down before they are counted, so that the counts
and the rows always belong together. What is gathered in one place is one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.schemas import SOURCE_FILE, SOURCE_ID
from martloom.workspace import Saved, Workspace

ROWS_PER_RANGE = 1_000_000
LEAST_ROWS_PER_RANGE = 10_000
# Ranges below ROWS_PER_RANGE rows are at most so many a core: each is a task and a file, and the driver samples each.
SMALL_RANGES_PER_CORE = 32
# Source files whose sizes every task gets; more are joined by a shuffle.
BROADCAST_FILES = 1_000_000
# Ids that a task gathers before it turns them into runs, and runs that it holds.
GATHERED_IDS, HELD_RUNS = 1_000_000, 200_000

LAST_ID = (1 << 63) - 1

# monotonically_increasing_id() holds the partition above this bit, the position below.
_POSITION_BITS = 33


def ranges_for(rows: int, cores: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Ranges of `rows_per_range` rows, or smaller ones where cores would stand idle.

    Ranges that are asked to be small grow with the rows, up to ROWS_PER_RANGE, once there are many for each core.
    """
    wanted, enough = -(-rows // rows_per_range), max(-(-rows // ROWS_PER_RANGE), SMALL_RANGES_PER_CORE * cores)
    return max(1, min(wanted, enough), min(cores, rows // LEAST_ROWS_PER_RANGE))


def _before(per_range: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """For each range `_before_<amount>`, the amount in the ranges before it: one row per range."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_before_{a}") for a in amounts]
    return per_range.select("_range", *sums)


def row_numbers(
    ws: Workspace,
    saved: Saved,
    order: Sequence[str],
    out: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds `out` = 1, 2, 3, ... in ascending `order`, NULLs first.

    Rows that are equal in `order` must be interchangeable. They may be many: a random
    last range column spreads them over ranges.
    """
    placed = (
        saved.df.withColumn("_spread", F.rand())
        .repartitionByRange(ranges_for(saved.rows, ws.cores, rows_per_range), *order, "_spread")
        .sortWithinPartitions(*order)
        .drop("_spread")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = ws.save(placed, f"{out}-ranges").df
    in_range = placed.withColumn("_range", F.shiftright("_at", _POSITION_BITS))
    per_range = _before(in_range.groupBy("_range").agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        in_range.join(F.broadcast(per_range), "_range")
        .withColumn(out, F.col("_before_rows") + position + 1)
        .select(*saved.df.columns, out)
    )


def running_totals(
    ws: Workspace, df: DataFrame, order: Sequence[Column], amounts: dict[str, str], ranges: int
) -> Saved:
    """For each amount and name in `amounts` adds the sum over the rows before; `order` tells all rows apart."""
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_inside_{a}": F.coalesce(F.sum(a).over(earlier), F.lit(0)) for a in amounts}
    placed = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    saved = ws.save(placed.withColumns(inside), "totals-ranges")
    placed = saved.df
    per_range = _before(placed.groupBy("_range").agg(*[F.sum(a).alias(a) for a in amounts]), list(amounts))
    totals = {out: F.col(f"_before_{a}") + F.col(f"_inside_{a}") for a, out in amounts.items()}
    totalled = placed.join(F.broadcast(per_range), "_range").withColumns(totals).select(*df.columns, *totals)
    return Saved(totalled, saved.rows)


def ranks(
    ws: Workspace, saved: Saved, by: str, out: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Adds `out`, the SQL `rank()` in descending `by`, NULLs last.

    Rows are counted per value, and only the values are put in order: the rank of a value is
    the number of rows with a greater one, plus one. Rows find it by a join on the value.
    A value of many rows is one row of that order, so ties need no care.
    """
    values = saved.df.groupBy(F.col(by).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    falling = F.col("_value").desc_nulls_last()
    ranges = ranges_for(saved.rows, ws.cores, rows_per_range)
    above = running_totals(ws, values, [falling], {"_rows": "_above"}, ranges)
    of_value = above.for_join().select("_value", (F.col("_above") + 1).cast("long").alias(out))
    return saved.df.join(of_value, saved.df[by].eqNullSafe(of_value["_value"])).select(*saved.df.columns, out)


def _merged(code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of ids by file; neighbours that touch become one. An id that comes twice stays in two runs."""
    order = np.lexsort((low, code))
    code, low, high = code[order], low[order], high[order]
    touches = (code[1:] == code[:-1]) & (low[1:] == high[:-1] + 1)
    return code[np.r_[True, ~touches]], low[np.r_[True, ~touches]], high[np.r_[~touches, True]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, id) of a task to runs (file, low, high); a file with a missing id gives a run without ends."""
    names: dict[str | None, int] = {}
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    without: set[int] = set()
    gathered = 0

    def merged() -> tuple[np.ndarray, ...]:
        code, ids = (np.concatenate(c) for c in zip(*waiting, strict=True))
        return _merged(*(np.concatenate([h, c]) for h, c in zip(held, (code, ids, ids), strict=True)))

    def rows(code: np.ndarray, low: pa.Array, high: pa.Array) -> pa.RecordBatch:
        files = pa.array(list(names), pa.string()).take(pa.array(code))
        return pa.RecordBatch.from_arrays([files, low, high], names=["file", "low", "high"])

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        own = np.array([names.setdefault(name, len(names)) for name in coded.dictionary.to_pylist()], np.int64)
        code, ids = own[coded.indices.to_numpy()], batch.column(1)
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        without.update(code[~there].tolist())
        waiting.append((code[there], ids.drop_null().to_numpy()))
        gathered += batch.num_rows
        if gathered >= GATHERED_IDS:
            held, waiting, gathered = merged(), [], 0
            if len(held[0]) >= HELD_RUNS:
                yield rows(held[0], pa.array(held[1]), pa.array(held[2]))
                held = tuple(h[:0] for h in held)
    if waiting:
        held = merged() if sum(len(i) for _, i in waiting) + len(held[0]) else held
    yield rows(held[0], pa.array(held[1]), pa.array(held[2]))
    none = np.array(sorted(without), np.int64)
    yield rows(none, pa.nulls(len(none), pa.int64()), pa.nulls(len(none), pa.int64()))


@dataclass(frozen=True)
class Sources:
    """The source files: file, _number in order of the name, _rows, _before (rows of the earlier files).

    `dense`: the ids of every file are exactly 1..n, so file and id tell all rows apart.
    """

    files: Saved
    dense: bool

    def located(self, rows: DataFrame, out: str) -> DataFrame:
        """Adds `out`, which is in order of (file, id), NULLs first; rows do not move.

        It is the number of the row, from 1 on, if the ids are dense. Otherwise rows with the same file
        and id share it, and it is a wide decimal that leaves room for every id.
        """
        files = self.files.df.withColumnRenamed(SOURCE_FILE, "_file")
        if self.files.rows <= BROADCAST_FILES:
            files = F.broadcast(files)
        joined = rows.join(files, rows[SOURCE_FILE].eqNullSafe(files["_file"]))
        if self.dense:
            position = F.col("_before") + F.col(SOURCE_ID)
        else:
            wide = F.col(SOURCE_ID).cast("decimal(20,0)") + F.lit(Decimal(1 << 63)) + 1
            step = F.lit(Decimal(10**20)).cast("decimal(21,0)")
            position = (F.col("_number").cast("decimal(16,0)") * step + F.coalesce(wide, F.lit(Decimal(0)))).cast("decimal(38,0)")
        return joined.withColumn(out, position).select(*rows.columns, out)


def read_sources(ws: Workspace, rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> Sources:
    """Learns the files of rows and whether their ids are dense. Exact, whatever the order of the rows.

    Each task turns its ids into runs, a few if they come in order. A run adds one where it begins and takes
    one where it ends; ids are exactly 1..n if over all runs nothing remains but one at 1 and minus one at
    n + 1, since then every id in between is covered once. A missing id, and the largest that there is, has no such
    place: it is one without a number, and as no file has that many rows, its file is not dense.
    """
    ws.ship_package()
    runs = rows.select(SOURCE_FILE, SOURCE_ID).mapInArrow(_runs, "file string, low long, high long")
    one = F.lit(1).cast("long")
    ends = F.array(
        F.struct(F.col("low").alias("at"), one.alias("step")),
        F.struct(F.when(F.col("high") < LAST_ID, F.col("high") + 1).alias("at"), (-one).alias("step")),
    )
    steps = runs.select("file", F.explode(ends).alias("end")).select("file", "end.at", "end.step")
    left = steps.groupBy("file", "at").agg(F.sum("step").alias("step")).where("step != 0 OR at IS NULL")
    dense = F.col("file").isNotNull() & (F.count("at") == 2) & (F.count(F.lit(1)) == 2) & (F.min("at") == 1) & (F.max("step") == 1)
    checked = ws.save(left.groupBy("file").agg(dense.alias("dense"), F.max("at").alias("end")), "id-ends")
    all_dense = checked.df.agg(F.bool_and(F.coalesce("dense", F.lit(False)))).first()[0] is not False
    if all_dense:
        files = checked.df.select("file", (F.col("end") - 1).alias("_rows"))
    else:
        files = rows.groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.count(F.lit(1)).alias("_rows"))
    files = files.withColumn("_one", F.lit(1).cast("long"))
    ranges = ranges_for(checked.rows, ws.cores, rows_per_range)
    files = running_totals(ws, files, [F.col("file").asc_nulls_first()], {"_rows": "_before", "_one": "_number"}, ranges)
    files = files.df.select(F.col("file").alias(SOURCE_FILE), "_rows", "_before", "_number")
    return Sources(ws.save(files, "source-files"), all_dense)


def source_row_numbers(
    ws: Workspace, rows: DataFrame, out: str, sources: Sources, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Adds `out`, the number of each row in (source file, id) order.

    Where the ids of every file are exactly 1..n, the number is the id plus the size of
    the earlier files, and the rows do not move at all. Otherwise they are numbered by range.
    """
    if sources.dense:
        return sources.located(rows, out)
    return numbered_by_content(ws, rows, out, rows_per_range)


def numbered_by_content(
    ws: Workspace, rows: DataFrame, out: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Numbers in (source file, id) order; ids that repeat are told apart by the row."""
    rest = [c for c in rows.columns if c not in (SOURCE_FILE, SOURCE_ID)]
    order = [SOURCE_FILE, SOURCE_ID, *rest]
    return row_numbers(ws, ws.save(rows, f"{out}-rows"), order, out, rows_per_range)
