"""CSV records that hold line breaks, read in many tasks.

A line break inside quotes ends no record. Whether a byte range of a file begins inside quotes depends on all
quotes before it, but only on whether they are odd or even. So there are two passes over the lines of the split
files:

* quotes are counted per line, and summed up per range: one row a range. The sums before a range say whether it
  opens inside quotes;
* each range, knowing that, joins its lines to records. What a range cannot finish, the head of a record at its
  end and the tail of one at its start, is written as a piece; pieces of a record are put together by
  their order in the file. There are at most two a range.

If no line of any file has an odd number of quotes, lines are records, and the second pass is not needed.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.quality import ContractError
from martloom.workspace import Workspace

#: Kinds of rows of the second pass: a record, its first, a middle and its last piece, and the end of a range.
WHOLE, HEAD, MIDDLE, TAIL, RANGE = range(5)

_PIECES = "file string, start long, kind int, record string"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of split files, in order inside a task: value, file, start of the range."""
    text = spark.read.text(path, lineSep="\n")
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def quotes_by_range(lines: DataFrame) -> DataFrame:
    """file, start, quotes, odd_lines: reduced before the shuffle to a row for each range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.select("file", "start", quotes.alias("quotes"))
    return counted.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("quotes") % 2 == 1).alias("odd_lines"))


def open_ranges(ranges: DataFrame) -> DataFrame:
    """Adds `opens_inside`, and `ends_inside` for the last range of a file."""
    along = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("start").over(along).isNull()
    return ranges.withColumn("opens_inside", before % 2 == 1).withColumn("ends_inside", last & ((before + F.col("quotes")) % 2 == 1))


class _Range:
    """Joins the lines of one range, as they come, to records and pieces."""

    def __init__(self, key: tuple[str, int], inside: bool, header: Sequence[str] | None):
        self.key, self.inside, self.header = key, inside, header
        self.begun_inside, self.held = inside, []
        self.wants_header = key[1] == 0

    def _rows(self, kind: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "record"])

    def _piece(self, kind: int) -> pa.RecordBatch:
        return self._rows(kind, pa.array(["\n".join(self.held)], pa.string()))

    def _check(self, record: str) -> None:
        found = [name.strip().lower() for name in next(csv.reader([record]))]
        if self.header is not None and found != [name.lower() for name in self.header]:
            raise ContractError(f"the header of {self.key[0]} has other names or another order: {found}")

    def _records(self, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Whole records: without those that are blank, and without the first of a file."""
        if pc.any(pc.ends_with(texts, "\r")).as_py():
            texts = pc.replace_substring_regex(texts, "\r$", "")
        texts = texts.filter(pc.match_substring_regex(texts, r"[^\x00-\x20]"))
        if self.wants_header and len(texts):
            self._check(texts[0].as_py())
            texts, self.wants_header = texts[1:], False
        if len(texts):
            yield self._rows(WHOLE, texts)

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
        after = (np.cumsum(odd) + self.inside) % 2
        inside = bool(after[-1])
        if not self.inside and not odd.any():
            yield from self._records(lines)
            return
        done: list[str] = []
        for line, open_after in zip(lines.to_pylist(), after.tolist(), strict=True):
            self.held.append(line)
            if not open_after:
                if self.begun_inside:  # the record began in an earlier range
                    yield self._piece(TAIL)
                    self.begun_inside = False
                else:
                    done.append("\n".join(self.held))
                self.held = []
        self.inside = inside
        if done:
            yield from self._records(pa.array(done, pa.string()))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._piece(MIDDLE if self.begun_inside else HEAD)
        yield self._rows(RANGE, pa.array([None], pa.string()))


def _joined(opened: frozenset[tuple[str, int]], header: Sequence[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            number = file.indices.to_numpy()
            new = np.flatnonzero((number[1:] != number[:-1]) | (start[1:] != start[:-1])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                key = (file.dictionary[int(number[a])].as_py(), int(start[a]))
                if now is None or now.key != key:
                    if now:
                        yield from now.close()
                    now = _Range(key, key in opened, header)
                yield from now.feed(batch.column("value")[a:b])
        if now:
            yield from now.close()

    return run


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a head opens one, middles and the tail follow it in the file."""
    order = F.when(F.col("kind") == HEAD, 1).otherwise(0)  # a range's tail stands before its head
    along = Window.partitionBy("file").orderBy("start", order)
    numbered = pieces.withColumn("number", F.count_if(F.col("kind") == HEAD).over(along)).withColumn("order", order)
    parts = F.array_sort(F.collect_list(F.struct("start", "order", "record")))
    joined = F.array_join(F.transform(parts, lambda p: p["record"]), "\n")
    return numbered.groupBy("file", "number").agg(F.regexp_replace(joined, "\r$", "").alias("record")).select("file", "record")


def _same_ranges(counted: DataFrame, seen: DataFrame) -> bool:
    def mark(ranges: DataFrame):
        hashed = F.sum(F.xxhash64("file", "start").cast("decimal(38,0)"))
        return ranges.agg(F.count(F.lit(1)), hashed).first()

    return mark(counted) == mark(seen)


def broken_records(ws: Workspace, path: str | list[str], header: Sequence[str] | None) -> DataFrame | None:
    """(file, record) of all records, header and blank ones left out; None if no record of any file is broken.

    `header` are the names that the first record of each file must have, if they matter. A file that ends inside
    quotes is refused by name. Both passes must see the same ranges, which follow from the session's settings; if
    they changed meanwhile, that is refused too.
    """
    ws.ship_package()
    lines = lines_of(ws.spark, path)
    ranges = ws.save(quotes_by_range(lines), "ranges").df
    if ranges.where("odd_lines > 0").isEmpty():
        return None
    ranges = ws.save(open_ranges(ranges), "open-ranges").df
    unended = ranges.where("ends_inside").select("file").first()
    if unended:
        raise ContractError(f"MALFORMED: {unended.file} ends inside quotes")
    # one entry for each range that begins inside quotes
    opened = frozenset((r.file, r.start) for r in ranges.where("opens_inside").select("file", "start").collect())
    joined = ws.save(lines.mapInArrow(_joined(opened, header), _PIECES), "records").df
    if not _same_ranges(ranges, joined.where(F.col("kind") == RANGE)):
        raise ContractError("the files, or how they are split, changed between the two passes")
    pieces = joined.where(F.col("kind").isin(HEAD, MIDDLE, TAIL))
    return joined.where(F.col("kind") == WHOLE).select("file", "record").union(_stitched(pieces))
