"""Substring dedup (2): words in windows of 35 words that also start anywhere else are removed.

The method is a compressed FM-index per shard, searched backwards for the matching statistics of documents that are
streamed past it; intervals at or above the threshold are reported.

Which shard a window belongs to must depend on its words alone, or every document would have to pass every shard. The
shard comes from the window's minimizer: the least hash of its runs of eight words, the leftmost of equals. Equal
windows have equal minimizers, and neighbouring windows mostly share one, so a document is dealt out in segments: all
windows of one minimizer, about 50 words.

1. *Land* the rows with their minimizers and the range of windows of each. Each task writes one file, in the bucket of
   the task's number, so that later joins send narrow rows to the texts and the texts never move.
2. *Classes*: documents of equal words, told by a SHA-256, are one class. Only its first row is dealt, with the number
   of rows as its weight, and the others take what the index reports for it.
3. *Count* minimizers over all classes. A minimizer that occurs once has no repeated window; its segments stay home.
4. *Deal* the other segments to shards of a bounded number of words. Each shard indexes its distinct segments, with a
   bit for those that stand for several, and matching statistics report every window that occurs more than once.
   Equal windows meet in one shard, so what is reported is exact.
   Segments of a minimizer with very many are collapsed before they move, and only distinct ones are dealt. Where even
   the distinct ones are more than a shard holds, they are dealt by the hash of each window instead. A segment gets its
   runs back as one row, by a 128-bit digest of its words: a passage that a third of all documents share costs a row a
   document and minimizer, not one a window. Equal segments inside a document are one row with all their places, so a
   document that says two words over and over costs a few rows, not one for each time.
5. *Remove*: the intervals of a document are united and its kept words joined.

Nothing is capped, and the shards' number follows the words that are dealt.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import join_small, prepared, scrambled, slices, split_words, texts_of, window_hashes, word_hashes
from martloom.llm.fm_index import FMIndex
from martloom.workspace import Saved, Workspace

WINDOW = 35
#: Words of the runs that a minimizer is chosen from.
RUN = 8
#: Words in one shard, about.
SHARD_WORDS = 1_000_000
#: Rows of counted tables of a number or a digest that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_NARROW = 3_000_000
#: From so many segments on, a minimizer's equal segments are collapsed before they are dealt.
MANY_SEGMENTS = 2_000
#: Distinct segments of one minimizer that are dealt to one shard, some half a million words; more are dealt by window.
SHARD_SEGMENTS = 10_000
#: Bytes of the input, as Spark estimates them, that a bucket of landed texts is meant for.
BUCKET_BYTES = 64 << 20
#: Estimates from here on say that Spark knows no size, as of rows that come from the driver.
UNKNOWN_BYTES = 1 << 52
#: Spark's own bound on buckets (spark.sql.sources.bucketing.maxBuckets); beyond it buckets grow.
MOST_BUCKETS = 100_000

#: monotonically_increasing_id() holds the task's number above this bit.
_TASK_BIT = 33
_POSITION = np.uint64((1 << 27) - 1)
_LANDED = "doc_id long, text string, n_words long, sha string, mins array<struct<key: long, first: int, last: int>>"
_PIECES = "rid long, first int, seg string, key long, weight long"
_HOT_PIECES = "rid long, firsts array<int>, seg string, key long, weight long"
_FOUND = "rid long, runs array<struct<start: int, end: int>>"
_WINDOWS = "sid long, at int, words string, weight long"
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MINS = pa.struct([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def sha256(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _joined(words: pa.Array, at: np.ndarray) -> pa.Array:
    """The words from each of `at` to the next, joined by one space; all in Arrow, since a Python object a word is slow."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words), " ")


def _ranges(words: pa.Array, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words of each range [first, end), joined by one space; ranges may overlap and hold a word at least."""
    if not len(first):
        return []
    begins = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)])
    whole = _joined(words, np.array([0, len(words)]))[0].as_buffer().to_pybytes()
    return [whole[a:b] for a, b in zip(begins[first].tolist(), (begins[end] - 1).tolist(), strict=True)]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Document, key, and first and last start of the windows that share a minimizer, in order."""
    nothing = np.zeros(0, np.int64)
    if len(hashes) < window:
        return nothing, nothing, nothing, nothing
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    runs = window_hashes(hashes, run)
    ranked = (scrambled(runs) & ~_POSITION) | np.arange(len(runs), dtype=np.uint64)
    place = (_sliding_least(ranked, window - run + 1) & _POSITION).astype(np.int64)
    start = np.flatnonzero(owner[: len(place)] == owner[window - 1 :])
    if not len(start):
        return nothing, nothing, nothing, nothing
    own = place[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (owner[start[1:]] != owner[start[:-1]])]))
    doc, first, last = owner[start[new]], start[new], start[np.append(new[1:], len(start)) - 1]
    return doc, runs[own[new]].view(np.int64), first - at[doc], last - at[doc]


def _land(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words, at = split_words(piece.column("text"))
                doc, key, first, last = minimizers(word_hashes(words), at, window, min(RUN, window))
                rows = pa.StructArray.from_arrays(
                    [pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], fields=list(_MINS)
                )
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(at) - 1))]).astype(np.int32)
                texts = _joined(words, at).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("text"),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(kept).hexdigest() for kept in texts], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), rows),
                    ],
                    names=["doc_id", "text", "n_words", "sha", "mins"],
                )

    return run


def _land_by_task(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The rows with their number (rid), written as they lie, in buckets by the number of the task (part).

    A join on (part, rid) then shuffles only its other side, which is why such joins may share less than all keys.
    The name in the catalog, which Spark wants for buckets, is gone when this returns; the files stay.
    """
    ws.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    numbered = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    name = f"landed_{uuid.uuid4().hex}"
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // BUCKET_BYTES if size < UNKNOWN_BYTES else 0
    buckets = min(MOST_BUCKETS, max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), wanted))
    numbered.write.bucketBy(buckets, "part").options(path=ws.path("landed"), compression="zstd").saveAsTable(name, format="parquet")
    landed = ws.spark.table(name)
    ws.spark.sql(f"DROP TABLE {name}")
    return landed


def _with_rows(landed: DataFrame, narrow: DataFrame, how: str = "inner") -> DataFrame:
    """Joins landed rows with narrow rows by rid, where the landed rows lie; a bucket's narrow rows fit its task."""
    placed = narrow.withColumn("part", F.shiftright("rid", _TASK_BIT).cast("int"))
    return landed.join(placed.hint("shuffle_hash"), ["part", "rid"], how).drop("part")


def _wanted(piece: pa.RecordBatch, words: pa.Array, at: np.ndarray, window: int) -> tuple[np.ndarray, pa.Array, np.ndarray, list[bytes]]:
    """Of each wanted range of windows: the row of the piece that wants it, its key, its first window and its words."""
    wanted = piece.column("wanted")
    row = np.repeat(np.arange(piece.num_rows), wanted.value_lengths().to_numpy())
    key, first, last = wanted.flatten().flatten()
    first, last = first.to_numpy(), last.to_numpy()
    return row, key, first, _ranges(words, at[row] + first, at[row] + last + window)


def _cut(window: int):
    """Texts and their wanted window ranges to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words, at = split_words(piece.column("text"))
                row, key, first, segs = _wanted(piece, words, at, window)
                rid, weight = (piece.column(c).take(pa.array(row)) for c in ("rid", "weight"))
                yield pa.RecordBatch.from_arrays(
                    [rid, pa.array(first), pa.array(segs, pa.string()), key, weight], names=["rid", "first", "seg", "key", "weight"]
                )

    return run


def _cut_once(window: int):
    """Like _cut, with one row for all equal segments of a text: where each begins, and their weights as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words, at = split_words(piece.column("text"))
                row, key, first, segs = _wanted(piece, words, at, window)
                places: dict[tuple[int, int, bytes], list[int]] = {}
                for k, place in enumerate(zip(row.tolist(), key.to_numpy().tolist(), segs, strict=True)):
                    places.setdefault(place, []).append(k)
                kept = pa.array([ks[0] for ks in places.values()], pa.int64())
                sizes = np.array([len(ks) for ks in places.values()], np.int64)
                every = np.array([k for ks in places.values() for k in ks], np.int64)
                rid, weight = (piece.column(c).take(pa.array(row)).take(kept) for c in ("rid", "weight"))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(first[every]))
                yield pa.RecordBatch.from_arrays(
                    [rid, firsts, pa.array([seg for _, _, seg in places], pa.string()), key.take(kept), pc.multiply(weight, pa.array(sizes))],
                    names=["rid", "firsts", "seg", "key", "weight"],
                )

    return run


def _windows(window: int):
    """Segments to their windows, each with its start and the weight of its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "seg"):
                words, at = split_words(piece.column("seg"))
                many = np.diff(at) - window + 1
                row = np.repeat(np.arange(piece.num_rows), many)
                start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                sid, weight = (piece.column(c).take(pa.array(row)) for c in ("sid", "weight"))
                texts = _ranges(words, at[row] + start, at[row] + start + window)
                yield pa.RecordBatch.from_arrays(
                    [sid, pa.array(start.astype(np.int32)), pa.array(texts, pa.string()), weight], names=["sid", "at", "words", "weight"]
                )

    return run


def _digest(column: str):
    return F.unhex(F.md5(column))


def _runs(starts: str, window: int):
    """Starts of windows to the [start, end) that runs of neighbouring windows cover."""
    alone = lambda step: F.filter(starts, lambda s: ~F.array_contains(starts, s + step))
    return F.transform(F.arrays_zip(alone(-1).alias("a"), alone(1).alias("z")), lambda r: F.struct(r["a"].alias("start"), (r["z"] + window).alias("end")))


def _search(window: int):
    """One shard: index of its distinct segments, each searched; per row with repeats, its covered words as [start, end)."""

    def run(table: pa.Table) -> pa.Table:
        coded = table.column("seg").combine_chunks().dictionary_encode()
        kind = coded.indices.to_numpy()
        times = np.bincount(kind, weights=table.column("weight").to_numpy(), minlength=len(coded.dictionary))
        words, at = split_words(coded.dictionary)
        symbols = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        hit = np.flatnonzero(FMIndex(symbols, at, window, times >= 2).repeated_windows(symbols, at))
        segment = np.searchsorted(at, hit, "right") - 1
        breaks = (hit[1:] != hit[:-1] + 1) | (segment[1:] != segment[:-1])  # runs of consecutive starts in one segment
        new, last = np.flatnonzero(np.append(True, breaks)[: len(hit)]), np.flatnonzero(np.append(breaks, True)[: len(hit)])
        run_from, run_to = hit[new] - at[segment[new]], hit[last] - at[segment[new]] + window
        first_run = np.searchsorted(segment[new], np.arange(len(at)))
        count = np.diff(first_run)[kind]
        row = np.flatnonzero(count)
        ends = np.concatenate([[0], np.cumsum(count[row])])
        which = np.repeat(first_run[kind[row]] - ends[:-1], count[row]) + np.arange(ends[-1])
        first = np.repeat(table.column("first").to_numpy()[row], count[row])
        found = pa.StructArray.from_arrays([pa.array((first + x[which]).astype(np.int32)) for x in (run_from, run_to)], fields=list(_RUN))
        return pa.table({"rid": pa.array(table.column("rid").to_numpy()[row]), "runs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            words, at = split_words(piece.column("text"))
            spans = piece.column("spans")
            begin = np.repeat(at[:-1], spans.value_lengths().to_numpy())
            start, end = (begin + side.to_numpy() for side in spans.flatten().flatten())
            inside = np.cumsum(np.bincount(start, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1))[:-1]
            stays = inside == 0
            left = np.concatenate([[0], np.cumsum(stays)])[at]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(left)), _joined(words.filter(pa.array(stays)), left)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


@dataclass(frozen=True)
class Deduped:
    """untouched: doc_id, n_words, sha of documents that keep all words. changed: doc_id, n_words, n_removed, kept.
    spans: doc_id, start, end of removed words; spans of a document may overlap."""

    untouched: DataFrame
    changed: DataFrame
    spans: DataFrame


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    many_segments: int = MANY_SEGMENTS,
    broadcast_rows: int = BROADCAST_NARROW,
    shard_segments: int = SHARD_SEGMENTS,
) -> Deduped:
    """Each input row is in exactly one of untouched and changed.

    Null, empty and short texts have no window and stay whole. Repeated rows are documents of their own, so all their
    windows are elsewhere too. Windows are judged on the input. An empty table gives empty results. Other columns are
    not looked at.
    """
    ws = prepared(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select("doc_id", "text").mapInArrow(_land(window), _LANDED)
    landed = _land_by_task(ws, rows)
    copies, occurring = _classes(ws, landed, broadcast_rows)
    keys = occurring.groupBy("key").agg(F.count(F.lit(1)).alias("segments"), F.sum("weight").alias("uses")).where("uses > 1")
    keys = ws.save(keys.drop("uses"), "keys")
    shared = join_small(occurring, keys.df, keys.rows, "key", most=broadcast_rows)
    many = F.col("segments") > many_segments
    wanted = shared.groupBy("rid", many.alias("hot")).agg(
        F.collect_list(F.struct("key", "first", "last")).alias("wanted"),
        F.first("weight").alias("weight"),
        F.sum(F.col("last") - F.col("first") + window).alias("words"),
    )
    wanted = ws.save(wanted, "wanted").df
    words = {r.hot: r.words for r in wanted.groupBy("hot").agg(F.sum("words").alias("words")).collect()}  # two rows

    def cut(hot: bool) -> DataFrame:
        own = wanted.where("hot" if hot else "NOT hot").select("rid", "wanted", "weight")
        texts = _with_rows(landed.select("part", "rid", "text"), own)
        texts = texts.select("rid", "text", "wanted", "weight")
        return texts.mapInArrow(_cut_once(window), _HOT_PIECES) if hot else texts.mapInArrow(_cut(window), _PIECES)

    found = landed.where("false").select("rid", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("runs"))
    if False in words:
        found = found.union(_report(cut(False), words[False], window))
    if True in words:
        found = found.union(_report_hot(ws, cut(True), window, shard_segments, broadcast_rows))
    spans = ws.save(found.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("spans")), "spans").df
    # what was reported for the first row of a class runs from its first word to its last: one narrow row
    ends = F.struct(F.array_min("spans.start").alias("start"), F.array_max("spans.end").alias("end"))
    whole = spans.select(F.col("rid").alias("first_rid"), F.array(ends).alias("spans")).join(copies.df.select("first_rid").distinct(), "first_rid")
    again = join_small(copies.df.where("rid != first_rid"), whole, copies.rows, "first_rid", most=broadcast_rows)
    per_doc = ws.save(spans.union(again.select("rid", "spans")), "spans-of-all").df

    touched = _with_rows(landed.select("part", "rid", "doc_id", "text"), per_doc)
    changed = touched.select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
    untouched = _with_rows(landed.select("part", "rid", "doc_id", "n_words", "sha"), per_doc.select("rid"), "left_anti").drop("rid")
    ids = _with_rows(landed.select("part", "rid", "doc_id"), per_doc)
    return Deduped(untouched, changed, ids.select("doc_id", F.inline("spans")))


def _classes(ws: Workspace, landed: DataFrame, broadcast_rows: int) -> tuple[Saved, DataFrame]:
    """Rows of classes of two and more (rid, first_rid, rows of the class), and the segments (rid, weight, key, first,
    last) of the first row of each class. Rows without a window are in no class and have no segment."""
    windowed = landed.where(F.size("mins") > 0)
    equal = windowed.groupBy("sha").agg(F.min("rid").alias("first_rid"), F.count(F.lit(1)).alias("size")).where("size > 1")
    equal = ws.save(equal, "equal")
    copies = ws.save(join_small(windowed.select("rid", "sha"), equal.df, equal.rows, "sha", most=broadcast_rows).drop("sha"), "copies")
    placed = _with_rows(windowed.select("part", "rid", "mins"), copies.df, "left").where("first_rid IS NULL OR rid = first_rid")
    return copies, placed.select("rid", F.coalesce("size", F.lit(1)).alias("weight"), F.inline("mins"))


def _report(pieces: DataFrame, words: int, window: int) -> DataFrame:
    """Deals pieces (rid, first, seg, key, weight) of so many words to shards; rid and its runs of repeated windows."""
    shards = max(1, -(-words // SHARD_WORDS))
    placed = pieces.select(F.pmod("key", F.lit(shards)).alias("shard"), "rid", "first", "seg", "weight")
    return placed.groupBy("shard").applyInArrow(_search(window), _FOUND)


def _report_hot(ws: Workspace, pieces: DataFrame, window: int, shard_segments: int, broadcast_rows: int) -> DataFrame:
    """Like _report, for minimizers with many pieces (rid, firsts, seg, key, weight), distinct ones of each text: equal
    ones of all texts are collapsed, and no shard gets too many distinct ones."""
    collapsed = pieces.groupBy("key", "seg").agg(F.sum("weight").alias("weight")).withColumn("sid", F.monotonically_increasing_id())
    distinct = ws.save(collapsed, "segments").df
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.regexp_count("seg", F.lit(" ")) + 1).alias("words"))
    sizes = ws.save(sizes, "sizes")
    wide = F.col("distinct") > shard_segments
    words = {r.wide: r.words for r in sizes.df.groupBy(wide.alias("wide")).agg(F.sum("words").alias("words")).collect()}  # two rows
    sized = join_small(distinct, sizes.df.select("key", "distinct"), sizes.rows, "key", most=broadcast_rows)
    found = []
    if False in words:
        own = sized.where(~wide).select(F.col("sid").alias("rid"), F.lit(0).alias("first"), "seg", "key", "weight")
        found.append(_report(own, words[False], window).select(F.col("rid").alias("sid"), "runs"))
    if True in words:
        windows = sized.where(wide).select("seg", "weight", "sid").mapInArrow(_windows(window), _WINDOWS)
        asked = windows.groupBy("words").agg(F.sum("weight").alias("weight")).withColumn("rid", F.monotonically_increasing_id())
        asked = ws.save(asked, "windows")
        own = asked.df.select("rid", F.lit(0).alias("first"), F.col("words").alias("seg"), F.xxhash64("words").alias("key"), "weight")
        hits = _report(own, window * asked.rows, window).select("rid")
        repeated = ws.save(asked.df.join(hits, "rid").select(_digest("words").alias("digest")), "repeated")
        starts = join_small(windows.select("sid", "at", _digest("words").alias("digest")), repeated.df, repeated.rows, "digest", most=broadcast_rows)
        starts = starts.groupBy("sid").agg(F.array_sort(F.collect_set("at")).alias("starts"))  # at most a segment's windows
        found.append(starts.select("sid", _runs("starts", window).alias("runs")))
    runs = found[0] if len(found) == 1 else found[0].union(found[1])
    runs = ws.save(distinct.join(runs, "sid").select(_digest("seg").alias("digest"), "runs"), "runs")
    placed = pieces.select("rid", "firsts", _digest("seg").alias("digest"))
    back = join_small(placed, runs.df, runs.rows, "digest", most=broadcast_rows)
    moved = lambda first: F.transform("runs", lambda r: F.struct((r["start"] + first).alias("start"), (r["end"] + first).alias("end")))
    return back.select("rid", F.flatten(F.transform("firsts", moved)).alias("runs"))
