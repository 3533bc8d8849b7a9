"""SimHash near-dedup (11): documents whose 64-bit fingerprints differ in four bits or fewer, as components.

The method is anchor-point covering. The words of a covering code are the anchors: every point lies within the
code's radius of one. If two points differ in t bits, the second lies within radius + t of the first one's nearest
anchor; so every fingerprint is replicated to all anchors within radius + t, and compared there only with the
fingerprints whose nearest anchor it is.

A code for all 64 bits with a threshold of four would need more than a thousand replicas. So the bits are cut into
windows with a code and a threshold each. Four differing bits cannot exceed the thresholds of all windows at once
if the thresholds, each plus one, sum up to five; so a pair is found in at least one window, and it is reported in
the first window that can. The code of 23 bits is the perfect binary Golay code: 4096 anchors, radius 3, one nearest
anchor for each point. Bits beyond those of the code are anchors of their own, with radius 0. COARSE makes some
12 replicas and 2^18 anchors, FINE 120 replicas and 2^22 anchors; both find the same pairs. Which is taken follows
from the number of distinct fingerprints, as the number of anchors must grow with them.

Equal fingerprints are one before anything is replicated, so copies cost nothing. An anchor with many fingerprints
is dealt out in blocks of bounded size, homes against visitors; blocks are put together in parts of even size.
A part returns links that join what it has not joined yet: fewer than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import join_small, prepared, slices, texts_of
from martloom.llm.jaccard_join import components
from martloom.workspace import Workspace

WORDS, BITS_APART, SEED = 4, 4, 42
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and its radius.
GOLAY, GOLAY_BITS, GOLAY_RADIUS = 0b110001110101, 23, 3
#: Fingerprints of one block on either side, rows of a part, pairs compared at a time.
BLOCK, PART_ROWS, PAIRS = 8_192, 100_000, 1 << 21
#: From this number of distinct fingerprints on, the finer windows are used.
MANY = 20_000_000


@dataclass(frozen=True)
class Window:
    """Bits low to low + coded + plain of a fingerprint. The first `coded` bits, 0 or 23, have the Golay code."""

    low: int
    coded: int
    plain: int
    threshold: int

    @property
    def mask(self) -> int:
        return (1 << self.coded + self.plain) - 1 << self.low


COARSE = (Window(0, 23, 0, 1), Window(23, 23, 0, 1), Window(46, 0, 18, 0))
FINE = (Window(0, 23, 9, 2), Window(32, 23, 9, 1))


def check_windows(windows: tuple[Window, ...], apart: int) -> None:
    """Refuses windows that could miss a pair."""
    seen = 0
    for w in windows:
        if seen & w.mask or w.mask >> 64 or w.coded not in (0, GOLAY_BITS):
            raise ValueError(f"windows overlap, leave the fingerprint or have no code: {windows}")
        seen |= w.mask
    if sum(w.threshold + 1 for w in windows) <= apart:
        raise ValueError(f"a pair {apart} bits apart could pass all windows: {windows}")


def shingle_bytes(text: str | None, words: int = WORDS) -> list[bytes]:
    """The shingles of a text, A-Z lower-cased, repeats included; all its words if they are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    return [joined[a:b] for a, b in zip(starts.tolist(), last.tolist(), strict=False)]


def fingerprints(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Of each text: a bit is 1 if it is set in over half the hashes of the shingles; zero without words."""
    hashed = [[xxhash.xxh64_intdigest(s, seed) for s in shingle_bytes(t, words)] for t in texts]
    out = np.zeros(len(texts), np.uint64)
    size = np.array([len(h) for h in hashed], np.int64)
    held = np.flatnonzero(size)
    if len(held):
        flat = np.concatenate([np.array(hashed[k], np.uint64) for k in held])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(size[held]) - size[held]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[held] = np.packbits(2 * ones > size[held][:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def _print(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = fingerprints(piece.column("text").to_pylist(), words, seed)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row"), pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"]
                )

    return run


@cache
def golay_words() -> np.ndarray:
    """The 4096 words: all multiples of the generator."""
    out = np.zeros(1, np.uint32)
    for shift in range(GOLAY_BITS - GOLAY.bit_length() + 1):
        out = np.concatenate([out, out ^ np.uint32(GOLAY << shift)])
    return out


@cache
def _nearby(bits: int, threshold: int) -> list[np.ndarray]:
    """Masks of `bits` bits with up to `threshold` ones, by their number of ones."""
    masks = [np.zeros(1, np.uint32)]
    for _ in range(threshold):
        more = (masks[-1][:, None] ^ (np.uint32(1) << np.arange(bits, dtype=np.uint32))).ravel()
        masks.append(np.unique(more[np.bitwise_count(more) == len(masks)]))
    return masks


def anchors_of(points: np.ndarray, window: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, anchor, whether it is the point's nearest) for all anchors within radius and threshold."""
    own = points >> np.uint64(window.low)
    plain = (own >> np.uint64(window.coded) & np.uint64((1 << window.plain) - 1)).astype(np.uint32)
    if window.coded:
        code = golay_words()
        coded = (own & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.uint32)
        apart = np.bitwise_count(coded[:, None] ^ code)
        index, word = np.nonzero(apart <= GOLAY_RADIUS + window.threshold)
        beyond = np.maximum(apart[index, word].astype(np.int64) - GOLAY_RADIUS, 0)
        part = code[word].astype(np.int64)
    else:
        index = np.arange(len(points))
        beyond, part = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    out = []
    for ones, masks in enumerate(_nearby(window.plain, window.threshold) if window.plain else [np.zeros(1, np.uint32)]):
        fits = np.flatnonzero(beyond + ones <= window.threshold)
        other = (plain[index[fits]][:, None] ^ masks).astype(np.int64).ravel()
        out.append(
            (
                np.repeat(index[fits], len(masks)),
                np.repeat(part[fits], len(masks)) | other << window.coded,
                np.repeat((beyond[fits] == 0) & (ones == 0), len(masks)),
            )
        )
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: Fingerprints that one step of the replication holds: each is compared with all words of the code.
_STEP = 2_048


def _replicate(windows: tuple[Window, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                points = batch.column("fp")[at : at + _STEP].to_numpy().view(np.uint64)
                for number, window in enumerate(windows):
                    index, anchor, is_home = anchors_of(points, window)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(index), number, np.int32)),
                            pa.array(anchor),
                            pa.array(points[index].view(np.int64)),
                            pa.array(is_home),
                        ],
                        names=["win", "anchor", "fp", "is_home"],
                    )

    return run


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Puts the smallest label of what the links join on each of its points; `label` points at points."""
    while len(u):
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        u, v, low, high = u[apart], v[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(windows: tuple[Window, ...], apart: int) -> Callable[[pa.Table], pa.Table]:
    """A part: blocks of anchors, in each the homes against the visitors. Links that join are returned."""
    masks = [np.uint64(w.mask) for w in windows]

    def first_window(different: np.ndarray) -> np.ndarray:
        """The window that reports a pair: the first whose threshold it keeps."""
        first = np.full(len(different), len(windows))
        for number in reversed(range(len(windows))):
            first[np.bitwise_count(different & masks[number]) <= windows[number].threshold] = number
        return first

    def run(part: pa.Table) -> pa.Table:
        fp = part.column("fp").to_numpy().view(np.uint64)
        is_home = part.column("is_home").to_numpy(zero_copy_only=False)
        columns = [part.column(c).to_numpy() for c in ("win", "anchor", "home_block", "salt")]
        order = np.lexsort((~is_home, *columns))
        fp, is_home = fp[order], is_home[order]
        win, *rest = (c[order] for c in columns)
        new = np.concatenate([[True], (win[1:] != win[:-1]) | np.logical_or.reduce([c[1:] != c[:-1] for c in rest])])
        points, point = np.unique(fp, return_inverse=True)
        starts = np.flatnonzero(new)
        homes = np.add.reduceat(is_home, starts, dtype=np.int64)
        visitors = np.diff(np.append(starts, len(fp))) - homes
        label = np.arange(len(points))
        home_at = np.flatnonzero(is_home)  # in order of their blocks
        block = np.repeat(np.arange(len(starts)), homes)
        asks, first = visitors[block], (starts + homes)[block]
        ends, at = np.cumsum(asks), 0
        while at < len(home_at):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            times = asks[at:to]
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            a, b = np.repeat(home_at[at:to], times), np.repeat(first[at:to], times) + inside
            different = fp[a] ^ fp[b]
            near = np.flatnonzero((np.bitwise_count(different) <= apart) & (different != 0))
            near = near[first_window(different[near]) == win[a[near]]]
            _joined(label, point[a[near]], point[b[near]])
            at = to
        found = np.flatnonzero(label != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"u": pa.array(signed[found]), "v": pa.array(signed[label[found]])})

    return run


def _cells(ws: Workspace, distinct: DataFrame, windows: tuple[Window, ...]) -> DataFrame:
    """Blocks of anchors: each row is a fingerprint at an anchor, as home or as visitor of one block."""
    schema = "win int, anchor long, fp long, is_home boolean"
    cells = ws.save(distinct.mapInArrow(_replicate(windows), schema), "replicas").df
    sizes = cells.groupBy("win", "anchor").agg(F.count(F.lit(1)).alias("visitors"), F.count(F.when(F.col("is_home"), 1)).alias("homes"))
    sizes = sizes.where("visitors > 1 AND homes > 0").select(
        "win",
        "anchor",
        F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"),
        F.ceil(F.col("visitors") / BLOCK).cast("int").alias("salts"),
    )
    met = cells.join(sizes, ["win", "anchor"])

    def deal(n: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    out = ["win", "anchor", "home_block", "salt", "fp", "is_home"]
    homes = met.where("is_home").withColumn("home_block", deal("home_blocks")).withColumn("salt", each("salts"))
    visitors = met.withColumn("is_home", F.lit(False)).withColumn("salt", deal("salts")).withColumn("home_block", each("home_blocks"))
    return homes.select(*out).union(visitors.select(*out))


@dataclass(frozen=True)
class Near:
    """documents: doc_id, row, fp (as a signed long), component_id, root. links: (u, v) of fingerprints; they join
    all that is linked, but are not all links."""

    documents: DataFrame
    links: DataFrame


def simhash_near(
    docs: DataFrame,
    words: int = WORDS,
    apart: int = BITS_APART,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    windows: tuple[Window, ...] | None = None,
    broadcast_rows: int = 1_000_000,
) -> Near:
    """Components of the documents under "fingerprints differ in at most `apart` bits".

    Null, empty and blank texts have the fingerprint zero, which is linked like any other. Equal fingerprints, so
    repeated rows too, are linked; each input row gives a row. A null id takes part, but is no component id unless all
    ids of the component are null. An empty table gives an empty result. Other columns are not looked at.
    """
    ws = prepared(docs.sparkSession)
    printed = texts_of(docs, id_col, text_col, row_col).mapInArrow(_print(words, SEED), "doc_id long, row long, fp long")
    printed = ws.save(printed, "printed").df
    distinct = ws.save(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    windows = windows or (COARSE if distinct.rows < MANY else FINE)
    check_windows(windows, apart)

    cells = ws.save(_cells(ws, distinct.df.select("fp"), windows), "cells")
    parts = max(1, -(-cells.rows // PART_ROWS))
    part = F.pmod(F.xxhash64("win", "anchor", "home_block", "salt"), F.lit(parts))
    links = ws.save(cells.df.groupBy(part).applyInArrow(_compare(windows, apart), "u long, v long"), "links")

    roots = components(ws, links.df, links.rows).withColumnRenamed("node", "fp")
    of_fp = distinct.df.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_fp = ws.save(of_fp, "roots").df
    of_root = of_fp.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = ws.save(of_fp.join(of_root, "root").select("fp", "component_id", "root"), "components")
    documents = join_small(printed, of_fp.df, of_fp.rows, "fp", most=broadcast_rows)
    return Near(documents.select("doc_id", "row", "fp", "component_id", "root"), links.df)
