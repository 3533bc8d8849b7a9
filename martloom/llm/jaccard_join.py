"""N-gram Jaccard join (1): documents whose word shingles agree to 75 percent or more, as components.

The method is a token-group matrix. Similar documents are put into groups, each group keeps the
union of its tokens, the overlap of a document with a group bounds its overlap with each member,
and only groups that the bound lets through are opened.

1. *Land.* Each document's shingle set is hashed (64 bits a shingle). Rows are written with the
   set's size, its smallest hash and a 128-bit fingerprint; within a task, equal sets keep one text.
   The same pass counts all shingles in a sketch of fixed width.
2. *Group.* Rows are range-partitioned and sorted by (smallest hash, fingerprint, id), so similar
   sets tend to meet and a hot key is spread over tasks. A set joins the group of an earlier set that it
   resembles loosely.
3. *Matrix.* Tokens are ordered by (frequent in the sketch, hash). With sizes a and b and a similarity
   of t, overlap is at least ta and tb; so a - ceil(ta) + l first tokens of one and b - ceil(tb) + l of
   the other share at least l tokens, for every l. l grows with the size, which is what makes the bound
   sharp. The (token, group) pairs of these tokens are the matrix; documents look up groups in it.
4. *Open.* Groups that share at least l tokens with a document are opened, and its own group: in blocks of
   members, the document is compared exactly, and every similar member is a link. A block is skipped if its
   token union holds too little of the document. Links are counted for both ends; only those that join what
   the block has not joined yet are written, so a group of near copies costs rows in proportion to its size.
5. *Components* of the classes over the links that join, by alternating large and small stars.

The order of tokens comes from a sketch, but any order is right: the sketch only makes it cheap. Nothing
is capped. Frequent tokens are dealt out by (token, salt), and what a group has of them only once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import (
    in_few,
    join_small,
    prepared,
    scrambled,
    slices,
    split_words,
    texts_of,
    window_hashes,
    word_hashes,
)
from martloom.workspace import Saved, Workspace

WORDS = 5
PERCENT = 75
#: One token in so many of a set is looked up in addition, and must be shared in addition.
SHARED = 30
#: Counters of the sketch, as a power of two, and of one written part of it.
SKETCH_BITS, PART_BITS = 24, 16
#: A token is frequent from this count on, or from so many deviations above the mean of a counter.
FREQUENT, DEVIATIONS = 16, 6
#: Last sets of a run, none similar to one before it, that the next set is compared with; and what makes a group, in percent.
HEADS, LOOSELY = 8, 40
#: Tokens of one bucket of the matrix, tokens dealt at a time, salts of a frequent token, pairs made at a time.
BUCKET_TOKENS, DEALT_TOKENS, SALTS, PAIRS = 500_000, 250_000, 8, 500_000
#: The bits above hold a group's rank: large groups first.
RANK_BITS = 58
#: Members of a block of an opened group and their shingles, and documents that are compared with it in one task.
BLOCK_MEMBERS, BLOCK_SHINGLES, BLOCK_QUERIES = 512, 2_000_000, 2_048

_LANDED = """doc_id long, row long, text string, n_shingles long, low long, fp1 long, fp2 long,
    part int, counts binary"""
_CLASSES = """rid long, fp1 long, fp2 long, n int, cls long, grp long, tokens array<long>"""
_BUCKETS = "bucket long, token binary, cls binary, grp binary, n binary, times binary"
_PAIRS = "q long, g long, n int, shared int"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: lower-cased, n words; the whole if fewer."""
    found, at = split_words(pa.compute.ascii_lower(texts))
    hashes = word_hashes(found)
    rolled = window_hashes(hashes, words)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            short = window_hashes(hashes[a:b], int(b - a))[:1] if b > a else np.zeros(0, np.uint64)
            out.append(scrambled(short + np.uint64(b - a)))
    return out


def least_overlap(n, percent: int = PERCENT):
    """The least that a set of n shares with any set that it is similar to."""
    return -(-percent * n // 100)


def prefix_length(n, percent: int = PERCENT):
    return n - least_overlap(n, percent) + n // SHARED + 1


def resemblance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _frequent_bits(packed: np.ndarray, token: np.ndarray) -> np.ndarray:
    at = (token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _land(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint8), set()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for piece in slices(batch):
                sets = shingle_sets(piece.column("text"), words)
                prints = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
                new = [p is not None and p not in seen and not seen.add(p) for p in prints]
                fresh = [s for s, is_new in zip(sets, new, strict=True) if is_new]
                if fresh:
                    at, times = np.unique(np.concatenate(fresh) & mask, return_counts=True)
                    counts[at] = np.minimum(255, counts[at] + times)  # a task alone can make a token frequent
                halves = [(p or 0) >> 64 for p in prints], [(p or 0) & (2**64 - 1) for p in prints]
                nothing = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("row"),
                        piece.column("text").take(pa.array(np.arange(len(new)), mask=~np.array(new, bool))),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _longs(np.array([s[0] if len(s) else 0 for s in sets], np.uint64)),
                        *(_longs(np.array(h, np.uint64)) for h in halves),
                        nothing,
                        pa.nulls(len(sets), pa.binary()),
                    ],
                    names=["doc_id", "row", "text", "n_shingles", "low", "fp1", "fp2", "part", "counts"],
                )
        packed = [zstandard.compress(c.tobytes(), 1) for c in counts.reshape(-1, 1 << PART_BITS)]
        yield _sketch_rows(packed)

    return run


def _sketch_rows(packed: list[bytes]) -> pa.RecordBatch:
    n = len(packed)
    long, text = pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays(
        [long, long, text, long, long, long, long, pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())],
        names=["doc_id", "row", "text", "n_shingles", "low", "fp1", "fp2", "part", "counts"],
    )


def _frequent(landed: DataFrame, total: int) -> np.ndarray:
    """One bit for each counter of the sketch: whether its tokens are frequent. Two megabytes."""
    mean = total / (1 << SKETCH_BITS)
    least = max(FREQUENT, mean + DEVIATIONS * mean**0.5)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(counts >= least).tobytes()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(zstandard.decompress(row["counts"]), np.uint8)
                if row["part"] != part:
                    if part is not None:
                        yield done()
                    part, counts = row["part"], np.zeros(1 << PART_BITS, np.uint64)
                counts += own
        if part is not None:
            yield done()

    parts = 1 << (SKETCH_BITS - PART_BITS)
    rows = landed.where("part IS NOT NULL").select("part", "counts").repartition(parts, "part").sortWithinPartitions("part")
    bits = np.zeros((parts, 1 << (PART_BITS - 3)), np.uint8)
    for row in rows.mapInArrow(add, "part int, bits binary").collect():  # as many rows as parts
        bits[row.part] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def _group(bits, words: int, percent: int):
    """Sorted rows to classes: equal sets one, each with its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, low, heads = TaskContext.get().partitionId() << 33, None, None, []
        for batch in batches:
            for piece in slices(batch):
                prints = list(zip(piece.column("fp1").to_pylist(), piece.column("fp2").to_pylist(), strict=True))
                first = [p != q for p, q in zip(prints, [last, *prints[:-1]], strict=True)]
                last = prints[-1]
                piece = piece.filter(pa.array(first))
                groups, tokens = [], []
                for s, own_low in zip(shingle_sets(piece.column("text"), words), piece.column("low").to_pylist(), strict=True):
                    if own_low != low:
                        low, heads = own_low, []
                    own = group = number + len(groups)
                    alone = True  # not similar to a head
                    for head, head_group in heads:
                        both, either = resemblance(s, head)
                        if group == own and 100 * both >= LOOSELY * either:
                            group = head_group
                        if 100 * both >= percent * either:
                            group, alone = head_group, False
                            break
                    if alone:
                        heads = [*heads[-HEADS + 1 :], (s, group)]
                    groups.append(group)
                    common = _frequent_bits(bits.value, s)
                    tokens.append(np.concatenate([s[~common], s[common]])[: prefix_length(len(s), percent)])
                if not groups:
                    continue
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("rid", "fp1", "fp2")),
                        piece.column("n_shingles").cast(pa.int32()),
                        pa.array(range(number, number + len(groups)), pa.int64()),
                        pa.array(groups, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(tokens))),
                    ],
                    names=["rid", "fp1", "fp2", "n", "cls", "grp", "tokens"],
                )
                number += len(groups)

    return run


def _deal(bits, buckets: int):
    """Classes' tokens, packed by bucket: the tokens of a class one after the other, with their number. cls is -1
    where only the group's having the token counts."""

    def pack(columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket, token, cls, grp, n = columns
        order = np.argsort(bucket, kind="stable")
        bucket, token, cls, grp, n = (c[order] for c in (bucket, token, cls, grp, n))
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cls[1:] != cls[:-1]) | (grp[1:] != grp[:-1])])
        run = np.flatnonzero(new)
        times = np.diff(np.append(run, len(bucket))).astype(np.int32)
        ids, starts = np.unique(bucket, return_index=True)
        cuts, run_cuts = [*starts, len(bucket)], np.searchsorted(run, [*starts, len(bucket)])

        def packed(values: np.ndarray, at) -> pa.Array:
            return pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())

        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), packed(token, cuts), *(packed(v, run_cuts) for v in (cls[run], grp[run], n[run], times))],
            names=["bucket", "token", "cls", "grp", "n", "times"],
        )

    def rows(batch: pa.RecordBatch, frequent: np.ndarray) -> list[np.ndarray]:
        lists = batch.column("tokens")
        size = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy().view(np.uint64)
        cls, grp = (np.repeat(batch.column(c).to_numpy(), size) for c in ("cls", "grp"))
        n = np.repeat(batch.column("n").to_numpy(), size)
        home = scrambled(token)
        hot = _frequent_bits(frequent, token)
        salt = np.where(hot, cls % SALTS, 0)
        made = [[home, salt, token, cls, grp, n]]
        if hot.any():
            once = np.unique(np.stack([token[hot], grp[hot].astype(np.uint64), home[hot]]), axis=1)
            for k in range(SALTS):
                none = np.full(once.shape[1], -1)
                made.append([once[2], np.full(once.shape[1], k), once[0], none, once[1].astype(np.int64), np.zeros(once.shape[1], np.int32)])
        home, salt, *rest = (np.concatenate(c) for c in zip(*made, strict=True))
        return [((home + salt.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(rows(batch, bits.value))
                size += len(held[-1][0])
            if size >= DEALT_TOKENS:
                yield pack([np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield pack([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _look_up(table: pa.Table) -> pa.Table:
    """A bucket of the matrix to (document's class, other group, tokens that they share).

    A class looks up the groups before its own: one side of a link is enough to find it. Large groups come first,
    so the few ask the many.
    """
    kinds = {"token": np.uint64, "cls": np.int64, "grp": np.int64, "n": np.int32, "times": np.int32}
    token, cls, grp, n, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items())
    cls, grp, n = (np.repeat(v, times) for v in (cls, grp, n))
    order = np.lexsort((grp, token))
    token, cls, grp, n = token[order], cls[order], grp[order], n[order]
    new_token = np.concatenate([[True], token[1:] != token[:-1]])
    new_cell = new_token | np.concatenate([[True], grp[1:] != grp[:-1]])
    cell = np.cumsum(new_cell) - 1
    first = cell[np.maximum.accumulate(np.where(new_token, np.arange(len(token)), 0))]
    cell_group, before = grp[new_cell], np.where(cls >= 0, cell - first, 0)
    asks = np.flatnonzero(before)
    ends = np.cumsum(before[asks])
    made, at = [], 0
    while at < len(asks):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        who, times = asks[at:to], before[asks[at:to]]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(who, times)
        group = cell_group[first[row] + inside]
        order = np.lexsort((group, cls[row]))
        row, group = row[order], group[order]
        new = np.concatenate([[True], (cls[row][1:] != cls[row][:-1]) | (group[1:] != group[:-1])])
        start = np.flatnonzero(new)
        shared = np.diff([*start, len(row)])
        pick = row[start]
        made.append([cls[pick], group[start], n[pick], shared.astype(np.int32)])
        at = to
    columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, t) for t in ("i8", "i8", "i4", "i4")]
    return pa.table(columns, names=["q", "g", "n", "shared"])


def _compare(words: int, percent: int):
    """One block: its members' tokens inverted, each class that asks against all of them. A group's own members ask for
    those before them, so every pair of classes is compared once, in one block.

    Two kinds of rows: (u, null, links), in how many similar pairs of this block u is; and (u, v, 0), a link that joins
    what the block's links before it do not. Both are no more than members and askers, however many pairs are similar.
    """

    def run(table: pa.Table) -> pa.Table:
        member = table.filter(table.column("is_member"))
        sets = [s for b in member.to_batches() for p in slices(b) for s in shingle_sets(p.column("text"), words)]
        members = member.column("cls").to_numpy()
        sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        union, starts = np.unique(token, return_index=True)
        ends = np.append(starts[1:], len(token))
        label, found = members.copy(), np.zeros(len(sets), np.int64)  # a member's component in this block, and its links
        place = {cls: k for k, cls in enumerate(members.tolist())}
        rows: list[tuple[int, int | None, int]] = []
        asking = table.filter(pa.compute.invert(table.column("is_member")))
        for batch in asking.to_batches():
            for piece in slices(batch):
                askers = zip(piece.column("cls").to_pylist(), piece.column("at_home").to_pylist(), shingle_sets(piece.column("text"), words), strict=True)
                for cls, at_home, s in askers:
                    if not len(union):
                        continue
                    at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                    at = at[union[at] == s]
                    if len(at) < least_overlap(len(s), percent):
                        continue
                    times = ends[at] - starts[at]
                    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    both = np.bincount(owner[np.repeat(starts[at], times) + inside], minlength=len(sets))
                    similar = 100 * both >= percent * (len(s) + sizes - both)
                    hit = np.flatnonzero(similar & (members < cls) if at_home else similar)
                    if not len(hit):
                        continue
                    rows.append((cls, None, len(hit)))
                    found[hit] += 1
                    own = int(label[place[cls]]) if cls in place else cls
                    met = np.unique(label[hit])
                    met = met[met != own]
                    rows += [(max(own, other), min(own, other), 0) for other in met.tolist()]
                    if len(met):
                        label[np.isin(label, met) | (label == own)] = min(own, int(met[0]))
        rows += [(cls, None, n) for cls, n in zip(members.tolist(), found.tolist(), strict=True) if n]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])

    return run


def components(ws: Workspace, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge (u, v): root is the smallest node that it reaches. There are no more
    than `most` edges, if that is given.

    Large and small stars in turn; the number of rounds grows with the logarithm of the nodes. What a round writes is
    bounded by what it reads, and so are its tasks and files: a few edges are a file, not one for each partition.
    """

    def saved(e: DataFrame, most: int | None) -> tuple[Saved, int]:
        kept = ws.save(e.distinct() if most is None else in_few(e.distinct(), most), "edges")
        return kept, kept.df.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]

    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    now, mark = saved(down, most)
    while now.rows:
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(in_few(large.distinct(), 2 * now.rows), "large")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, next_mark = saved(small.union(least), 2 * large.rows)
        if (following.rows, next_mark) == (now.rows, mark):
            break
        now, mark = following, next_mark
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


@dataclass(frozen=True)
class Joined:
    """documents: doc_id, row, n_shingles, component_id, root (of the component, whatever its ids), n_links and cls.
    cls is the class of equal shingle sets, n_links how many other classes it is linked with, each counted; cls and
    root are null and n_links is 0 without shingles. links: (u, v) between classes, u > v: links that join all that
    is linked, but not all links."""

    documents: DataFrame
    links: DataFrame


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, broadcast_rows: int = 1_000_000) -> Joined:
    """Components of the documents under "shingle sets agree to `percent` or more".

    Null, empty and blank texts have no shingles and are linked with nothing. Equal texts and repeated rows
    are one class; each input row gives a row. A null id takes part, but is no component id unless all are null.
    An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ws = prepared(spark)
    landed = texts_of(docs, id_col, text_col, row_col).mapInArrow(_land(words), _LANDED)
    landed = ws.save(landed.withColumn("rid", F.monotonically_increasing_id()), "landed").df
    rows = landed.where("part IS NULL")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = spark.sparkContext.broadcast(_frequent(landed, total))

    texts = rows.where("text IS NOT NULL").select("rid", "doc_id", "text", "n_shingles", "low", "fp1", "fp2")
    met = texts.repartitionByRange("low", "fp1", "fp2", "rid").sortWithinPartitions("low", "fp1", "fp2", "rid")
    grouped = ws.save(met.mapInArrow(_group(bits, words, percent), _CLASSES), "classes")
    # equal sets at the border of two tasks are several classes: one of them stays. There are no more such sets than tasks.
    first = grouped.df.groupBy("fp1", "fp2").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    doubled = grouped.df.join(first.drop("n"), ["fp1", "fp2"]).where("cls != first").select("cls")
    doubled = ws.save(doubled, "doubled")
    classes = join_small(grouped.df, doubled.df, doubled.rows, "cls", "left_anti", most=broadcast_rows).select(*grouped.df.columns)

    size = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_TOKENS))
    several = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    several = ws.save(in_few(several, grouped.rows), "several")
    ranked = join_small(classes.select("cls", "grp", "n", "tokens"), several.df, several.rows, "grp", "left", most=broadcast_rows)
    rank = F.lit(31).cast("long") - F.floor(F.log2(F.coalesce("members", F.lit(1)))).cast("long")
    ranked = ranked.withColumn("grp", F.shiftleft(rank, RANK_BITS).bitwiseOR(F.col("grp")))
    cells = ranked.select("cls", "grp", "n", "tokens").mapInArrow(_deal(bits, buckets), _BUCKETS)
    shared = cells.groupBy("bucket").applyInArrow(_look_up, _PAIRS)
    home = join_small(classes.select("cls", "grp"), several.df.select("grp"), several.rows, "grp", most=broadcast_rows)
    home = home.select(F.col("cls").alias("q"), F.col("grp").alias("g"))
    least = F.floor(F.ceil(F.col("n") * percent / 100) / SHARED) + 1
    asks = (
        shared.groupBy("q", "g").agg(F.sum("shared").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= least)
    )
    asks = asks.select("q", F.col("g").bitwiseAND(F.lit((1 << RANK_BITS) - 1)).alias("g"))
    asks = ws.save(asks.union(home), "asks")
    opened = ws.save(_open(ws, asks, classes, texts, words, percent, broadcast_rows), "opened")
    links = opened.df.where("v IS NOT NULL").select("u", "v")
    degrees = opened.df.where("v IS NULL").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("n_links"))

    roots = components(ws, links, opened.rows).withColumnRenamed("node", "cls")
    of_print = classes.select("fp1", "fp2", "cls").join(roots, "cls", "left").join(degrees, "cls", "left")
    of_print = of_print.select("fp1", "fp2", "cls", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = rows.where("n_shingles > 0")
    ids = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("least_id"))
    of_print = ws.save(in_few(of_print.join(ids, ["fp1", "fp2"]), grouped.rows), "prints").df
    of_root = of_print.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = of_print.join(of_root, "root").drop("least_id")
    out = ["doc_id", "row", "n_shingles", "component_id", "root", "n_links", "cls"]
    none = F.lit(None).cast("long")
    alone = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "root": none, "cls": none, "n_links": F.lit(0).cast("long")})
    return Joined(full.join(of_print, ["fp1", "fp2"]).select(*out).union(alone.select(*out)), links)


def _open(ws: Workspace, asks: Saved, classes: DataFrame, texts: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Links between classes, verified, from the questions that the bound let through: counted, and those that join."""
    size = F.broadcast if asks.rows <= broadcast_rows else lambda df: df
    opened = asks.df.groupBy("g").agg(F.count(F.lit(1)).alias("queries"))
    members = classes.select(F.col("grp").alias("g"), "cls", "rid", "n").join(size(opened), "g")
    members = ws.save(members, "members")
    plan = members.df.groupBy("g").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.ceil(F.max("queries") / BLOCK_QUERIES).cast("int").alias("salts"),
    )
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.df.join(plan, "g").withColumn("block", deal("cls", "blocks")).withColumn("salt", spread("salts"))
    asking = asks.df.join(plan, "g").withColumn("salt", deal("q", "salts")).withColumn("block", spread("blocks"))
    asking = asking.join(classes.select(F.col("cls").alias("q"), "rid", "grp"), "q")
    out = ["rid", "cls", "g", "block", "salt"]
    asking = asking.withColumn("cls", F.col("q")).select(*out, F.lit(False).alias("is_member"), (F.col("grp") == F.col("g")).alias("at_home"))
    wanted = own.select(*out, F.lit(True).alias("is_member"), F.lit(False).alias("at_home")).union(asking)
    wanted = ws.save(wanted, "wanted")
    full = join_small(texts.select("rid", "text"), wanted.df, wanted.rows, "rid", most=broadcast_rows)
    return full.groupBy("g", "block", "salt").applyInArrow(_compare(words, percent), "u long, v long, links long")
