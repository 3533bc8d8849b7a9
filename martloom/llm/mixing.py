"""Mixing sources to target weights (6): a min-cost flow from documents to source quotas.

Documents are aggregated by membership pattern, the set of sources that they belong to. A pattern's words
can be taken once at no cost, a second time at cost 1, a third time at cost 2: convex, so repeating is the
last resort. The flow of words from patterns to the quotas of their sources is solved on the driver over one
row per pattern. Then each pattern's documents are taken in whole copies: as many full rounds as the flow
holds, and one more copy of documents in a seeded order until the rest is filled.

The seeded order is cut by hash buckets: their sums tell in which bucket a pattern's rest runs out, and only
that bucket's rows are ordered one by one. No window holds more than one bucket of one pattern.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import WORD, prepared

REPEATS = 3
#: Patterns are solved on the driver; more than this are refused by name.
MOST_PATTERNS = 1_000_000
#: Documents of one bucket of the seeded order, on average.
BUCKET_DOCS = 50_000
LEAST_BUCKETS = 256


def shares(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Targets that share the sum of `sizes` by weight, none above `repeats` times its size.

    What is above is shared again by weight among the others, until none is above.
    """
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > repeats * sizes[i]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(repeats * sizes[i])
        left -= sum(target[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return target


def _poured(held: np.ndarray, amount: int) -> np.ndarray:
    """What is taken of each of `held`, in order, until `amount` is together."""
    return np.clip(amount - (np.cumsum(held) - held), 0, held)


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources, at the least total cost of repeating.

    Every path costs what the tier costs at which its pattern starts, so paths of the first tier are used up
    before the second is opened, which is the order of successive shortest paths.

    Ways are searched between sources: from one that a pattern with words left belongs to, over sources whose words
    some pattern can move to another of its own, to one with room. All patterns that can go such a way go at once, so
    the number of ways follows from the sources, and a way takes a few passes over the memberships.
    """
    width = np.array([len(m) for m in members], np.int64)
    first = np.cumsum(width) - width
    at = np.repeat(np.arange(len(members)), width)  # a membership: a pattern and one of its sources
    to = np.array([s for m in members for s in m], np.int64)
    order = np.argsort(to, kind="stable")
    of_source = np.split(order, np.searchsorted(to[order], np.arange(1, len(quotas)))) if len(quotas) else []
    size, room = np.array(sizes, np.int64), np.array(quotas, np.int64)
    left, flow = np.zeros(len(sizes), np.int64), np.zeros(len(to), np.int64)

    def sources_of(patterns: np.ndarray) -> np.ndarray:
        count = width[patterns]
        return np.unique(to[np.arange(count.sum()) + np.repeat(first[patterns] - (np.cumsum(count) - count), count)])

    def shortest() -> list[int]:
        """Sources of a way that ends at one with room; empty if there is none."""
        came = dict.fromkeys(np.unique(to[left[at] > 0]).tolist(), -1)
        seen, queue = np.zeros(len(sizes), bool), deque(came)
        while queue:
            s = queue.popleft()
            if room[s] > 0:
                way = [s]
                while came[way[-1]] >= 0:
                    way.append(came[way[-1]])
                return way[::-1]
            movable = at[of_source[s][flow[of_source[s]] > 0]]
            movable = movable[~seen[movable]]
            seen[movable] = True
            for t in sources_of(movable).tolist():
                if t not in came:
                    came[t] = s
                    queue.append(t)
        return []

    def shared(s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Memberships in s, and in t, of the patterns that belong to both."""
        _, in_s, in_t = np.intersect1d(at[of_source[s]], at[of_source[t]], assume_unique=True, return_indices=True)
        return of_source[s][in_s], of_source[t][in_t]

    for _ in range(repeats):
        left += size
        while way := shortest():
            own = of_source[way[0]]
            hops = [shared(s, t) for s, t in zip(way, way[1:])]
            amount = min(left[at[own]].sum(), room[way[-1]], *(flow[here].sum() for here, _ in hops))
            for here, there in hops:  # a way meets a source once, so what one hop moves is not what another was promised
                moved = _poured(flow[here], amount)
                flow[here] -= moved
                flow[there] += moved
            given = _poured(left[at[own]], amount)
            flow[own] += given
            left[at[own]] -= given
            room[way[-1]] -= amount
    return [dict(zip(to[a : a + n].tolist(), flow[a : a + n].tolist(), strict=True)) for a, n in zip(first.tolist(), width.tolist(), strict=True)]


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, row, sources, size, copies, taken. quotas: source, size, target. flow: pattern, source, words."""

    documents: DataFrame
    quotas: DataFrame
    flow: DataFrame


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[float] = (1, 2, 3),
    repeats: int = REPEATS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> Mix:
    """Copies of each document so that each source's words come near its target.

    `sources` is an array of the names that a document belongs to; null is a source of its own, last in order.
    `weights` repeat over the sources in code point order. A document without words or without sources is taken
    0 times; null text has 0 words. Repeated rows are documents of their own, told apart by their order in the
    written table. Equal seeds and ids give equal results. An empty table gives an empty mix. Other columns are
    not looked at. More than MOST_PATTERNS patterns raise ValueError.
    """
    spark = docs.sparkSession
    ws = prepared(spark)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (docs[row_col].cast("long") if row_col else F.lit(None).cast("long")).alias("row"),
        F.array_sort(F.array_distinct(sources)).alias("sources"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"), F.lit(seed)).alias("at"),  # ids may be null
    )
    rows = rows.withColumn("pattern", F.to_json("sources"))
    saved = ws.save(rows, "sized")
    found = saved.df.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    found = sorted(found, key=lambda r: r.pattern or "")

    names = sorted({s for r in found for s in r.sources or ()}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    members = [[number[s] for s in r.sources or ()] for r in found]
    sizes = [r.size for r in found]
    held = [0] * len(names)
    for own, size in zip(members, sizes, strict=True):
        for s in own:
            held[s] += size
    by_size = shares(held, [weights[i % len(weights)] for i in range(len(names))], repeats)
    if any(len(m) > 1 for m in members):  # what is shared counts once
        scale = sum(sizes) / max(1, sum(held))
        by_size = [t * scale for t in by_size]
    flow = min_cost_flow(sizes, members, [round(t) for t in by_size], repeats)

    plan = [(r.pattern, sum(f.values()) // max(1, r.size), sum(f.values()) % max(1, r.size)) for r, f in zip(found, flow, strict=True)]
    plan = spark.createDataFrame(plan, "pattern string, rounds long, rest long")
    quotas = spark.createDataFrame(list(zip(names, held, by_size, strict=True)), "source string, size long, target double")
    sent = [(r.pattern, names[s], w) for r, f in zip(found, flow, strict=True) for s, w in f.items()]
    return Mix(_select(saved.df, plan, saved.rows), quotas, spark.createDataFrame(sent, "pattern string, source string, words long"))


def _select(rows: DataFrame, plan: DataFrame, count: int) -> DataFrame:
    """Full rounds for all documents of a pattern, one more copy in seeded order until its rest is filled."""
    buckets = max(LEAST_BUCKETS, count // BUCKET_DOCS)
    bucket = F.pmod("at", F.lit(buckets))
    plan = F.broadcast(plan)  # at most MOST_PATTERNS rows
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).join(plan, "pattern")
    pivot = sums.where("before < rest AND before + words >= rest").select("pattern", "rounds", F.col("bucket").alias("pivot"), (F.col("rest") - F.col("before")).alias("room"))
    plan = plan.join(pivot.drop("rounds"), "pattern", "left")
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(plan), rows["pattern"].eqNullSafe(plan["pattern"]), "left").drop(plan["pattern"])
    copies = F.coalesce("rounds", F.lit(0))
    whole = rows.where("pivot IS NULL OR bucket != pivot").withColumn("copies", copies + F.coalesce(F.col("bucket") < F.col("pivot"), F.lit(False)).cast("long"))
    order = Window.partitionBy("pattern").orderBy("at", "doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where("bucket = pivot").withColumn("upto", F.sum("size").over(order))
    # the document at the edge is taken if more than half of it fits
    cut = cut.withColumn("copies", copies + (F.col("upto") * 2 - F.col("size") <= F.col("room") * 2).cast("long"))
    out = ["doc_id", "row", "sources", "size", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long").alias("copies")]
    return whole.select(*out).union(cut.select(*out)).withColumn("taken", F.col("size") * F.col("copies"))
