"""Toxicity (10): a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams that it has, by hash, each once. A feature's scale r is the log of how much
likelier it is in toxic documents; a logistic regression on the scaled features learns the weights. Features that
tell the labels apart too little, by the likelihood-ratio statistic, get no scale: else long clean texts add up noise,
and what a few mislabelled copies share looks toxic. Weight times scale is one number per feature, four megabytes,
broadcast to the tasks that score every whole text.

Ratios and weights come from a bounded sample: at most FIT_ROWS labelled documents of each label, the first by a
hash of the id. The intercept is then set for the share of toxic documents among all labelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import is_held_out, prepared, slices, strings, texts_of

LENGTHS = (3, 4, 5, 6)
BITS = 20
FIT_ROWS = 3_000
#: A feature counts from this statistic on. By chance one of the whole hash space reaches it in one sample of 20.
LEAST_STATISTIC = 30.0
THRESHOLD = 0.3
STEPS, RATE, DECAY = 300, 0.5, 1e-4

_FIT_PARTS = 8


class Features:
    """The distinct n-gram hashes of texts. Keeps one array for finding repeats, as large as the hash space."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            found = []
            for n in LENGTHS:
                count = len(points) - n + 1
                if count <= 0:
                    break
                code = np.full(count, n, np.uint64)
                for k in range(n):
                    code = code * np.uint64(0x100000001B3) + points[k : k + count]
                code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((code >> np.uint64(64 - BITS)).astype(np.int32))
            each = np.concatenate(found) if found else np.zeros(0, np.int32)
            order = np.arange(len(each), dtype=np.int32)
            self.last[each] = order
            yield each[self.last[each] == order]


@dataclass
class Model:
    """log odds of being toxic = intercept + the sum of `worth` over a text's features."""

    worth: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.worth[features].sum(dtype=float), -60, 60))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, features = np.zeros((2, 1 << BITS), np.int64), Features()
    for batch in batches:
        for piece in slices(batch):
            for label, own in zip(piece.column("label").to_pylist(), features(strings(piece.column("text"))), strict=True):
                counts[label, own] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(seen), 100_000):
        own = seen[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[1, own]), pa.array(counts[0, own])], names=["feature", "toxic", "clean"])


def _rows_with(chosen: np.ndarray):
    """Each document's features among the chosen ones, as their places."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for piece in slices(batch):
                own = [place[f] for f in features(strings(piece.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), pa.array([o[o >= 0].tobytes() for o in own], pa.binary())], names=["label", "places"]
                )

    return run


def _regress(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by averaged-gradient steps with momentum."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[at] / np.sqrt(1 + np.mean(np.bincount(owner, weights=scale[at] ** 2, minlength=len(rows))))
    size = np.sqrt(1 + np.mean(np.bincount(owner, weights=scale[at] ** 2, minlength=len(rows))))
    weight, intercept, move, move0 = np.ones(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    for _ in range(STEPS):
        odds = intercept + np.bincount(owner, weights=weight[at] * value, minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(odds, -60, 60))) - label
        slope = np.bincount(at, weights=value * off[owner], minlength=len(scale)) / len(rows) + DECAY * weight
        move, move0 = 0.9 * move - RATE * slope, 0.9 * move0 - RATE * off.mean()
        weight, intercept = weight + move, intercept + move0
    return weight / size, float(intercept)


def learn(labelled: DataFrame, docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from `labelled` (doc_id, label 0/1) and `docs` (doc_id, text). Null labels teach nothing; of several
    labels of a document the highest counts. Without both labels the score is the share of toxic labels."""
    spark = docs.sparkSession
    ws = prepared(spark)
    labels = labelled.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    labels = ws.save(labels, "labels").df
    held = {r.label: r.rows for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    toxic, clean = held.get(1, 0), held.get(0, 0)
    share = (toxic + 0.5) / (toxic + clean + 1)
    nothing = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    if not toxic or not clean:
        return nothing
    first = [labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most 2 * fit_rows rows
    sample = docs.join(chosen, "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    sample = ws.save(sample.groupBy("text").agg(F.max("label").alias("label")).repartition(_FIT_PARTS), "sample").df  # copies once
    sizes = {r.label: r.rows for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(sizes) < 2:
        return nothing

    counts = sample.mapInArrow(_count, "feature long, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.withColumn("r", F.log((F.col("toxic") + 1) / F.lit(sizes[1] + 2.0)) - F.log((F.col("clean") + 1) / F.lit(sizes[0] + 2.0)))
    everything = sizes[0] + sizes[1]
    seen = F.col("toxic") + F.col("clean")
    cells = [(F.col("toxic"), seen * sizes[1]), (F.col("clean"), seen * sizes[0])]
    cells += [(sizes[1] - F.col("toxic"), (everything - seen) * sizes[1]), (sizes[0] - F.col("clean"), (everything - seen) * sizes[0])]
    statistic = F.lit(0.0)
    for found, expected in cells:
        statistic = statistic + F.when(found > 0, 2 * found * F.log(found * everything / expected)).otherwise(0.0)
    counts = counts.where(statistic >= LEAST_STATISTIC).orderBy("feature").toPandas()  # at most one row a hash
    feature, scale = counts["feature"].to_numpy(np.int64), counts["r"].to_numpy(float)
    rows = sample.mapInArrow(_rows_with(feature), "label int, places binary").collect()  # at most 2 * fit_rows rows
    weight, intercept = _regress([np.frombuffer(r.places, np.int32) for r in rows], np.array([r.label for r in rows], float), scale)
    worth = np.zeros(1 << BITS, np.float32)
    worth[feature] = weight * scale
    return Model(worth, intercept + float(np.log(share / (1 - share)) - np.log(sizes[1] / sizes[0])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text; null counts as empty, which has the intercept's score."""
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = shared.value, Features()
        for batch in batches:
            for piece in slices(batch):
                scores = np.array([own.score(f) for f in features(strings(piece.column("text")))])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return texts_of(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels of documents that are not held out.

    Held out: crc32 of the id as text, modulo 4, is 2; a null id is not. Repeated rows are scored one by one. Empty
    tables are fine. Only the text takes part in a score.
    """
    rows = texts_of(docs, id_col, text_col).select("doc_id", "text")
    labelled = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where(~is_held_out())
    scored = score(rows, learn(labelled, rows, fit_rows), threshold=THRESHOLD)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
