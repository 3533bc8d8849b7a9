"""Language ID (4): prediction by partial matching, frozen after training.

For each language a context tree over bytes gives the cost in bits of a byte after the up to ORDER bytes before
it: if the tree has seen the byte there, -log2 of its share; else the cost of escaping to the context that is a
byte shorter, and the cost there. A context with T bytes of D kinds gives a byte seen c times c / (T + D) and the
escape D / (T + D); the empty context escapes to 256 equal bytes. The language with the shortest code wins; the
score is its share when code lengths are read as likelihoods, among the languages and no language: the shorter code of
equal bytes and of bytes drawn one by one, with the average frequencies of all languages. So random letters, keys and
writing that no tree has seen score about 0, though some language is the nearest.

The statistics are frozen, so a byte's cost depends on the ORDER + 1 bytes that end in it alone. A task codes each
distinct run of ORDER + 1 bytes of a step once, for all languages, and adds up.

Trees are grown from a bounded sample: about FIT_DOCS documents of each language, chosen by a hash of id and text, so
rows without an id teach like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import LOWER, UPPER, is_held_out, prepared, slices, strings, texts_of

ORDER = 3
#: Labelled documents of each language that the trees are grown from, about; a bound on the training sample.
FIT_DOCS = 1_500
UNKNOWN = "und"

# ASCII letters in lower case, every other ASCII byte as a space; bytes of other characters stay.
_BYTES = bytes(
    b if b > 127 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER else 32 for b in range(256)
)
_SCALE = float(1 << 63)


def letters(text: str) -> bytes:
    """What is coded of a text: lower case, anything in ASCII that is no letter as a space."""
    return text.lower().encode().translate(_BYTES)


def _grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each text with the n - 1 bytes before it, as one number; spaces stand before a text."""
    pad = b" " * (n - 1)
    raw = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(max(0, len(raw) - n + 1), np.uint32)
    for k in range(n):
        code = (code << np.uint32(8)) | raw[k : k + len(code)]
    starts = np.cumsum(size + n - 1) - (size + n - 1)
    at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
    return code[at] if len(at) else np.zeros(0, np.uint32), size


@dataclass
class _Level:
    """Runs of one length that some language has seen: their cost, and the cost of escaping after them."""

    keys: np.ndarray
    cost: np.ndarray
    escape: np.ndarray


class ContextTrees:
    def __init__(self, languages: list[str], counts: list[dict[int, np.ndarray]], order: int = ORDER):
        """counts[n - 1]: of each run of n bytes, how often each language has it."""
        self.languages, self.order = languages, order
        self.width = width = len(languages) + 1  # the last column is no language: counts of bytes without context
        keys = [np.array(sorted(c), np.uint32) for c in counts]
        table = [np.array([c[k] for k in sorted(c)], float).reshape(len(c), len(languages)) for c in counts]
        average = [t.sum(axis=1) / max(1, len(languages)) if n == 0 else np.zeros(len(t)) for n, t in enumerate(table)]
        table = [np.column_stack([t, a]) for t, a in zip(table, average, strict=True)]
        self.levels: list[_Level] = []
        escapes = []
        for n in range(order + 1):  # of contexts of n bytes
            context = keys[n] >> np.uint32(8)
            names = np.unique(context)
            row = np.searchsorted(names, context)
            total, kinds = np.zeros((len(names), width)), np.zeros((len(names), width))
            np.add.at(total, row, table[n])
            np.add.at(kinds, row, table[n] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(table[n] / (total + kinds)[row])
            escapes.append((names, escape))
            shorter = escape[row] + (self.cost(keys[n] & np.uint32((1 << 8 * n) - 1), n) if n else 8.0)
            self.levels.append(_Level(keys[n], np.where(table[n] > 0, own, shorter), escape))
            self.escapes = escapes

    def _escape(self, context: np.ndarray, n: int) -> np.ndarray:
        names, escape = self.escapes[n]
        if not len(names):
            return np.zeros((len(context), self.width))
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        return np.where((names[at] == context)[:, None], escape[at], 0.0)

    def cost(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of each run of n bytes, in each language."""
        if n == 0:
            return np.full((len(codes), self.width), 8.0)
        level = self.levels[n - 1]
        out = np.zeros((len(codes), self.width))
        at = np.minimum(np.searchsorted(level.keys, codes), max(0, len(level.keys) - 1))
        seen = level.keys[at] == codes if len(level.keys) else np.zeros(len(codes), bool)
        out[seen] = level.cost[at[seen]]
        new = codes[~seen]
        if len(new):
            shorter = self.cost(new & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
            out[~seen] = self._escape(new >> np.uint32(8), n - 1) + shorter
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language, and of its bytes without context."""
        codes, size = _grams(texts, self.order + 1)
        row, distinct = pd.factorize(codes)
        cost = self.cost(distinct.astype(np.uint32), self.order + 1)
        ends = np.cumsum(size)
        out = np.zeros((len(texts), self.width))
        for k in range(self.width):
            total = np.concatenate([[0.0], np.cumsum(cost[:, k][row])])
            out[:, k] = total[ends] - total[ends - size]
        return out


def _pieces(texts: list[bytes], limit: int, overlap: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """(text, its bytes, bytes that only give context) in lists of bounded size; long texts come in parts."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text)), limit):
            before = min(start, overlap)
            held.append((number, text[start - before : start + limit], before))
            size += len(held[-1][1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                table = pd.DataFrame({"lang": piece.column("lang").to_pylist(), "text": [letters(t) for t in strings(piece.column("text"))]})
                for lang, own in table.groupby("lang").text:
                    for n in range(1, order + 2):
                        codes, times = np.unique(_grams(list(own), n)[0], return_counts=True)
                        yield pa.RecordBatch.from_pydict(
                            {"lang": pa.array([lang] * len(codes), pa.string()), "n": pa.array(np.full(len(codes), n, np.int32)), "code": pa.array(codes.astype(np.int64)), "times": pa.array(times.astype(np.int64))}
                        )

    return run


def learn(labelled: DataFrame, fit_docs: int = FIT_DOCS, order: int = ORDER) -> ContextTrees:
    """Trees from (doc_id, text, lang). Rows without text or language teach nothing."""
    spark = labelled.sparkSession
    ws = prepared(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    held = {r.lang: r.rows for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    languages = sorted(held)
    if not languages:
        return ContextTrees([], [{} for _ in range(order + 1)], order)
    least = [(lang, min((1 << 63) - 1, int(_SCALE * (2 * fit_docs / held[lang] - 1)))) for lang in languages]
    chosen = rows.join(F.broadcast(spark.createDataFrame(least, "lang string, bound long")), "lang")  # one row a language
    chosen = chosen.where(F.xxhash64("doc_id", "text") <= F.col("bound")).select("lang", "text")
    counts = chosen.mapInArrow(_count(order), "lang string, n int, code long, times long")
    counts = ws.save(counts.groupBy("lang", "n", "code").agg(F.sum("times").alias("times")), "counts").df.toPandas()
    number = {lang: k for k, lang in enumerate(languages)}
    found: list[dict[int, np.ndarray]] = [{} for _ in range(order + 1)]
    for lang, n, code, times in zip(counts.lang, counts.n, counts.code, counts.times, strict=True):
        found[n - 1].setdefault(code, np.zeros(len(languages)))[number[lang]] = times
    return ContextTrees(languages, found, order)


def predict(
    docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, step: int = 1 << 20
) -> DataFrame:
    """doc_id, row, lang_pred, score, bits (per byte). `und` and 0 if a text is null or has no letter, or nothing was learned."""
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in slices(batch):
                has = pc.fill_null(pc.match_substring_regex(piece.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                has &= bool(model.languages)
                texts = [letters(t) if h else b"" for t, h in zip(strings(piece.column("text")), has, strict=True)]
                total = np.zeros((len(texts), model.width))
                for part in _pieces(texts, step, model.order) if has.any() else ():
                    bits = model.code_lengths([t for _, t, _ in part])
                    late = [k for k, (_, _, before) in enumerate(part) if before]
                    if late:  # what only gives context was counted with the part before
                        bits[late] -= model.code_lengths([part[k][1][: part[k][2]] for k in late])
                    np.add.at(total, [number for number, _, _ in part], bits)
                size = np.maximum(1, [len(t) for t in texts])
                total[:, -1] = np.minimum(total[:, -1], 8.0 * size)
                best = total[:, : max(1, len(model.languages))].argmin(axis=1)
                least = total[np.arange(len(texts)), best]
                score = 1 / np.exp2(np.clip(least[:, None] - total, -1000, 1000)).sum(axis=1)
                names = [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row"), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, least / size, 0.0))],
                    names=["doc_id", "row", "lang_pred", "score", "bits"],
                )

    return texts_of(docs, id_col, text_col, row_col).mapInArrow(run, "doc_id long, row long, lang_pred string, score double, bits double")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", row_col: str | None = None, fit_docs: int = FIT_DOCS
) -> DataFrame:
    """doc_id, row, held_out, lang_pred, score, bits of every document; learns from those that are not held out.

    Held out: crc32 of the id as text, modulo 4, is 2; a null id is not. Repeated rows are
    scored, and may teach, one by one; equal code lengths go to the first language in code point order. An empty
    table gives an empty result. Language, source and id take no part in a prediction.
    """
    rows = texts_of(docs, id_col, text_col, row_col)
    labelled = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    scored = predict(rows, learn(labelled.where(~is_held_out()), fit_docs), row_col="row")
    return scored.select("doc_id", "row", is_held_out().alias("held_out"), "lang_pred", "score", "bits")
