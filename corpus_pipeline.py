"""The corpus pipeline: five stages, each an operator of martloom.llm, each over all that the one before kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.bpe import bpe_decode, bpe_encode
from martloom.llm.common import join_small, prepared
from martloom.llm.content_sort import exact_dedup
from martloom.llm.jaccard_join import jaccard_join
from martloom.llm.language import UNKNOWN, identify
from martloom.llm.mixing import mix
from martloom.llm.queries import tokenizer_path
from martloom.operators.numbering import row_numbers
from martloom.workspace import Workspace, remove

#: A document goes if it has no letter, or if the odds that it is of the nearest language, and not bytes without order, are
#: less than one to a million: noise of a line or more, while texts of a word or two, and texts with a key in them, stay.
LEAST_SCORE = 1e-6

#: Bits of a row's number that hold its place in its file; those above hold the number of the file.
_PLACE_BITS = 40


@dataclass(frozen=True)
class Rows:
    """Documents with a number of their own each, in the column `row`: ids may be null or repeat."""

    ws: Workspace
    df: DataFrame
    row: str
    columns: list[str]

    def only(self, kept: DataFrame) -> DataFrame:
        """The documents whose number is in `kept` (row), as often as it is there, with the columns that they came with."""
        kept = self.ws.save(kept.select(F.col("row").alias(self.row)), "kept")
        return join_small(self.df, kept.df, kept.rows, self.row).select(*self.columns)


def numbered(ws: Workspace, docs: DataFrame) -> Rows:
    """Files say where a row lies, which numbers it without a copy of its text; other rows are written with a number."""
    row = "_row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row += "_"
    file, place = f"{row}_file", f"{row}_place"
    try:
        where = docs.metadataColumn("_metadata")
        located = docs.select("*", where["file_path"].alias(file), where["row_index"].alias(place))
    except AnalysisException:  # these rows are not read from Parquet files
        copy = ws.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        return Rows(ws, copy.df, row, docs.columns)
    files = ws.save(located.select(file).distinct(), "files")
    files = ws.save(row_numbers(ws, files, [file], row), "file-numbers")
    number = F.shiftleft(F.col(row), _PLACE_BITS).bitwiseOR(F.col(place))
    return Rows(ws, join_small(located, files.df, files.rows, file).withColumn(row, number).select(*docs.columns, row), row, docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, so null, empty and blank texts too, and those of no language. Repeated rows and
    rows without an id are judged one by one; an empty table stays empty, and one without labels loses all rows."""
    rows = numbered(prepared(spark), docs)
    found = identify(rows.df, row_col=rows.row)
    return rows.only(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest id stays, a null id only if there is no other; of repeated rows one stays. Null
    counts as empty, so one of all empty texts stays; an empty table stays empty."""
    rows = numbered(prepared(spark), docs)
    return rows.only(exact_dedup(rows.df, keep="largest", row_col=rows.row).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the smallest id stays, a null id only if there is no other, and one row of repeated ones.
    Documents without words are no component and stay; an empty table stays empty."""
    rows = numbered(prepared(spark), docs)
    found = jaccard_join(rows.df, row_col=rows.row).documents
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"]
    one = found.where("root IS NOT NULL").groupBy("root").agg(first.alias("row"))
    return rows.only(one.select("row").union(found.where("root IS NULL").select("row")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times. A null source is a source of its own; documents
    without words add nothing to a mix and stay out; an empty table stays empty."""
    rows = numbered(prepared(spark), docs)
    taken = mix(rows.df, F.array(rows.df["source"]), row_col=rows.row).documents.where("copies > 0")
    return rows.only(taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the text that they decode to, row by row. Null counts as
    empty and has no ids; an empty table gives an empty result."""
    path = tokenizer_path()
    return bpe_decode(bpe_encode(docs, path), path).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: Language models, seeded selection and BPE are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returned is removed when the next one's is written."""
    ws = prepared(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        done = ws.save(stage(spark, docs, sf_dir), "stage")
        if before:
            remove(spark, before.path)
        docs, before = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
