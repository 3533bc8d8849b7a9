"""Staging from files: CSV exports, or a landed Parquet copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.quality import ContractError
from martloom.schemas import LANDED, SOURCE_FILE, SOURCE_ID, STAGING, STAGING_COLUMNS
from martloom.sources.records import broken_records
from martloom.workspace import Workspace

# No text of an export contains this character, so no quoted text is taken for NULL.
_NEVER = "\u0001"


# How exports are written. A row of another width stops the job even if few columns are read.
_OPTIONS = {
    "mode": "FAILFAST",
    "quote": '"',
    "escape": '"',
    "nullValue": _NEVER,
    "emptyValue": "",
    "columnPruning": "false",
}


def read_staging_csv(
    spark: SparkSession,
    path: str | list[str],
    strict_header: bool = False,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Reads exports with a header; columns bind by position, a bad row stops the job.

    An unquoted empty field is NULL, a quoted one is the empty text; quotes inside a
    quoted text are doubled, and it may hold line breaks. `strict_header` also stops on a
    header in another order. Files are split. If quotes show that records are broken over
    lines, the records are put together in `workspace` first; lines end in LF or CRLF then.

    The source file of a row is the folder level `_src_file=...` if the files lie in
    such folders, else the name of the file.
    """
    records = broken_records(workspace or Workspace(spark), path, STAGING_COLUMNS if strict_header else None)
    if records is not None:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STAGING)
        parsed = F.from_csv("record", columns, {**_OPTIONS, "multiLine": "true"})
        rows = records.select(_source_file("file").alias(SOURCE_FILE), parsed.alias("row")).select(SOURCE_FILE, "row.*")
    else:
        rows = spark.read.schema(STAGING).options(header=True, enforceSchema=not strict_header, **_OPTIONS).csv(path)
        rows = rows.withColumn(SOURCE_FILE, _source_file("_metadata.file_path"))
    return landed_columns(rows.withColumn(SOURCE_ID, F.col("id").cast("long")))


def _source_file(path: str) -> Column:
    """The name that a path stands for. It comes percent-encoded; only in a query string would + mean a blank."""
    folder = F.regexp_extract(path, f"/{SOURCE_FILE}=([^/]*)/", 1)
    name = F.when(folder != "", folder).otherwise(F.substring_index(path, "/", -1))
    plain = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    # A name in a folder level is escaped once more by the writer.
    return F.when(folder != "", F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))).otherwise(plain)


def landed_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LANDED.fields])


def read_staging_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Landed rows. A folder that lacks a column, or has it in another type, is refused: it would read as NULLs."""
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    # The type of a folder level is guessed from the values it has.
    bad = [f.name for f in LANDED if f.name not in found or f.name != SOURCE_FILE and found[f.name] != f.dataType]
    if bad:
        raise ContractError(f"{path} is no landed staging: missing or of another type are {bad}")
    return spark.read.schema(LANDED).parquet(path)
