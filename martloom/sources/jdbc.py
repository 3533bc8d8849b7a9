"""Tables behind JDBC, read and written by several connections at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


# Defaults of a write: rows per batch, and connections per table.
BATCH_SIZE = 10_000
CONNECTIONS = 8


@dataclass(frozen=True)
class Database:
    """Where a database is: its URL and the connection properties (user, driver, ...)."""

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Split:
    """How to cut a table scan: a numeric or date column, its bounds, how many parts."""

    column: str
    lower: object
    upper: object
    parts: int


def scan_options(db: Database, table: str, split: Split | None, fetch_size: int) -> dict[str, str]:
    options = {
        **db.properties,
        "url": db.url,
        "dbtable": table,
        "fetchsize": str(fetch_size),
    }
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.parts),
        }
    return options


def bounds_query(table: str, column: str) -> str:
    return f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"


def split_by(spark: SparkSession, db: Database, table: str, column: str, parts: int) -> Split | None:
    """A split over the values that `column` has now; none for an empty table.

    Rows outside the bounds are not lost: they fall into the first or the last part.
    """
    options = {**db.properties, "url": db.url, "query": bounds_query(table, column)}
    low, high = spark.read.format("jdbc").options(**options).load().first()
    return None if low is None else Split(column, low, high, parts)


def read_jdbc(
    spark: SparkSession,
    db: Database,
    table: str,
    split: Split | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table scan; without a `split` it is one connection, so give one for a large table."""
    return spark.read.format("jdbc").options(**scan_options(db, table, split, fetch_size)).load()


def write_options(
    db: Database,
    table: str,
    batch_size: int,
    connections: int,
    create_table_options: str | None,
) -> dict[str, str]:
    options = {
        **db.properties,
        "url": db.url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "numPartitions": str(connections),
        # Empties the table instead of dropping it, which keeps its keys and indexes.
        "truncate": "true",
    }
    if create_table_options:
        # Such a clause only takes effect when the table is created anew.
        options["truncate"] = "false"
        options["createTableOptions"] = create_table_options
    return options


def write_jdbc(
    df: DataFrame,
    db: Database,
    table: str,
    batch_size: int = BATCH_SIZE,
    connections: int = CONNECTIONS,
    create_table_options: str | None = None,
) -> None:
    options = write_options(db, table, batch_size, connections, create_table_options)
    df.write.format("jdbc").mode("overwrite").options(**options).save()
