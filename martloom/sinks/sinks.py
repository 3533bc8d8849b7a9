"""Where finished tables go: files, a database behind JDBC, or a keyed store.

All sinks replace the content of a table. Each write is counted while it runs, so the
rows are computed once and nothing has to be cached.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from martloom.quality import assert_schema, assert_unique
from martloom.schemas import Table
from martloom.sources.jdbc import BATCH_SIZE, CONNECTIONS, Database, write_jdbc
from martloom.workspace import Workspace, exists, remove


class Sink(Protocol):
    def write(self, df: DataFrame, name: str, table: Table) -> None: ...


@dataclass(frozen=True)
class FileSink:
    """Parquet files, sorted inside each file, below `root`; tables may be split by columns."""

    root: str
    partition_by: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, table: Table) -> None:
        split = self.partition_by.get(name, ())
        if split or table.order_by:
            df = df.sortWithinPartitions(*split, *[c for c in table.order_by if c not in split])
        df.write.mode("overwrite").partitionBy(*split).parquet(self.path(name))

    def read(self, spark: SparkSession, name: str, table: Table) -> DataFrame:
        return spark.read.schema(table.schema).parquet(self.path(name)).select(*table.schema.names)


@dataclass(frozen=True)
class JdbcSink:
    """Tables of a database; they are emptied and filled, which keeps their indexes.

    A table is written by at most `connections` tasks, so set it to what the database takes.
    """

    db: Database
    prefix: str = ""
    connections: int = CONNECTIONS
    batch_size: int = BATCH_SIZE

    def write(self, df: DataFrame, name: str, table: Table) -> None:
        write_jdbc(df, self.db, self.prefix + name, batch_size=self.batch_size, connections=self.connections)


@dataclass(frozen=True)
class OlapSink:
    """Tables of a columnar database that stores each one in a sort order."""

    db: Database
    connections: int = CONNECTIONS
    batch_size: int = BATCH_SIZE

    def table_options(self, table: Table) -> str:
        # Fixed value: the clause the database expects, and its form for "no order".
        order = ", ".join(table.order_by)
        return f"ENGINE = MergeTree() ORDER BY {f'({order})' if order else 'tuple()'}"

    def write(self, df: DataFrame, name: str, table: Table) -> None:
        write_jdbc(
            df, self.db, name, batch_size=self.batch_size, connections=self.connections, create_table_options=self.table_options(table)
        )


@dataclass(frozen=True)
class KeyedSink:
    """Any Spark data source that keeps one row per key, such as a wide-column store.

    Rows with equal keys would silently overwrite each other there, so `write_counted` checks the keys first.
    `table_option` names the option that takes the table; its value may need a prefix.
    """

    format: str
    options: Mapping[str, str] = field(default_factory=dict)
    table_option: str = "table"
    prefix: str = ""

    def write_options(self, name: str) -> dict[str, str]:
        return {**self.options, self.table_option: self.prefix + name}

    def write(self, df: DataFrame, name: str, table: Table) -> None:
        df.write.format(self.format).mode("overwrite").options(**self.write_options(name)).save()


def wide_column_sink(keyspace: str) -> KeyedSink:
    # The connector's source name and its option that permits overwriting.
    return KeyedSink(
        "org.apache.spark.sql.cassandra",
        {"keyspace": keyspace, "confirm.truncate": "true"},
    )


@dataclass(frozen=True)
class UpsertSink:
    """Parquet tables by key below `root`: a write replaces the rows whose keys it brings and leaves the others.

    Rows lie in buckets by a hash of the key. Only buckets with a new or changed row are rewritten; each is
    replaced as a whole. The number of buckets belongs to the table: another one is refused.
    """

    root: str
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _bucket(self, table: Table) -> Column:
        return F.pmod(F.xxhash64(*table.keys), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, name: str, table: Table) -> DataFrame:
        return self._stored(spark, name, table).select(*table.schema.names)

    def _stored(self, spark: SparkSession, name: str, table: Table) -> DataFrame:
        schema = StructType([*table.schema.fields, StructField("_of", IntegerType()), StructField("_bucket", IntegerType())])
        return spark.read.schema(schema).parquet(self.path(name))

    def _put(self, rows: DataFrame, name: str) -> None:
        buckets = rows.repartition("_bucket").withColumn("_of", F.lit(self.buckets))
        buckets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_of", "_bucket").parquet(self.path(name))

    def write(self, df: DataFrame, name: str, table: Table) -> None:
        self.upsert(df, name, table)

    def upsert(self, df: DataFrame, name: str, table: Table) -> list[int]:
        """Writes the rows and returns the buckets that were rewritten."""
        spark, ws = df.sparkSession, Workspace(df.sparkSession, f"{self.root}/_incoming-{uuid.uuid4().hex}")
        with ws.scratch():
            new = ws.save(df.withColumn("_bucket", self._bucket(table)), name).df
            if not exists(spark, self.path(name)):
                self._put(new, name)
                found = [r[0] for r in new.select("_bucket").distinct().collect()]  # no more than there are buckets
            else:
                stored = self._stored(spark, name, table)
                of = {r[0] for r in stored.select("_of").distinct().collect()}
                if of - {self.buckets}:
                    raise ValueError(f"{self.path(name)} has {of} buckets, not {self.buckets}")
                same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in table.schema.names]
                key = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("_bucket", *table.keys)]
                changed = new.alias("n").join(stored.alias("o"), reduce(and_, [*key, *same]), "left_anti")
                found = [r[0] for r in changed.select("_bucket").distinct().collect()]
                touched = F.col("_bucket").isin(found)
                older = stored.where(touched).drop("_of").alias("o").join(new.where(touched).alias("n"), reduce(and_, key), "left_anti")
                if found:
                    self._put(ws.save(new.where(touched).unionByName(older), f"{name}-merged").df, name)
        remove(spark, ws.root)
        return sorted(found)


def write_counted(df: DataFrame, name: str, table: Table, sink: Sink) -> int:
    """Checks the schema, and the keys if equal keys would overwrite each other; writes, and returns how many rows
    went through the write: the check of the keys runs on the rows before they are observed."""
    assert_schema(df, table)
    if isinstance(sink, UpsertSink):
        assert_unique(df, table.keys, complete=not table.rollup)
    if isinstance(sink, KeyedSink):
        if table.rollup:  # such stores take no NULL in a key; the level tells a blank from a real one
            df = df.fillna("", list(table.keys))
        assert_unique(df, table.keys)
    seen = Observation()
    sink.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, table)
    return seen.get["rows"]


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")


def publish(spark: SparkSession, namespace: str, name: str, path: str, table: Table) -> None:
    """Names written files as a table of a namespace; the files stay where they are.

    A table of that name is pointed to the new files, so its readers see the old rows or the new ones.
    """
    full = f"{namespace}.{name}"
    if spark.catalog.tableExists(full):
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
        spark.catalog.refreshTable(full)
    else:
        spark.catalog.createTable(full, path=path, source="parquet", schema=table.schema)
