"""Which finished run is the one to read.

A run writes its tables to a folder of its own. The last thing that it writes is one small file that names all of
them, with their folders, row counts and columns. That file is the commit: readers resolve every name through the
newest one, so they see all tables of one run, and a run that was cut off is never seen. One job commits at a time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from martloom.schemas import Table
from martloom.sinks.sinks import ensure_namespace, publish
from martloom.workspace import Saved, remove

NAME = "MANIFEST.json"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@dataclass(frozen=True)
class Manifest:
    """A committed run: its number, its folder below `out`, and for each table folder, rows and schema."""

    spark: SparkSession
    out: str
    number: int
    run: str
    tables: Mapping[str, Mapping]

    def path(self, name: str) -> str:
        return f"{self.out}/{self.run}/{self.tables[name]['folder']}"

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.tables[name]["schema"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    def publish(self, namespace: str, location: str | None = None) -> None:
        """Points the names of a namespace to this run's tables; if one fails, those before it are pointed back.

        A catalog takes one name at a time. Who must not meet two runs in one query reads through `latest`.
        """
        spark = self.spark
        ensure_namespace(spark, namespace, location)
        before: dict[str, str | None] = {}
        try:
            for name in self.tables:
                full = f"{namespace}.{name}"
                before[name] = _location(spark, full) if spark.catalog.tableExists(full) else None
                publish(spark, namespace, name, self.path(name), Table(self.schema(name), ()))
        except Exception:
            for name, path in before.items():
                if path is not None:
                    spark.sql(f"ALTER TABLE {namespace}.{name} SET LOCATION '{path}'")
                elif spark.catalog.tableExists(f"{namespace}.{name}"):
                    spark.sql(f"DROP TABLE {namespace}.{name}")
            raise


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0].data_type


def manifests(spark: SparkSession, out: str) -> list[Manifest]:
    """All committed runs, the newest first. A file that is not whole counts as none."""
    out = out.rstrip("/")
    files, place = _place(spark, f"{out}/run-*/{NAME}")
    paths = [status.getPath().toString() for status in files.globStatus(place) or []]
    found = []
    for row in spark.read.text(paths, wholetext=True).collect() if paths else []:
        try:
            read = json.loads(row.value)
            found.append(Manifest(spark, out, read["number"], read["run"], read["tables"]))
        except (ValueError, KeyError):
            continue
    return sorted(found, key=lambda m: (m.number, m.run), reverse=True)


def latest(spark: SparkSession, out: str) -> Manifest | None:
    found = manifests(spark, out)
    return found[0] if found else None


def commit(spark: SparkSession, folder: str, tables: Mapping[str, Saved]) -> Manifest:
    """Makes a run the newest one. All tables must lie in its folder."""
    out, run = folder.rsplit("/", 1)
    newest = latest(spark, out)
    entries = {}
    for name, saved in tables.items():
        if not saved.path or not saved.path.startswith(f"{folder}/"):
            raise ValueError(f"{name} does not lie in {folder}: {saved.path}")
        entries[name] = {"folder": saved.path.removeprefix(f"{folder}/"), "rows": saved.rows, "schema": saved.df.schema.jsonValue()}
    number = newest.number + 1 if newest else 1
    text = json.dumps({"number": number, "run": run, "tables": entries})
    files, unfinished = _place(spark, f"{folder}/.{NAME}")
    _, final = _place(spark, f"{folder}/{NAME}")
    stream = files.create(unfinished, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.rename(unfinished, final):
        raise RuntimeError(f"{folder} has a manifest already")
    return Manifest(spark, out, number, run, entries)


def retire(spark: SparkSession, out: str, keep: int) -> list[str]:
    """Removes committed runs but the newest `keep`, and returns their names. Runs without a manifest may be
    at work and stay."""
    if keep < 1:
        raise ValueError("the newest run stays")
    old = manifests(spark, out)[keep:]
    for manifest in old:
        # the manifest goes first: half a run must not be found
        remove(spark, f"{manifest.out}/{manifest.run}/{NAME}")
        remove(spark, f"{manifest.out}/{manifest.run}")
    return [m.run for m in old]
