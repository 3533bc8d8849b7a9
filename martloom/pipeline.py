"""One full refresh: staging, star, marts, reports, sinks, reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from martloom.manifest import Manifest, commit
from martloom.plans import reports
from martloom.plans.warehouse import Warehouse
from martloom.quality import ContractError, marts_reconciliation, reconciliation
from martloom.schemas import MARTS, REPORT_TABLES, STAR, Table
from martloom.sinks.sinks import FileSink, Sink, write_counted
from martloom.workspace import Workspace


@dataclass(frozen=True)
class Run:
    """`counts` holds, by table, the rows of the run's own copy and then of each sink."""

    folder: str
    warehouse: Warehouse
    counts: dict[str, list[int]]
    reports: dict[str, DataFrame]
    reconciliation: DataFrame
    manifest: Manifest


def _run_folder(out: str) -> str:
    return f"{out.rstrip('/')}/run-{uuid.uuid4().hex}"


def _fill(
    warehouse: Warehouse, tables: Mapping[str, Table], sinks: Sequence[Sink]
) -> dict[str, list[int]]:
    """Writes the tables side by side, each to one sink after the other, and compares the row counts."""

    def fill(name: str) -> list[int]:
        own = warehouse.saved(name)
        counts = [own.rows, *(write_counted(own.df, name, tables[name], sink) for sink in sinks)]
        if len(set(counts)) > 1:
            raise ContractError(f"{name} was written with differing row counts: {counts}")
        return counts

    with ThreadPoolExecutor(len(tables)) as pool:
        return dict(zip(tables, pool.map(fill, tables), strict=True))


def _fill_results(warehouse: Warehouse, folder: str, sinks: Sequence[Sink]) -> dict[str, list[int]]:
    """Builds marts and reports and fills the sinks with both; without sinks they become files of the run."""
    warehouse.build_marts()
    warehouse.build_reports()
    mart_files = [FileSink(f"{folder}/marts", {"mart_sales_by_time": ("year",)})]
    counts = _fill(warehouse, MARTS, sinks or mart_files)
    return counts | _fill(warehouse, REPORT_TABLES, sinks or [FileSink(f"{folder}/reports")])


def _reports(warehouse: Warehouse) -> dict[str, DataFrame]:
    return {name: warehouse.table(name) for name in reports.REPORTS}


def _commit(spark: SparkSession, folder: str, warehouse: Warehouse, counts: dict[str, list[int]], report: DataFrame) -> Run:
    """Ends a run: what only the run needed goes, and the rest is named in the manifest, which is written last."""
    saved = warehouse.workspace.save(report, "reconciliation")
    warehouse.finish()
    manifest = commit(spark, folder, {**warehouse.results(), "reconciliation": saved})
    return Run(folder, warehouse, counts, _reports(warehouse), saved.df, manifest)


def run(
    spark: SparkSession,
    staging: DataFrame,
    out: str,
    sinks: Sequence[Sink] = (),
    star_sinks: Sequence[Sink] = (),
    landed: bool = False,
) -> Run:
    """Builds everything in a folder of its own below `out`, then fills the sinks.

    A run never touches the tables of another run: it is read from when its manifest is
    there. After it only the star, marts, reports, the reconciliation and the manifest remain. Marts and reports go to the `sinks`; without any they go to files,
    the time mart split by year.
    Staging rows that are `landed` already, as a Parquet table, are read where they lie.
    """
    folder = _run_folder(out)
    over = Warehouse.over_landed if landed else Warehouse.land
    warehouse = over(staging, Workspace(spark, f"{folder}/tables"))
    warehouse.build_star()
    counts = _fill(warehouse, STAR, star_sinks) | _fill_results(warehouse, folder, sinks)
    return _commit(spark, folder, warehouse, counts, reconciliation(warehouse))


def run_marts(
    spark: SparkSession,
    star_tables: Mapping[str, DataFrame],
    out: str,
    sinks: Sequence[Sink] = (),
) -> Run:
    """The marts and reports alone, over a star that was built before."""
    folder = _run_folder(out)
    warehouse = Warehouse.over_star(star_tables, Workspace(spark, f"{folder}/tables"))
    counts = {name: [warehouse.saved(name).rows] for name in star_tables}
    counts |= _fill_results(warehouse, folder, sinks)
    return _commit(spark, folder, warehouse, counts, marts_reconciliation(warehouse))
