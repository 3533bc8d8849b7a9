"""The tables of one run, each built once, on first use, and read back as written."""

from __future__ import annotations

import threading
from collections.abc import Callable, Collection, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from martloom.operators.numbering import ROWS_PER_RANGE, Sources, read_sources
from martloom.plans import marts, reports, star
from martloom.operators.survivors import Survivors, first_by
from martloom.quality import assert_contract
from martloom.schemas import LANDED, MARTS, REPORT_TABLES, STAR, Table
from martloom.sources.driver_tables import staging_from_tables
from martloom.workspace import Proven, Saved, Workspace, remove


class Warehouse:
    """Star tables, sales totals and marts over one set of staging rows.

    `staging` must be cheap to scan by column, as a landed Parquet table is: every
    builder reads it for itself, and reads only its own columns.
    """

    def __init__(self, staging: DataFrame | None, workspace: Workspace, rows_per_range: int = ROWS_PER_RANGE):
        self.staging = staging
        self.workspace = workspace
        self.rows_per_range = rows_per_range
        self._written: dict[str, Saved] = {}
        self._borrowed: set[str] = set()
        self._sources: Sources | None = None
        self._survivors: dict[str, Survivors] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    @classmethod
    def land(
        cls, staging: DataFrame, workspace: Workspace, rows_per_range: int = ROWS_PER_RANGE
    ) -> Warehouse:
        """Writes the staging rows as Parquet, and counts them, before anything reads them."""
        landed = workspace.save(staging.select(*LANDED.names), "staging")
        warehouse = cls(landed.df, workspace, rows_per_range)
        warehouse._written["staging"] = landed
        return warehouse

    @classmethod
    def over_landed(
        cls, staging: DataFrame, workspace: Workspace, rows_per_range: int = ROWS_PER_RANGE
    ) -> Warehouse:
        """Over staging rows that are a Parquet table already, which is not copied."""
        warehouse = cls(staging, workspace, rows_per_range)
        warehouse._written["staging"] = Saved(staging, staging.count())
        warehouse._borrowed.add("staging")
        return warehouse

    @classmethod
    def over_star(
        cls, tables: Mapping[str, DataFrame], workspace: Workspace, rows_per_range: int = ROWS_PER_RANGE
    ) -> Warehouse:
        """Marts and reports over star tables that exist already, for example in a database.

        Each table is scanned once and written, so that the joins know its size. Tables
        that the marts do not need may be left out.
        """
        warehouse = cls(None, workspace, rows_per_range)
        for name, df in tables.items():
            accepted = workspace.save(star.conform(df, STAR[name]), name)
            assert_contract(accepted, STAR[name], name)
            warehouse._written[name] = accepted
        return warehouse

    def _lock(self, name: str) -> threading.Lock:
        with self._guard:
            return self._locks.setdefault(name, threading.Lock())

    def _once(self, name: str, build: Callable[[], DataFrame | Proven], table: Table | None = None) -> Saved:
        """Writes a table on first use; columns, types and keys of a declared one are checked as written.

        What was written on the way to it goes again. A key that is proven is not looked at again.
        """
        with self._lock(name):
            if name not in self._written:
                with self.workspace.scratch():
                    made = build()
                    proven = made if isinstance(made, Proven) else None
                    saved = self.workspace.keep(self.workspace.save(proven.df if proven else made, name))
                if table:
                    assert_contract(saved, table, name, proven)
                self._written[name] = saved
            return self._written[name]

    def sources(self) -> Sources:
        """The files that staging rows came from."""
        with self._lock("sources"):
            if self._sources is None:
                with self.workspace.scratch():
                    self._sources = read_sources(self.workspace, self.staging, self.rows_per_range)
                    self._written["source-files"] = self.workspace.keep(self._sources.files)
            return self._sources

    def survivors(self, name: str) -> Survivors:
        """One row per key of a dimension, and which keys had differing rows."""
        with self._lock(f"survivors-{name}"):
            if name not in self._survivors:
                sources = self.sources()
                rows, keys = star.SURVIVOR_ROWS[name]
                with self.workspace.scratch():
                    found = first_by(self.workspace, rows(self.staging), keys, sources)
                    self._written[f"first-{name}"] = self.workspace.keep(found.keys)
                self._survivors[name] = found
            return self._survivors[name]

    def results(self) -> dict[str, Saved]:
        """Star tables, marts and reports as far as they were written by this run."""
        kept = (*star.BUILDERS, *marts.PLANS, *reports.REPORTS)
        return {name: self._written[name] for name in kept if name in self._written}

    def finish(self) -> None:
        """Removes what only the run itself needed: the landed copy, the totals, the places of first rows."""
        kept = {*star.BUILDERS, *marts.PLANS, *reports.REPORTS, *self._borrowed}
        for name in [n for n in self._written if n not in kept]:
            remove(self.workspace.spark, self._written.pop(name).path)
        self._survivors.clear()
        self._sources = None

    def saved(self, name: str) -> Saved:
        """A star table, mart or report by name, with its row count."""
        if name in star.BUILDERS:
            return self._once(name, lambda: star.BUILDERS[name](self), STAR[name])
        if name in marts.PLANS:
            return self._once(name, lambda: marts.build_mart(self, name), MARTS[name])
        if name in reports.REPORTS:
            return self._once(name, lambda: reports.REPORTS[name](self), REPORT_TABLES[name])
        return self._written[name]

    def has(self, name: str) -> bool:
        """Whether a table was written already."""
        return name in self._written

    def table(self, name: str) -> DataFrame:
        return self.saved(name).df

    def lookup(self, name: str) -> DataFrame:
        """A table as the side of a join in which rows are looked up."""
        return self.saved(name).for_join()

    def sale_days(self) -> DataFrame:
        return self._once("sale-days", lambda: star.sale_days(self)).df

    def sale_day_ids(self) -> DataFrame:
        return self._once("sale-day-ids", lambda: star.sale_day_ids(self)).df

    def sales_by(self, key: str) -> DataFrame:
        return self._once(
            f"sales-by-{key}", lambda: marts.sales_by(self.table("fact_sales"), key)
        ).df

    def build(self, names: Collection[str]) -> None:
        """Builds tables side by side; one that needs another waits for it."""
        with ThreadPoolExecutor(len(names)) as pool:
            for done in [pool.submit(self.saved, name) for name in names]:
                done.result()

    def build_star(self) -> None:
        self.build(star.BUILDERS)

    def build_marts(self) -> None:
        self.build(marts.PLANS)

    def build_reports(self) -> None:
        self.build(reports.REPORTS)

    def register_views(self) -> None:
        """Names the star tables for SQL."""
        for name in star.BUILDERS:
            if self.staging is not None or self.has(name):
                self.table(name).createOrReplaceTempView(name)


def warehouse_from_tables(
    spark: SparkSession, sf_dir: str, rows_per_range: int = ROWS_PER_RANGE
) -> Warehouse:
    workspace = Workspace(spark)
    return Warehouse.land(staging_from_tables(workspace, spark, sf_dir), workspace, rows_per_range)
