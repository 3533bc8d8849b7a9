"""Checks before a write, and the report after a run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.operators.survivors import differing_keys
from martloom.plans import marts, star
from martloom.schemas import Table
from martloom.workspace import Proven, Saved

if TYPE_CHECKING:
    from martloom.plans.warehouse import Warehouse


class ContractError(ValueError):
    """A table does not have the columns, the types or the keys it is declared with."""


def assert_schema(df: DataFrame, table: Table) -> None:
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in table.schema]
    if found != wanted:
        raise ContractError(f"columns are {found}, declared are {wanted}")


def assert_unique(df: DataFrame, keys: Sequence[str], complete: bool = True) -> None:
    """Every row has its own key, and a complete one unless it may have NULLs."""
    missing = F.lit(False)
    for key in keys if complete else ():
        missing = missing | F.col(key).isNull()
    bad = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > 1) | missing)
        .limit(1)
        .collect()
    )
    if bad:
        raise ContractError(f"key {tuple(keys)} is not unique or not complete: {bad[0]}")


def assert_contract(saved: Saved, table: Table, name: str = "table", proven: Proven | None = None) -> None:
    """Checks a written table. Its rows are grouped by key only if the way it was made proves nothing of the key."""
    try:
        assert_schema(saved.df, table)
        if proven is None:
            assert_unique(saved.df, table.keys, complete=not table.rollup)
        elif saved.rows != proven.rows:
            raise ContractError(f"{saved.rows} rows were written, but there are {proven.rows} {proven.how}")
    except ContractError as error:
        raise ContractError(f"{name}: {error}") from error


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _counts(wh: Warehouse, names: Iterable[str]) -> DataFrame:
    return _union(
        wh.table(name).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        for name in names
    )


def reconciliation(wh: Warehouse) -> DataFrame:
    """Rows per written table, counted in the table, and conflicts per dimension.

    Conflicts were found with the survivors; staging is not read for them again.
    """
    conflicts = _union(
        differing_keys(wh.survivors(name).keys.df).withColumn("table_name", F.lit(name))
        for name in star.SURVIVOR_ROWS
    )
    return (
        _counts(wh, ("staging", *star.BUILDERS, *marts.PLANS))
        .join(conflicts, "table_name", "left")
        .select("table_name", "row_count", "keys_with_differing_digests")
    )


def marts_reconciliation(wh: Warehouse) -> DataFrame:
    """For marts over a star that was there: rows per table, and per dimension the sales whose key it lacks.

    The totals per key are compared with the dimensions, not the sales. A sale without a key belongs nowhere.
    """
    lost = []
    for key in marts.SALES_KEYS:
        name = f"dim_{key.removesuffix('_id')}"
        missing = wh.sales_by(key).join(wh.table(name), key, "left_anti")
        lost.append(missing.agg(F.coalesce(F.sum("sales"), F.lit(0)).alias("sales_without_row")).withColumn("table_name", F.lit(name)))
    given = [name for name in star.BUILDERS if wh.has(name)]
    return (
        _counts(wh, (*given, *marts.PLANS))
        .join(_union(lost), "table_name", "left")
        .select("table_name", "row_count", "sales_without_row")
    )
