"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from conftest import sale
from martloom import workspace
from martloom.operators.numbering import ranks, row_numbers
from martloom.operators.survivors import first_by
from martloom.plans import marts, reports, star
from martloom.schemas import ROW_ORDER


def plan(df) -> str:
    """Without what was read: names of folders are no operators."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    from martloom.plans.warehouse import Warehouse
    from martloom.schemas import LANDED
    from martloom.workspace import Workspace

    data = [sale(_src_file="A", _src_id=n, sale_product_id=str(n % 5)) for n in range(1, 40)]
    df = spark.createDataFrame([tuple(r.get(c) for c in LANDED.names) for r in data], LANDED)
    return Warehouse.land(df, Workspace(spark, str(tmp_path_factory.mktemp("plans"))))


@pytest.mark.parametrize("per_range", [1_000, 10**6])
def test_rows_are_never_moved_into_one_partition(spark, ws, per_range):
    df = ws.save(spark.range(5_000).select("id", (F.col("id") % 7).alias("v")), "d")
    # The rows come from the written ranges; only the one-row-per-range table is gathered.
    text = plan(row_numbers(ws, df, ["v", "id"], "n", per_range))
    rows_side = text.split("BroadcastExchange")[0]
    assert "SinglePartition" not in rows_side and "Window" not in rows_side
    assert "BroadcastHashJoin" in text


def test_ranks_move_values_not_rows(spark, ws):
    df = ws.save(spark.range(5_000).select("id", (F.col("id") % 7).alias("v")), "d")
    text = plan(ranks(ws, df, "v", "r", 1_000))
    assert "rangepartitioning" not in text and text.count("Window") == text.count("Window [sum(_rows")
    # what is put in order was written before: one row for each value
    assert "FileScan parquet [_value" in text


def test_survivors_are_reduced_before_the_shuffle_and_not_sorted(wh):
    found = first_by(wh.workspace, star.customer_rows(wh.staging), ["customer_id"], wh.sources())
    assert wh.sources().dense
    text = plan(found.rows)
    assert "Sort" not in text and "hashpartitioning" not in text


def test_the_dimension_of_customers_sorts_nothing(wh, monkeypatch):
    plans = []
    save = wh.workspace.save
    monkeypatch.setattr(wh.workspace, "save", lambda df, name: (plans.append(plan(df)), save(df, name))[1])
    wh._survivors.clear()
    wh.survivors("dim_customer")
    star.dim_customer(wh)
    (first,) = (p for p in plans if "partial_min" in p)
    assert "HashAggregate" in first and "Sort" not in first and first.count("Exchange hashpartitioning") == 1
    assert first.index("partial_min") > first.index("Exchange hashpartitioning")
    assert "Sort" not in plan(star.dim_customer(wh).df)


def test_the_fact_is_not_grouped_by_its_key(wh, monkeypatch):
    from martloom import quality

    def refuse(*_, **__):
        raise AssertionError("a proven key was grouped")

    monkeypatch.setattr(quality, "assert_unique", refuse)
    wh._written.pop("fact_sales", None)
    assert wh.saved("fact_sales").rows == 39


def test_a_join_that_doubles_a_proven_row_is_noticed(wh, monkeypatch):
    from martloom.quality import ContractError

    wh.table("dim_store")
    stores = wh.table("dim_store")
    monkeypatch.setattr(wh, "table", lambda name: stores.union(stores) if name == "dim_store" else wh.saved(name).df)
    wh._written.pop("fact_sales", None)
    with pytest.raises(ContractError, match="78 rows were written, but there are 39 sales"):
        wh.saved("fact_sales")


def test_builders_read_only_their_columns(wh):
    text = plan(star.seller_rows(wh.staging))
    columns = text.split("FileScan parquet [")[1].split("]")[0]
    assert {c.split("#")[0] for c in columns.split(",")} == {
        *ROW_ORDER, "sale_seller_id", "seller_first_name", "seller_last_name", "seller_email",
        "seller_country", "seller_postal_code",
    }


def test_sales_do_not_move_when_their_files_are_complete(wh):
    text = plan(star.fact_sales(wh).df)
    assert "Exchange hashpartitioning" not in text and "rangepartitioning" not in text
    assert text.count("gettimestamp") == 0
    assert text.count("BroadcastHashJoin") >= 2


def test_the_time_mart_scans_its_sales_once(wh):
    text = plan(marts.PLANS["mart_sales_by_time"].rows(wh))
    assert text.count("sales-by-date_id") == 1 and "Expand" in text


@pytest.mark.parametrize("name", list(marts.PLANS))
def test_marts_read_totals_not_sales(wh, name):
    text = plan(marts.PLANS[name].rows(wh))
    assert "fact_sales" not in text
    assert "SinglePartition" not in text and "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_totals_are_summed_before_the_shuffle_and_read_three_columns(wh):
    text = plan(marts.sales_by(wh.table("fact_sales"), "product_id"))
    assert "partial_sum" in text and "HashAggregate" in text and "SortAggregate" not in text
    assert "ReadSchema: struct<product_id:int,quantity:int,total_price:double>" in text
    assert "PushedFilters: [IsNotNull(product_id)]" in text


@pytest.mark.parametrize(
    "report", ["top10_products", "top10_customers", "top5_stores", "top5_suppliers", "most_reviewed_products"]
)
def test_top_lists_are_not_sorted_as_a_whole(wh, report):
    text = plan(reports.REPORTS[report](wh))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_counted_rows_decide_what_is_sent_to_the_driver(wh, ws, spark, monkeypatch):
    """Small files may hold many rows: they are looked up by a shuffle, not gathered for a broadcast."""
    numbers = ws.save(spark.range(5_000).select("id", (F.col("id") % 7).alias("v")), "d")
    for name in ("dim_product", "dim_product_category"):
        wh.table(name)
    wh.sales_by("product_id")
    few = plan(marts.sold_products(wh)), plan(reports.revenue_by_category(wh)), plan(ranks(ws, numbers, "v", "r"))
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 4)
    many = plan(marts.sold_products(wh)), plan(reports.revenue_by_category(wh)), plan(ranks(ws, numbers, "v", "r"))
    for before, after in zip(few, many, strict=True):
        assert "ShuffledHashJoin" in after and "SortMergeJoin" not in after
        assert after.count("BroadcastExchange") == before.count("BroadcastExchange") - 1
