"""Every registered query against SQL on the smallest tables, and the expected row counts."""

import duckdb
import pytest

import __spark_entry__ as registered
import check_oracle

SF = "/root/testdata/sf0.001"
ORACLE = registered.oracle_sql()
# The text operators have tests of their own: not all of them can be said in SQL.
NAMES = [name for name in registered.queries() if name not in registered._text_operators()[0]]

# Rows that staging made from the smallest tables must lead to.
COUNTS = {
    "fact_sales": 5_932,
    "dim_customer": 150,
    "dim_seller": 100,
    "dim_product": 200,
    "dim_product_category": 6,
    "dim_supplier": 10,
    "dim_store": 93,
    "dim_date": 1_084,
    "dim_pet_type": 12,
    "mart_sales_by_product": 200,
    "mart_product_quality": 200,
    "mart_sales_by_customer": 150,
    "mart_customers_by_country": 26,
    "mart_sales_by_time": 87,
    "mart_sales_by_store": 93,
    "mart_sales_by_supplier": 10,
    "mart_suppliers_by_country": 6,
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    result = registered.queries()[name](spark, SF)
    assert check_oracle.compare(result, db, ORACLE[name]) == ""


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(ORACLE) <= set(registered.queries())


@pytest.mark.parametrize("name", list(COUNTS))
def test_row_counts(spark, name):
    assert registered.queries()[name](spark, SF).count() == COUNTS[name]


def test_missing_keys_of_the_fact(spark):
    fact = registered.queries()["fact_sales"](spark, SF)
    missing = [fact.where(f"{c} IS NULL").count() for c in ("customer_id", "store_id", "quantity", "total_price")]
    assert missing == [64, 68, 51, 55]


def test_entry(spark):
    assert registered.entry(spark).count() == 200
