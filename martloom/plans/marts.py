"""The eight marts.

The fact is reduced to one row per product, customer, store or day before it meets a
dimension. The reduction starts inside each scan task, so a key that holds a third of
the sales costs one row per task, the joins are one to one, and no distinct count is
needed later: rows are already distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.money import average, cents, exact, times
from martloom.operators.numbering import ranks
from martloom.plans.star import conform
from martloom.schemas import MARTS

if TYPE_CHECKING:
    from martloom.plans.warehouse import Warehouse

# What a mart shows for a missing text.
NO_CATEGORY = "N/A"
NO_PLACE = "Unknown"

SALES_KEYS = ("product_id", "customer_id", "store_id", "date_id")


def sales_by(fact: DataFrame, key: str) -> DataFrame:
    """Exact totals of the sales with the same `key`; sales without one belong nowhere."""
    return (
        fact.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("sales"),
            F.count("total_price").alias("priced"),
            F.sum("quantity").alias("quantity"),
            F.sum(exact(F.col("total_price"))).alias("revenue"),
        )
    )


def _total(column: str) -> Column:
    return F.sum(column).alias(column)


def _place(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NO_PLACE))


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _revenue() -> Column:
    return cents(F.col("revenue")).alias("total_revenue")


def _basket(name: str = "avg_basket") -> Column:
    return average(F.col("revenue"), F.col("priced")).alias(name)


def sold_products(wh: Warehouse) -> DataFrame:
    """Products with sales: their totals, attributes and category name."""
    products = wh.lookup("dim_product").select(
        "product_id", "name", "category_id", "rating", "reviews"
    )
    return (
        wh.sales_by("product_id")
        .join(products, "product_id")
        .join(wh.lookup("dim_product_category"), "category_id", "left")
        .withColumn("category_name", F.coalesce("category_name", F.lit(NO_CATEGORY)))
        .withColumnRenamed("name", "product_name")
    )


def _by_product(wh: Warehouse) -> DataFrame:
    return sold_products(wh).select(
        "product_id",
        "product_name",
        "category_name",
        _revenue(),
        F.col("quantity").alias("total_quantity"),
        # The rating is the same for all sales of a product, and so is its average.
        F.round(F.coalesce("rating", F.lit(0.0)), 2).alias("avg_rating"),
        _or_zero("reviews").alias("total_reviews"),
        F.col("revenue").alias("_by"),
    )


def _by_customer(wh: Warehouse) -> DataFrame:
    customers = wh.lookup("dim_customer").select("customer_id", "first_name", "last_name", "country")
    first, last = (F.coalesce(c, F.lit("")) for c in ("first_name", "last_name"))
    return (
        wh.sales_by("customer_id")
        .join(customers, "customer_id")
        .select(
            "customer_id",
            F.concat(first, F.lit(" "), last).alias("customer_name"),
            _place("country").alias("country"),
            F.col("sales").alias("total_orders"),
            _revenue(),
            _basket(),
            F.col("revenue").alias("_by"),
        )
    )


def _by_customer_country(wh: Warehouse) -> DataFrame:
    customers = wh.lookup("dim_customer").select("customer_id", _place("country").alias("country"))
    return (
        wh.sales_by("customer_id")
        .join(customers, "customer_id")
        .groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            _total("sales"),
            _total("priced"),
            _total("revenue"),
        )
        .select(
            "country",
            "customer_count",
            F.col("sales").alias("total_orders"),
            _revenue(),
            _basket(),
            F.col("customer_count").alias("_by"),
        )
    )


def _by_time(wh: Warehouse) -> DataFrame:
    dates = wh.lookup("dim_date").select("date_id", "year", "month")
    yearly = F.grouping("month") == 1
    return (
        wh.sales_by("date_id")
        .join(dates, "date_id")
        .groupingSets([["year", "month"], ["year"]], "year", "month")
        .agg(
            _total("sales"),
            _total("priced"),
            _total("revenue"),
            F.when(yearly, "yearly").otherwise("monthly").alias("period_type"),
        )
        .select(
            "year",
            F.coalesce("month", F.lit(0)).alias("month"),
            "period_type",
            F.col("sales").alias("total_orders"),
            _revenue(),
            _basket("avg_order_value"),
        )
    )


def _by_store(wh: Warehouse) -> DataFrame:
    stores = wh.lookup("dim_store").select("store_id", "name", "city", "country")
    return (
        wh.sales_by("store_id")
        .join(stores, "store_id")
        .select(
            "store_id",
            F.col("name").alias("store_name"),
            _place("city").alias("city"),
            _place("country").alias("country"),
            F.col("sales").alias("total_orders"),
            _revenue(),
            _basket(),
            F.col("revenue").alias("_by"),
        )
    )


def selling_suppliers(wh: Warehouse) -> DataFrame:
    """Suppliers of sold products: totals over those products, and the supplier's own columns."""
    products = (
        wh.lookup("dim_product")
        .where("supplier_id IS NOT NULL")
        .select("product_id", "supplier_id", "price")
    )
    price = F.col("price")
    per_supplier = (
        wh.sales_by("product_id")
        .join(products, "product_id")
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("products"),
            _total("revenue"),
            # An average over sales: a product sold five times weighs five.
            F.sum(times(price, F.col("sales"))).alias("prices"),
            F.sum(F.when(price.isNotNull(), F.col("sales"))).alias("prices_seen"),
        )
    )
    suppliers = wh.lookup("dim_supplier").select("supplier_id", "name", _place("country").alias("country"))
    return per_supplier.join(suppliers, "supplier_id")


def _by_supplier(wh: Warehouse) -> DataFrame:
    return selling_suppliers(wh).select(
        "supplier_id",
        F.col("name").alias("supplier_name"),
        "country",
        _revenue(),
        average(F.col("prices"), F.col("prices_seen")).alias("avg_item_price"),
        F.col("products").alias("product_count"),
        F.col("revenue").alias("_by"),
    )


def _by_supplier_country(wh: Warehouse) -> DataFrame:
    return (
        selling_suppliers(wh)
        .groupBy(F.col("country").alias("supplier_country"))
        .agg(
            F.count(F.lit(1)).alias("supplier_count"),
            F.sum("products").alias("product_count"),
            _total("revenue"),
        )
        .select(
            "supplier_country",
            "supplier_count",
            "product_count",
            _revenue(),
            F.col("revenue").alias("_by"),
        )
    )


def _quality(wh: Warehouse) -> DataFrame:
    return sold_products(wh).select(
        "product_id",
        "product_name",
        "category_name",
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        _or_zero("reviews").alias("reviews"),
        F.col("sales").alias("sales_count"),
        _revenue(),
        F.coalesce("rating", F.lit(0.0)).alias("_by"),
    )


@dataclass(frozen=True)
class MartPlan:
    """Builds a mart; `rank` is its rank column, given by `_by`, the largest value first."""

    rows: Callable[[Warehouse], DataFrame]
    rank: str | None = None


PLANS = {
    "mart_sales_by_product": MartPlan(_by_product, "revenue_rank"),
    "mart_sales_by_customer": MartPlan(_by_customer, "revenue_rank"),
    "mart_customers_by_country": MartPlan(_by_customer_country, "country_rank"),
    "mart_sales_by_time": MartPlan(_by_time),
    "mart_sales_by_store": MartPlan(_by_store, "revenue_rank"),
    "mart_sales_by_supplier": MartPlan(_by_supplier, "revenue_rank"),
    "mart_suppliers_by_country": MartPlan(_by_supplier_country, "country_rank"),
    "mart_product_quality": MartPlan(_quality, "rating_rank"),
}


def build_mart(wh: Warehouse, name: str) -> DataFrame:
    plan, table = PLANS[name], MARTS[name]
    rows = plan.rows(wh)
    if plan.rank:
        unranked = wh.workspace.save(rows, f"{name}-rows")
        rows = ranks(wh.workspace, unranked, "_by", plan.rank, wh.rows_per_range)
    return conform(rows, table)
