"""The eighteen report lines, read from the marts or from the totals behind them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.money import average, cents, exact
from martloom.plans.marts import NO_CATEGORY, NO_PLACE

if TYPE_CHECKING:
    from martloom.plans.warehouse import Warehouse


def top_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first `k` rows; `order` must end in a key, or ties would be cut at random."""
    return df.orderBy(*order).limit(k)


# Products


def top10_products(wh: Warehouse) -> DataFrame:
    """By revenue; the quantity stays a column."""
    return top_k(wh.table("mart_sales_by_product"), 10, "revenue_rank", "product_id")


def revenue_by_category(wh: Warehouse) -> DataFrame:
    products = wh.lookup("dim_product").select("product_id", "category_id")
    return (
        wh.sales_by("product_id")
        .join(products, "product_id")
        .groupBy("category_id")
        .agg(F.sum("quantity").alias("total_quantity"), F.sum("revenue").alias("revenue"))
        .join(wh.lookup("dim_product_category"), "category_id", "left")
        .select(
            F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category_name"),
            "total_quantity",
            "revenue",
        )
        # A category may itself be named like the missing one.
        .groupBy("category_name")
        .agg(
            F.sum("total_quantity").alias("total_quantity"),
            cents(F.sum("revenue")).alias("total_revenue"),
        )
    )


def product_ratings(wh: Warehouse) -> DataFrame:
    return wh.table("mart_sales_by_product").select(
        "product_id", "product_name", "avg_rating", "total_reviews"
    )


# Customers


def top10_customers(wh: Warehouse) -> DataFrame:
    return top_k(wh.table("mart_sales_by_customer"), 10, "revenue_rank", "customer_id")


def customers_by_country(wh: Warehouse) -> DataFrame:
    return wh.table("mart_customers_by_country").orderBy("country_rank", "country")


def customer_avg_basket(wh: Warehouse) -> DataFrame:
    return wh.table("mart_sales_by_customer").select("customer_id", "customer_name", "avg_basket")


# Time


def sales_trends(wh: Warehouse) -> DataFrame:
    return wh.table("mart_sales_by_time").orderBy("year", "month")


def revenue_period_over_period(wh: Warehouse) -> DataFrame:
    """Each month against the month before it in the mart, each year against the year before.

    One window group holds one row per month, so its size is bounded by the calendar.
    """
    in_time = Window.partitionBy("period_type").orderBy("year", "month")
    revenue, previous = F.col("total_revenue"), F.col("previous_revenue")
    wide = "decimal(38,6)"
    return (
        wh.table("mart_sales_by_time")
        .select("year", "month", "period_type", "total_revenue")
        .withColumn("previous_revenue", F.lag("total_revenue").over(in_time))
        .withColumn("revenue_change", cents(revenue.cast(wide) - previous.cast(wide)))
        .withColumn("revenue_ratio", F.try_divide(revenue, previous))
    )


def monthly_avg_order(wh: Warehouse) -> DataFrame:
    return (
        wh.table("mart_sales_by_time")
        .where(F.col("period_type") == "monthly")
        .select("year", "month", "avg_order_value")
    )


# Stores


def top5_stores(wh: Warehouse) -> DataFrame:
    return top_k(wh.table("mart_sales_by_store"), 5, "revenue_rank", "store_id")


def sales_by_city_country(wh: Warehouse) -> DataFrame:
    """Cities, countries and the whole; `level` tells them apart, not the NULLs."""
    stores = wh.lookup("dim_store").select(
        "store_id", "city", F.coalesce("country", F.lit(NO_PLACE)).alias("country")
    )
    level = (
        F.when(F.grouping_id() == 0, "city")
        .when(F.grouping_id() == 1, "country")
        .otherwise("total")
    )
    return (
        wh.sales_by("store_id")
        .join(stores, "store_id")
        .rollup("country", "city")
        .agg(
            level.alias("level"),
            F.sum("sales").alias("total_orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("priced").alias("priced"),
        )
        .select(
            "level",
            "country",
            "city",
            "total_orders",
            cents(F.col("revenue")).alias("total_revenue"),
            average(F.col("revenue"), F.col("priced")).alias("avg_basket"),
        )
    )


def store_avg_basket(wh: Warehouse) -> DataFrame:
    return wh.table("mart_sales_by_store").select("store_id", "store_name", "avg_basket")


# Suppliers


def top5_suppliers(wh: Warehouse) -> DataFrame:
    return top_k(wh.table("mart_sales_by_supplier"), 5, "revenue_rank", "supplier_id")


def supplier_avg_price(wh: Warehouse) -> DataFrame:
    """`avg_item_price` weighs a product by its sales, `avg_product_price` weighs all alike."""
    price = exact(F.col("price"))
    products = (
        wh.table("dim_product")
        .where("supplier_id IS NOT NULL")
        .groupBy("supplier_id")
        .agg(average(F.sum(price), F.count(price)).alias("avg_product_price"))
    )
    return (
        wh.lookup("mart_sales_by_supplier")
        .select("supplier_id", "supplier_name", "avg_item_price")
        .join(products, "supplier_id")
    )


def suppliers_by_country(wh: Warehouse) -> DataFrame:
    return wh.table("mart_suppliers_by_country").orderBy("country_rank", "supplier_country")


# Quality


def _rated(wh: Warehouse) -> DataFrame:
    """Products with a rating: the mart shows 0 for the others, which nobody gave."""
    rated = wh.lookup("dim_product").where("rating IS NOT NULL").select("product_id")
    return wh.table("mart_product_quality").join(rated, "product_id", "left_semi")


def rating_extremes(wh: Warehouse) -> DataFrame:
    rated = _rated(wh)
    highest = top_k(rated, 10, F.desc("rating"), "product_id")
    lowest = top_k(rated, 10, F.asc("rating"), "product_id")
    return highest.withColumn("extreme", F.lit("highest")).unionByName(
        lowest.withColumn("extreme", F.lit("lowest"))
    )


def _correlation(x: str, y: str) -> Column:
    """Over the rows that have both values; NULL if either is the same in all of them."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    # The last digits of a sum of doubles depend on the partitioning; six do not.
    return F.when(~constant, F.round(F.covar_pop(a, b) / spread, 6))


def rating_sales_correlation(wh: Warehouse) -> DataFrame:
    return _rated(wh).agg(
        F.count(F.lit(1)).alias("products"),
        _correlation("rating", "sales_count").alias("corr_sales_count"),
        _correlation("rating", "total_revenue").alias("corr_total_revenue"),
    )


def most_reviewed_products(wh: Warehouse) -> DataFrame:
    return top_k(wh.table("mart_product_quality"), 10, F.desc("reviews"), "product_id")


REPORTS = {
    report.__name__: report
    for report in (
        top10_products,
        revenue_by_category,
        product_ratings,
        top10_customers,
        customers_by_country,
        customer_avg_basket,
        sales_trends,
        revenue_period_over_period,
        monthly_avg_order,
        top5_stores,
        sales_by_city_country,
        store_avg_basket,
        top5_suppliers,
        supplier_avg_price,
        suppliers_by_country,
        rating_extremes,
        rating_sales_correlation,
        most_reviewed_products,
    )
}
