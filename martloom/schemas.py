"""Declared schemas and keys of every table the engine reads or writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

# The column names of the staging table, in file order. `id` is an
# int, every other column is text.
STAGING_COLUMNS = """
id customer_first_name customer_last_name customer_age customer_email customer_country
customer_postal_code customer_pet_type customer_pet_name customer_pet_breed
seller_first_name seller_last_name seller_email seller_country seller_postal_code
product_name product_category product_price product_quantity
sale_date sale_customer_id sale_seller_id sale_product_id sale_quantity sale_total_price
store_name store_location store_city store_state store_country store_phone store_email
pet_category product_weight product_color product_size product_brand product_material
product_description product_rating product_reviews product_release_date product_expiry_date
supplier_name supplier_contact supplier_email supplier_phone supplier_address supplier_city
supplier_country
""".split()

# Row identity, added while reading: which file a row came from and its id there.
SOURCE_FILE = "_src_file"
SOURCE_ID = "_src_id"
ROW_ORDER = (SOURCE_FILE, SOURCE_ID)

STAGING = StructType(
    [StructField(name, IntegerType() if name == "id" else StringType()) for name in STAGING_COLUMNS]
)
LANDED = StructType(
    [StructField(SOURCE_FILE, StringType()), StructField(SOURCE_ID, LongType()), *STAGING.fields]
)


@dataclass(frozen=True)
class Table:
    """A written table: its columns, the columns that identify a row, its sort order.

    In a rollup a key column may be NULL, where the row stands for all its values.
    """

    schema: StructType
    keys: tuple[str, ...]
    order_by: tuple[str, ...] = ()
    rollup: bool = False


_TYPES = {
    "string": StringType(),
    "smallint": ShortType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "date": DateType(),
}


def _table(columns: str, keys: str, order_by: str = "", rollup: bool = False) -> Table:
    pairs = [column.split() for column in columns.split(",")]
    schema = StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])
    return Table(schema, tuple(keys.split()), tuple(order_by.split()), rollup)


# Names, types and keys of the star tables.
STAR = {
    "dim_pet_type": _table(
        "pet_type_id int, pet_type string, pet_category string",
        "pet_type_id",
    ),
    "dim_customer": _table(
        "customer_id int, first_name string, last_name string, age int, email string, "
        "country string, postal_code string, pet_type_id int, pet_name string, pet_breed string",
        "customer_id",
    ),
    "dim_seller": _table(
        "seller_id int, first_name string, last_name string, email string, country string, "
        "postal_code string",
        "seller_id",
    ),
    "dim_product_category": _table(
        "category_id int, category_name string",
        "category_id",
    ),
    "dim_supplier": _table(
        "supplier_id int, name string, contact string, email string, phone string, "
        "address string, city string, country string",
        "supplier_id",
    ),
    "dim_product": _table(
        "product_id int, name string, category_id int, supplier_id int, price double, "
        "weight string, color string, size string, brand string, material string, "
        "description string, rating double, reviews int, release_date date, expiry_date date",
        "product_id",
    ),
    "dim_store": _table(
        "store_id int, name string, location string, city string, state string, "
        "country string, phone string, email string",
        "store_id",
    ),
    "dim_date": _table(
        "date_id int, full_date date, day smallint, month smallint, year smallint, "
        "quarter smallint",
        "date_id",
    ),
    "fact_sales": _table(
        "sale_id bigint, date_id int, customer_id int, seller_id int, product_id int, "
        "store_id int, quantity int, total_price double",
        "sale_id",
    ),
}

# Names, types, keys and sort orders of the marts.
MARTS = {
    "mart_sales_by_product": _table(
        "product_id int, product_name string, category_name string, total_revenue double, "
        "total_quantity bigint, avg_rating double, total_reviews int, revenue_rank int",
        "product_id",
        "revenue_rank",
    ),
    "mart_sales_by_customer": _table(
        "customer_id int, customer_name string, country string, total_orders bigint, "
        "total_revenue double, avg_basket double, revenue_rank int",
        "customer_id",
        "revenue_rank",
    ),
    "mart_customers_by_country": _table(
        "country string, customer_count bigint, total_orders bigint, total_revenue double, "
        "avg_basket double, country_rank int",
        "country",
        "country_rank",
    ),
    "mart_sales_by_time": _table(
        "year smallint, month smallint, period_type string, total_orders bigint, "
        "total_revenue double, avg_order_value double",
        "year month",
        "year month",
    ),
    "mart_sales_by_store": _table(
        "store_id int, store_name string, city string, country string, total_orders bigint, "
        "total_revenue double, avg_basket double, revenue_rank int",
        "store_id",
        "revenue_rank",
    ),
    "mart_sales_by_supplier": _table(
        "supplier_id int, supplier_name string, country string, total_revenue double, "
        "avg_item_price double, product_count bigint, revenue_rank int",
        "supplier_id",
        "revenue_rank",
    ),
    "mart_suppliers_by_country": _table(
        "supplier_country string, supplier_count bigint, product_count bigint, "
        "total_revenue double, country_rank int",
        "supplier_country",
        "country_rank",
    ),
    "mart_product_quality": _table(
        "product_id int, product_name string, category_name string, rating double, "
        "reviews int, sales_count bigint, total_revenue double, rating_rank int",
        "product_id",
        "rating_rank",
    ),
}

# Names, types, keys and sort orders of the reports; some have the columns of a whole mart.
REPORT_TABLES = {
    "top10_products": MARTS["mart_sales_by_product"],
    "revenue_by_category": _table(
        "category_name string, total_quantity bigint, total_revenue double",
        "category_name",
    ),
    "product_ratings": _table(
        "product_id int, product_name string, avg_rating double, total_reviews int",
        "product_id",
        "product_id",
    ),
    "top10_customers": MARTS["mart_sales_by_customer"],
    "customers_by_country": MARTS["mart_customers_by_country"],
    "customer_avg_basket": _table(
        "customer_id int, customer_name string, avg_basket double",
        "customer_id",
        "customer_id",
    ),
    "sales_trends": MARTS["mart_sales_by_time"],
    "revenue_period_over_period": _table(
        "year smallint, month smallint, period_type string, total_revenue double, "
        "previous_revenue double, revenue_change double, revenue_ratio double",
        "year month",
        "year month",
    ),
    "monthly_avg_order": _table(
        "year smallint, month smallint, avg_order_value double",
        "year month",
        "year month",
    ),
    "top5_stores": MARTS["mart_sales_by_store"],
    "sales_by_city_country": _table(
        "level string, country string, city string, total_orders bigint, total_revenue double, "
        "avg_basket double",
        "level country city",
        "level country city",
        rollup=True,
    ),
    "store_avg_basket": _table(
        "store_id int, store_name string, avg_basket double",
        "store_id",
        "store_id",
    ),
    "top5_suppliers": MARTS["mart_sales_by_supplier"],
    "supplier_avg_price": _table(
        "supplier_id int, supplier_name string, avg_item_price double, avg_product_price double",
        "supplier_id",
        "supplier_id",
    ),
    "suppliers_by_country": MARTS["mart_suppliers_by_country"],
    "rating_extremes": _table(
        "product_id int, product_name string, category_name string, rating double, "
        "reviews int, sales_count bigint, total_revenue double, rating_rank int, extreme string",
        "extreme product_id",
        "extreme rating product_id",
    ),
    "rating_sales_correlation": _table(
        "products bigint, corr_sales_count double, corr_total_revenue double",
        "products",
    ),
    "most_reviewed_products": MARTS["mart_product_quality"],
}
