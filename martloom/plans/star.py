"""The star schema: eight dimensions and one fact, built from landed staging rows.

Every builder reads only its own staging columns. Builders ask the warehouse for the
tables they look keys up in, and get them as written, sized relations.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.clean import date_or_null, double_or_null, int_or_null, or_blank, present
from martloom.operators.numbering import row_numbers, source_row_numbers
from martloom.schemas import ROW_ORDER, STAR, Table
from martloom.workspace import Proven

if TYPE_CHECKING:
    from martloom.plans.warehouse import Warehouse


def conform(df: DataFrame, table: Table) -> DataFrame:
    """The declared columns, in order, in their declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])


def _named(prefix: str, names: str) -> list[Column]:
    """Staging columns `<prefix>_<name>` under their short names."""
    return [F.col(f"{prefix}_{name}").alias(name) for name in names.split()]


def _with_ids(wh: Warehouse, name: str, distinct: DataFrame, natural: list[str], out: str) -> Proven:
    """Surrogate ids 1..n in order of the natural key."""
    saved = wh.workspace.save(distinct, f"{name}-rows")
    numbered = row_numbers(wh.workspace, saved, natural, out, wh.rows_per_range)
    return Proven(conform(numbered, STAR[name]), saved.rows, f"numbers from 1 on, a number for each of the {name}-rows")


def _per_key(wh: Warehouse, name: str, rows: DataFrame) -> Proven:
    """Survivors with what was looked up for them, one row for each key."""
    return Proven(conform(rows, STAR[name]), wh.survivors(name).keys.rows, "keys by which rows were grouped")


def dim_pet_type(wh: Warehouse) -> Proven:
    # A missing category is the blank one, so that a customer finds exactly one row.
    pairs = (
        wh.staging.where(present("customer_pet_type"))
        .select(F.col("customer_pet_type").alias("pet_type"), or_blank("pet_category").alias("pet_category"))
        .distinct()
    )
    return _with_ids(wh, "dim_pet_type", pairs, ["pet_type", "pet_category"], "pet_type_id")


def customer_rows(staging: DataFrame) -> DataFrame:
    """What staging says about customers, one row per sale."""
    return staging.select(
        *ROW_ORDER,
        int_or_null("sale_customer_id").alias("customer_id"),
        *_named("customer", "first_name last_name age email country postal_code"),
        *_named("customer", "pet_type pet_name pet_breed"),
        or_blank("pet_category").alias("pet_category"),
    ).where("customer_id IS NOT NULL")


def dim_customer(wh: Warehouse) -> Proven:
    customers = wh.survivors("dim_customer").rows
    pets = wh.lookup("dim_pet_type")
    return _per_key(
        wh,
        "dim_customer",
        customers.withColumn("age", int_or_null("age")).join(pets, ["pet_type", "pet_category"], "left"),
    )


def seller_rows(staging: DataFrame) -> DataFrame:
    return staging.select(
        *ROW_ORDER,
        int_or_null("sale_seller_id").alias("seller_id"),
        *_named("seller", "first_name last_name email country postal_code"),
    ).where("seller_id IS NOT NULL")


def dim_seller(wh: Warehouse) -> Proven:
    return _per_key(wh, "dim_seller", wh.survivors("dim_seller").rows)


def dim_product_category(wh: Warehouse) -> Proven:
    names = (
        wh.staging.where(present("product_category"))
        .select(F.col("product_category").alias("category_name"))
        .distinct()
    )
    return _with_ids(wh, "dim_product_category", names, ["category_name"], "category_id")


def supplier_rows(staging: DataFrame) -> DataFrame:
    return staging.where(present("supplier_name")).select(
        *ROW_ORDER,
        *_named("supplier", "name contact email phone address country"),
        or_blank("supplier_city").alias("city"),
    )


def dim_supplier(wh: Warehouse) -> Proven:
    return _with_ids(wh, "dim_supplier", wh.survivors("dim_supplier").rows, ["name", "city"], "supplier_id")


def product_rows(staging: DataFrame) -> DataFrame:
    return staging.select(
        *ROW_ORDER,
        int_or_null("sale_product_id").alias("product_id"),
        *_named("product", "name category price weight color size brand material description"),
        *_named("product", "rating reviews release_date expiry_date"),
        "supplier_name",
        or_blank("supplier_city").alias("supplier_city"),
    ).where("product_id IS NOT NULL")


def dim_product(wh: Warehouse) -> Proven:
    products = (
        wh.survivors("dim_product")
        .rows.withColumn("price", double_or_null("price"))
        .withColumn("rating", double_or_null("rating"))
        .withColumn("reviews", int_or_null("reviews"))
        .withColumn("release_date", date_or_null("release_date"))
        .withColumn("expiry_date", date_or_null("expiry_date"))
    )
    categories = wh.lookup("dim_product_category").withColumnRenamed("category_name", "category")
    suppliers = wh.lookup("dim_supplier").select(
        "supplier_id", F.col("name").alias("supplier_name"), F.col("city").alias("supplier_city")
    )
    return _per_key(
        wh,
        "dim_product",
        products.join(categories, "category", "left").join(
            suppliers, ["supplier_name", "supplier_city"], "left"
        ),
    )


def store_rows(staging: DataFrame) -> DataFrame:
    return staging.where(present("store_name")).select(
        *ROW_ORDER,
        *_named("store", "name location state country phone email"),
        or_blank("store_city").alias("city"),
    )


def dim_store(wh: Warehouse) -> Proven:
    return _with_ids(wh, "dim_store", wh.survivors("dim_store").rows, ["name", "city"], "store_id")


def sale_days(wh: Warehouse) -> DataFrame:
    """The readable date texts, their days and sales: every text is parsed once, not once per sale."""
    return (
        wh.staging.groupBy("sale_date")
        .agg(F.count(F.lit(1)).alias("sales"))
        .withColumn("full_date", date_or_null("sale_date"))
        .where("full_date IS NOT NULL")
    )


def dim_date(wh: Warehouse) -> Proven:
    # Different texts can name one day, so it is the days that are distinct.
    days = wh.sale_days().select("full_date").distinct()
    parts = days.select(
        "full_date",
        F.dayofmonth("full_date").alias("day"),
        F.month("full_date").alias("month"),
        F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"),
    )
    return _with_ids(wh, "dim_date", parts, ["full_date"], "date_id")


def sale_day_ids(wh: Warehouse) -> DataFrame:
    dates = wh.table("dim_date").select("date_id", "full_date")
    return wh.sale_days().join(dates, "full_date").select("sale_date", "date_id")


def fact_sales(wh: Warehouse) -> Proven:
    """One row per staging row with a readable date; numbers are given before that filter."""
    source = wh.staging.select(
        *ROW_ORDER,
        "sale_date",
        "sale_customer_id",
        "sale_seller_id",
        "sale_product_id",
        "store_name",
        or_blank("store_city").alias("store_city"),
        "sale_quantity",
        "sale_total_price",
    )
    sales = source_row_numbers(wh.workspace, source, "sale_id", wh.sources(), wh.rows_per_range).select(
        "sale_id",
        "sale_date",
        int_or_null("sale_customer_id").alias("customer_id"),
        int_or_null("sale_seller_id").alias("seller_id"),
        int_or_null("sale_product_id").alias("product_id"),
        "store_name",
        "store_city",
        int_or_null("sale_quantity").alias("quantity"),
        double_or_null("sale_total_price").alias("total_price"),
    )
    # Only readable texts are in here, so the join is also the filter.
    days = wh.sale_day_ids()
    stores = wh.table("dim_store").select(
        "store_id", F.col("name").alias("store_name"), F.col("city").alias("store_city")
    )
    joined = sales.join(days, "sale_date").join(stores, ["store_name", "store_city"], "left")
    dated = wh.sale_days().agg(F.sum("sales")).first()[0] or 0
    return Proven(conform(joined, STAR["fact_sales"]), dated, "sales with a readable date, each numbered once")


# The dimensions whose key can come with differing rows, what staging says of them, and the key.
SURVIVOR_ROWS = {
    "dim_customer": (customer_rows, ["customer_id"]),
    "dim_seller": (seller_rows, ["seller_id"]),
    "dim_supplier": (supplier_rows, ["name", "city"]),
    "dim_product": (product_rows, ["product_id"]),
    "dim_store": (store_rows, ["name", "city"]),
}


BUILDERS = {
    "dim_pet_type": dim_pet_type,
    "dim_customer": dim_customer,
    "dim_seller": dim_seller,
    "dim_product_category": dim_product_category,
    "dim_supplier": dim_supplier,
    "dim_product": dim_product,
    "dim_store": dim_store,
    "dim_date": dim_date,
    "fact_sales": fact_sales,
}
