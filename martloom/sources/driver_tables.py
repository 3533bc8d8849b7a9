"""Staging rows made from order tables: one sale per line item.

The tables have no ratings, reviews, pets, sellers or stores; those follow from the
keys by rule, with blanks and NULLs in fixed places to exercise the null rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.functions.clean import DATE_FORMAT
from martloom.operators.numbering import row_numbers
from martloom.schemas import SOURCE_FILE, SOURCE_ID, STAGING
from martloom.sources.files import landed_columns
from martloom.workspace import Saved, Workspace

LINE_KEY = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_extendedprice",
]


def _every(key: str | Column, n: int) -> Column:
    return (F.col(key) if isinstance(key, str) else key) % n == 0


def _numbered_lines(ws: Workspace, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a file name and their number within that file."""
    file_name = F.concat(F.lit("MOCK_DATA_"), (F.col("l_orderkey") % 10).cast("string"))
    lines = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select(*LINE_KEY, "l_quantity")
        .withColumn(SOURCE_FILE, file_name)
    )
    numbered = row_numbers(ws, Saved(lines, lines.count()), [SOURCE_FILE, *LINE_KEY], "_number")
    # There are ten files, so the window sees ten rows and ten rows are broadcast.
    earlier = Window.orderBy(SOURCE_FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = (
        lines.groupBy(SOURCE_FILE)
        .count()
        .select(SOURCE_FILE, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    return numbered.join(F.broadcast(files), SOURCE_FILE).withColumn(
        SOURCE_ID, F.col("_number") - F.col("_before")
    )


def _place(tables: DataFrame, regions: DataFrame, prefix: str) -> DataFrame:
    """Nations with their region: `<prefix>_nation`, `<prefix>_region`, by nation key."""
    return tables.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias(f"{prefix}_nationkey"),
        F.col("n_name").alias(f"{prefix}_nation"),
        F.col("r_name").alias(f"{prefix}_region"),
    )


def staging_from_tables(ws: Workspace, spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)

    nation = table("nation", "n_nationkey", "n_name", "n_regionkey")
    region = table("region", "r_regionkey", "r_name")
    customer = table("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    supplier = table("supplier", "s_suppkey", "s_name", "s_nationkey")
    orders = table("orders", "o_orderkey", "o_custkey", "o_orderdate")
    part = table("part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    # Tables are joined as they are read: Spark knows their sizes, but not those of joins,
    # and decides by size which of them to broadcast.
    joined = (
        _numbered_lines(ws, spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_place(nation, region, "c"), "c_nationkey")
        .join(_place(nation, region, "s"), "s_nationkey")
    )
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")
    blank, none = F.lit(""), F.lit(None).cast("string")

    def blank_every(n: int, value: Column) -> Column:
        return F.when(_every(h, n), blank).otherwise(value.cast("string"))

    pet = F.element_at(
        F.array(F.lit("cat"), F.lit("dog"), F.lit("bird"), blank),
        (F.col("c_custkey") % 4 + 1).cast("int"),
    )
    pet_category = F.element_at(
        F.array(F.lit("Cats"), F.lit("Dogs"), F.lit("Birds"), blank, none),
        (F.col("c_custkey") % 5 + 1).cast("int"),
    )
    values = {
        "id": F.col(SOURCE_ID),
        "sale_customer_id": blank_every(101, F.col("o_custkey")),
        "customer_first_name": F.col("c_name"),
        "customer_last_name": F.col("c_mktsegment"),
        "customer_country": F.when(_every("c_custkey", 29), none)
        .when(_every("c_custkey", 31), F.lit("Unknown"))
        .otherwise(F.col("c_nation")),
        "customer_pet_type": pet,
        "pet_category": pet_category,
        "sale_seller_id": F.col("l_orderkey") % 100,
        "seller_first_name": F.lit("Seller"),
        "seller_last_name": F.col("l_orderkey") % 100,
        "sale_product_id": F.col("l_partkey"),
        "product_name": F.col("p_name"),
        "product_category": F.when(~_every("l_partkey", 83), F.col("p_type")),
        "product_price": F.col("p_retailprice"),
        "product_rating": F.when(_every("l_partkey", 11), blank).otherwise(
            (F.col("p_size") / 10.0).cast("string")
        ),
        "product_reviews": F.when(_every("l_partkey", 13), blank).otherwise(
            (F.col("p_size") * 3).cast("string")
        ),
        "supplier_name": F.col("s_name"),
        "supplier_city": F.col("s_nation"),
        "supplier_country": F.when(~_every("l_suppkey", 23), F.col("s_region")),
        "store_name": blank_every(89, F.col("c_mktsegment")),
        "store_city": F.col("c_nation"),
        "store_country": F.col("c_region"),
        "sale_date": blank_every(97, F.date_format("o_orderdate", DATE_FORMAT)),
        "sale_quantity": blank_every(103, F.col("l_quantity").cast("int")),
        "sale_total_price": blank_every(107, F.col("l_extendedprice")),
    }
    columns = [values.get(name, none).alias(name) for name in STAGING.names]
    return landed_columns(joined.select(SOURCE_FILE, SOURCE_ID, *columns))
