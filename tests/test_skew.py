"""One key with a third of the sales, and dimensions too large to broadcast."""

import glob

import pytest
from pyspark.sql import functions as F

from martloom.operators.numbering import numbered_by_content
from martloom.plans.warehouse import Warehouse
from martloom.schemas import LANDED
from martloom.workspace import Workspace

ROWS = 120_000
CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    before = {key: spark.conf.get(key, None) for key in CONF}
    for key, value in CONF.items():
        spark.conf.set(key, value)
    ws = Workspace(spark, str(tmp_path_factory.mktemp("skew")))
    yield Warehouse.land(skewed_rows(spark), ws, rows_per_range=10_000)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed_rows(spark):
    n = F.col("id")
    hot = n % 3 == 0

    def mostly(value, other):
        return F.when(hot, F.lit(value)).otherwise(other.cast("string"))

    values = {
        "_src_file": F.when(n < ROWS // 3, "A").otherwise(F.concat(F.lit("B"), (n % 5).cast("string"))),
        "sale_date": mostly("5/1/2021", F.date_format(F.date_add(F.lit("2020-01-01"), (n % 365).cast("int")), "M/d/yyyy")),
        "sale_customer_id": (n * 7919 % 9973).cast("string"),
        "sale_product_id": mostly("1", n % 499),
        "sale_seller_id": mostly("1", n % 13),
        "sale_quantity": F.lit("1"),
        "sale_total_price": (n * 104729 % 99991 / 100).cast("string"),
        "store_name": mostly("Shop", n % 211),
        "store_city": F.lit("Lima"),
        "supplier_name": mostly("Acme", n % 31),
        "customer_first_name": F.sha2(n.cast("string"), 256),
    }
    columns = [values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in LANDED]
    rows = spark.range(0, ROWS, numPartitions=8).select(*columns)
    # Ids with gaps and repeats: every file has to be numbered by content.
    return rows.withColumn("_src_id", F.xxhash64("customer_first_name") % 1000)


def test_hot_keys_are_split_and_nothing_is_lost(skewed):
    wh = skewed
    fact = wh.table("fact_sales")
    assert wh.saved("fact_sales").rows == ROWS
    # One task wrote each file, and no task got more than a part of the hot rows.
    hot = fact.where("product_id = 1").groupBy(F.input_file_name().alias("f")).count()
    assert hot.agg(F.max("count")).first()[0] < ROWS / 6
    assert fact.agg(F.min("sale_id"), F.max("sale_id"), F.count_distinct("sale_id")).first() == (1, ROWS, ROWS)
    assert fact.where("store_id IS NULL OR date_id IS NULL").isEmpty()


def test_hot_keys_have_whole_totals(skewed):
    hot = skewed.table("mart_sales_by_product").where("product_id = 1").first()
    others = sum(1 for n in range(ROWS) if n % 3 and n % 499 == 1)
    assert hot.total_quantity == ROWS // 3 + others and hot.revenue_rank == 1
    years = skewed.table("mart_sales_by_time").where("month = 0").agg(F.sum("total_orders")).first()[0]
    assert years == ROWS


def test_numbers_by_range_are_even(skewed, ws):
    rows = skewed.staging.select("_src_file", "_src_id", "customer_first_name")
    numbered_by_content(ws, rows, "n", 15_000)
    (folder,) = glob.glob(f"{ws.root}/n-ranges-*")
    written = ws.spark.read.parquet(folder)
    sizes = [r[0] for r in written.groupBy(F.shiftright("_at", 33)).count().select("count").collect()]
    assert sum(sizes) == ROWS and max(sizes) < 2 * ROWS / len(sizes)
