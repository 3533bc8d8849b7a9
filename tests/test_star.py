import pytest
from pyspark.sql import functions as F

from conftest import rows, sale
from martloom.operators.numbering import read_sources
from martloom.operators import survivors
from martloom.operators.survivors import differing_keys, first_by
from martloom.plans import marts, star
from martloom.quality import assert_contract
from martloom.schemas import MARTS, STAR


@pytest.mark.parametrize("partitions", [1, 3])
@pytest.mark.parametrize("swap", [False, True])
def test_the_first_row_survives_whole(warehouse, partitions, swap):
    first = sale(_src_file="A", _src_id=1, customer_first_name="Zoe", customer_country=None)
    later = sale(_src_file="A", _src_id=2, customer_first_name="Ann", customer_country="Chad")
    wh = warehouse(*([later, first] if swap else [first, later]), partitions=partitions)
    assert rows(wh.table("dim_customer"), "customer_id", "first_name", "country") == [(1, "Zoe", None)]


def first_customers(ws, data):
    return first_by(ws, star.customer_rows(data), ["customer_id"], read_sources(ws, data))


def test_rows_of_one_id_are_settled_by_content(ws, staging):
    one, two = (sale(_src_id=1, customer_first_name=n) for n in ("Bob", "Ann"))
    for pair in ([one, two], [two, one]):
        assert rows(first_customers(ws, staging(*pair)).rows, "first_name") == [("Ann",)]


ODD = [((2, 9), ("A", "A")), ((-(1 << 63), -1), ("A", "A")), ((None, -(1 << 63)), ("A", "A")), (((1 << 63) - 1, 0), (None, "A")), ((None, 3), ("B", "a"))]


@pytest.mark.parametrize(("ids", "files"), ODD)
def test_the_first_of_odd_ids_and_files(ws, staging, ids, files):
    """Ids that are no numbers of rows: the first file wins, then the smallest id, a missing one first."""
    first = sale(_src_file=files[0], _src_id=ids[0], id=1, customer_first_name="Zoe")
    later = sale(_src_file=files[1], _src_id=ids[1], id=2, customer_first_name="Ann")
    assert rows(first_customers(ws, staging(later, first)).rows, "first_name") == [("Zoe",)]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ids_are_given_before_the_date_filter(warehouse, partitions):
    wh = warehouse(
        sale(sale_quantity="1"),
        sale(sale_quantity="2", sale_date="2/30/2021"),
        sale(sale_quantity="3"),
        partitions=partitions,
    )
    assert rows(wh.table("fact_sales"), "sale_id", "quantity") == [(1, 1), (3, 3)]


def test_one_key_in_two_files_is_one_customer(warehouse):
    wh = warehouse(
        sale(_src_file="A", customer_first_name="Ann"),
        sale(_src_file="B", customer_first_name="Bob"),
    )
    assert rows(wh.table("dim_customer"), "customer_id", "first_name") == [(1, "Ann")]
    assert wh.saved("fact_sales").rows == 2
    assert rows(differing_keys(wh.survivors("dim_customer").keys.df)) == [(1,)]


def test_a_null_and_a_blank_are_a_conflict(ws, staging):
    data = staging(
        sale(customer_email="", customer_postal_code=None),
        sale(customer_email=None, customer_postal_code=""),
    )
    assert rows(differing_keys(first_customers(ws, data).keys.df)) == [(1,)]
    same = staging(sale(), sale())
    assert rows(differing_keys(first_customers(ws, same).keys.df)) == [(0,)]


def test_missing_and_blank_pet_categories_are_one(warehouse):
    wh = warehouse(
        *[
            sale(sale_customer_id=str(n), customer_pet_type="cat", pet_category=category)
            for n, category in enumerate([None, "", "Cats"])
        ],
        sale(sale_customer_id="9", customer_pet_type="", pet_category="Cats"),
    )
    assert rows(wh.table("dim_pet_type")) == [(1, "cat", ""), (2, "cat", "Cats")]
    assert rows(wh.table("dim_customer"), "customer_id", "pet_type_id") == [
        (0, 1), (1, 1), (2, 2), (9, None),
    ]


def test_surrogate_keys_follow_the_natural_key(warehouse):
    wh = warehouse(
        sale(store_name="B", store_city=None),
        sale(store_name="B", store_city="A"),
        sale(store_name="A", store_city="Z"),
        sale(store_name="", store_city="Q"),
        sale(store_name=None, store_city="R"),
    )
    assert rows(wh.table("dim_store"), "store_id", "name", "city") == [
        (1, "A", "Z"), (2, "B", ""), (3, "B", "A"),
    ]
    assert rows(wh.table("fact_sales"), "sale_id", "store_id") == [
        (1, 2), (2, 3), (3, 1), (4, None), (5, None),
    ]


def test_one_day_written_in_two_ways_is_one_date(warehouse):
    wh = warehouse(sale(sale_date="5/1/2021"), sale(sale_date="05/01/2021"), sale(sale_date="12/31/2020"))
    assert rows(wh.table("dim_date"), "date_id", "day", "month", "year", "quarter") == [
        (1, 31, 12, 2020, 4), (2, 1, 5, 2021, 2),
    ]
    assert rows(wh.table("fact_sales"), "sale_id", "date_id") == [(1, 2), (2, 2), (3, 1)]


def test_unreadable_texts_become_null(warehouse):
    wh = warehouse(
        sale(
            sale_customer_id="x", sale_seller_id="99999999999", sale_product_id="1.7",
            sale_quantity="1e2", sale_total_price="NaN", product_price="abc", product_rating="Infinity",
            product_reviews="7.9", product_release_date="13/1/2021", product_expiry_date="1/2/2022",
        )
    )
    assert rows(wh.table("fact_sales")) == [(1, 1, None, None, 1, 1, None, None)]
    (product,) = wh.table("dim_product").collect()
    assert (product.price, product.rating, product.reviews, product.release_date) == (None, None, 7, None)
    assert str(product.expiry_date) == "2022-01-02"
    assert wh.table("dim_customer").isEmpty() and wh.table("dim_seller").isEmpty()


def build(wh):
    wh.build_star()
    wh.build_marts()
    for name, table in {**STAR, **MARTS}.items():
        assert_contract(wh.saved(name), table)
    return {name: wh.saved(name).rows for name in (*star.BUILDERS, *marts.PLANS)}


def test_no_rows_at_all(warehouse):
    assert set(build(warehouse()).values()) == {0}


def test_no_date_at_all(warehouse):
    counts = build(warehouse(sale(sale_date=""), sale(sale_date=None, sale_customer_id="2")))
    filled = {name for name, n in counts.items() if n}
    assert filled == set(star.BUILDERS) - {"dim_date", "fact_sales"}
    assert counts["dim_customer"] == 2


def test_tables_do_not_depend_on_partitions_or_on_the_numbering_used(spark, staging, ws):
    from martloom.plans.warehouse import Warehouse

    data = [
        sale(
            _src_file=f"F{n % 3}",
            sale_customer_id=str(n % 7),
            sale_product_id=str(n % 11),
            customer_first_name=f"name {n}",
            product_name=f"product {n}",
            product_category=f"c{n % 4}",
            supplier_name=f"s{n % 5}",
            store_city=f"city {n % 6 if n % 3 else 0}",
            sale_date=f"{n % 12 + 1}/1/202{n % 2}",
            sale_total_price=f"{n * 37 % 100}.{n % 100:02d}",
            customer_country=f"country {n % 2}",
        )
        for n in range(200)
    ]
    results = []
    for partitions, per_range in ((1, 100_000), (5, 20)):
        wh = Warehouse.land(staging(*data, partitions=partitions), ws, per_range)
        build(wh)
        results.append({n: rows(wh.table(n)) for n in (*star.BUILDERS, *marts.PLANS)})
    assert results[0] == results[1]


@pytest.mark.parametrize("dense", [True, False])
def test_of_many_keys_only_rows_that_may_be_chosen_move(ws, spark, monkeypatch, dense):
    """Four rows a key: the join with the chosen ones shuffles a row a key and few others."""
    monkeypatch.setattr(survivors, "_HASHED_KEYS", 100)
    monkeypatch.setattr(survivors, "_MOST_BITS", 1 << 15 if dense else 1 << 28)
    n = F.col("id")
    file, own = F.when(n % 2 == 0, "A").otherwise("B"), F.floor(n / 2) + (1 if dense else 7)
    data = spark.range(4_000, numPartitions=3).select(file.alias("_src_file"), own.cast("long").alias("_src_id"), (n % 1_000).alias("k"), n.cast("string").alias("x"))
    data = ws.save(data, "rows").df
    sources = read_sources(ws, data)
    assert sources.dense is dense
    may, let = survivors._perhaps_chosen, []
    monkeypatch.setattr(survivors, "_perhaps_chosen", lambda *given: (let.append(may(*given)), let[0])[1])
    got = first_by(ws, data, ["k"], sources).rows
    assert sorted(tuple(r) for r in got.collect()) == [(k, str(k)) for k in range(1_000)]
    assert 1_000 <= let[0].count() <= 1_200
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
