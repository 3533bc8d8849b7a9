import pytest

from conftest import rows, sale
from martloom.plans import reports


def test_countries_missing_unknown_and_blank(warehouse):
    countries = [None, "Unknown", "", "Peru"]
    wh = warehouse(*[sale(sale_customer_id=str(n), customer_country=c) for n, c in enumerate(countries)])
    mart = wh.table("mart_customers_by_country")
    assert rows(mart, "country", "customer_count", "country_rank") == [
        ("", 1, 2), ("Peru", 1, 2), ("Unknown", 2, 1),
    ]


def test_supplier_countries_missing_and_unknown(warehouse):
    wh = warehouse(
        sale(sale_product_id="1", supplier_name="A", supplier_country=None),
        sale(sale_product_id="2", supplier_name="B", supplier_country="Unknown"),
        sale(sale_product_id="3", supplier_name="B", supplier_country="Unknown"),
    )
    mart = wh.table("mart_suppliers_by_country")
    assert rows(mart) == [("Unknown", 2, 3, 30.0, 1)]


def test_a_missing_city_is_blank(warehouse):
    wh = warehouse(sale(store_city=None, store_country=None))
    assert rows(wh.table("mart_sales_by_store"), "city", "country") == [("", "Unknown")]


def test_a_product_without_prices_ranks_last(warehouse):
    wh = warehouse(
        sale(sale_product_id="1", sale_total_price=""),
        sale(sale_product_id="2", sale_total_price="0"),
        sale(sale_product_id="3", sale_total_price="5"),
    )
    mart = wh.table("mart_sales_by_product")
    assert rows(mart, "product_id", "total_revenue", "revenue_rank") == [
        (1, None, 3), (2, 0.0, 2), (3, 5.0, 1),
    ]


def test_missing_attributes_have_their_stand_ins(warehouse):
    wh = warehouse(
        sale(product_category=None, product_rating="", product_reviews=None,
             customer_first_name=None, customer_last_name=None, customer_country=None)
    )
    product = wh.table("mart_sales_by_product").first()
    assert (product.category_name, product.avg_rating, product.total_reviews) == ("N/A", 0.0, 0)
    customer = wh.table("mart_sales_by_customer").first()
    assert (customer.customer_name, customer.country) == (" ", "Unknown")
    quality = wh.table("mart_product_quality").first()
    assert (quality.rating, quality.reviews, quality.sales_count) == (0.0, 0, 1)


def test_sales_without_a_key_are_missing_only_there(warehouse):
    wh = warehouse(
        sale(sale_customer_id="", sale_total_price="1"),
        sale(sale_product_id="2", store_name="", sale_total_price="2"),
        sale(supplier_name="", sale_product_id="3", sale_total_price="4"),
    )

    def total(mart):
        return sum(r[0] for r in rows(wh.table(mart), "total_revenue"))

    assert total("mart_sales_by_customer") == 6
    assert total("mart_sales_by_store") == 5
    assert total("mart_sales_by_supplier") == 3
    assert total("mart_sales_by_product") == 7
    assert rows(wh.table("mart_sales_by_time").where("month = 0"), "total_revenue") == [(7.0,)]


def test_an_average_price_weighs_sales(warehouse):
    wh = warehouse(
        *[sale(sale_product_id="1", product_price="10")] * 3,
        sale(sale_product_id="2", product_price="20"),
        sale(sale_product_id="3", product_price=""),
    )
    assert rows(wh.table("mart_sales_by_supplier"), "avg_item_price", "product_count") == [(12.5, 3)]
    assert rows(reports.supplier_avg_price(wh), "avg_item_price", "avg_product_price") == [(12.5, 15.0)]


def test_months_add_up_to_years(warehouse):
    wh = warehouse(
        *[sale(sale_date=f"{m}/3/{y}", sale_total_price=f"{m}.01") for m in (1, 2, 12) for y in (2020, 2021)]
    )
    mart = wh.table("mart_sales_by_time")
    assert rows(mart.where("year = 2020"), "month", "period_type", "total_orders", "total_revenue") == [
        (0, "yearly", 3, 15.03), (1, "monthly", 1, 1.01), (2, "monthly", 1, 2.01), (12, "monthly", 1, 12.01),
    ]
    changes = reports.revenue_period_over_period(wh).where("year = 2021 AND month IN (0, 1)")
    assert rows(changes, "month", "previous_revenue", "revenue_change", "revenue_ratio") == [
        (0, 15.03, 0.0, 1.0), (1, 12.01, -11.0, 1.01 / 12.01),
    ]


def test_ties_at_the_cut(warehouse):
    prices = [100 - n for n in range(9)] + [50, 50, 50]
    wh = warehouse(
        *[sale(sale_product_id=str(40 - n), sale_total_price=str(p)) for n, p in enumerate(prices)]
    )
    top = reports.top10_products(wh).collect()
    assert [r.product_id for r in top] == [*range(40, 31, -1), 29]
    assert [r.revenue_rank for r in top] == [*range(1, 10), 10]


@pytest.mark.parametrize(
    "ratings, sales, expected",
    [(["3", "3", "3"], [1, 2, 3], None), (["3"], [2], None), (["1", "2"], [1, 3], 1.0), (["2", "1"], [1, 3], -1.0)],
)
def test_correlation_of_few_or_constant_values(warehouse, ratings, sales, expected):
    data = [
        sale(sale_product_id=str(n), product_rating=rating)
        for n, (rating, count) in enumerate(zip(ratings, sales))
        for _ in range(count)
    ]
    got = reports.rating_sales_correlation(warehouse(*data)).first()
    assert (got.products, got.corr_sales_count) == (len(ratings), expected)


def test_an_unrated_product_is_neither_best_nor_worst(warehouse):
    wh = warehouse(
        sale(sale_product_id="1", product_rating=""),
        sale(sale_product_id="2", product_rating="0"),
        sale(sale_product_id="3", product_rating="4.9"),
    )
    got = rows(reports.rating_extremes(wh), "extreme", "product_id")
    assert got == [("highest", 2), ("highest", 3), ("lowest", 2), ("lowest", 3)]


def test_cities_roll_up(warehouse):
    wh = warehouse(
        sale(store_city="Lima", store_country="Peru"),
        sale(store_city="Cusco", store_country="Peru"),
        sale(store_city="X", store_country=None),
    )
    assert rows(reports.sales_by_city_country(wh), "level", "country", "city", "total_orders") == [
        ("city", "Peru", "Cusco", 1), ("city", "Peru", "Lima", 1), ("city", "Unknown", "X", 1),
        ("country", "Peru", None, 2), ("country", "Unknown", None, 1), ("total", None, None, 3),
    ]


def test_one_key_with_most_of_the_sales(warehouse):
    wh = warehouse(*[sale(sale_product_id="1" if n % 3 else str(n), sale_total_price="0.1") for n in range(300)])
    hot = wh.table("mart_sales_by_product").where("product_id = 1").first()
    assert (hot.total_revenue, hot.total_quantity, hot.revenue_rank) == (20.0, 200, 1)


def test_a_very_large_sale_keeps_its_revenue(warehouse):
    wh = warehouse(sale(sale_product_id="1", sale_total_price="1e15"), sale(sale_product_id="2", sale_total_price="10"))
    got = wh.table("mart_sales_by_product").select("product_id", "total_revenue", "revenue_rank").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1e15, 1), (2, 10.0, 2)]
