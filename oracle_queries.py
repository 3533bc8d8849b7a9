"""The expected result of every registered query, as SQL over the given tables.

Written from the meaning of each table, not from the engine: amounts are integer cents,
averages are rounded with integer arithmetic, survivors come from a row number.
"""

from __future__ import annotations

STAGING = """
line AS (
  SELECT *, 'MOCK_DATA_' || (l_orderkey % 10) AS src_file,
         l_orderkey*7 + l_linenumber*13 + l_partkey AS h
  FROM lineitem
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY src_file ORDER BY l_orderkey, l_linenumber,
           l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS src_id
  FROM line
),
st AS (
  SELECT src_file, src_id,
    CASE WHEN h % 101 <> 0 THEN o_custkey::INT END AS customer_id,
    c_name AS customer_first_name, c_mktsegment AS customer_last_name,
    CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'Unknown'
         ELSE cn.n_name END AS customer_country,
    ['cat', 'dog', 'bird', ''][c_custkey % 4 + 1] AS pet_type,
    ['Cats', 'Dogs', 'Birds', '', NULL][c_custkey % 5 + 1] AS pet_category,
    (o_orderkey % 100)::INT AS seller_id,
    l_partkey::INT AS product_id, p_name AS product_name,
    CASE WHEN l_partkey % 83 <> 0 THEN p_type END AS product_category,
    p_retailprice AS price, round(p_retailprice * 100)::BIGINT AS price_cents,
    CASE WHEN l_partkey % 11 <> 0 THEN p_size / 10.0::DOUBLE END AS rating,
    CASE WHEN l_partkey % 13 <> 0 THEN p_size * 3 END AS reviews,
    s_name AS supplier_name, sn.n_name AS supplier_city,
    CASE WHEN l_suppkey % 23 <> 0 THEN sr.r_name END AS supplier_country,
    CASE WHEN h % 89 <> 0 THEN c_mktsegment END AS store_name,
    cn.n_name AS store_city, cr.r_name AS store_country,
    CASE WHEN h % 97 <> 0 THEN o_orderdate::DATE END AS sale_date,
    CASE WHEN h % 103 <> 0 THEN l_quantity::INT END AS quantity,
    CASE WHEN h % 107 <> 0 THEN l_extendedprice END AS total_price,
    CASE WHEN h % 107 <> 0 THEN round(l_extendedprice * 100)::BIGINT END AS cents,
    h, o_orderdate, c_mktsegment, c_custkey, p_size
  FROM numbered
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey
)"""


def _first(key: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY src_file, src_id) = 1"


STAR = f"""
dim_pet_type AS (
  SELECT row_number() OVER (ORDER BY pet_type, pet_category)::INT AS pet_type_id,
         pet_type, pet_category
  FROM (SELECT DISTINCT pet_type, coalesce(pet_category, '') AS pet_category
        FROM st WHERE pet_type <> '')
),
dim_customer AS (
  SELECT customer_id, customer_first_name AS first_name, customer_last_name AS last_name,
         NULL::INT AS age, NULL::VARCHAR AS email, customer_country AS country,
         NULL::VARCHAR AS postal_code, pet_type_id,
         NULL::VARCHAR AS pet_name, NULL::VARCHAR AS pet_breed
  FROM (SELECT * FROM st WHERE customer_id IS NOT NULL {_first('customer_id')}) c
  LEFT JOIN dim_pet_type d
    ON c.pet_type = d.pet_type AND coalesce(c.pet_category, '') = d.pet_category
),
dim_seller AS (
  SELECT seller_id, 'Seller' AS first_name, seller_id::VARCHAR AS last_name,
         NULL::VARCHAR AS email, NULL::VARCHAR AS country, NULL::VARCHAR AS postal_code
  FROM (SELECT DISTINCT seller_id FROM st)
),
dim_product_category AS (
  SELECT row_number() OVER (ORDER BY category_name)::INT AS category_id, category_name
  FROM (SELECT DISTINCT product_category AS category_name FROM st
        WHERE product_category <> '')
),
dim_supplier AS (
  SELECT row_number() OVER (ORDER BY name, city)::INT AS supplier_id, name,
         NULL::VARCHAR AS contact, NULL::VARCHAR AS email, NULL::VARCHAR AS phone,
         NULL::VARCHAR AS address, city, country
  FROM (SELECT supplier_name AS name, supplier_city AS city, supplier_country AS country
        FROM st {_first('supplier_name, supplier_city')})
),
dim_product AS (
  SELECT product_id, p.product_name AS name, category_id, supplier_id, price,
         NULL::VARCHAR AS weight, NULL::VARCHAR AS color, NULL::VARCHAR AS size,
         NULL::VARCHAR AS brand, NULL::VARCHAR AS material, NULL::VARCHAR AS description,
         rating, reviews, NULL::DATE AS release_date, NULL::DATE AS expiry_date, price_cents
  FROM (SELECT * FROM st {_first('product_id')}) p
  LEFT JOIN dim_product_category ON product_category = category_name
  LEFT JOIN dim_supplier s ON p.supplier_name = s.name AND p.supplier_city = s.city
),
dim_store AS (
  SELECT row_number() OVER (ORDER BY name, city)::INT AS store_id, name,
         NULL::VARCHAR AS location, city, NULL::VARCHAR AS state, country,
         NULL::VARCHAR AS phone, NULL::VARCHAR AS email
  FROM (SELECT store_name AS name, store_city AS city, store_country AS country
        FROM st WHERE store_name <> '' {_first('store_name, store_city')})
),
dim_date AS (
  SELECT row_number() OVER (ORDER BY full_date)::INT AS date_id, full_date,
         day(full_date)::SMALLINT AS day, month(full_date)::SMALLINT AS month,
         year(full_date)::SMALLINT AS year, quarter(full_date)::SMALLINT AS quarter
  FROM (SELECT DISTINCT sale_date AS full_date FROM st WHERE sale_date IS NOT NULL)
),
fact AS (
  SELECT sale_id, date_id, customer_id, seller_id, product_id, store_id, quantity,
         total_price, cents
  FROM (SELECT *, row_number() OVER (ORDER BY src_file, src_id) AS sale_id FROM st) f
  JOIN dim_date ON sale_date = full_date
  LEFT JOIN dim_store s ON store_name = s.name AND store_city = s.city
)"""

CATEGORY = "coalesce(category_name, 'N/A')"
REVENUE = "(sum(cents) / 100.0)::DOUBLE AS total_revenue"


def _average(total: str, count: str) -> str:
    """Half up to cents; amounts are positive."""
    return f"((2 * ({total}) + ({count})) // (2 * ({count})) / 100.0)::DOUBLE"


BASKET = _average("sum(cents)", "count(cents)")


def _rank(value: str) -> str:
    return f"rank() OVER (ORDER BY {value} DESC NULLS LAST)::INT"


MARTS = f"""
mart_sales_by_product AS (
  SELECT product_id, d.name AS product_name, {CATEGORY} AS category_name, {REVENUE},
         sum(quantity)::BIGINT AS total_quantity, round(coalesce(rating, 0), 2) AS avg_rating,
         coalesce(reviews, 0)::INT AS total_reviews, {_rank('sum(cents)')} AS revenue_rank
  FROM fact JOIN dim_product d USING (product_id)
  LEFT JOIN dim_product_category c USING (category_id)
  GROUP BY product_id, d.name, category_name, rating, reviews
),
mart_sales_by_customer AS (
  SELECT customer_id, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS customer_name,
         coalesce(country, 'Unknown') AS country, count(*) AS total_orders, {REVENUE},
         {BASKET} AS avg_basket, {_rank('sum(cents)')} AS revenue_rank
  FROM fact JOIN dim_customer USING (customer_id)
  GROUP BY customer_id, first_name, last_name, country
),
mart_customers_by_country AS (
  SELECT coalesce(c.country, 'Unknown') AS country,
         count(DISTINCT customer_id) AS customer_count, count(*) AS total_orders, {REVENUE},
         {BASKET} AS avg_basket, {_rank('count(DISTINCT customer_id)')} AS country_rank
  FROM fact JOIN dim_customer c USING (customer_id)
  GROUP BY coalesce(c.country, 'Unknown')
),
mart_sales_by_time AS (
  SELECT year, month, 'monthly' AS period_type, count(*) AS total_orders, {REVENUE},
         {BASKET} AS avg_order_value, sum(cents) AS cents
  FROM fact JOIN dim_date USING (date_id) GROUP BY year, month
  UNION ALL
  SELECT year, 0::SMALLINT, 'yearly', count(*), {REVENUE}, {BASKET}, sum(cents)
  FROM fact JOIN dim_date USING (date_id) GROUP BY year
),
mart_sales_by_store AS (
  SELECT store_id, name AS store_name, coalesce(city, 'Unknown') AS city,
         coalesce(country, 'Unknown') AS country, count(*) AS total_orders, {REVENUE},
         {BASKET} AS avg_basket, {_rank('sum(cents)')} AS revenue_rank
  FROM fact JOIN dim_store USING (store_id)
  GROUP BY store_id, name, city, country
),
mart_sales_by_supplier AS (
  SELECT supplier_id, s.name AS supplier_name, coalesce(s.country, 'Unknown') AS country,
         {REVENUE}, {_average('sum(price_cents)', 'count(price_cents)')} AS avg_item_price,
         count(DISTINCT product_id) AS product_count, {_rank('sum(cents)')} AS revenue_rank
  FROM fact JOIN dim_product p USING (product_id) JOIN dim_supplier s USING (supplier_id)
  GROUP BY supplier_id, s.name, s.country
),
mart_suppliers_by_country AS (
  SELECT coalesce(s.country, 'Unknown') AS supplier_country,
         count(DISTINCT supplier_id) AS supplier_count,
         count(DISTINCT product_id) AS product_count, {REVENUE},
         {_rank('sum(cents)')} AS country_rank
  FROM fact JOIN dim_product p USING (product_id) JOIN dim_supplier s USING (supplier_id)
  GROUP BY coalesce(s.country, 'Unknown')
),
mart_product_quality AS (
  SELECT product_id, d.name AS product_name, {CATEGORY} AS category_name,
         coalesce(rating, 0)::DOUBLE AS rating, coalesce(reviews, 0)::INT AS reviews,
         count(*) AS sales_count, {REVENUE}, {_rank('coalesce(rating, 0)')} AS rating_rank
  FROM fact JOIN dim_product d USING (product_id)
  LEFT JOIN dim_product_category c USING (category_id)
  GROUP BY product_id, d.name, category_name, rating, reviews
)"""


def query(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts or (STAGING, STAR, MARTS)) + "\n" + select


TIME = (
    "SELECT year, month, period_type, total_orders, total_revenue, avg_order_value "
    "FROM mart_sales_by_time"
)

DIMENSIONS = (
    "dim_pet_type dim_customer dim_seller dim_product_category dim_supplier dim_store dim_date"
).split()
MART_NAMES = (
    "mart_sales_by_product mart_sales_by_customer mart_customers_by_country mart_sales_by_time "
    "mart_sales_by_store mart_sales_by_supplier mart_suppliers_by_country mart_product_quality"
).split()

PRODUCT = """SELECT product_id, name, category_id, supplier_id, price, weight, color, size, brand,
  material, description, rating, reviews, release_date, expiry_date FROM dim_product"""
FACT = """SELECT sale_id, date_id, customer_id, seller_id, product_id, store_id, quantity,
  total_price FROM fact"""


def _counts(names: list[str]) -> str:
    """Rows per table; `fact_sales` is the CTE `fact`, `staging` the CTE `st`."""
    source = {"fact_sales": "fact", "staging": "st"}
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {source.get(n, n)}" for n in names
    )


def _conflicts(table: str, keys: str, where: str, content: str) -> str:
    return f"""SELECT '{table}' AS table_name, count(*) AS keys_with_differing_digests
      FROM (SELECT {keys} FROM st WHERE {where} GROUP BY {keys}
            HAVING count(DISTINCT row({content})) > 1)"""


STAR_NAMES = [*DIMENSIONS, "dim_product", "fact_sales"]

CONFLICTS = " UNION ALL ".join(
    [
        _conflicts(
            "dim_customer",
            "customer_id",
            "customer_id IS NOT NULL",
            "customer_first_name, customer_last_name, customer_country, pet_type, "
            "coalesce(pet_category, '')",
        ),
        _conflicts("dim_seller", "seller_id", "true", "seller_id"),
        _conflicts("dim_supplier", "supplier_name, supplier_city", "true", "supplier_country"),
        _conflicts(
            "dim_product",
            "product_id",
            "true",
            "product_name, product_category, price, rating, reviews, supplier_name, supplier_city",
        ),
        _conflicts("dim_store", "store_name, store_city", "store_name <> ''", "store_country"),
    ]
)

_TEXT = {
    "id": "src_id::INT",
    "customer_first_name": "customer_first_name",
    "customer_last_name": "customer_last_name",
    "customer_country": "customer_country",
    "customer_pet_type": "pet_type",
    "seller_first_name": "'Seller'",
    "seller_last_name": "seller_id::VARCHAR",
    "product_name": "product_name",
    "product_category": "product_category",
    "product_price": "price::VARCHAR",
    "sale_date": "coalesce(strftime(sale_date, '%-m/%-d/%Y'), '')",
    "sale_customer_id": "coalesce(customer_id::VARCHAR, '')",
    "sale_seller_id": "seller_id::VARCHAR",
    "sale_product_id": "product_id::VARCHAR",
    "sale_quantity": "coalesce(quantity::VARCHAR, '')",
    "sale_total_price": "coalesce(total_price::VARCHAR, '')",
    "store_name": "coalesce(store_name, '')",
    "store_city": "store_city",
    "store_country": "store_country",
    "pet_category": "pet_category",
    "product_rating": "coalesce(rating::VARCHAR, '')",
    "product_reviews": "coalesce(reviews::VARCHAR, '')",
    "supplier_name": "supplier_name",
    "supplier_city": "supplier_city",
    "supplier_country": "supplier_country",
}


def staging_load(columns: list[str]) -> str:
    texts = ", ".join(f"{_TEXT.get(c, 'NULL::VARCHAR')} AS {c}" for c in columns)
    return query(f"SELECT src_file AS _src_file, src_id AS _src_id, {texts} FROM st", STAGING)


def all_queries(staging_columns: list[str], lookup_year: int) -> dict[str, str]:
    star = {name: query(f"SELECT * FROM {name}", STAGING, STAR) for name in DIMENSIONS}
    star["dim_product"] = query(PRODUCT, STAGING, STAR)
    star["fact_sales"] = query(FACT, STAGING, STAR)
    marts = {name: query(f"SELECT * FROM {name}") for name in MART_NAMES}
    marts["mart_sales_by_time"] = query(TIME)
    counts = [f"SELECT '{name}' AS table_name, count(*) AS row_count FROM ({sql})" for name, sql in REPORTS.items()]
    return {
        **star,
        **marts,
        **REPORTS,
        "report_counts": " UNION ALL ".join(counts),
        "staging_load": staging_load(staging_columns),
        "dedup_first_by": query(
            f"SELECT product_id, product_name AS name, supplier_name, supplier_city FROM st "
            f"{_first('product_id')}",
            STAGING,
        ),
        "surrogate_keys": query(
            """SELECT product_id, supplier_name,
                 row_number() OVER (ORDER BY product_id, supplier_name) AS pair_id
               FROM (SELECT DISTINCT product_id, supplier_name FROM st)""",
            STAGING,
        ),
        "row_numbers_by_content": query(
            """SELECT src_file AS _src_file, src_id AS _src_id,
                 row_number() OVER (ORDER BY src_file, src_id) AS row_id FROM st""",
            STAGING,
        ),
        "global_rank": query(
            "SELECT product_id, rating, rating_rank::BIGINT AS rating_rank FROM mart_product_quality"
        ),
        "star_views": query(_counts(STAR_NAMES), STAGING, STAR),
        "star_namespace": query(_counts(STAR_NAMES), STAGING, STAR),
        "write_counts": query(_counts(MART_NAMES)),
        "sink_sorted": query("SELECT * FROM mart_sales_by_product"),
        "sink_keyed": query("SELECT * FROM mart_customers_by_country"),
        "sink_upsert": query(_counts(MART_NAMES)),
        "time_mart_year_lookup": query(f"{TIME} WHERE year = {lookup_year}"),
        "mart_sample": query("SELECT * FROM mart_sales_by_product ORDER BY product_id LIMIT 10"),
        "reconciliation": query(
            f"""SELECT table_name, row_count, keys_with_differing_digests
                FROM ({_counts(['staging', *STAR_NAMES, *MART_NAMES])})
                LEFT JOIN ({CONFLICTS}) USING (table_name)"""
        ),
    }


RATED = "mart_product_quality SEMI JOIN (FROM dim_product WHERE rating IS NOT NULL) USING (product_id)"


def _correlation(y: str) -> str:
    pairs = f"FILTER (WHERE rating IS NOT NULL AND {y} IS NOT NULL)"
    constant = " OR ".join(f"min({c}) {pairs} = max({c}) {pairs}" for c in ("rating", y))
    return f"CASE WHEN {constant} THEN NULL ELSE round(corr(rating, {y}) {pairs}, 6) END"


REPORTS = {
    "top10_products": query(
        "SELECT * FROM mart_sales_by_product ORDER BY revenue_rank, product_id LIMIT 10"
    ),
    "revenue_by_category": query(
        f"""SELECT {CATEGORY} AS category_name, sum(quantity)::BIGINT AS total_quantity, {REVENUE}
            FROM fact JOIN dim_product USING (product_id)
            LEFT JOIN dim_product_category USING (category_id) GROUP BY 1""",
        STAGING,
        STAR,
    ),
    "product_ratings": query(
        "SELECT product_id, product_name, avg_rating, total_reviews FROM mart_sales_by_product"
    ),
    "top10_customers": query(
        "SELECT * FROM mart_sales_by_customer ORDER BY revenue_rank, customer_id LIMIT 10"
    ),
    "customers_by_country": query(
        "SELECT * FROM mart_customers_by_country ORDER BY country_rank, country"
    ),
    "customer_avg_basket": query(
        "SELECT customer_id, customer_name, avg_basket FROM mart_sales_by_customer"
    ),
    "sales_trends": query(f"{TIME} ORDER BY year, month"),
    "revenue_period_over_period": query(
        """SELECT year, month, period_type, total_revenue,
             lag(total_revenue) OVER w AS previous_revenue,
             ((cents - lag(cents) OVER w) / 100.0)::DOUBLE AS revenue_change,
             total_revenue / nullif(lag(total_revenue) OVER w, 0) AS revenue_ratio
           FROM mart_sales_by_time
           WINDOW w AS (PARTITION BY period_type ORDER BY year, month)"""
    ),
    "monthly_avg_order": query(
        "SELECT year, month, avg_order_value FROM mart_sales_by_time WHERE period_type = 'monthly'"
    ),
    "top5_stores": query(
        "SELECT * FROM mart_sales_by_store ORDER BY revenue_rank, store_id LIMIT 5"
    ),
    "sales_by_city_country": query(
        f"""SELECT CASE grouping_id(c, t) WHEN 0 THEN 'city' WHEN 1 THEN 'country' ELSE 'total' END AS level,
              c AS country, t AS city, count(*) AS total_orders, {REVENUE}, {BASKET} AS avg_basket
            FROM (SELECT cents, coalesce(country, 'Unknown') AS c, city AS t
                  FROM fact JOIN dim_store USING (store_id))
            GROUP BY ROLLUP (c, t)""",
        STAGING,
        STAR,
    ),
    "store_avg_basket": query("SELECT store_id, store_name, avg_basket FROM mart_sales_by_store"),
    "top5_suppliers": query(
        "SELECT * FROM mart_sales_by_supplier ORDER BY revenue_rank, supplier_id LIMIT 5"
    ),
    "supplier_avg_price": query(
        f"""SELECT supplier_id, supplier_name, avg_item_price, avg_product_price
            FROM mart_sales_by_supplier JOIN (
              SELECT supplier_id,
                     {_average('sum(price_cents)', 'count(price_cents)')} AS avg_product_price
              FROM dim_product GROUP BY supplier_id) USING (supplier_id)"""
    ),
    "suppliers_by_country": query(
        "SELECT * FROM mart_suppliers_by_country ORDER BY country_rank, supplier_country"
    ),
    "rating_extremes": query(
        f"""(SELECT *, 'highest' AS extreme FROM {RATED} ORDER BY rating DESC, product_id LIMIT 10)
            UNION ALL
            (SELECT *, 'lowest' AS extreme FROM {RATED} ORDER BY rating, product_id LIMIT 10)"""
    ),
    "rating_sales_correlation": query(
        f"""SELECT count(*) AS products, {_correlation('sales_count')} AS corr_sales_count,
              {_correlation('total_revenue')} AS corr_total_revenue
            FROM {RATED}"""
    ),
    "most_reviewed_products": query(
        "SELECT * FROM mart_product_quality ORDER BY reviews DESC, product_id LIMIT 10"
    ),
}
