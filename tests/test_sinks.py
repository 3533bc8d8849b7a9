import dataclasses
import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows, sale
from martloom import manifest, pipeline
from martloom.plans import marts, reports, star
from martloom.quality import ContractError, assert_contract, assert_unique
from martloom.schemas import MARTS, REPORT_TABLES, STAR
from martloom.sinks import sinks
from martloom.sinks.sinks import FileSink, KeyedSink, OlapSink, UpsertSink, wide_column_sink, write_counted
from martloom.sources import jdbc
from martloom.sources.files import read_staging_parquet
from martloom.sources.jdbc import Database, Split
from martloom.workspace import Saved

TIME = MARTS["mart_sales_by_time"]
COUNTRY = MARTS["mart_customers_by_country"]
DB = Database("jdbc:x://host/db", {"user": "u", "driver": "D"})


def periods(spark, *pairs):
    data = [(y, m, "yearly" if m == 0 else "monthly", 1, 1.0, 1.0) for y, m in pairs]
    return spark.createDataFrame(data, TIME.schema)


def countries(spark, *names):
    return spark.createDataFrame([(n, 1, 1, 1.0, 1.0, 1) for n in names], COUNTRY.schema)


def test_a_second_write_replaces_the_first(spark, tmp_path):
    sink = FileSink(str(tmp_path), {"t": ("year",)})
    assert write_counted(periods(spark, (2020, 1), (2020, 2), (2021, 0)), "t", TIME, sink) == 3
    assert write_counted(periods(spark, (2022, 3)), "t", TIME, sink) == 1
    assert rows(sink.read(spark, "t", TIME), "year", "month") == [(2022, 3)]


def test_files_are_sorted_and_keep_their_types(spark, tmp_path):
    sink = FileSink(str(tmp_path))
    data = periods(spark, *[(2000 + n * 7 % 20, n % 13) for n in range(100)])
    write_counted(data.coalesce(1), "t", TIME, sink)
    back = sink.read(spark, "t", TIME)
    assert back.schema.simpleString() == TIME.schema.simpleString()
    keys = [(r.year, r.month) for r in back.collect()]
    assert keys == sorted(keys) and len(keys) == 100


def test_a_lookup_opens_one_year(spark, tmp_path):
    sink = FileSink(str(tmp_path), {"t": ("year",)})
    write_counted(periods(spark, (2020, 1), (2021, 1), (2021, 0)), "t", TIME, sink)
    found = sink.read(spark, "t", TIME).where("year = 2021")
    assert rows(found, "year", "month") == [(2021, 0), (2021, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "= 2021)]" in plan.split("PartitionFilters: ")[1].splitlines()[0].split("PushedFilters")[0]
    assert "DataFilters: []" in plan


def test_a_wrong_schema_is_refused(spark, tmp_path):
    with pytest.raises(ContractError):
        write_counted(periods(spark, (2020, 1)).drop("month"), "t", TIME, FileSink(str(tmp_path)))
    with pytest.raises(ContractError):
        wide = periods(spark, (2020, 1)).selectExpr("int(year) year", "* except (year)")
        write_counted(wide, "t", TIME, FileSink(str(tmp_path)))


def test_keys_must_be_unique_and_complete(spark):
    assert_contract(Saved(countries(spark, "a", "b"), 2), COUNTRY)
    for names in (["a", "a"], ["a", None]):
        with pytest.raises(ContractError):
            assert_unique(countries(spark, *names), COUNTRY.keys)


def test_a_keyed_store_gets_unique_keys(spark, tmp_path):
    sink = KeyedSink("parquet", table_option="path", prefix=f"{tmp_path}/")
    assert write_counted(countries(spark, "a", "b"), "t", COUNTRY, sink) == 2
    with pytest.raises(ContractError):
        write_counted(countries(spark, "c", "c"), "t", COUNTRY, sink)
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "country") == [("a",), ("b",)]


def test_wide_column_options():
    sink = wide_column_sink("reports")
    assert sink.format == "org.apache.spark.sql.cassandra"
    assert sink.write_options("mart_sales_by_time") == {
        "keyspace": "reports", "table": "mart_sales_by_time", "confirm.truncate": "true",
    }


def test_olap_options():
    sink = OlapSink(DB)
    assert sink.table_options(TIME) == "ENGINE = MergeTree() ORDER BY (year, month)"
    assert sink.table_options(COUNTRY) == "ENGINE = MergeTree() ORDER BY (country_rank)"
    assert sink.table_options(STAR["dim_date"]) == "ENGINE = MergeTree() ORDER BY tuple()"


def test_jdbc_write_options():
    assert jdbc.write_options(DB, "star.dim_date", 500, 4, None) == {
        "user": "u", "driver": "D", "url": DB.url, "dbtable": "star.dim_date",
        "batchsize": "500", "numPartitions": "4", "truncate": "true",
    }
    created = jdbc.write_options(DB, "m", 500, 4, "ENGINE = MergeTree() ORDER BY tuple()")
    assert created["truncate"] == "false"
    assert created["createTableOptions"] == "ENGINE = MergeTree() ORDER BY tuple()"


def test_jdbc_scan_options():
    whole = jdbc.scan_options(DB, "t", None, 100)
    assert "numPartitions" not in whole and whole["fetchsize"] == "100"
    parts = jdbc.scan_options(DB, "t", Split("id", 1, datetime.date(2021, 1, 1), 16), 100)
    assert (parts["partitionColumn"], parts["lowerBound"]) == ("id", "1")
    assert (parts["upperBound"], parts["numPartitions"]) == ("2021-01-01", "16")


def test_jdbc_sinks_pass_the_table_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sinks, "write_jdbc", lambda df, db, table, **kw: seen.append((table, kw)))
    sinks.JdbcSink(DB, "star.").write(countries(spark, "a"), "t", COUNTRY)
    sinks.OlapSink(DB, connections=64, batch_size=500).write(countries(spark, "a"), "t", COUNTRY)
    assert seen == [
        ("star.t", {"batch_size": 10_000, "connections": 8}),
        ("t", {"batch_size": 500, "connections": 64, "create_table_options": "ENGINE = MergeTree() ORDER BY (country_rank)"}),
    ]


def test_a_namespace_names_written_files(spark, warehouse, tmp_path):
    wh = warehouse(sale(), sale(store_city="Quito"))
    sinks.ensure_namespace(spark, "test_star", str(tmp_path / "db"))
    for _ in range(2):
        sinks.publish(spark, "test_star", "dim_store", wh.saved("dim_store").path, STAR["dim_store"])
    assert spark.sql("SELECT city FROM test_star.dim_store ORDER BY store_id").collect() == [("Lima",), ("Quito",)]
    wh.register_views()
    assert spark.sql("SELECT count(*) FROM fact_sales JOIN dim_store USING (store_id)").first()[0] == 2
    spark.sql("DROP DATABASE test_star CASCADE")
    assert wh.table("dim_store").count() == 2


def test_a_whole_run(spark, staging, tmp_path):
    data = staging(
        *[sale(sale_product_id=str(n % 3), sale_date=f"{n % 2 + 1}/1/2021") for n in range(30)],
        sale(sale_date="", customer_first_name="Bob"),
    )
    first, second = (pipeline.run(spark, data, str(tmp_path)) for _ in range(2))
    assert first.folder != second.folder
    report = {r.table_name: (r.row_count, r.keys_with_differing_digests) for r in first.reconciliation.collect()}
    assert set(report) == {"staging", *star.BUILDERS, *marts.PLANS}
    assert report["staging"] == (31, None) and report["fact_sales"] == (30, None)
    assert report["dim_customer"] == (1, 1) and report["dim_store"] == (1, 0)
    for name in marts.PLANS:
        assert first.counts[name] == [report[name][0]] * 2
        assert Path(first.folder, "marts", name).is_dir()
    assert first.counts["fact_sales"] == [30]
    assert set(first.reports) == set(reports.REPORTS)
    assert first.reports["top10_products"].count() == 3
    files = FileSink(f"{first.folder}/reports")
    for name, table in REPORT_TABLES.items():
        back = files.read(spark, name, table)
        assert first.counts[name] == [back.count()] * 2
        assert rows(back) == rows(first.reports[name])
    for name, table in {**STAR, **MARTS}.items():
        assert_contract(first.warehouse.saved(name), table)


def test_marts_over_an_existing_star(spark, warehouse, tmp_path):
    wh = warehouse(
        *[sale(sale_product_id=str(n % 3), sale_customer_id=str(n % 4)) for n in range(20)]
    )
    wh.build_star()
    # A database may hand back wider types; the seller is in no mart.
    tables = {n: wh.table(n) for n in star.BUILDERS if n != "dim_seller"}
    tables["dim_date"] = tables["dim_date"].selectExpr(
        "date_id", "full_date", "int(day) day", "int(month) month", "int(year) year", "int(quarter) quarter"
    )
    done = pipeline.run_marts(spark, tables, str(tmp_path))
    for name in marts.PLANS:
        assert rows(done.warehouse.table(name)) == rows(wh.table(name))
    done.warehouse.register_views()
    assert done.reports["top10_products"].count() == 3
    found = {r.table_name: tuple(r)[1:] for r in done.reconciliation.collect()}
    assert found["fact_sales"] == (20, None) and found["dim_product"] == (3, 0) and found["dim_customer"] == (4, 0)
    assert set(found) == {*tables, *marts.PLANS}


def test_sales_without_a_row_are_counted(spark, warehouse, tmp_path):
    wh = warehouse(*[sale(sale_product_id=str(n % 3)) for n in range(20)])
    wh.build_star()
    tables = {n: wh.table(n) for n in star.BUILDERS}
    tables["dim_product"] = tables["dim_product"].where("product_id > 0")
    found = {r.table_name: r.sales_without_row for r in pipeline.run_marts(spark, tables, str(tmp_path)).reconciliation.collect()}
    assert found["dim_product"] == 7 and found["dim_store"] == 0 and found["mart_sales_by_store"] is None


def test_the_star_goes_to_a_sink_as_well(spark, staging, tmp_path):
    sink = FileSink(str(tmp_path / "star"))
    done = pipeline.run(spark, staging(sale(), sale()), str(tmp_path), star_sinks=[sink])
    assert done.counts["fact_sales"] == [2, 2]
    assert sink.read(spark, "fact_sales", STAR["fact_sales"]).count() == 2


def test_a_doubled_key_is_refused(spark, warehouse, tmp_path):
    wh = warehouse(sale(), sale(sale_customer_id="2"))
    wh.build_star()
    tables = {n: wh.table(n) for n in star.BUILDERS}
    tables["dim_customer"] = tables["dim_customer"].union(tables["dim_customer"].limit(1))
    with pytest.raises(ContractError, match="dim_customer: key .*not unique"):
        pipeline.run_marts(spark, tables, str(tmp_path))


def test_a_folder_without_the_right_columns_is_refused(spark, staging, tmp_path):
    staging(sale()).drop("sale_total_price").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ContractError, match="sale_total_price"):
        read_staging_parquet(spark, str(tmp_path / "short"))


def test_landed_rows_are_not_copied(spark, staging, tmp_path):
    staging(sale(), sale(sale_date="")).write.parquet(str(tmp_path / "landed"))
    landed = read_staging_parquet(spark, str(tmp_path / "landed"))
    done = pipeline.run(spark, landed, str(tmp_path), landed=True)
    assert done.warehouse.staging is landed
    assert done.reconciliation.where("table_name = 'staging'").first().row_count == 2
    assert not list(Path(done.folder, "tables").glob("staging*"))


def folders(run):
    return {p.name.rsplit("-", 1)[0] for p in Path(run.folder, "tables").iterdir()}


def test_after_a_run_only_its_results_remain(spark, staging, tmp_path):
    done = pipeline.run(spark, staging(*[sale(sale_product_id=str(n)) for n in range(5)]), str(tmp_path))
    assert folders(done) == {*star.BUILDERS, *marts.PLANS, *reports.REPORTS, "reconciliation"}
    assert done.warehouse.table("fact_sales").count() == 5


def test_readers_see_the_newest_whole_run(spark, staging, tmp_path, monkeypatch):
    out = str(tmp_path)
    assert manifest.latest(spark, out) is None
    one = pipeline.run(spark, staging(sale()), out)
    two = pipeline.run(spark, staging(sale(), sale()), out)
    assert [m.run for m in manifest.manifests(spark, out)] == [Path(r.folder).name for r in (two, one)]
    assert manifest.latest(spark, out).table("fact_sales").count() == 2
    assert set(manifest.latest(spark, out).tables) == {*star.BUILDERS, *marts.PLANS, *reports.REPORTS, "reconciliation"}

    def stop(*_):
        raise RuntimeError("cut off")

    monkeypatch.setattr(pipeline, "commit", stop)
    with pytest.raises(RuntimeError, match="cut off"):
        pipeline.run(spark, staging(sale(), sale(), sale()), out)
    (tmp_path / "run-half").mkdir()
    (tmp_path / "run-half" / manifest.NAME).write_text('{"number": 9, "run"')
    assert manifest.latest(spark, out).run == Path(two.folder).name

    assert manifest.retire(spark, out, 1) == [Path(one.folder).name]
    assert not Path(one.folder).exists() and manifest.latest(spark, out).table("fact_sales").count() == 2
    assert len([p for p in tmp_path.glob("run-*")]) == 3  # the newest, the one cut off, the one half written


def test_a_namespace_follows_the_run_or_stays(spark, staging, tmp_path, monkeypatch):
    runs = [pipeline.run(spark, staging(*[sale()] * n), str(tmp_path)) for n in (1, 2)]
    place = str(tmp_path / "db")
    try:
        runs[0].manifest.publish("test_runs", place)
        assert spark.table("test_runs.fact_sales").count() == 1
        named = manifest.publish

        def fails_late(spark, namespace, name, *rest):
            if name == "mart_product_quality":
                raise RuntimeError("no catalog")
            named(spark, namespace, name, *rest)

        monkeypatch.setattr(manifest, "publish", fails_late)
        with pytest.raises(RuntimeError, match="no catalog"):
            runs[1].manifest.publish("test_runs", place)
        assert spark.table("test_runs.fact_sales").count() == 1
        monkeypatch.undo()
        runs[1].manifest.publish("test_runs", place)
        assert spark.table("test_runs.fact_sales").count() == 2
        assert spark.table("test_runs.reconciliation").where("table_name = 'staging'").first().row_count == 2
    finally:
        spark.sql("DROP DATABASE IF EXISTS test_runs CASCADE")


def names_of(spark, sink, name="t"):
    return [r.country for r in sink.read(spark, name, COUNTRY).orderBy("country").collect()]


def test_an_upsert_rewrites_one_bucket(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), buckets=8)
    everyone = [f"c{n}" for n in range(60)]
    assert write_counted(countries(spark, *everyone), "t", COUNTRY, sink) == 60
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    changed = countries(spark, *everyone).withColumn("total_orders", F.when(F.col("country") == "c7", 5).otherwise(F.col("total_orders")).cast("bigint"))
    changed = spark.createDataFrame(changed.collect(), COUNTRY.schema)
    assert write_counted(changed, "t", COUNTRY, sink) == 60
    kept = [p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len({p.parent for p in files} - {p.parent for p in kept}) == 1
    assert names_of(spark, sink) == sorted(everyone)
    assert rows(sink.read(spark, "t", COUNTRY).where("total_orders = 5"), "country") == [("c7",)]
    assert sink.upsert(changed, "t", COUNTRY) == []
    assert not list(tmp_path.glob("_incoming*"))


def test_an_upsert_leaves_other_keys(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), buckets=2)
    write_counted(countries(spark, "a", "b"), "t", COUNTRY, sink)
    assert write_counted(countries(spark, "b", "c"), "t", COUNTRY, sink) == 2
    assert names_of(spark, sink) == ["a", "b", "c"]
    assert write_counted(countries(spark), "t", COUNTRY, sink) == 0
    assert names_of(spark, sink) == ["a", "b", "c"]
    with pytest.raises(ContractError, match="not unique"):
        write_counted(countries(spark, "d", "d"), "t", COUNTRY, sink)
    with pytest.raises(ValueError, match="buckets, not 3"):
        UpsertSink(str(tmp_path), buckets=3).upsert(countries(spark, "a"), "t", COUNTRY)


def test_a_key_with_nulls_is_upserted_once(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), buckets=2)
    for _ in range(2):
        write_counted(spark.createDataFrame([(2020, None, "x", 1, 1.0, 1.0), (None, None, "x", 1, 1.0, 1.0)], TIME.schema), "t", dataclasses.replace(TIME, rollup=True), sink)
    assert sink.read(spark, "t", TIME).count() == 2


def test_a_sink_that_loses_rows_stops_the_run(spark, staging, tmp_path):
    class Loses(FileSink):
        def write(self, df, name, table):
            super().write(df.limit(1), name, table)

    data = staging(sale(sale_customer_id="1"), sale(sale_customer_id="2"))
    with pytest.raises(ContractError, match="row counts"):
        pipeline.run(spark, data, str(tmp_path), sinks=[Loses(str(tmp_path / "x"))])
