"""Full refresh as a job: spark-submit refresh.py --csv 'exports/*.csv' --out /shared/runs

Reads staging rows from CSV files, from a landed Parquet folder or from a database table,
or a finished star from a database, and fills the sinks that are named.
"""

from __future__ import annotations

import argparse
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from martloom import pipeline
from martloom.manifest import retire
from martloom.schemas import SOURCE_FILE, SOURCE_ID, STAR
from martloom.sinks.sinks import FileSink, JdbcSink, OlapSink, Sink, UpsertSink, wide_column_sink
from martloom.sources.files import landed_columns, read_staging_csv, read_staging_parquet
from martloom.sources.jdbc import BATCH_SIZE, CONNECTIONS, Database, read_jdbc, split_by


def database(url: str | None, properties: list[str], file: str | None = None) -> Database:
    """Properties of the command line win over those of the file, where passwords belong."""
    lines = Path(file).read_text().splitlines() if file else []
    kept = [line.strip() for line in lines if "=" in line and not line.lstrip().startswith("#")]
    pairs = (p.split("=", 1) for p in [*kept, *properties])
    return Database(url, {name.strip(): value.strip() for name, value in pairs})


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv", help="files or a folder of exports")
    source.add_argument("--parquet", help="folder of landed staging rows")
    source.add_argument("--staging-table", help="staging table of the database at --url")
    source.add_argument("--star-prefix", help="star tables of the database at --url, e.g. 'star.'")
    parser.add_argument("--out", required=True, help="folder that every executor reaches")
    parser.add_argument("--url", help="JDBC URL of the source database")
    parser.add_argument("--property", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--properties-file", help="NAME=VALUE lines for --url, such as the password")
    parser.add_argument("--connections", type=int, default=CONNECTIONS, help="connections per written table")
    parser.add_argument("--batch-size", type=int, default=BATCH_SIZE, help="rows per written batch")
    parser.add_argument("--parts", type=int, default=64, help="parts of a database scan")
    parser.add_argument("--strict-header", action="store_true")
    parser.add_argument("--write-star", metavar="PREFIX", help="write the star back to --url")
    parser.add_argument("--publish", metavar="NAMESPACE", help="point the tables of a namespace to the finished run")
    parser.add_argument("--keep", type=int, help="runs to keep below --out; older finished ones are removed")
    parser.add_argument("--upsert", help="write the marts by key to tables below this folder: only changed buckets are rewritten")
    parser.add_argument("--files", help="write marts and reports as Parquet to a new folder below this one")
    parser.add_argument("--olap-url", help="write the marts to a columnar database")
    parser.add_argument("--olap-property", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--olap-properties-file", help="NAME=VALUE lines for --olap-url")
    parser.add_argument("--keyspace", help="write the marts to a wide-column store")
    return parser.parse_args()


def mart_sinks(args: argparse.Namespace) -> list[Sink]:
    sinks: list[Sink] = []
    if args.files:
        new = f"{args.files.rstrip('/')}/run-{uuid.uuid4().hex}"
        sinks.append(FileSink(new, {"mart_sales_by_time": ("year",)}))
    if args.upsert:
        sinks.append(UpsertSink(args.upsert))
    if args.olap_url:
        olap = database(args.olap_url, args.olap_property, args.olap_properties_file)
        sinks.append(OlapSink(olap, args.connections, args.batch_size))
    if args.keyspace:
        sinks.append(wide_column_sink(args.keyspace))
    return sinks


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("refresh of the retail marts").getOrCreate()
    db = database(args.url, args.property, args.properties_file)

    def table(name: str, column: str):
        return read_jdbc(spark, db, name, split_by(spark, db, name, column, args.parts))

    if args.star_prefix:
        tables = {
            name: table(args.star_prefix + name, contract.keys[0]) for name, contract in STAR.items()
        }
        done = pipeline.run_marts(spark, tables, args.out, mart_sinks(args))
    else:
        if args.csv:
            staging = read_staging_csv(spark, args.csv, args.strict_header)
        elif args.parquet:
            staging = read_staging_parquet(spark, args.parquet)
        else:
            # A database table does not say which file a row came from: the ids repeat.
            rows = table(args.staging_table, "id")
            staging = landed_columns(
                rows.withColumn(SOURCE_FILE, F.lit(args.staging_table)).withColumn(
                    SOURCE_ID, F.col("id")
                )
            )
        star_sinks = [JdbcSink(db, args.write_star, args.connections, args.batch_size)] if args.write_star else []
        done = pipeline.run(
            spark, staging, args.out, mart_sinks(args), star_sinks, landed=bool(args.parquet)
        )
    if args.publish:
        done.manifest.publish(args.publish)
    if args.keep:
        retire(spark, args.out, args.keep)
    for name, counts in done.counts.items():
        print(name, counts)
    done.reconciliation.orderBy("table_name").show(30, truncate=False)
    print(done.folder)


if __name__ == "__main__":
    main()
