import random
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows, sale
from martloom.quality import ContractError
from martloom.schemas import STAGING_COLUMNS
from martloom.sources import records
from martloom.sources.files import read_staging_csv
from martloom.sources.records import broken_records, lines_of

HEADER = ",".join(STAGING_COLUMNS)


def line(number, first, last, rest=47):
    return f"{number},{first},{last}" + "," * rest


def write(folder, name, *lines, header=HEADER):
    (folder / name).write_text("\n".join([header, *lines]) + "\n")
    return str(folder / "MOCK_DATA*.csv")


def names(df):
    return rows(df, "_src_file", "_src_id", "customer_first_name", "customer_last_name")


def test_null_blank_quotes_and_newlines(spark, tmp_path):
    path = write(
        tmp_path, "MOCK_DATA.csv",
        line(1, "", '"he said ""hi"", ok"'),
        line(2, '""', '"two\nlines"'),
    )
    assert names(read_staging_csv(spark, path)) == [
        ("MOCK_DATA.csv", 1, None, 'he said "hi", ok'),
        ("MOCK_DATA.csv", 2, "", "two\nlines"),
    ]


def test_source_file_is_the_plain_name(spark, tmp_path):
    path = write(tmp_path, "MOCK_DATA (1).csv", line(1, "a", "b"))
    write(tmp_path, "MOCK_DATA%20+2.csv", line(1, "c", "d"))
    assert names(read_staging_csv(spark, path)) == [
        ("MOCK_DATA (1).csv", 1, "a", "b"),
        ("MOCK_DATA%20+2.csv", 1, "c", "d"),
    ]


SHORT, LONG = line(2, "a", "b", rest=3), line(2, "a", "b", rest=60)


@pytest.mark.parametrize("bad", [line("x", "a", "b"), SHORT, LONG])
@pytest.mark.parametrize("broken", [True, False])
def test_a_bad_row_stops_the_load(spark, tmp_path, bad, broken):
    path = write(tmp_path, "MOCK_DATA.csv", line(1, "a", '"x\ny"' if broken else "b"), bad)
    with pytest.raises(Exception, match="MALFORMED"):
        read_staging_csv(spark, path).collect()


@pytest.mark.parametrize("bad", [SHORT, LONG])
def test_a_row_of_another_width_stops_any_read(spark, tmp_path, bad):
    path = write(tmp_path, "MOCK_DATA.csv", line(1, "a", "b"), bad)
    with pytest.raises(Exception, match="MALFORMED"):
        read_staging_csv(spark, path).select("customer_first_name").collect()


def test_header_order(spark, tmp_path):
    swapped = HEADER.replace("customer_first_name,customer_last_name", "customer_last_name,customer_first_name")
    path = write(tmp_path, "MOCK_DATA.csv", line(1, "a", "b"), header=swapped)
    assert names(read_staging_csv(spark, path)) == [("MOCK_DATA.csv", 1, "a", "b")]
    with pytest.raises(Exception, match="header"):
        read_staging_csv(spark, path, strict_header=True).collect()


def test_source_folders(spark, tmp_path):
    for n in (1, 2):
        folder = tmp_path / f"_src_file=F{n}"
        folder.mkdir()
        write(folder, "part.csv", line(1, "a", "b"))
    assert names(read_staging_csv(spark, str(tmp_path))) == [("F1", 1, "a", "b"), ("F2", 1, "a", "b")]


def test_pieces_of_folders_keep_all_rows(spark, tmp_path, staging):
    data = staging(*[{"_src_file": f"F{i % 3}", "customer_email": v} for i, v in enumerate(["", None, 'q"x', "a,b", "x\ny"] * 20)])
    (
        data.select("_src_file", *STAGING_COLUMNS)
        .write.partitionBy("_src_file")
        .options(header=True, escape='"', maxRecordsPerFile=7)
        .csv(str(tmp_path / "out"))
    )
    back = read_staging_csv(spark, str(tmp_path / "out"))
    assert data.exceptAll(back).isEmpty() and back.exceptAll(data).isEmpty()


@contextmanager
def small_ranges(spark, size="4k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(text):
    return "" if text is None else '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["700", "4k", "128m"])
def test_records_broken_over_lines_and_ranges(spark, tmp_path, size, end):
    """Breaks, quotes and blank lines in texts, texts longer than a range, and files with none of them."""
    rnd = random.Random(7)
    pieces = ["a", '"', "\n", "\n\n", ",", " ", "é", "word", '""', "\r\n"]
    want = []
    for name in "XYZ":
        rows = []
        for k in range(1, 120):
            first = "".join(rnd.choices(pieces, k=rnd.randrange(12))) if name != "Z" and k % 3 else "plain"
            last = ("long\n" * 500 if k % 50 == 0 else None) if name == "Y" else "b"
            rows.append((k, first, last))
        want += [(f"{name}.csv", *r) for r in rows]
        text = end.join([HEADER, "", *(line(k, quoted(f), quoted(t)) for k, f, t in rows)])
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    with small_ranges(spark, size):
        got = names(read_staging_csv(spark, str(tmp_path / "*.csv")))
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_a_broken_file_is_read_in_many_tasks(spark, tmp_path, ws):
    path = write(tmp_path, "MOCK_DATA.csv", *[line(n, '"a\nb"', "c") for n in range(1, 2001)])
    with small_ranges(spark):
        found = broken_records(ws, path, None)
        ranges = lines_of(spark, path).select("start").distinct().count()
        assert ranges > 20 and lines_of(spark, path).rdd.getNumPartitions() > 4
    assert found.count() == 2000


def test_plain_files_stay_with_the_csv_reader(spark, tmp_path, ws):
    path = write(tmp_path, "MOCK_DATA.csv", line(1, '"a, ""b"""', "c"))
    assert broken_records(ws, path, None) is None


def test_a_file_that_ends_inside_quotes_is_refused(spark, tmp_path):
    path = write(tmp_path, "MOCK_DATA.csv", line(1, "a", "b"), line(2, '"open', "b"))
    with pytest.raises(ContractError, match="MOCK_DATA.csv ends inside quotes"):
        read_staging_csv(spark, path)


def test_ranges_that_change_are_refused(spark, tmp_path, ws, monkeypatch):
    path = write(tmp_path, "MOCK_DATA.csv", *[line(n, '"a\nb"', "c") for n in range(1, 300)])
    found = records.open_ranges
    monkeypatch.setattr(records, "open_ranges", lambda r: found(r.withColumn("start", F.col("start") + 1)))
    with pytest.raises(ContractError, match="changed between"):
        broken_records(ws, path, None)


def test_strict_header_of_broken_files(spark, tmp_path):
    swapped = HEADER.replace("customer_first_name,customer_last_name", "customer_last_name,customer_first_name")
    path = write(tmp_path, "MOCK_DATA.csv", line(1, '"a\nb"', "b"), header=swapped)
    assert names(read_staging_csv(spark, path)) == [("MOCK_DATA.csv", 1, "a\nb", "b")]
    with pytest.raises(Exception, match="header"):
        read_staging_csv(spark, path, strict_header=True).collect()


def test_no_rows(spark, tmp_path):
    assert read_staging_csv(spark, write(tmp_path, "MOCK_DATA.csv")).isEmpty()
    (tmp_path / "MOCK_DATA2.csv").write_text("")
    assert read_staging_csv(spark, str(tmp_path / "MOCK_DATA*.csv")).isEmpty()


def test_one_file_gives_many_partitions(spark, tmp_path):
    path = write(tmp_path, "MOCK_DATA.csv", *[line(n, "a", "b") for n in range(1, 2001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        loaded = read_staging_csv(spark, path)
        assert loaded.rdd.getNumPartitions() > 4 and loaded.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_staging_load_writes_less_than_plain_text_and_reads_it_back(warehouse):
    """Compressed files keep every text: NULL, blank, quotes and line breaks, in many files."""
    import __spark_entry__ as entry

    texts = [None, "", 'he said "hi", ok', "two\nlines", "x" * 200]
    wh = warehouse(*[sale(_src_file=f"F{n % 3}", customer_last_name=texts[n % 5]) for n in range(600)], partitions=3)
    back = entry.staging_load(wh)
    assert back.exceptAll(wh.staging).isEmpty() and wh.staging.exceptAll(back).isEmpty()
    (folder,) = Path(wh.workspace.root).glob("csv-*")
    sizes = [f.stat().st_size for f in folder.rglob("part-*")]
    assert len(sizes) == 9 and sum(sizes) < 600 * 50  # plain text is over 130 bytes a row
