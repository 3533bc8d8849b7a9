import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.operators import numbering
from martloom.operators.numbering import ranges_for, ranks, read_sources, row_numbers, source_row_numbers


def same(left, right):
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture
def values(spark):
    """A third of the rows share one value and a tenth have none."""
    n = F.col("id")
    value = F.when(n % 3 == 0, 500).when(n % 10 == 1, None).otherwise(n * 7919 % 1000)
    return spark.range(20_000).select("id", value.cast("decimal(20,6)").alias("v"))


@pytest.mark.parametrize("per_range", [300, 7_000, 10**6])
def test_ranks_equal_the_window(ws, values, per_range):
    got = ranks(ws, ws.save(values, "v"), "v", "r", per_range)
    over = Window.orderBy(F.col("v").desc_nulls_last())
    same(got, values.withColumn("r", F.rank().over(over).cast("long")))


def test_a_tie_may_fill_many_ranges(ws, spark):
    ties = spark.range(1_000).select("id", F.lit(1.5).alias("v"))
    got = ranks(ws, ws.save(ties, "v"), "v", "r", 50)
    assert [tuple(r) for r in got.groupBy("r").count().collect()] == [(1, 1_000)]


def test_only_nulls_are_one_tie(ws, spark):
    nulls = spark.range(500).select("id", F.lit(None).cast("double").alias("v"))
    got = ranks(ws, ws.save(nulls, "v"), "v", "r", 50)
    assert [tuple(r) for r in got.groupBy("r").count().collect()] == [(1, 500)]


@pytest.mark.parametrize("per_range", [1, 10])
def test_ranks_with_gaps_and_nulls_last(ws, spark, per_range):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 3), (4, None), (5, None)], "id int, v int")
    got = ranks(ws, ws.save(df.repartition(4), "v"), "v", "r", per_range)
    assert sorted(tuple(r) for r in got.select("id", "r").collect()) == [
        (1, 1), (2, 1), (3, 3), (4, 4), (5, 4),
    ]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_row_numbers_equal_the_window(ws, spark, partitions):
    n = F.col("id")
    names = spark.range(9_000).select(
        F.when(n % 3 == 0, "hot").when(n % 50 == 1, None).otherwise((n % 91).cast("string")).alias("a"),
        n.cast("string").alias("b"),
    )
    got = row_numbers(ws, ws.save(names.repartition(partitions), "n"), ["a", "b"], "k", 400)
    over = Window.orderBy("a", "b")
    same(got, names.withColumn("k", F.row_number().over(over).cast("long")))


def test_equal_rows_are_spread_and_numbered_once_each(ws, spark):
    copies = spark.range(4_000).select(F.lit("x").alias("a"))
    got = row_numbers(ws, ws.save(copies, "c"), ["a"], "k", 100)
    low, high, distinct = got.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first()
    assert (low, high, distinct) == (1, 4_000, 4_000)


def test_nothing_to_number(ws, spark):
    empty = ws.save(spark.createDataFrame([], "id int, v int"), "e")
    assert row_numbers(ws, empty, ["id"], "k").isEmpty()
    assert ranks(ws, empty, "v", "r").isEmpty()


def test_ranges_follow_the_rows():
    assert ranges_for(0, 8) == ranges_for(10, 8) == 1
    assert ranges_for(600_000, 8) == 8
    assert ranges_for(10**12, 4_000) == 10**6


def test_small_ranges_do_not_become_tasks_without_end():
    """A range is a task, a file and a sample on the driver: those grow with the cores, not with rows / 1,000."""
    assert ranges_for(100_000, 8, 1_000) == 100
    assert ranges_for(216_000_000, 12, 1_000) == 12 * 32
    assert ranges_for(10**9, 12, 1_000) == ranges_for(10**9, 12) == 1_000


@pytest.fixture
def numbered(ws, spark):
    def make(rows, partitions=3, per_range=10**6):
        df = spark.createDataFrame(rows, "_src_file string, _src_id bigint, x string").repartition(partitions)
        df = ws.save(df, "rows").df
        sources = read_sources(ws, df)
        make.dense = sources.dense
        got = [tuple(r) for r in source_row_numbers(ws, df, "n", sources, per_range).collect()]
        return sorted(got, key=lambda r: r[-1])

    return make


def no_ranges(monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were moved")

    monkeypatch.setattr(numbering, "numbered_by_content", refuse)


def test_complete_ids_are_numbered_in_place(numbered, monkeypatch):
    no_ranges(monkeypatch)
    rows = [("B", 1, "p"), ("A", 2, "q"), ("A", 1, "r"), ("B", 2, "s"), ("C", 1, "t")]
    assert numbered(rows) == [
        ("A", 1, "r", 1), ("A", 2, "q", 2), ("B", 1, "p", 3), ("B", 2, "s", 4), ("C", 1, "t", 5),
    ]


ODD_IDS = [
    [1, 1, 3], [1, 2, 2], [2, 3, 4], [0, 1, 2], [None, 1, 2], [None, None, None], [-1, 1, 3], [1, 1, 1, 3, 3],
    [-1, 0, 1], [-3, -2, -1], [1, 2, 2, 4], [2, 2], [1, 3, 5], [(1 << 63) - 1, 1, -(1 << 63)],
]


@pytest.mark.parametrize(("ids", "per_range"), [(ids, 2 if n % 2 else 10**6) for n, ids in enumerate(ODD_IDS)])
def test_other_ids_are_numbered_by_content(numbered, ids, per_range):
    rows = [("A", i, x) for i, x in zip(ids, "vwxyz")] + [("B", 1, "w")]
    got = numbered(rows, per_range=per_range)
    assert not numbered.dense
    in_order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1], r[2]))
    assert got == [(*r, n) for n, r in enumerate(in_order, 1)]


def test_rows_without_a_file_are_not_dense(ws, spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("A", 1)], "_src_file string, _src_id bigint")
    found = read_sources(ws, df)
    assert not found.dense
    assert [tuple(r) for r in found.files.df.orderBy("_number").collect()] == [(None, 2, 0, 0), ("A", 1, 2, 1)]


@pytest.mark.parametrize(("gathered", "held"), [(1_000, 50), (10**6, 10**6)])
def test_runs_of_any_order_and_size(ws, spark, monkeypatch, gathered, held):
    """In order a task has a run a file; in any order, and however often runs are given away, ids stay dense."""
    seen = []
    kept = numbering._runs

    def few(batches):
        numbering.GATHERED_IDS, numbering.HELD_RUNS = gathered, held
        return kept(batches)

    monkeypatch.setattr(numbering, "_runs", few)
    n = F.col("id")
    df = spark.range(0, 4_000, numPartitions=4).select(F.concat(F.lit("F"), (n % 3).cast("string")).alias("_src_file"), (F.floor(n / 3) + 1).alias("_src_id"))
    for rows in (df, df.orderBy(F.rand(3))):
        found = read_sources(ws, rows)
        assert found.dense
        seen.append([tuple(r) for r in found.files.df.orderBy("_number").collect()])
    assert seen[0] == seen[1] == [("F0", 1_334, 0, 0), ("F1", 1_333, 1_334, 1), ("F2", 1_333, 2_667, 2)]
    assert not read_sources(ws, df.where("id != 777")).dense
    assert not read_sources(ws, df.union(df.where("id = 777"))).dense


def test_a_task_holds_few_runs(ws, spark):
    df = spark.range(1, 100_001, numPartitions=4).select(F.lit("A").alias("_src_file"), F.col("id").alias("_src_id"))
    assert read_sources(ws, df).dense
    assert df.mapInArrow(numbering._runs, "file string, low long, high long").count() == 4


def test_many_files_are_joined_not_broadcast(ws, spark, monkeypatch):
    monkeypatch.setattr(numbering, "BROADCAST_FILES", 10)
    df = spark.range(0, 400).select(F.concat(F.lit("F"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("_src_file"), (F.floor(F.col("id") / 40) + 1).alias("_src_id"))
    got = source_row_numbers(ws, df, "n", read_sources(ws, df, 7))
    assert [r.n for r in got.orderBy("_src_file", "_src_id").collect()] == list(range(1, 401))


@pytest.mark.parametrize(("ids", "dense"), [([2, 3, 1], True), ([1, 2, 2**63 - 1], False), ([2**63 - 1], False), ([-(2**63), 1], False), ([1, None], False)])
def test_ends_of_runs_are_longs(ws, spark, ids, dense):
    """The ends of runs were wide decimals, slow to add up and to move; only an id has no number after it."""
    df = spark.createDataFrame([("A", i) for i in ids] + [("B", 1)], "_src_file string, _src_id long")
    made, kept = [], ws.save
    ws.save = lambda df, name: made.append((name, dict(df.dtypes))) or kept(df, name)
    found = read_sources(ws, df)
    assert found.dense is dense
    assert [tuple(r) for r in found.files.df.orderBy("_number").collect()] == [("A", len(ids), 0, 0), ("B", 1, len(ids), 1)]
    assert dict(made)["id-ends"]["end"] == "bigint"
