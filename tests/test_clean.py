import datetime
import random
import re

import pytest

from martloom.functions.clean import date_or_null, double_or_null, int_or_null, present
from martloom.functions.money import average, cents, exact
from pyspark.sql import functions as F


def read(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_ints_never_throw(spark):
    texts = ["12", " 7 ", "1.7", "1e2", "abc", "", None, "99999999999", "-0.5", "7.", "12abc", "+3"]
    got = read(spark, texts, int_or_null("t"))
    assert got == [12, 7, 1, None, None, None, None, None, 0, 7, None, 3]


def test_ints_against_a_plain_reading(spark):
    rng = random.Random(5)
    pieces = ["", " ", "+", "-", "0", "7", "12", "2147483647", "2147483648", ".", ".5", "e2", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(3_000)]

    def plain(text):
        match = re.fullmatch(r"\s*([+-]?\d+)(\.\d*)?\s*", text)
        value = int(match[1]) if match else None
        return value if value is not None and -(2**31) <= value < 2**31 else None

    assert read(spark, texts, int_or_null("t")) == [plain(t) for t in texts]


def test_a_long_fraction_is_cut_not_rounded(spark):
    assert read(spark, ["1.99999999999999999999999999999999999999999"], int_or_null("t")) == [1]


def test_doubles_never_throw(spark):
    texts = ["1.5", "", None, "x", "NaN", "Infinity", "-Infinity", "1e300", "-2", "1e15"]
    got = read(spark, texts, double_or_null("t"))
    assert got == [1.5, None, None, None, None, None, None, 1e300, -2.0, 1e15]


def test_dates_never_throw(spark):
    texts = ["5/1/2021", "05/01/2021", "5/1/21", "13/1/2021", "2/30/2021", "", None]
    day = datetime.date(2021, 5, 1)
    assert read(spark, texts, date_or_null("t")) == [day, day, None, None, None, None, None]


def test_present(spark):
    assert read(spark, ["a", "", " "], present("t")) == [True, False, True]
    assert read(spark, [None], F.coalesce(present("t"), F.lit(False))) == [False]


@pytest.mark.parametrize(
    "amounts, expected",
    [
        ([0.005], 0.01),
        ([1.0, 1.01], 1.01),
        ([1.0, 1.0, 1.01], 1.0),
        ([-0.005], -0.01),
        ([1e21, 1e21, 1e21], 1e21),
        ([1e14, 0.01, 0.0], 33333333333333.34),
        ([], None),
    ],
)
def test_averages_round_half_up(spark, amounts, expected):
    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    value = exact(F.col("a"))
    assert df.agg(average(F.sum(value), F.count(value)).alias("m")).first()[0] == expected


def test_an_amount_that_does_not_fit_stops_the_job(spark):
    df = spark.createDataFrame([(1.0,), (1e23,)], "a double")
    with pytest.raises(Exception, match="10\\^22"):
        df.agg(F.sum(exact(F.col("a")))).collect()


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 977 * 0.01 + 0.1).alias("a"))
    sums = {
        df.repartition(n).agg(cents(F.sum(exact(F.col("a")))).alias("s")).first()[0]
        for n in (1, 3, 8)
    }
    assert len(sums) == 1
