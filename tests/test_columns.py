from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.shaping import inline_rows


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_delay_ranges_are_closed_on_the_right(spark):
    days = [-1000, -999, -1, 0, 1, 7, 8, 14, 15, 1000, 1001, None]
    df = inline_rows(spark, [(d,) for d in days], "d int")
    label = C.right_closed_label(F.col("d"), C.DELAY_EDGES, C.DELAY_LABELS)
    assert values(df, label) == [
        None, "Early", "Early", "On the day", "1-7 days late", "1-7 days late", "8-14 days late",
        "8-14 days late", "15+ days late", "15+ days late", None, None]


def test_elapsed_days_are_floored(spark):
    start = datetime(2020, 3, 28, 12)
    ends = [datetime(2020, 3, 28, 11), datetime(2020, 3, 29, 11, 59), datetime(2020, 3, 29, 12),
            datetime(2020, 3, 27, 12), None]
    df = inline_rows(spark, [(start, e) for e in ends], "a timestamp_ntz, b timestamp_ntz")
    assert values(df, C.elapsed_days(F.col("a"), F.col("b"))) == [-1, 0, 1, -1, None]


def test_elapsed_days_ignore_the_session_zone(spark):
    df = inline_rows(spark, [(datetime(2020, 3, 28, 12), datetime(2020, 3, 29, 12))],
                     "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # the clock changes that night
    try:
        assert values(df, C.elapsed_days(F.col("a"), F.col("b"))) == [1]
        assert values(df, C.month_of("a")) == [date(2020, 3, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_promised_day_counts_until_midnight(spark):
    promised = datetime(2018, 5, 5)
    df = inline_rows(spark, [(promised, datetime(2018, 5, 5, 22)), (promised, datetime(2018, 5, 6, 0, 10)),
                             (promised, None)], "p timestamp_ntz, a timestamp_ntz")
    assert values(df, C.delay_days(F.col("p"), F.col("a"))) == [0, 1, None]
    assert values(df, C.is_late(F.col("p"), F.col("a"))) == [0, 1, 0]


def test_bins_caps_and_shares(spark):
    df = inline_rows(spark, [(-8,), (-1,), (0,), (6,), (7,), (None,)], "d int")
    assert values(df, C.fixed_bin(F.col("d"), 7)) == [-14, -7, 0, 0, 7, None]
    assert values(df, C.clip_upper(F.col("d"), 3)) == [-8, -1, 0, 3, 3, None]
    assert values(df, C.share_true(F.col("d") > 0)) == [2 / 6]  # null stays in the denominator


def test_frequency_score_and_weekend(spark):
    df = inline_rows(spark, [(1,), (2,), (3,), (9,)], "n int")
    assert values(df, C.frequency_score(F.col("n"))) == [1, 3, 5, 5]
    days = inline_rows(spark, [(date(2018, 1, 5),), (date(2018, 1, 6),), (date(2018, 1, 7),)], "d date")
    assert values(days, C.is_weekend(F.col("d"))) == [0, 1, 1]


def test_division_by_zero_is_null(spark):
    df = inline_rows(spark, [(Decimal("3.00"), 0), (Decimal("3.00"), 2)], "a decimal(10,2), b int")
    assert values(df, C.ratio(F.col("a"), F.col("b"))) == [None, 1.5]
    assert values(df, C.percent(F.col("a"), F.col("b"))) == [None, 150.0]


def test_rounding_and_labels(spark):
    df = inline_rows(spark, [(0.125, date(2017, 11, 1))], "x double, d date")
    assert values(df, C.rounded_half_even(F.col("x"), 2)) == [0.12]
    assert values(df, F.col("x").cast("decimal(5,2)")) == [Decimal("0.13")]
    assert values(df, C.percent_label(F.col("x"))) == ["12.5%"]
    assert values(df, C.month_label(F.col("d"))) == ["Nov 2017"]
    assert values(df, C.number_label(F.lit(15418395.4))) == ["15,418,395"]
