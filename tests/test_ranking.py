import random
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ordermill.operators import ranking
from ordermill.operators.shaping import (equal_width_histogram, fill_months, fixed_width_histogram,
                                         growth_over_previous_row, inline_rows, top_n_with_ties)


def tiles(n, k):
    """NTILE by its definition: sizes differ by at most one, larger tiles first."""
    small, larger = divmod(n, k)
    out = []
    for tile in range(1, k + 1):
        out += [tile] * (small + (1 if tile <= larger else 0))
    return out


@pytest.mark.parametrize("n,k", [(12, 5), (5, 5), (3, 5), (101, 7), (1, 1), (0, 3)])
def test_tiles_match_the_definition(spark, n, k):
    rows = spark.range(1, n + 1).select("id", (F.col("id") % 4).alias("v"))
    got = rows.select("id", "v", ranking.ntile_of(rows, k, "v", "id").alias("t")).orderBy("v", "id").collect()
    assert [r.t for r in got] == tiles(n, k)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_tiles_equal_the_window(many_partitions, monkeypatch, accuracy):
    # a third of the rows share one value, and a bound falls inside it
    monkeypatch.setattr(ranking, "_ACCURACY", accuracy)
    rows = spark_rows(many_partitions, 3000).select("id", F.col("v").cast("decimal(12,2)").alias("v"))
    got = rows.select("id", ranking.ntile_of(rows, 20, "v", "id").alias("t"))
    want = rows.select("id", F.ntile(20).over(Window.orderBy("v", "id")).alias("t"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_global_rows_equal_the_window(many_partitions):
    rows = spark_rows(many_partitions, 3000)
    order = Window.orderBy(F.col("v").desc(), "id")
    want = rows.withColumn("rn", F.row_number().over(order))
    got = ranking.global_row_number(rows, [F.col("v").desc(), "id"], "rn", "total")
    assert got.select("total").distinct().collect()[0][0] == 3000
    assert got.select("id", "v", "rn").exceptAll(want).count() == 0 and got.count() == 3000


def spark_rows(spark, n):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 37 % 101).alias("v"))


def test_running_sums_equal_the_window(many_partitions):
    rows = spark_rows(many_partitions, 2000)
    w = Window.orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("s", F.sum("id").over(w))
    got = ranking.running_sums(rows, ["v", "id"], {"s": "id"})
    assert got.select("id", "s").exceptAll(want.select("id", "s")).count() == 0


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, numbers):
    df = inline_rows(spark, [(v,) for v in numbers], "v int")
    row = ranking.exact_quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
    assert list(row) == pytest.approx(list(np.quantile(numbers, [0.5, 0.95, 0, 1])))


def test_grouped_quantiles_with_a_hot_group(many_partitions):
    spark = many_partitions
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 400)) for i in range(3000)]
    data += [("none", None), (None, 5)]
    got = {r.k: r.m for r in ranking.exact_quantiles(
        inline_rows(spark, data, "k string, v int"), "v", {"m": 0.5}, ["k"]).collect()}
    groups = {}
    for k, v in data:
        if k and v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: float(np.median(v)) for k, v in groups.items()}


def test_first_rows_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = ranking.first_rows(df, ["k"], [F.col("id").desc()], 2, rank="r")
    assert sorted(map(tuple, top.collect())) == [(0, 996, 2), (0, 998, 1), (1, 997, 2), (1, 999, 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan  # before the exchange


def test_equal_width_histogram_edges_and_empty_bins(spark):
    df = inline_rows(spark, [(v,) for v in (0.0, 1.0, 2.0, 10.0, 10.0)], "v double")
    got = [(r.bin_start, r.n) for r in equal_width_histogram(df, "v", 5).collect()]
    assert got == [(0.0, 2), (2.0, 1), (4.0, 0), (6.0, 0), (8.0, 2)]
    same = inline_rows(spark, [(3.0,), (3.0,)], "v double")
    assert [r.n for r in equal_width_histogram(same, "v", 2).collect()] == [2, 0]


def test_fixed_width_histogram_closes_the_last_bin(spark):
    df = inline_rows(spark, [(v,) for v in (0, 6, 7, 20, 21, 22, -1)], "v int")
    assert [r.n for r in fixed_width_histogram(df, "v", 7, 21).collect()] == [2, 1, 2]


def test_growth_compares_with_the_previous_row(spark):
    df = inline_rows(spark, [("2016-09", 10), ("2016-10", 30), ("2016-12", 15), ("2017-01", 0),
                             ("2017-02", 5)], "m string, v int")
    got = [r.g for r in growth_over_previous_row(df, "m", "v", "g").orderBy("m").collect()]
    assert got == [None, 200.0, -50.0, -100.0, None]


def test_top_n_keeps_ties(spark):
    df = inline_rows(spark, [("a", 5), ("b", 4), ("c", 4), ("d", 3), ("e", None)], "k string, v int")
    assert sorted(r.k for r in top_n_with_ties(df, 2, "v").collect()) == ["a", "b", "c"]


def test_missing_months_are_filled_with_zero(spark):
    df = inline_rows(spark, [(date(2016, 10, 1), 5), (date(2017, 1, 1), 7)], "m date, v int")
    assert [(r.m.month, r.v) for r in fill_months(df, "m", ["v"]).orderBy("m").collect()] == [
        (10, 5), (11, 0), (12, 0), (1, 7)]
