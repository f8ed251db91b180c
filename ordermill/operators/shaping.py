"""Joins, shares, histograms and small generators used by several jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordermill.operators.ranking import columns, running_sums


# ---- joins -----------------------------------------------------------------

def keep_keys(df: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, key, "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return df.join(keys, key, "left_anti")


def left_join_all(base: DataFrame, frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins on one key; every frame holds a key once, so no row multiplies.

    All joins share the key, so ``base`` is shuffled at most once.
    """
    for frame in frames:
        base = base.join(frame, key, "left")
    return base


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row frame (an aggregate without groups) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


# ---- whole-result shares ------------------------------------------------------
# Totals come as one row; running sums and tops need no task that sees all rows.

def share_over(df: DataFrame, value: str, name: str, scale: float = 1.0) -> DataFrame:
    """Value divided by the total of all rows."""
    total = df.agg(F.sum(value).alias("__total"))
    share = (F.lit(scale) * F.col(value).cast("double")) / F.col("__total").cast("double")
    return attach_row(df, total).withColumn(name, share).drop("__total")


def cumulative_share(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Running share of the total, largest value first."""
    upto = running_sums(df, [F.col(value).desc(), tie], {"__upto": value})
    total = upto.agg(F.sum(value).alias("__total"))
    return attach_row(upto, total).withColumn(
        name, F.col("__upto").cast("double") / F.col("__total").cast("double")).drop("__upto", "__total")


def growth_over_previous_row(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Percent change against the previous row, whichever month that row holds.

    For one row per month, of which there are few: one task orders them.
    """
    before = F.lag(value).over(Window.orderBy(order))
    return df.withColumn("__before", before).withColumn(
        name, F.try_divide(F.lit(100.0) * (F.col(value) - F.col("__before")).cast("double"),
                           F.col("__before").cast("double"))).drop("__before")


def top_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows; ties are cut by the order."""
    return df.orderBy(*columns(order)).limit(n)


def top_n_with_ties(df: DataFrame, n: int, measure: str) -> DataFrame:
    """Rows whose measure ranks in the first ``n``; equal values stay together."""
    window = Window.orderBy(F.col(measure).desc())
    return df.filter(F.col(measure).isNotNull()).withColumn(
        "__rank", F.rank().over(window)).filter(F.col("__rank") <= n).drop("__rank")


# ---- histograms --------------------------------------------------------------

def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bins`` equal bins between the smallest and largest value, the last closed on the right.

    Empty bins are reported with 0.
    """
    x = df.select(F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    span = x.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    at = F.try_divide((F.col("__x") - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))
    slot = F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(bins - 1))
    counts = attach_row(x, span).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    spine = attach_row(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), span)
    width = (F.col("__hi") - F.col("__lo")) / bins
    # at most `bins` rows
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("__lo") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def fixed_width_histogram(df: DataFrame, value: str, width: int, stop: int) -> DataFrame:
    """Bins of ``width`` from 0, the last one closed on the right at or after ``stop``.

    Values outside the edges are left out; empty bins are reported with 0.
    """
    bins = -(-stop // width)
    x = df.filter(F.col(value).between(0, bins * width))
    slot = F.least(F.floor(F.col(value) / width), F.lit(bins - 1))
    counts = x.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


# ---- generators ----------------------------------------------------------------

def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a local relation, whose size the optimizer knows."""
    names = StructType.fromDDL(schema).names
    table = pa.table({name: pa.array([row[i] for row in rows]) for i, name in enumerate(names)})
    return spark.createDataFrame(table, schema)


def day_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))


def fill_months(df: DataFrame, month: str, values: Sequence[str]) -> DataFrame:
    """Every month from the first to the last, with 0 where the data has none.

    The input holds one row per month, so both sides are bounded by the calendar.
    """
    span = df.agg(F.min(month).alias("__first"), F.max(month).alias("__last"))
    spine = span.select(F.explode(F.sequence(
        "__first", "__last", F.expr("interval 1 month"))).alias(month))
    return spine.join(df, month, "left").select(
        month, *[F.coalesce(c, F.lit(0)).alias(c) for c in values])
