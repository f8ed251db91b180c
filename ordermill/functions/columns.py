"""Column expressions shared by every job. All compile to built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- dates ---------------------------------------------------------------

def month_of(ts) -> Column:
    """First day of the month, without going through a time zone."""
    return F.trunc(F.to_date(ts), "MM")


def elapsed_days(start: Column, end: Column) -> Column:
    """Full elapsed days, floored: one hour before the start is -1.

    The calendar gap is lowered by one when the last day is not complete, so no
    conversion to epoch seconds (and to a time zone) is needed.
    """
    gap = F.datediff(end, start)
    return gap - (end < start + F.make_dt_interval(gap)).cast("int")


def delay_days(promised: Column, actual: Column) -> Column:
    """Calendar days from the promised to the actual date; 22:00 on the promised day is 0."""
    return F.datediff(actual, promised)


def is_late(promised: Column, actual: Column) -> Column:
    """1 when the actual date is after the promised date; a missing date counts as 0."""
    return F.when(F.to_date(actual) > F.to_date(promised), 1).otherwise(0)


def is_weekend(day: Column) -> Column:
    return F.when(F.dayofweek(day).isin(1, 7), 1).otherwise(0)


# ---- orders --------------------------------------------------------------

def revenue() -> Column:
    """Price plus freight, the one revenue definition."""
    return F.col("price") + F.col("freight_value")


def has_delivered_status() -> Column:
    return F.col("order_status") == "delivered"


def has_delivered_date() -> Column:
    """Delivered status and a real delivery date."""
    return has_delivered_status() & F.col("order_delivered_customer_date").isNotNull()


def is_delivered() -> Column:
    return F.when(has_delivered_date(), 1).otherwise(0)


def order_delivery_days() -> Column:
    return elapsed_days(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))


def order_delay_days() -> Column:
    return delay_days(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date"))


def order_is_late() -> Column:
    return is_late(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date"))


def is_low_review(score: Column) -> Column:
    return (score <= 2).cast("int")


def frequency_score(frequency: Column) -> Column:
    """Fixed thresholds: most people buy once, so quantiles would split equal values."""
    return F.when(frequency >= 3, 5).when(frequency == 2, 3).otherwise(1)


# ---- ranges --------------------------------------------------------------

# Delay ranges, closed on the right, and their labels.
DELAY_EDGES = (-1000, -1, 0, 7, 14, 1000)
DELAY_LABELS = ("Early", "On the day", "1-7 days late", "8-14 days late", "15+ days late")


def right_closed_range(value: Column, edges: Sequence[float]) -> Column:
    """1-based number of the range ``(edges[i-1], edges[i]]``; null outside all ranges."""
    out = F.when(value <= edges[0], None)
    for number, upper in enumerate(edges[1:], start=1):
        out = out.when(value <= upper, number)
    return out


def right_closed_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    number = right_closed_range(value, edges)
    out = None
    for i, label in enumerate(labels, start=1):
        out = F.when(number == i, label) if out is None else out.when(number == i, label)
    return out


def fixed_bin(value: Column, width: int) -> Column:
    """Lower edge of the bin of ``width`` that holds an integer value; -1 falls in -width."""
    return value - F.pmod(value, F.lit(width))


def clip_upper(value: Column, cap) -> Column:
    """Cap from above; null stays null (``least`` alone would return the cap)."""
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


# ---- ratios and rounding ---------------------------------------------------

def ratio(num: Column, den: Column) -> Column:
    """Double division of exact numerator and denominator; null when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))


def share_true(predicate: Column) -> Column:
    """Aggregate: share of rows where the predicate holds; an unknown result counts as false."""
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("int"))


def rounded_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def number_label(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def percent_label(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")
