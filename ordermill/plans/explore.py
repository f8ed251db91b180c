"""The numbers behind the exploratory figures. Everything looks at delivered orders with a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.ranking import exact_quantiles, first_rows, global_row_number, spread_join
from ordermill.operators.shaping import (attach_row, cumulative_share, equal_width_histogram,
                                         fill_months, fixed_width_histogram, keep_keys, share_over, top_n)
from ordermill.plans.questions import (delivered_dated, order_revenue, person_orders,
                                       revenue_by_category)


# ---- delivery -------------------------------------------------------------------

def delivery_headline(orders: DataFrame) -> DataFrame:
    """Delivered orders, late share and median days to deliver."""
    timed = delivered_dated(orders).select(C.order_delivery_days().alias("days"),
                                           C.order_delay_days().alias("delay"))
    counts = timed.agg(F.count("*").alias("delivered_orders"),
                       C.share_true(F.col("delay") > 0).alias("late_share"))
    return attach_row(counts, exact_quantiles(timed, "days", {"median_days": 0.5}))


def score_by_delay(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review scores per delay range; gaps outside all ranges are left out."""
    delay = delivered_dated(orders).select("order_id", C.order_delay_days().alias("delay"))
    scored = delay.join(reviews.select("order_id", "review_score"), "order_id").select(
        C.right_closed_range(F.col("delay"), C.DELAY_EDGES).alias("delay_range"),
        C.right_closed_label(F.col("delay"), C.DELAY_EDGES, C.DELAY_LABELS).alias("delay_bucket"),
        "review_score").filter(F.col("delay_range").isNotNull())
    return scored.groupBy("delay_range", "delay_bucket").agg(
        F.avg("review_score").alias("mean_score"),
        C.share_true(F.col("review_score") <= 2).alias("low_share"),
        F.count("*").alias("n")).orderBy("delay_range")


# ---- order value ------------------------------------------------------------------

def delivered_order_value(orders: DataFrame, items: DataFrame) -> DataFrame:
    return keep_keys(order_revenue(items), delivered_dated(orders).select("order_id"), "order_id")


def order_value_stats(orders: DataFrame, items: DataFrame, cap: int = 500) -> DataFrame:
    values = delivered_order_value(orders, items)
    plain = values.agg(
        F.count("*").alias("orders"), C.ratio(F.sum("revenue"), F.count("*")).alias("mean_value"),
        F.max("revenue").alias("max_value"),
        C.share_true(F.col("revenue") <= cap).alias("share_up_to_cap"))
    return attach_row(plain, exact_quantiles(
        values, "revenue", {"median_value": 0.5, "p95_value": 0.95, "p99_value": 0.99}))


def order_value_hist(orders: DataFrame, items: DataFrame, cap: int = 500,
                     bins: int = 50) -> DataFrame:
    values = delivered_order_value(orders, items).filter(F.col("revenue") <= cap)
    return equal_width_histogram(values, "revenue", bins)


# ---- revenue over time, place and category -------------------------------------------

def monthly_trend(orders: DataFrame, items: DataFrame) -> DataFrame:
    dated = delivered_dated(orders).select(
        "order_id", C.month_of("order_purchase_timestamp").alias("month"))
    return dated.join(order_revenue(items), "order_id").groupBy("month").agg(
        F.sum("revenue").alias("revenue")).orderBy("month")


def monthly_trend_filled(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The trend on a continuous month axis."""
    return fill_months(monthly_trend(orders, items), "month", ["revenue"]).orderBy("month")


def peak_month(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The month with most revenue (the earlier one on a tie) and the overall total."""
    monthly = monthly_trend(orders, items)
    peak = F.max_by("month", F.struct("revenue", -F.unix_date("month")))
    return monthly.agg(peak.alias("peak_month"), F.max("revenue").alias("peak_revenue"),
                       F.sum("revenue").alias("total_revenue"))


def state_revenue(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue and share per customer state, largest first."""
    valued = delivered_dated(orders).select("order_id", "customer_id").join(
        order_revenue(items), "order_id")
    by_state = valued.join(
        customers.select("customer_id", "customer_state"), "customer_id").filter(
        F.col("customer_state").isNotNull()).groupBy("customer_state").agg(
        F.sum("revenue").alias("revenue"))
    return share_over(by_state, "revenue", "revenue_share").orderBy(
        F.col("revenue").desc(), "customer_state")


def _head_share(df: DataFrame, n: int, tie: str, name: str) -> DataFrame:
    """Share of the total revenue held by the first ``n`` rows."""
    head = top_n(df.select("revenue", tie), n, [F.col("revenue").desc(), tie]).agg(
        F.sum("revenue").alias("__head"))
    return attach_row(df.agg(F.sum("revenue").alias("__all")), head).select(
        C.ratio(F.col("__head"), F.col("__all")).alias(name))


def state_concentration(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    by_state = state_revenue(orders, items, customers)
    return attach_row(_head_share(by_state, 1, "customer_state", "top1_share"),
                      _head_share(by_state, 3, "customer_state", "top3_share"))


def category_pareto(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per category with the running share of the total, largest first."""
    by_category = revenue_by_category(delivered_dated(orders), items, products)
    return cumulative_share(by_category.select("category", "revenue"), "revenue", "category",
                            "cumulative_share").orderBy(F.col("revenue").desc(), "category")


def category_concentration(orders: DataFrame, items: DataFrame, products: DataFrame,
                           share: float = 0.8, head: int = 5) -> DataFrame:
    """How many categories reach the share, and what the largest ones hold."""
    pareto = category_pareto(orders, items, products)
    reach = pareto.agg(F.count("*").alias("categories"),
                       (F.count_if(F.col("cumulative_share") < share) + 1).alias(
                           "categories_to_share"))
    return attach_row(reach, _head_share(pareto, head, "category", "top_share"))


# ---- payments -----------------------------------------------------------------------

def delivered_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return keep_keys(payments, delivered_dated(orders).select("order_id"), "order_id")


def payment_value_share(orders: DataFrame, payments: DataFrame) -> DataFrame:
    by_type = delivered_payments(orders, payments).filter(
        F.col("payment_type").isNotNull()).groupBy("payment_type").agg(
        F.sum("payment_value").alias("payment_value"))
    return share_over(by_type, "payment_value", "value_share").orderBy(
        F.col("payment_value").desc(), "payment_type")


def _card_legs(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return delivered_payments(orders, payments).filter(F.col("payment_type") == "credit_card")


def installment_dist(orders: DataFrame, payments: DataFrame, cap: int = 11) -> DataFrame:
    """Card payment legs per number of installments; the cap stands for that many or more."""
    capped = C.clip_upper(F.col("payment_installments"), cap)
    return _card_legs(orders, payments).filter(F.col("payment_installments").isNotNull()).groupBy(
        capped.alias("installments")).agg(F.count("*").alias("n")).orderBy("installments")


def installment_shares(orders: DataFrame, payments: DataFrame) -> DataFrame:
    legs = F.col("payment_installments")
    return _card_legs(orders, payments).agg(
        F.count("*").alias("card_payments"), C.share_true(legs == 1).alias("share_single"),
        C.share_true(legs >= 10).alias("share_ten_or_more"))


# ---- repeat purchases -----------------------------------------------------------------

_PURCHASE_ORDER = ["order_purchase_timestamp", "order_id"]


def _people(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return person_orders(delivered_dated(orders).select(
        "order_id", "customer_id", "order_purchase_timestamp"), customers)


def purchase_rank(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """All delivered orders, numbered from 0 within each person; ties on the time go by order id.

    A number is the order's position in one sort of all rows minus the position of the
    person's first order, so a person with very many orders is spread over many tasks.
    """
    people = _people(orders, customers)
    placed = global_row_number(people, ["customer_unique_id", *_PURCHASE_ORDER], "__position")
    first = placed.groupBy("customer_unique_id").agg(F.min("__position").alias("__first"))
    return spread_join(placed, first, ["customer_unique_id"], "__position").select(
        *people.columns, (F.col("__position") - F.col("__first")).alias("purchase_rank"))


def first_second(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """First and, if any, second purchase of every person, in one row."""
    bought = F.col("order_purchase_timestamp")
    ranked = first_rows(_people(orders, customers), ["customer_unique_id"], _PURCHASE_ORDER, 2, rank="nth")
    return ranked.groupBy("customer_unique_id").agg(
        F.max(F.when(F.col("nth") == 1, bought)).alias("first_purchase"),
        F.max(F.when(F.col("nth") == 2, bought)).alias("second_purchase"))


def repeat_rate(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Persons with a second delivered order among persons with one.

    Only a count per person is needed, so persons are counted without ranking.
    """
    per_person = person_orders(delivered_dated(orders).select("customer_id"), customers).groupBy(
        "customer_unique_id").agg(F.count("*").alias("n"))
    repeat = F.count_if(F.col("n") > 1)
    return per_person.agg(F.count("*").alias("persons"), repeat.alias("repeaters"),
                          C.ratio(repeat, F.count("*")).alias("repeat_rate"))


def repeat_gaps(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Whole days from first to second order, for persons who have both."""
    return first_second(orders, customers).filter(F.col("second_purchase").isNotNull()).select(
        "customer_unique_id",
        C.elapsed_days(F.col("first_purchase"), F.col("second_purchase")).alias("gap_days"))


def repeat_gap(orders: DataFrame, customers: DataFrame) -> DataFrame:
    gaps = repeat_gaps(orders, customers)
    shares = gaps.agg(F.count("*").alias("repeaters"),
                      C.share_true(F.col("gap_days") <= 90).alias("share_90_days"),
                      C.share_true(F.col("gap_days") <= 365).alias("share_365_days"))
    return attach_row(shares, exact_quantiles(gaps, "gap_days", {"median_gap_days": 0.5}))


def repeat_gap_hist(orders: DataFrame, customers: DataFrame, width: int = 7, stop: int = 371,
                    longest: int = 365) -> DataFrame:
    gaps = repeat_gaps(orders, customers).filter(F.col("gap_days") <= longest)
    return fixed_width_histogram(gaps, "gap_days", width, stop)
