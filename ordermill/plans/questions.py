"""The six business questions.

Item rows are summed per order (or per seller and order) before they meet the
orders table, so joins run between unique keys, no item row is counted twice and
``count(distinct)`` is never needed. Ratios are plain double divisions;
``reported`` applies the printed decimal types.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.cleaning import fill_unknown
from ordermill.operators.ranking import ntile_of
from ordermill.operators.shaping import (attach_row, growth_over_previous_row, share_over, top_n)
from ordermill.session import kept


def delivered_status(orders: DataFrame) -> DataFrame:
    return orders.filter(C.has_delivered_status())


def delivered_dated(orders: DataFrame) -> DataFrame:
    return orders.filter(C.has_delivered_date())


def order_revenue(items: DataFrame) -> DataFrame:
    """One row per order that has items."""
    return items.groupBy("order_id").agg(F.sum(C.revenue()).alias("revenue"))


def monthly_revenue(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders, revenue and growth over the previous listed month."""
    valued = delivered_status(orders).join(order_revenue(items), "order_id")
    monthly = valued.groupBy(C.month_of("order_purchase_timestamp").alias("order_month")).agg(
        F.count("*").alias("orders"), F.sum("revenue").alias("revenue"))
    # one row per month
    return growth_over_previous_row(monthly, "order_month", "revenue", "mom_growth_pct").orderBy(
        "order_month")


def revenue_by_product(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Units and revenue per product over the orders given."""
    sold = items.join(orders.select("order_id"), "order_id", "left_semi")
    return sold.groupBy("product_id").agg(F.count("*").alias("items_sold"),
                                          F.sum(C.revenue()).alias("revenue"))


def revenue_by_category(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Units and revenue per category.

    A best seller is summed to one row before the product join, so its key
    cannot overload that join.
    """
    named = revenue_by_product(orders, items).join(
        products.select("product_id", F.col("product_category_name_english").alias("category")),
        "product_id")
    return fill_unknown(named, {"category": "unknown"}).groupBy("category").agg(
        F.sum("items_sold").alias("items_sold"), F.sum("revenue").alias("revenue"))


def category_revenue(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    by_category = revenue_by_category(delivered_status(orders), items, products)
    return share_over(by_category, "revenue", "revenue_share_pct", 100.0).orderBy(
        F.col("revenue").desc(), "category")


def state_delivery(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivery speed, gap to the promise and late share per customer state."""
    timed = delivered_dated(orders).select(
        "customer_id", C.order_delivery_days().alias("days"), C.order_delay_days().alias("gap"),
        C.order_is_late().alias("late"))
    located = timed.join(customers.select("customer_id", "customer_state"), "customer_id")
    return located.groupBy("customer_state").agg(
        F.count("*").alias("delivered_orders"),
        F.avg("days").alias("avg_delivery_days"),
        F.avg("gap").alias("avg_days_vs_estimate"),
        C.percent(F.sum("late"), F.count("*")).alias("late_pct"),
    ).orderBy(F.col("avg_delivery_days").desc(), "customer_state")


def top_sellers(orders: DataFrame, items: DataFrame, sellers: DataFrame, reviews: DataFrame,
                n: int = 10) -> DataFrame:
    """Sellers with the most revenue; a review counts once per seller and order."""
    per_order = items.groupBy("order_id", "seller_id").agg(F.sum(C.revenue()).alias("revenue"))
    scored = per_order.join(delivered_status(orders).select("order_id"), "order_id").join(
        reviews.select("order_id", "review_score"), "order_id", "left")
    per_seller = scored.groupBy("seller_id").agg(
        F.count("*").alias("orders"), F.sum("revenue").alias("revenue"),
        F.avg("review_score").alias("avg_review_score"))
    ranked = per_seller.join(sellers.select("seller_id", "seller_state"), "seller_id").select(
        "seller_id", "seller_state", "orders", "revenue", "avg_review_score")
    return top_n(ranked, n, [F.col("revenue").desc(), "seller_id"])


def person_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The given orders with the person behind each."""
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")


def cohort_repeat(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per month of first purchase: people, and those who ever bought again."""
    people = person_orders(
        delivered_status(orders).select("customer_id", "order_purchase_timestamp"), customers)
    per_person = people.groupBy("customer_unique_id").agg(
        F.min("order_purchase_timestamp").alias("first_purchase"), F.count("*").alias("orders"))
    repeat = F.count_if(F.col("orders") > 1)
    return per_person.groupBy(C.month_of("first_purchase").alias("cohort_month")).agg(
        F.count("*").alias("cohort_customers"), repeat.alias("repeat_customers"),
        C.percent(repeat, F.count("*")).alias("repeat_rate_pct")).orderBy("cohort_month")


def rfm(orders: DataFrame, items: DataFrame, customers: DataFrame, k: int = 5) -> DataFrame:
    """Recency, frequency and monetary value with scores, one row per person.

    Both tile scores need places among all people. These come from counts around the tiles' bounds, so people are only
    sorted for the output, by monetary value, largest first. Last purchase date ascending is the same order as recency
    descending.
    """
    valued = delivered_status(orders).select(
        "order_id", "customer_id", "order_purchase_timestamp").join(
        order_revenue(items), "order_id")
    people = kept(person_orders(valued, customers).groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("last_purchase"),
        F.count("*").alias("frequency"), F.sum("revenue").alias("monetary"))
        .withColumn("last_day", F.unix_date(F.to_date("last_purchase"))))
    anchor = people.agg(F.max("last_purchase").alias("anchor"))
    return attach_row(people, anchor).select(
        "customer_unique_id", F.datediff("anchor", "last_purchase").alias("recency_days"), "frequency", "monetary",
        ntile_of(people, k, "last_day", "customer_unique_id").alias("r_score"),
        C.frequency_score(F.col("frequency")).alias("f_score"),
        ntile_of(people, k, "monetary", "customer_unique_id").alias("m_score")) \
        .orderBy(F.col("monetary").desc(), F.col("customer_unique_id").desc())


# Printed types of the computed columns.
REPORTED = {
    "monthly_revenue": {"revenue": "decimal(12,2)", "mom_growth_pct": "decimal(12,1)"},
    "category_revenue": {"revenue": "decimal(12,2)", "revenue_share_pct": "decimal(5,2)"},
    "state_delivery": {"avg_delivery_days": "decimal(5,1)", "avg_days_vs_estimate": "decimal(5,1)",
                       "late_pct": "decimal(5,2)"},
    "top_sellers": {"revenue": "decimal(12,2)", "avg_review_score": "decimal(3,2)"},
    "cohort_repeat": {"repeat_rate_pct": "decimal(5,2)"},
    "rfm": {"monetary": "decimal(12,2)"},
}


#: Computed columns that grow with the tables, so they may outgrow their printed type.
GROWING = ("revenue", "monetary")


def reported(question: str, df: DataFrame) -> DataFrame:
    """The result of a question in its printed decimal types (rounded half up).

    A sum that has too many digits for its printed type gets more of them, and the same decimals, instead of an error.
    """
    types = dict(REPORTED[question])
    growing = [c for c in types if c in GROWING]
    if growing:
        df = kept(df)  # one row tells whether the values fit
        places = {c: [int(n) for n in re.findall(r"\d+", types[c])] for c in growing}
        largest = df.agg(*[F.max(F.abs(F.round(c, places[c][1]))).alias(c) for c in growing]).first()
        types |= {c: f"decimal(38,{n})" for c, (digits, n) in places.items()
                  if largest[c] is not None and largest[c] >= 10 ** (digits - n)}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
