"""The data behind the three dashboard pages, one frame per visual."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.shaping import top_n_with_ties
from ordermill.plans.metrics import Request, Slicers, evaluate, evaluate_all, select_visual
from ordermill.plans.star import Star
from ordermill.session import kept


def top_categories(star: Star, where: Slicers | None = None, n: int = 10) -> DataFrame:
    return top_n_with_ties(evaluate(star, ["total_revenue"], ["category"], where), n,
                           "total_revenue").orderBy(F.col("total_revenue").desc(), "category")


def top_states(star: Star, where: Slicers | None = None, n: int = 10) -> DataFrame:
    return top_n_with_ties(evaluate(star, ["total_revenue"], ["customer_state"], where), n,
                           "total_revenue").orderBy(F.col("total_revenue").desc(), "customer_state")


def category_economics(star: Star, where: Slicers | None = None) -> DataFrame:
    return evaluate(star, ["total_revenue", "total_orders", "avg_order_value", "avg_review_score"],
                    ["category"], where).orderBy(F.col("total_revenue").desc(), "category")


def delivery_by_state(star: Star, where: Slicers | None = None) -> DataFrame:
    return evaluate(star, ["avg_delivery_days"], ["customer_state"], where).orderBy(
        F.col("avg_delivery_days").desc(), "customer_state")


def late_by_month(star: Star, where: Slicers | None = None) -> DataFrame:
    return evaluate(star, ["pct_late"], ["year_month"], where).orderBy("year_month")


def score_by_delay_bin(star: Star, where: Slicers | None = None) -> DataFrame:
    return evaluate(star, ["avg_review_score"], ["delay_bin_7d"], where).orderBy("delay_bin_7d")


def months_sorted(star: Star, where: Slicers | None = None) -> DataFrame:
    """Month names in calendar order, not alphabetical."""
    return evaluate(star, ["total_orders"], ["month_name", "month_number"], where).orderBy(
        "month_number")


#: Visual -> its measures and the columns that it groups by.
OVERVIEW: dict[str, Request] = {
    "cards": (("total_revenue", "total_orders", "avg_order_value", "avg_review_score"), ()),
    "monthly_revenue": (("total_revenue", "mom_growth"), ("year_month",)),
    "top_categories": (("total_revenue",), ("category",)),
    "top_states": (("total_revenue",), ("customer_state",)),
}
CUSTOMERS: dict[str, Request] = {
    "cards": (("repeat_customer_rate", "avg_order_value", "total_orders"), ()),
    "orders_by_month": (("total_orders",), ("year_month",)),
    "orders_by_state": (("total_orders",), ("customer_state",)),
    "category_economics": (("total_revenue", "total_orders", "avg_order_value", "avg_review_score"), ("category",)),
}
DELIVERY: dict[str, Request] = {
    "cards": (("avg_delivery_days", "pct_late", "avg_review_score"), ()),
    "days_by_state": (("avg_delivery_days",), ("customer_state",)),
    "late_by_month": (("pct_late",), ("year_month",)),
    "score_by_delay_bin": (("avg_review_score",), ("delay_bin_7d",)),
}
#: How cards and axes print a value.
LABELS = {"total_revenue": lambda v: C.number_label(v), "total_orders": lambda v: C.number_label(v),
          "avg_order_value": lambda v: C.number_label(v, 2), "avg_review_score": lambda v: C.number_label(v, 2),
          "avg_delivery_days": lambda v: C.number_label(C.rounded_half_even(v, 1), 1),
          "pct_late": C.percent_label, "mom_growth": C.percent_label, "repeat_customer_rate": C.percent_label,
          "year_month": C.month_label}


def whole_page(star: Star, visuals: Mapping[str, Request], where: Slicers | None = None) -> DataFrame:
    """All visuals of a page in one frame, from one pass over the facts, with the labels that cards and axes print."""
    rows = evaluate_all(star, visuals, where)
    return rows.select("*", *[LABELS[c](F.col(c)).alias(f"{c}_label") for c in rows.columns if c in LABELS])


def _split_page(star: Star, visuals: Mapping[str, Request], where: Slicers | None) -> dict[str, DataFrame]:
    """The visuals of a page; the pass over the facts is made once and its few rows are kept."""
    rows = kept(evaluate_all(star, visuals, where))
    return {name: _arranged(name, select_visual(rows, name, request)) for name, request in visuals.items()}


def _arranged(name: str, rows: DataFrame) -> DataFrame:
    if name in ("top_categories", "top_states"):
        column = rows.columns[0]
        return top_n_with_ties(rows, 10, "total_revenue").orderBy(F.col("total_revenue").desc(), column)
    if name == "category_economics":
        return rows.orderBy(F.col("total_revenue").desc(), "category")
    if name == "days_by_state":
        return rows.orderBy(F.col("avg_delivery_days").desc(), "customer_state")
    return rows.orderBy(rows.columns[0]) if name != "cards" else rows


def page_overview(star: Star, where: Slicers | None = None) -> dict[str, DataFrame]:
    return _split_page(star, OVERVIEW, where)


def page_customers(star: Star, where: Slicers | None = None) -> dict[str, DataFrame]:
    return _split_page(star, CUSTOMERS, where)


def page_delivery(star: Star, where: Slicers | None = None) -> dict[str, DataFrame]:
    return _split_page(star, DELIVERY, where)
