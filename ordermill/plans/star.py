"""The star schema: one fact table at item grain and four dimensions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.cleaning import fill_unknown
from ordermill.operators.shaping import day_spine
from ordermill.sources.files import register_views

# First and last day of the source data's calendar.
CALENDAR = (date(2016, 9, 1), date(2018, 12, 31))

def order_facts(orders: DataFrame) -> DataFrame:
    """What the fact rows know about their order, one row per order."""
    return orders.select(
        "order_id", "customer_id", F.to_date("order_purchase_timestamp").alias("order_date"),
        "order_status", C.is_delivered().alias("is_delivered"),
        C.order_delivery_days().alias("delivery_days"),
        C.order_delay_days().alias("delivery_delay_days"), C.order_is_late().alias("is_late"))


def order_scores(reviews: DataFrame) -> DataFrame:
    return reviews.select("order_id", "review_score")


def fact_order_items(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per item unit, all statuses kept.

    Delivery days, delay and score belong to the order and repeat on each of its
    rows; measures over them count every order once.
    """
    placed = order_facts(orders).join(order_scores(reviews), "order_id", "left")
    return items.join(placed, "order_id").select(
        "order_id", "order_item_id", "customer_id", "product_id", "seller_id", "order_date",
        "order_status", "is_delivered", "price", "freight_value", C.revenue().alias("revenue"),
        "delivery_days", "delivery_delay_days", "is_late", "review_score")


def _located(df: DataFrame, geolocation: DataFrame, zip_column: str) -> DataFrame:
    """Coordinates by zip prefix; places without any stay, with nulls."""
    points = geolocation.select(F.col("geolocation_zip_code_prefix").alias(zip_column),
                                "geolocation_lat", "geolocation_lng")
    return df.join(points, zip_column, "left")


def dim_customer(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    return _located(customers, geolocation, "customer_zip_code_prefix").select(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        "customer_state", "geolocation_lat", "geolocation_lng")


def dim_product(products: DataFrame) -> DataFrame:
    return fill_unknown(
        products.withColumnRenamed("product_category_name_english", "category"),
        {"category": "unknown"}).select(
        "product_id", "category", "product_photos_qty", "product_weight_g")


def dim_seller(sellers: DataFrame, geolocation: DataFrame) -> DataFrame:
    return _located(sellers, geolocation, "seller_zip_code_prefix").select(
        "seller_id", "seller_city", "seller_state", "geolocation_lat", "geolocation_lng")


#: What the calendar says of a day.
DATE_COLUMNS: dict[str, Callable[[Column], Column]] = {
    "date": lambda day: day, "year": F.year, "quarter": F.quarter, "month_number": F.month,
    "month_name": lambda day: F.date_format(day, "MMMM"), "year_month": lambda day: F.trunc(day, "MM"),
    "day_name": lambda day: F.date_format(day, "EEEE"), "is_weekend": C.is_weekend,
}


def _calendar(days: DataFrame) -> DataFrame:
    return days.select(*[of(F.col("date")).alias(name) for name, of in DATE_COLUMNS.items()])


def dim_date(spark: SparkSession, start: date = CALENDAR[0], end: date = CALENDAR[1]) -> DataFrame:
    """One row per calendar day, both ends included."""
    return _calendar(day_spine(spark, start, end))


def order_span(orders: DataFrame) -> tuple[date, date] | None:
    """First and last purchase day; one row reaches the driver. None without any purchase."""
    bought = F.to_date("order_purchase_timestamp")
    first, last = orders.agg(F.min(bought), F.max(bought)).first()
    return (first, last) if first else None


def dim_date_of(orders: DataFrame, months_after: int = 0) -> DataFrame:
    """The calendar of whole months that covers all purchases, and so many months more."""
    bought = F.to_date("order_purchase_timestamp")
    span = orders.agg(F.trunc(F.min(bought), "MM").alias("first"),
                      F.last_day(F.add_months(F.max(bought), months_after)).alias("last"))
    return _calendar(span.select(F.explode(F.sequence("first", "last")).alias("date")))


@dataclass(frozen=True)
class Star:
    """The five views, and the tables behind the fact.

    Measures start from the latter, so that items are summed before they meet
    their order and reviews are only read where a score is asked for.
    """

    fact: DataFrame
    items: DataFrame
    orders: DataFrame
    scores: DataFrame
    customer: DataFrame
    product: DataFrame
    seller: DataFrame
    calendar: Callable[[], DataFrame]
    fixed: tuple[date, date] | None = None

    @cached_property
    def date(self) -> DataFrame:
        return self.calendar()

    def views(self) -> dict[str, DataFrame]:
        return {"fact_order_items": self.fact, "dim_customer": self.customer,
                "dim_product": self.product, "dim_seller": self.seller, "dim_date": self.date}


def build_star(spark: SparkSession, tables: Mapping[str, DataFrame],
               calendar: tuple[date, date] | None = None, with_places: bool = True) -> Star:
    """All five views of the cleaned tables.

    Without ``calendar`` the days come from the orders: whole months, and one more, in which
    growth sees the last month as the one before. A given calendar that misses a purchase
    raises an error.
    ``with_places=False`` leaves the coordinates out of the dimensions, so that
    measures do not start the geolocation jobs.
    """
    customers, sellers, orders = tables["customers"], tables["sellers"], tables["orders"]

    def days() -> DataFrame:
        if not calendar:
            return dim_date_of(orders, 1)
        span = order_span(orders)
        if span and not calendar[0] <= span[0] <= span[1] <= calendar[1]:
            raise ValueError(f"the calendar {calendar} misses purchases between {span[0]} and {span[1]}")
        return dim_date(spark, *calendar)
    return Star(
        items=tables["order_items"], orders=order_facts(tables["orders"]),
        scores=order_scores(tables["reviews"]),
        fact=fact_order_items(tables["order_items"], tables["orders"], tables["reviews"]),
        customer=dim_customer(customers, tables["geolocation"]) if with_places else customers,
        product=dim_product(tables["products"]),
        seller=dim_seller(sellers, tables["geolocation"]) if with_places else sellers,
        calendar=days, fixed=calendar)


def register_star(spark: SparkSession, star: Star) -> DataFrame:
    """Create or replace the five views and list them."""
    return register_views(spark, star.views())


def star_join(facts: DataFrame, star: Star, needed: set[str]) -> DataFrame:
    """Fact rows with only the customer, product and seller columns in ``needed``.

    Each dimension is many-to-one, so no fact row multiplies. Spark broadcasts a
    dimension when its size allows. What the calendar says of a day follows from the day itself (``DATE_COLUMNS``).
    """
    dims = ((star.customer, "customer_id"), (star.product, "product_id"),
            (star.seller, "seller_id"))
    for dim, key in dims:
        wanted = [c for c in dim.columns if c in needed and c != key]
        if wanted:
            facts = facts.join(dim.select(key, *wanted), key, "left")
    return facts
