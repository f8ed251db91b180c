"""Cleaning: repair what is wrong in a table, keep everything a later question may need."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.operators.ranking import exact_quantiles, first_rows
from ordermill.operators.shaping import inline_rows, union_rows
from ordermill.schemas import DATE_COLUMNS

# Bounding box of the country, both ends included.
LAT_RANGE = (-33.8, 5.3)
LNG_RANGE = (-74.0, -34.7)

# Categories that the translation file lacks.
MANUAL_TRANSLATIONS = (
    ("pc_gamer", "pc_gamer"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_food_preparers"),
)

# Column names misspelled in the source.
MISSPELLED = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}


def parse_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to timestamps without a zone; null stays null, bad text raises."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def clean_orders(orders: DataFrame) -> DataFrame:
    return parse_timestamps(orders, DATE_COLUMNS["orders"])


def clean_order_items(items: DataFrame) -> DataFrame:
    return parse_timestamps(items, DATE_COLUMNS["order_items"])


def clean_payments(payments: DataFrame) -> DataFrame:
    """Drop undefined payment types (a null type is kept) and lift 0 installments to 1."""
    return payments.filter(~F.col("payment_type").eqNullSafe("not_defined")).withColumn(
        "payment_installments",
        F.when(F.col("payment_installments") == 0, 1).otherwise(F.col("payment_installments")))


def keep_latest(df: DataFrame, keys: Sequence[str], latest: str,
                ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest by ``latest`` (null counts as latest), ties by larger values."""
    order = [F.col(latest).desc_nulls_first(), *[F.col(c).desc_nulls_last() for c in ties]]
    return first_rows(df, keys, order)


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """One review per order: the customer's last answer."""
    return keep_latest(parse_timestamps(reviews, DATE_COLUMNS["reviews"]), ["order_id"],
                       "review_answer_timestamp", ["review_id", "review_score"])


def translate(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Add the English category name; products without a category keep null.

    A category with more than one translation stops the job, as it would multiply products.
    Spark broadcasts the translation when its size allows and otherwise joins by shuffle.
    """
    key, english = "product_category_name", "product_category_name_english"
    once = translation.groupBy(key).agg(F.count("*").alias("__n"), F.max(english).alias("__english"))
    checked = F.when(F.col("__n") == 1, F.col("__english")).otherwise(
        F.raise_error(F.concat(F.lit("translated more than once: "), F.col(key))))
    return products.join(once.select(key, checked.alias(english)), key, "left")


def clean_products(products: DataFrame, translation: DataFrame,
                   extra: Sequence[tuple[str, str]] = MANUAL_TRANSLATIONS) -> DataFrame:
    added = inline_rows(products.sparkSession, extra,
                        "product_category_name string, product_category_name_english string")
    return translate(products.withColumnsRenamed(MISSPELLED), union_rows(translation, added))


def inside_box(df: DataFrame, lat=LAT_RANGE, lng=LNG_RANGE) -> DataFrame:
    """Points inside the box; a missing coordinate is outside."""
    return df.filter(F.col("geolocation_lat").between(*lat) & F.col("geolocation_lng").between(*lng))


def zip_centroid(points: DataFrame) -> DataFrame:
    """Median latitude and longitude per zip prefix over distinct points inside the box.

    Both axes run through one exact-quantile pass keyed by (zip, axis); it splits
    a zip that holds most of the points over many tasks.
    """
    zip_ = "geolocation_zip_code_prefix"
    distinct = inside_box(points).dropDuplicates()
    axes = distinct.unpivot([zip_], ["geolocation_lat", "geolocation_lng"], "axis", "degrees")
    medians = exact_quantiles(axes, "degrees", {"median": 0.5}, [zip_, "axis"])
    return medians.groupBy(zip_).agg(*[
        F.max(F.when(F.col("axis") == axis, F.col("median"))).alias(axis)
        for axis in ("geolocation_lat", "geolocation_lng")])


def fill_unknown(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls; applied after joins it also covers rows that found no match."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


class LazyTables(Mapping):
    """Table name to frame, each built by its function on first use."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


def clean_all(raw: Mapping[str, DataFrame],
              extra_translations: Sequence[tuple[str, str]] = MANUAL_TRANSLATIONS) -> LazyTables:
    """All cleaned tables; the translation is folded into products and not kept."""
    return LazyTables({
        "customers": lambda: raw["customers"],
        "sellers": lambda: raw["sellers"],
        "products": lambda: clean_products(raw["products"], raw["translation"], extra_translations),
        "geolocation": lambda: zip_centroid(raw["geolocation"]),
        "orders": lambda: clean_orders(raw["orders"]),
        "order_items": lambda: clean_order_items(raw["order_items"]),
        "payments": lambda: clean_payments(raw["payments"]),
        "reviews": lambda: clean_reviews(raw["reviews"]),
    })
