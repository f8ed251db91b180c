"""The feature table of the low-review model, its split, weights and level folding.

A feature may only use what is known when the parcel arrives. Nothing that the
review itself produces is allowed, except the score that becomes the label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.operators.cleaning import fill_unknown
from ordermill.operators.shaping import attach_row, left_join_all, top_n
from ordermill.plans.questions import delivered_dated
from ordermill.session import kept, written

# The model's columns.
NUMERIC = ("delivery_delay_days", "delivery_days", "price_total", "freight_total", "item_count",
           "max_installments", "cross_state")
CATEGORICAL = ("category", "payment_type")
LABEL = "is_low_review"
INFREQUENT = "infrequent"
# More values than this is no label to stratify by.
MAX_LABELS = 1000
SEED = 42


def argmax(payload: str, value: str, ties: Sequence[str]) -> Column:
    """Aggregate: ``payload`` of the row with the largest value, ties by the smallest ``ties``.

    It combines on the map side, so a hot group never meets in one task as rows.
    """
    return F.min_by(payload, F.struct(F.col(value).isNull(), -F.col(value), *ties))


def item_features(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per order: totals, count, priciest product and the range of seller states.

    Every seller sits in the customer's state exactly when the smallest and the
    largest seller state both equal it, so no item row has to meet its customer.
    """
    states = sellers.select("seller_id", F.coalesce("seller_state", F.lit("")).alias("state"))
    return items.join(states, "seller_id", "left").groupBy("order_id").agg(
        F.sum("price").alias("price_total"), F.sum("freight_value").alias("freight_total"),
        F.count("*").alias("item_count"),
        argmax("product_id", "price", ["order_item_id", "product_id"]).alias("product_id"),
        F.min("state").alias("__first_state"), F.max("state").alias("__last_state"))


def payment_features(payments: DataFrame) -> DataFrame:
    """Per order: type of the largest leg and the most installments."""
    return payments.groupBy("order_id").agg(
        argmax("payment_type", "payment_value", ["payment_sequential", "payment_type"]).alias(
            "payment_type"),
        F.max("payment_installments").alias("max_installments"))


def feature_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per delivered and reviewed order.

    The joins on ``order_id`` come first and share one shuffle of the orders; an
    order without items keeps nulls in its item features.
    """
    timed = delivered_dated(tables["orders"]).select(
        "order_id", "customer_id", C.order_delay_days().alias("delivery_delay_days"),
        C.order_delivery_days().alias("delivery_days"))
    reviewed = timed.join(tables["reviews"].select("order_id", "review_score"), "order_id")
    rolled = left_join_all(reviewed, [
        item_features(tables["order_items"], tables["sellers"]),
        payment_features(tables["payments"])], "order_id")
    home = tables["customers"].select("customer_id", "customer_state")
    named = tables["products"].select(
        "product_id", F.col("product_category_name_english").alias("category"))
    joined = rolled.join(home, "customer_id", "left").join(named, "product_id", "left")
    differs = ~(F.col("__first_state").eqNullSafe(F.col("customer_state"))
                & F.col("__last_state").eqNullSafe(F.col("customer_state")))
    return fill_unknown(joined, {"category": "unknown", "payment_type": "unknown",
                                 "max_installments": 1}).select(
        "order_id", "delivery_delay_days", "delivery_days", "price_total", "freight_total",
        "item_count", "category",
        F.when(F.col("__first_state").isNotNull(), differs.cast("int")).alias("cross_state"),
        "payment_type", "max_installments", C.is_low_review(F.col("review_score")).alias(LABEL))


def model_rows(features: DataFrame) -> DataFrame:
    """Rows a model can use: orders that have items."""
    return features.filter(F.col("item_count").isNotNull())


def hash_order(key: str, seed: int) -> Column:
    """A repeatable pseudo-random order of rows."""
    return F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))


#: Hash digits by which rows are counted, and how many rows around a cut may be ordered.
_DIGITS, _NEAR = 4, 1_000_000


def first_by_hash(rows: DataFrame, label: str, wanted: Column, key: str) -> DataFrame:
    """Per label the place (``cut``) of its ``wanted``-th row by (``__hash``, key); none where nothing is wanted.

    Nothing is sorted: rows are counted per range of the hash, the range in which the wanted row lies is divided further
    until few rows are left, and only these are ordered.
    """
    state = rows.groupBy(label).agg(F.count("*").alias("__size")).withColumn("__left", wanted.cast("long")) \
                .filter("__left > 0").select(label, "__left", F.lit("").alias("__range"))
    if state.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values")
    digits, near = 0, rows
    while True:
        digits += _DIGITS
        # one row per label
        inside = near.join(F.broadcast(state), label).filter(F.substring("__hash", 1, digits - _DIGITS) == F.col("__range"))
        counts = inside.groupBy(label, "__left", F.substring("__hash", 1, digits).alias("__range")).agg(F.count("*").alias("__n"))
        upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(label).orderBy("__range")))  # ranges of one range
        hit = kept(upto.filter((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left"))))
        state = hit.select(label, (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"), "__range")
        if (hit.agg(F.sum("__n")).first()[0] or 0) <= _NEAR or digits >= 32:
            break
    last = near.join(F.broadcast(state), label).filter(F.substring("__hash", 1, digits) == F.col("__range"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("__hash", key))
    return last.withColumn("__place", place).filter("__place = __left").select(label, F.struct("__hash", key).alias("cut"))


def stratified_split(df: DataFrame, label: str = LABEL, key: str = "order_id",
                     fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Mark exactly the rounded fraction of every label as test rows (``is_test``): its first ones by a hash of the key.

    The rows are written once, as they come; the hash at which a label's test rows end is found by counting.
    """
    # a row without a label has no side
    labelled = F.coalesce(F.col(label), F.raise_error(F.lit(f"a row has no {label}")).cast(df.schema[label].dataType))
    rows = written(df.withColumn(label, labelled).withColumn("__hash", hash_order(key, seed)), "split")
    cuts = first_by_hash(rows.select(label, "__hash", key), label, F.round(F.lit(fraction) * F.col("__size")), key)
    return rows.join(F.broadcast(cuts), label, "left").select(  # one row per label
        *df.columns, F.coalesce(F.struct("__hash", key) <= F.col("cut"), F.lit(False)).alias("is_test"))


def split_counts(split: DataFrame, label: str = LABEL) -> DataFrame:
    return split.groupBy("is_test").agg(F.count("*").alias("n"), F.avg(label).alias("prevalence"))


def balanced_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Per label: rows, the balanced class weight, and the negative-to-positive ratio."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("__all"), F.count("*").alias("__labels"),
                        F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("__neg"),
                        F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("__pos"))
    return attach_row(counts, totals).select(
        label, "n",
        C.ratio(F.col("__all"), F.col("__labels") * F.col("n")).alias("weight"),
        C.ratio(F.col("__neg"), F.col("__pos")).alias("imbalance_ratio"))


def frequent_levels(train: DataFrame, column: str, min_count: int = 500,
                    max_levels: int = 10_000) -> list[str]:
    """Levels with at least ``min_count`` training rows, sorted.

    They become one-hot columns, so they have to fit the driver. Their number is
    checked: more than ``max_levels`` raises instead of being cut.
    """
    found = train.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("__n")).filter(F.col("__n") >= min_count).select(column).limit(
        max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} frequent levels")
    return sorted(r[0] for r in found)


def fold_level(value: Column, frequent: Sequence[str], other: str = INFREQUENT) -> Column:
    """Replace every level that is not frequent, unseen and missing ones included, by one level."""
    return F.when(value.isin(list(frequent)), value).otherwise(other)


def moments(train: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """One row with mean and population standard deviation of every column.

    The mean comes first; the deviation is taken from distances to the rounded mean, which are
    exact decimals. Nothing large cancels that way, a constant column has deviation 0, and the
    result does not depend on the order in which partitions are merged.
    """
    n = F.count("*").cast("double")
    exact = "decimal(18,2)"
    means = train.agg(*[(F.sum(F.col(c).cast(exact)).cast("double") / n).alias(f"{c}__mean") for c in columns])
    out = []
    for c in columns:
        far = F.col(c).cast(exact) - F.round(f"{c}__mean", 2).cast(exact)
        squares, rest = F.sum(far * far).cast("double") / n, F.sum(far).cast("double") / n
        out += [F.max(f"{c}__mean").alias(f"{c}__mean"),
                F.sqrt(F.greatest(squares - rest * rest, F.lit(0.0))).alias(f"{c}__std")]
    return attach_row(train, means).agg(*out)


def scaled(column: str, stats: Mapping[str, float]) -> Column:
    """Zero mean and unit variance by the training moments; a constant column becomes 0."""
    centred = F.col(column).cast("double") - F.lit(stats[f"{column}__mean"])
    spread = stats[f"{column}__std"]
    return centred / F.lit(spread) if spread else F.lit(0.0)


def sample_rows(df: DataFrame, n: int = 5000, key: str = "order_id", seed: int = SEED) -> DataFrame:
    """A repeatable sample of ``n`` rows."""
    return top_n(df, n, [hash_order(key, seed), key])
