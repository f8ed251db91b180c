"""Distinct counts from mergeable sketches, beside the exact ones of ``metrics``.

An exact distinct count cannot be added up over months or groups. A sketch can: one is kept per month and group of the
asked dimensions, a few kilobytes each, and any grouping or slicer over them is a union of sketches, without another pass
over the orders. Estimates have a relative standard error of ``ERROR``; counts up to some hundreds come out nearly exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.plans.metrics import FACT_COLUMNS, MONTH_COLUMNS, Slicers, delivered_facts
from ordermill.plans.star import DATE_COLUMNS, Star

#: Registers of a sketch, as a power of two, and the relative standard error that follows.
REGISTERS = 14
ERROR = 0.833 / 2 ** (REGISTERS / 2)
COUNTED = {"persons": "customer_unique_id", "orders": "order_id"}


def monthly_sketches(star: Star, dims: Sequence[str] = ()) -> DataFrame:
    """(year_month, dims, persons, orders): sketches of who bought and of the orders, from one pass over the facts."""
    bad = [c for c in dims if c in DATE_COLUMNS or c in FACT_COLUMNS]
    if bad:
        raise ValueError(f"months are kept already, and {bad} are no dimensions")
    facts = delivered_facts(star, {*dims, "customer_unique_id"})
    return facts.groupBy(DATE_COLUMNS["year_month"](F.col("order_date")).alias("year_month"), *dims).agg(
        *[F.hll_sketch_agg(c, F.lit(REGISTERS)).alias(name) for name, c in COUNTED.items()])


def estimated(sketches: DataFrame, by: Sequence[str] = (), where: Slicers | None = None) -> DataFrame:
    """Distinct persons and orders per group of months' columns and kept dimensions, under slicers on the same columns."""
    dims = [c for c in sketches.columns if c != "year_month" and c not in COUNTED]
    bad = [c for c in (*by, *(where or {})) if c not in dims and c not in MONTH_COLUMNS]
    if bad:
        raise ValueError(f"not kept in these sketches: {bad}")
    day = F.col("year_month")
    rows = sketches.select(*COUNTED, *dims, *[DATE_COLUMNS[c](day).alias(c) for c in MONTH_COLUMNS])
    for column, values in (where or {}).items():
        rows = rows.filter(F.col(column).isin(list(values)))
    return rows.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in COUNTED])
