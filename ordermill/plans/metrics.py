"""Measures that stay right at the grand total, under any grouping and under any slicer.

Facts are reduced through fixed grains: item rows to orders, orders to persons,
persons to groups. Every measure is a sum, a count or a ratio of those at the last
grain, so one aggregation chain serves all of them, without ``count(distinct)``
and without one hot order or person holding up a task.

Several groupings (the visuals of a page) share one pass over the facts: orders are
reduced by grouping sets, then each order goes to the groupings that it belongs to.
For growth it also goes to the month after its own, as what that month compares with,
so growth needs neither a second pass nor a join of months.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.functions import columns as C
from ordermill.plans.star import DATE_COLUMNS, Star, star_join

MEASURES = ("total_revenue", "total_orders", "avg_order_value", "avg_delivery_days", "pct_late",
            "avg_review_score", "mom_growth", "repeat_customer_rate")

# Date columns that are constant inside a month, as growth needs them.
MONTH_COLUMNS = ("year_month", "year", "quarter", "month_number", "month_name")

# Columns computed from the fact row itself.
FACT_COLUMNS = {
    "delay_bin_7d": lambda: C.fixed_bin(F.col("delivery_delay_days"), 7),
    "delivery_delay_days": lambda: F.col("delivery_delay_days"),
    "is_late": lambda: F.col("is_late"),
}

Slicers = Mapping[str, Sequence]


#: A grouping: its measures and the columns it groups by.
Request = tuple[Sequence[str], Sequence[str]]
_SUMS = ("revenue", "orders", "days", "days_n", "late", "score", "score_n", "before")


def _matches(day: Column, where: Slicers) -> Column:
    """Whether a day passes the date slicers."""
    out = F.lit(True)
    for column, values in where.items():
        out &= DATE_COLUMNS[column](day).isin(list(values))
    return out


def _month_after(day: Column) -> Column:
    """The first day of the next month, which stands for it."""
    return F.trunc(F.add_months(day, 1), "MM")


def _on_dates(where: Slicers) -> dict[str, Sequence]:
    return {c: v for c, v in where.items() if c in DATE_COLUMNS}


def _delivered(star: Star, used: set[str], scored: bool, where: Slicers, growth: bool) -> DataFrame:
    """Delivered orders that the slicers keep, at the coarsest grain that still carries the used columns.

    Item rows are summed to one per order (and product or seller, if asked for) with map-side combine before any join,
    so a huge order stays small; reviews are only joined for the score measure. For growth the month before a selection stays.
    """
    own = {name: expr() for name, expr in FACT_COLUMNS.items() if name in used}
    keys = [key for dim, key in ((star.product, "product_id"), (star.seller, "seller_id")) if used & set(dim.columns)]
    day, dates = F.col("order_date"), _on_dates(where)
    orders = star.orders.filter(F.col("is_delivered") == 1)
    if dates:
        orders = orders.filter(_matches(day, dates) | (_matches(_month_after(day), dates) if growth else F.lit(False)))
    sold = star.items.groupBy("order_id", *keys).agg(F.sum(C.revenue()).alias("revenue"))
    orders = orders.withColumns(own)
    if scored:
        orders = orders.join(star.scores, "order_id", "left")
    score = F.col("review_score") if scored else F.lit(None).cast("int")
    facts = sold.join(orders, "order_id").select(
        "order_id", *keys, "customer_id", "order_date", *own, "revenue",
        F.col("delivery_days").alias("days"), F.col("is_late").alias("late"), score.alias("score"))
    facts = star_join(facts, star, used)
    for column, values in where.items():
        if column not in DATE_COLUMNS:
            facts = facts.filter(F.col(column).isin(list(values)))
    return facts


def delivered_facts(star: Star, used: set[str]) -> DataFrame:
    """Delivered orders with the dimension columns in ``used``, one row per order (and product or seller, if used)."""
    return _delivered(star, used, False, {}, False)


def _per_order(facts: DataFrame, star: Star, sets: Sequence[Sequence[str]], person: Sequence[str], own: Sequence[str]) -> DataFrame:
    """One row per order and group of each of ``sets``, numbered ``__set``: an order's own values count once in each."""
    columns = [c for c in dict.fromkeys(c for s in sets for c in s) if c not in person]
    values = (F.sum("revenue").alias("revenue"), *[F.max(c).alias(c) for c in ("days", "late", "score", "order_date", *own)])
    below = {"product_id", "seller_id"} & set(facts.columns)
    if len(sets) == 1 and not below:
        return facts.withColumn("__set", F.lit(0))
    keys = ["order_id", *person]
    if len(sets) == 1:
        return facts.groupBy(*columns, *keys).agg(*values).withColumn("__set", F.lit(0))
    grouped = [[F.col(c) for c in (*s, *keys)] for s in ([c for c in s if c not in person] for s in sets)]
    rows = facts.groupingSets(grouped, *[F.col(c) for c in (*columns, *keys)]).agg(F.grouping_id().alias("__id"), *values)
    top = len(columns) + len(keys) - 1  # a bit is set for each column that a set leaves out, the first column highest
    number = {sum(1 << (top - i) for i, c in enumerate(columns) if c not in s): n for n, s in enumerate(sets)}
    which = F.lit(None).cast("int")
    for code, n in number.items():
        which = F.when(F.col("__id") == code, n).otherwise(which)
    return rows.withColumn("__set", which).drop("__id")


def _states(star: Star, requests: Sequence[Request], where: Slicers) -> DataFrame:
    """Sums and counts per request (``__request``) and group, from which every measure follows."""
    growth = any("mom_growth" in m for m, _ in requests)
    per_person = any("repeat_customer_rate" in m for m, _ in requests)
    scored = any("avg_review_score" in m for m, _ in requests)
    columns = list(dict.fromkeys(c for _, by in requests for c in by))
    if (set(columns) | set(where)) & set(DATE_COLUMNS) and star.fixed:
        star.date  # a purchase outside a given calendar is an error
    person = ["customer_unique_id"] if per_person else []
    used = {*columns, *where, *person}
    facts = _delivered(star, used, scored, where, growth)
    own = [c for c in FACT_COLUMNS if c in columns]
    dims = [[c for c in by if c not in DATE_COLUMNS and c not in own] for _, by in requests]
    sets = list(dict.fromkeys(map(tuple, dims)))
    rows = _per_order(facts, star, sets, person, own)
    # an order goes to the requests of its set, and for growth to the month after its own as well
    goes = []
    for n, ((measures, _), dim) in enumerate(zip(requests, dims)):
        for shift in (0, 1) if "mom_growth" in measures else (0,):
            goes.append(F.struct(F.lit(n).alias("request"), F.lit(shift).alias("shift"), F.lit(sets.index(tuple(dim))).alias("set")))
    if len(goes) > 1:
        rows = rows.withColumn("__to", F.explode(F.filter(F.array(*goes), lambda g: g["set"] == F.col("__set"))))
    else:
        rows = rows.withColumn("__to", goes[0])
    now = F.col("__to.shift") == 0
    day = F.when(now, F.col("order_date")).otherwise(_month_after(F.col("order_date"))) if growth else F.col("order_date")
    rows = rows.withColumn("__day", day)
    if growth and star.fixed:
        rows = rows.filter(F.col("__day").between(*star.fixed))
    if dates := _on_dates(where):
        rows = rows.filter(_matches(F.col("__day"), dates))

    def part(column: str) -> Column:
        """The column in the requests that group by it."""
        value = DATE_COLUMNS[column](F.col("__day")) if column in DATE_COLUMNS else F.col(column)
        inside = [n for n, (_, by) in enumerate(requests) if column in by]
        return value if len(inside) == len(requests) else F.when(F.col("__to.request").isin(inside), value)
    with_person = [n for n, (m, _) in enumerate(requests) if "repeat_customer_rate" in m]
    states = rows.select(
        F.col("__to.request").alias("__request"), *[part(c).alias(c) for c in columns],
        *[F.when(F.col("__to.request").isin(with_person), F.col(c)).alias("__person") for c in person],
        *[F.when(now, F.col(c)).alias(c) for c in ("revenue", "days", "late", "score")],
        F.when(now, 1).alias("orders"), F.when(~now, F.col("revenue")).alias("before"))
    sums = [F.sum("revenue").alias("revenue"), F.count("orders").alias("orders"), F.sum("days").alias("days"),
            F.count("days").alias("days_n"), F.sum("late").alias("late"), F.sum("score").alias("score"),
            F.count("score").alias("score_n"), F.sum("before").alias("before")]
    keys = ["__request", *columns] if len(requests) > 1 else columns
    if not person:
        return states.groupBy(*keys).agg(*sums)
    per_human = states.groupBy(*keys, "__person").agg(*sums)
    return per_human.groupBy(*keys).agg(
        F.count_if(F.col("orders") > 1).alias("repeaters"), F.count_if(F.col("orders") > 0).alias("persons"),
        *[F.sum(c).alias(c) for c in _SUMS])


def _formula(measure: str) -> Column:
    """A measure from the sums and counts of its group.

    Growth compares with the same group one calendar month earlier: a group without earlier revenue gets null; one that
    has earlier revenue but none of its own gets -1, and no other measure.
    """
    if measure == "total_revenue":
        return F.col("revenue")
    if measure == "mom_growth":
        return C.ratio(F.coalesce("revenue", F.lit(0)) - F.col("before"), F.col("before"))
    parts = {"avg_order_value": ("revenue", "orders"), "avg_delivery_days": ("days", "days_n"),
             "pct_late": ("late", "orders"), "avg_review_score": ("score", "score_n"),
             "repeat_customer_rate": ("repeaters", "persons")}
    top, bottom = parts[measure]
    return C.ratio(F.col(top), F.col(bottom))


def _orders(by: Sequence[str]) -> Column:
    """Orders of a group; none at all is 0 in the grand total."""
    return F.when(F.col("orders") > 0, F.col("orders")) if by else F.coalesce("orders", F.lit(0).cast("long"))


def _checked(requests: Sequence[Request], where: Slicers) -> None:
    for measures, by in requests:
        unknown = set(measures) - set(MEASURES)
        if unknown:
            raise ValueError(f"unknown measures: {sorted(unknown)}")
        bad = [c for c in (*by, *where) if c in DATE_COLUMNS and c not in MONTH_COLUMNS]
        if bad and "mom_growth" in measures:
            raise ValueError(f"growth needs whole months, not {bad}")


def evaluate_all(star: Star, requests: Mapping[str, Request], where: Slicers | None = None) -> DataFrame:
    """Several groupings in one pass over the facts: ``visual``, every column any of them groups by, and every measure.

    What a visual does not group by or ask for is null in its rows; ``select_visual`` cuts one out.
    """
    where, wanted = dict(where or {}), list(requests.values())
    _checked(wanted, where)
    columns = list(dict.fromkeys(c for _, by in wanted for c in by))
    states = _states(star, wanted, where)
    if len(wanted) == 1:
        states = states.withColumn("__request", F.lit(0))
    request = F.col("__request")

    def where_asked(measure: str) -> Column:
        asking = [n for n, (m, _) in enumerate(wanted) if measure in m]
        if measure != "total_orders":
            return F.when(request.isin(asking), _formula(measure))
        total = [n for n in asking if not wanted[n][1]]
        return F.when(request.isin(total), _orders(())).when(request.isin(asking), _orders(columns))
    names = F.element_at(F.array(*[F.lit(n) for n in requests]), request + 1)
    measures = [m for m in MEASURES if any(m in asked for asked, _ in wanted)]
    return states.select(names.alias("visual"), *columns, *[where_asked(m).alias(m) for m in measures])


def select_visual(rows: DataFrame, name: str, request: Request) -> DataFrame:
    """The rows of one visual, with its own columns; a grand total has a row even when nothing is left."""
    measures, by = request
    out = rows.filter(F.col("visual") == name).select(*by, *measures)
    if by:
        return out
    return out.agg(*[F.coalesce(F.max(m), F.lit(0)).alias(m) if m == "total_orders" else F.max(m).alias(m) for m in measures])


def evaluate(star: Star, measures: Sequence[str], by: Sequence[str] = (),
             where: Slicers | None = None) -> DataFrame:
    """Measures per group of dimension columns, under slicers given as column -> values."""
    by, where = list(by), dict(where or {})
    _checked([(measures, by)], where)
    states = _states(star, [(measures, by)], where)
    return states.select(*by, *[(_orders(by) if m == "total_orders" else _formula(m)).alias(m) for m in measures])
