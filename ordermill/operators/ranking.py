"""Ranks, prefix sums, tiles and exact quantiles that never pull a whole table into one task.

A window without ``partitionBy`` sends every row to one task. Here the rows are
range-partitioned on the sort order instead, so equal keys and hot groups spread
over many tasks as long as the order is total. Only one small row per
*partition* (its size or its sums) is combined centrally.

The sorted rows are checkpointed because partition numbers are read twice (once
for the sizes, once for the rows). A second evaluation could sample other range
bounds and move rows; a checkpoint also survives lost executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.session import shared_dir

_PART = "__part"
_ROW_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id: row number in its partition


def columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1,
               rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group under a total order, optionally with their 1-based rank.

    Spark keeps at most ``n`` rows per group and map task before the shuffle
    (WindowGroupLimit), so a group that holds a third of all rows costs its task
    only ``n`` rows per map task.
    """
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*columns(order))
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def globally_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partitioned, sorted and checkpointed rows; the order must be total."""
    shared_dir(df.sparkSession)
    order = columns(order)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)


def _before(per_part: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Totals of all earlier partitions; the input has one row per partition."""
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        _PART, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}__before") for c in sums])


def with_position(ordered: DataFrame, position: str, total: str | None = None) -> DataFrame:
    """1-based global position on rows from ``globally_sorted``, without another shuffle."""
    rows = ordered.select(
        "*", F.spark_partition_id().alias(_PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)).alias("__row"))
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("__size"))
    offsets = _before(sizes, ["__size"])
    if total:
        offsets = offsets.crossJoin(F.broadcast(sizes.agg(F.sum("__size").alias(total))))
    # one row per partition: bounded by the partition count, not by the data
    out = rows.join(F.broadcast(offsets), _PART)
    return out.withColumn(position, F.col("__size__before") + F.col("__row") + 1).drop(
        _PART, "__row", "__size__before")


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str,
                      total: str | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` over the whole table."""
    return with_position(globally_sorted(df, order), name, total)


#: Rank error of the sketch that brackets a bound, as one part in so many rows.
_ACCURACY = 10_000


def tile_bounds(rows: DataFrame, k: int, value: str, key: str) -> list[tuple]:
    """The (value, key) of the last row of every tile but the last, in ascending order of both.

    Nothing is sorted as a whole: a mergeable sketch brackets each bound, the rows below the bracket are counted, and only
    those inside it (some ten thousandths of all, and ties of the bound) are ordered, by a distributed sort.
    """
    n = rows.count()
    wanted = [p for p in (sum(n // k + (t < n % k) for t in range(tile)) for tile in range(1, k)) if p]
    if not wanted:
        return []
    wide = 4 / _ACCURACY
    shares = [min(1.0, max(0.0, p / n + side)) for p in wanted for side in (-wide, wide)]
    edges = rows.agg(F.percentile_approx(value, shares, _ACCURACY)).first()[0]  # two numbers per tile
    low, high = edges[::2], edges[1::2]
    below = rows.agg(*[F.count_if(F.col(value) < F.lit(v)).alias(f"b{i}") for i, v in enumerate(low)],
                     *[F.count_if(F.col(value) <= F.lit(v)).alias(f"u{i}") for i, v in enumerate(high)]).first()
    for i, p in enumerate(wanted):
        if not below[f"b{i}"] < p <= below[f"u{i}"]:
            raise RuntimeError("the sketch's bracket misses its bound")
    inside = [F.col(value).between(F.lit(a), F.lit(b)) for a, b in zip(low, high)]
    near = rows.filter(reduce(lambda a, b: a | b, inside)).select(value, key)
    placed = with_position(globally_sorted(near, [value, key]), "__position")
    first = placed.agg(*[F.min(F.when(F.col(value) >= F.lit(a), F.col("__position"))).alias(f"f{i}") for i, a in enumerate(low)]).first()
    at = {p: first[f"f{i}"] + p - below[f"b{i}"] - 1 for i, p in enumerate(wanted)}
    # one row per tile
    found = {r["__position"]: (r[value], r[key]) for r in placed.filter(F.col("__position").isin(list(set(at.values())))).collect()}
    return [found[at[p]] for p in wanted]


def tile_by_bounds(value: Column, key: Column, bounds: Sequence[tuple], kinds: Sequence[str]) -> Column:
    """The tile of a row, as one more than the number of bounds that it lies beyond."""
    out = F.lit(1)
    for at, last in bounds:
        at, last = F.lit(at).cast(kinds[0]), F.lit(last).cast(kinds[1])
        out += ((value > at) | ((value == at) & (key > last))).cast("int")
    return out


def ntile_of(rows: DataFrame, k: int, value: str, key: str) -> Column:
    """``ntile(k) over (order by value, key)`` of rows whose (value, key) are distinct and not null, as a column of them.

    ``rows`` are read three times; give a table or a checkpoint.
    """
    bounds = tile_bounds(rows, k, value, key)
    # with fewer rows than tiles the bounds are all rows
    kinds = [rows.schema[c].dataType.simpleString() for c in (value, key)]
    return tile_by_bounds(F.col(value), F.col(key), bounds, kinds)


def running_sums(df: DataFrame, order: Sequence[str | Column],
                 sums: Mapping[str, str | Column]) -> DataFrame:
    """Inclusive prefix sums over the whole table, one column per entry of ``sums``."""
    ordered = globally_sorted(
        df.select("*", *[columns([c])[0].alias(name) for name, c in sums.items()]), order)
    rows = ordered.withColumn(_PART, F.spark_partition_id())
    parts = rows.groupBy(_PART).agg(*[F.sum(name).alias(name) for name in sums])
    inside = Window.partitionBy(_PART).orderBy(*columns(order)).rowsBetween(
        Window.unboundedPreceding, 0)
    out = rows.select(
        *[c for c in ordered.columns if c not in sums], _PART,
        *[F.sum(name).over(inside).alias(name) for name in sums])
    out = out.join(F.broadcast(_before(parts, list(sums))), _PART)
    return out.select(
        *[c for c in ordered.columns if c not in sums],
        *[(F.col(name) + F.col(f"{name}__before")).alias(name) for name in sums])


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], value: str,
                 salts: int = 32) -> DataFrame:
    """Join rows to one row per group, each group's rows spread over ``salts`` tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated exact quantiles of a column, overall or per key.

    The rows shrink to (key, value, count) first. Prefix sums over that table
    tell which values sit at the wanted positions, so no task ever holds all
    values of a group. Null values and null keys are left out.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = running_sums(counts, [*keys, value], {"__upto": "__n"})
    groups = upto.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__n")).alias("__base"),
                                     F.sum("__n").alias("__size"))
    placed = spread_join(upto, groups, keys, value) if keys else upto.crossJoin(
        F.broadcast(groups))
    first = F.col("__upto") - F.col("__n") - F.col("__base")
    last = F.col("__upto") - F.col("__base")
    picks = []
    for i, p in enumerate(quantiles.values()):
        at = F.lit(float(p)) * (F.col("__size") - 1)
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (first <= position) & (position < last)
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{side}{i}"))
    found = placed.groupBy(*keys).agg(F.max("__size").alias("__size"), *picks)
    out = []
    for i, (name, p) in enumerate(quantiles.items()):
        at = F.lit(float(p)) * (F.col("__size") - 1)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        part = at - F.floor(at)
        between = low * (1.0 - part) + high * part
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(*keys, *out)
