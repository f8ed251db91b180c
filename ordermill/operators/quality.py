"""Audits and constraint checks. Each returns a small table; a failing check can raise.

Row-level counts of one table share a single aggregate pass. Checks across rows
(duplicates, keys, references) count per key first, so a key that holds a large
part of the table is reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, _parse_datatype_string

from ordermill.functions import columns as C
from ordermill.operators.shaping import inline_rows, missing_keys
from ordermill.schemas import CLEAN_KEYS, Rule


def stacked(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_missing(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


# ---- profiles ------------------------------------------------------------------

def profile_nulls(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Null counts (NaN included) of the columns that have any, with the table's shape."""
    def one(name: str, df: DataFrame) -> DataFrame:
        counts = [F.struct(F.lit(c).alias("column_name"),
                           F.count_if(_is_missing(df, c)).alias("nulls")) for c in df.columns]
        return df.agg(F.count("*").alias("table_rows"), F.array(*counts).alias("c")).select(
            F.lit(name).alias("table_name"), "table_rows",
            F.lit(len(df.columns)).alias("table_columns"), F.inline("c"))
    return stacked(one(n, d) for n, d in tables.items()).filter("nulls > 0")


def profile_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    return stacked(
        df.agg(F.count("*").alias("table_rows")).select(
            F.lit(name).alias("table_name"), "table_rows",
            F.lit(len(df.columns)).alias("table_columns"))
        for name, df in tables.items())


def row_digest(columns: Sequence[Column]) -> list[Column]:
    """Two longs, equal for equal values (nulls included); different values share them in one of 2^128 pairs."""
    cells = [c for v in columns for c in (v, v.isNull())]  # a null by itself leaves a hash as it is
    return [F.xxhash64(F.lit(salt), *cells).alias(name) for salt, name in ((17, "__h"), (71, "__k"))]


def dup_row_count(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact duplicate rows beyond the first; nulls count as equal.

    Only 128-bit digests of the rows are shuffled, whatever their width.
    """
    return stacked(
        df.select(*row_digest([F.col(c) for c in df.columns])).groupBy("__h", "__k").agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")).select(
            F.lit(name).alias("table_name"), "duplicate_rows")
        for name, df in tables.items())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of the non-null values, most frequent first."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def null_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """How often each group occurs among rows where a column is null."""
    return value_counts(df.filter(F.col(column).isNull()), group)


def column_span(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    spans = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("min_value"),
                      F.max(c).cast("string").alias("max_value")) for c in columns]
    return df.agg(F.array(*spans).alias("c")).select(F.inline("c"))


def predicate_count(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Rows matching each named predicate; an unknown result does not match."""
    counts = [F.struct(F.lit(n).alias("predicate"), F.count_if(p).alias("n"))
              for n, p in predicates.items()]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def _row_counts(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    return stacked(df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table_name"), name)
                   for t, df in tables.items())


def row_delta(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before and after cleaning, for the tables that exist on both sides."""
    both = [t for t in before if t in after]
    counts = _row_counts({t: before[t] for t in both}, "rows_before").join(
        _row_counts({t: after[t] for t in both}, "rows_after"), "table_name")
    return counts.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def row_parity(source: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    counts = _row_counts(source, "source_rows").join(
        _row_counts(loaded, "loaded_rows"), "table_name", "full")
    return counts.withColumn("matches", F.col("source_rows").eqNullSafe(F.col("loaded_rows")))


def count_parity(spark: SparkSession, counts: Mapping[str, int], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Parity of tables whose rows were counted while they were written."""
    source = inline_rows(spark, list(counts.items()), "table_name string, source_rows long")
    both = source.join(_row_counts(loaded, "loaded_rows"), "table_name", "full")
    return both.withColumn("matches", F.col("source_rows").eqNullSafe(F.col("loaded_rows")))


def require_parity(parity: DataFrame) -> None:
    wrong = [r.table_name for r in parity.filter("not matches").collect()]  # one row per table
    if wrong:
        raise ValueError(f"row counts differ: {', '.join(wrong)}")


def null_total(df: DataFrame) -> DataFrame:
    """All nulls of a table in one number."""
    total = reduce(lambda a, b: a + b, [F.count_if(_is_missing(df, c)) for c in df.columns])
    return df.agg(F.count("*").alias("table_rows"), total.alias("nulls"))


# ---- declared constraints --------------------------------------------------------

def _broken(rule: Rule, df: DataFrame) -> Column:
    """True on rows that break a row-level rule; null passes unless the rule forbids null."""
    column = F.col(rule.columns[0])
    if rule.kind == "not_null":
        return column.isNull()
    if rule.kind == "length":
        return F.length(column) != rule.arg[0]
    if rule.kind == "max_length":
        return F.length(column) > rule.arg[0]
    if rule.kind == "between":
        return ~column.between(*rule.arg)
    if rule.kind == "fits":
        wanted, have = _parse_datatype_string(rule.arg[0]), df.schema[rule.columns[0]].dataType
        if isinstance(wanted, DecimalType) and isinstance(have, DecimalType):
            # a cast that fails costs an exception for each row
            return F.abs(F.round(column, wanted.scale)) >= F.lit(Decimal(10) ** (wanted.precision - wanted.scale))
        return column.isNotNull() & column.try_cast(rule.arg[0]).isNull()
    raise ValueError(f"not a row rule: {rule.kind}")


def _row_rules(df: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(rule, n) of the row-level rules of one table, from a single aggregate without groups."""
    counts = [F.struct(F.lit(n).alias("rule"), F.count_if(_broken(r, df)).alias("n")) for n, r in rules]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def _domains(rules: Sequence[tuple[int, Rule]]) -> dict[tuple, dict]:
    """Keys that rules are about, as (table, columns) -> uniqueness rules of that key, and the references to it."""
    out: dict[tuple, dict] = {}
    for n, r in rules:
        if r.kind == "unique":
            out.setdefault((r.table, tuple(r.columns)), {"unique": [], "children": []})["unique"].append(n)
        elif r.kind == "foreign_key":
            parent = r.arg[0]
            out.setdefault((parent, tuple(CLEAN_KEYS[parent])), {"unique": [], "children": []})["children"].append((n, r))
    return out


def _key_rules(tables: Mapping[str, DataFrame], rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(rule, n) of uniqueness and references.

    A table's rows give one slim cell per key that they hold or refer to: the key's number, its 128-bit digest, and which
    side they are. A key's rows and all references to it meet in one group, counted before the one shuffle.
    """
    domains = list(_domains(rules).items())
    most = max((len(d["children"]) for _, d in domains), default=0)

    def cell(number: int, df: DataFrame, columns: Sequence[str], kinds: Sequence[str], rows: Column, slot: int | None) -> Column:
        # both sides of a reference are read as one type, as text where they differ
        values = [F.col(c) if df.schema[c].dataType.simpleString() == kind else F.col(c).cast(kind) for c, kind in zip(columns, kinds)]
        counts = [(rows if slot == i else F.lit(0)).cast("long").alias(f"child{i}") for i in range(most)]
        return F.struct(F.lit(number).alias("domain"), *row_digest(values),
                        (rows if slot is None else F.lit(0)).cast("long").alias("own"), *counts)
    cells: dict[str, list[Column]] = {}
    for number, ((table, columns), domain) in enumerate(domains):
        sides = [(table, columns)] + [(r.table, r.columns) for _, r in domain["children"]]
        types = [[tables[t].schema[c].dataType.simpleString() for c in some] for t, some in sides]
        kinds = [k[0] if len(set(k)) == 1 else "string" for k in zip(*types)]
        cells.setdefault(table, []).append(cell(number, tables[table], columns, kinds, F.lit(1), None))
        for slot, (_, r) in enumerate(domain["children"]):
            known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.columns])
            cells.setdefault(r.table, []).append(cell(number, tables[r.table], r.columns, kinds, known.cast("int"), slot))
    rows = stacked(tables[t].select(F.inline(F.array(*some))) for t, some in cells.items())
    children = [f"child{i}" for i in range(most)]
    keys = rows.groupBy("domain", "__h", "__k").agg(F.sum("own").alias("own"), *[F.sum(c).alias(c) for c in children])
    found = keys.groupBy("domain").agg(
        F.sum(F.greatest(F.col("own") - 1, F.lit(0))).alias("again"),
        *[F.sum(F.when(F.col("own") == 0, F.col(c)).otherwise(0)).alias(c) for c in children])
    wanted = []
    for number, (_, domain) in enumerate(domains):
        wanted += [(number, n, "again") for n in domain["unique"]]
        wanted += [(number, n, f"child{i}") for i, (n, _) in enumerate(domain["children"])]
    pick = [F.when(F.col("domain") == d, F.struct(F.lit(n).alias("rule"), F.col(c).alias("n"))) for d, n, c in wanted]
    return found.select(F.explode(F.array_compact(F.array(*pick))).alias("r")).select("r.rule", "r.n")


def check_constraints(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with its number of violations.

    Two tiers: rules about single rows are conditional counts in one aggregate per table; rules across rows (unique keys,
    references) count slim key digests, all in one shuffle.
    """
    numbered = list(enumerate(rules))
    across = [(n, r) for n, r in numbered if r.kind in ("unique", "foreign_key")]
    parts = [_key_rules(tables, across)] if across else []
    for table in tables:
        own = [(n, r) for n, r in numbered if r.table == table and r.kind not in ("unique", "foreign_key")]
        if own:
            parts.append(_row_rules(tables[table], own))
    found = stacked(parts)
    kinds = inline_rows(found.sparkSession, [(n, r.table, r.kind, ",".join(r.columns)) for n, r in numbered],
                        "rule int, table_name string, kind string, columns string")
    return kinds.join(F.broadcast(found), "rule", "left").select(  # one row for each rule
        "table_name", F.col("kind").alias("rule"), "columns", F.coalesce("n", F.lit(0)).alias("violations"))


def require_valid(violations: DataFrame) -> None:
    """Raise when any rule is broken; one row per rule is collected."""
    broken = violations.filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(
            f"{r.table_name}.{r['columns']} {r.rule}: {r.violations}" for r in broken))


# ---- targeted audits ---------------------------------------------------------------

def lookup_gaps(df: DataFrame, key: str, looked_up: str) -> DataFrame:
    """Rows that have a key but found no lookup value, and rows without a key."""
    return df.agg(
        F.count_if(F.col(key).isNotNull() & F.col(looked_up).isNull()).alias("untranslated"),
        F.count_if(F.col(key).isNull()).alias("without_key"),
        F.count_distinct(looked_up).alias("lookup_values"))


def date_order_conflicts(orders: DataFrame) -> DataFrame:
    """Delivered before hand-off, and delivery dates on orders that are not delivered."""
    delivered = F.col("order_delivered_customer_date")
    return predicate_count(orders, {
        "delivered_before_carrier": C.has_delivered_status()
        & (delivered < F.col("order_delivered_carrier_date")),
        "not_delivered_with_date": (F.col("order_status") != "delivered") & delivered.isNotNull(),
    })


def unmatched_keys(sides: Mapping[str, tuple[DataFrame, str]], keys: DataFrame,
                   key: str) -> DataFrame:
    """Distinct keys per side that have no match."""
    return stacked(
        missing_keys(df.select(F.col(column).alias(key)).distinct(), keys.select(key), key).agg(
            F.count("*").alias("unmatched")).select(F.lit(name).alias("side"), "unmatched")
        for name, (df, column) in sides.items())


def key_reuse(reviews: DataFrame) -> DataFrame:
    """Orders with several reviews, review ids on several orders, and the rows these ids cover."""
    per_order = reviews.groupBy("order_id").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("orders_with_many_reviews"))
    pairs = reviews.groupBy("review_id", "order_id").agg(F.count("*").alias("n"))
    per_id = pairs.groupBy("review_id").agg(
        F.count("*").alias("orders"), F.sum("n").alias("n")).agg(
        F.count_if(F.col("orders") > 1).alias("reused_review_ids"),
        F.coalesce(F.sum(F.when(F.col("orders") > 1, F.col("n"))), F.lit(0)).alias(
            "rows_with_reused_ids"))
    return per_order.crossJoin(F.broadcast(per_id))


def person_repeat_audit(customers: DataFrame) -> DataFrame:
    """Records, persons and persons with several records, over all order statuses."""
    repeat = F.count_if(F.col("n") > 1)
    return customers.groupBy("customer_unique_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("records"), F.count("*").alias("persons"),
        repeat.alias("repeat_persons"), C.ratio(repeat, F.count("*")).alias("repeat_share"))


def seller_audit(sellers: DataFrame) -> DataFrame:
    return sellers.agg(F.count("*").alias("sellers"),
                       F.count_distinct("seller_state").alias("states"))
