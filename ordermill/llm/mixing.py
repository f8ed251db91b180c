"""Mixing sources to target weights: budgets down a tree, token prefixes of seeded epochs at its leaves.

The tree has one level for each column in ``levels`` (here domain, language, source). A node's budget is split among its
children by weight; what a child cannot use, because its texts in ``max_epochs`` epochs are too few, goes to its siblings
by weight, and only what a whole subtree cannot use goes on to the siblings of its ancestors. A leaf then reads whole
epochs of its rows and, for the rest, a prefix of one more epoch, whose order is a seeded hash: rows are taken until the
tokens are used up, the last one in part (tokens_taken).

Prefixes need no sort of a leaf: sums by ranges of the hash find the one range in which the prefix ends, and only the rows
of that range are put in order. The number of ranges grows with the largest leaf, so one source may hold most rows.

Nulls in a level's column are the child "" of their parent; null and empty texts have no tokens and come with every whole
epoch and with each range that is taken whole. Equal rows tie on all but an arbitrary order among themselves. Children
without a stated weight have weight 1; a budget over what there is takes everything max_epochs times. More than
``MAX_LEAVES`` leaves raise an error, as their budgets are found on the driver. Rows travel whole, so extra columns may have
any name; an empty table gives no rows. A very long text is a row like others, and only cut where a prefix ends in it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the hash at least and at most, and rows of the largest leaf in one.
RANGES, MOST_RANGES, RANGE_ROWS = 4096, 1 << 20, 8192
MAX_LEAVES = 100_000
Path = tuple[str, ...]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _split(total: int, children: Sequence[tuple[float, int]]) -> list[int]:
    """``total`` among (weight, capacity): by weight, never over capacity, shortages to the others by weight."""
    out = [0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(total, sum(children[i][1] for i in open_))
    while left > 0 and open_:
        weight = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] - out[i] <= left * children[i][0] / weight]
        if full:
            for i in full:
                left -= children[i][1] - out[i]
                out[i] = children[i][1]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        shares = {i: int(left * children[i][0] / weight) for i in open_}
        for i, n in shares.items():
            out[i] += n
        rest = left - sum(shares.values())
        for i in sorted(open_, key=lambda i: (-children[i][0], i)):  # single tokens that rounding left over
            step = min(rest, children[i][1] - out[i])
            out[i] += step
            rest -= step
        break
    return out


def budgets(capacity: Mapping[Path, int], weights: Mapping[Path, float], total: int) -> dict[Path, int]:
    """The token budget of every leaf; ``capacity`` is what each could give at most."""
    def down(prefix: Path, amount: int, leaves: dict[Path, int]) -> dict[Path, int]:
        depth = len(prefix)
        if any(len(p) == depth for p in leaves):
            return {p: min(amount, c) for p, c in leaves.items()}
        children: dict[Path, dict[Path, int]] = {}
        for p, c in leaves.items():
            children.setdefault(p[:depth + 1], {})[p] = c
        names = sorted(children)
        parts = _split(amount, [(weights.get(n, 1.0), sum(children[n].values()) if weights.get(n, 1.0) > 0 else 0) for n in names])
        out: dict[Path, int] = {}
        for n, part in zip(names, parts):
            out |= down(n, part, children[n])
        return out
    # a leaf of weight 0 anywhere on its path gives nothing, so it is no capacity for its ancestors
    usable = {p: c for p, c in capacity.items() if all(weights.get(p[:k], 1.0) > 0 for k in range(1, len(p) + 1))}
    return {p: 0 for p in capacity} | (down((), total, usable) if usable else {})


def mixed(rows: DataFrame, levels: Mapping[str, Column], weights: Mapping[Path, float], share: float,
          max_epochs: int, seed: int, tokens: Column | None = None) -> DataFrame:
    """The selected rows, each whole as ``row``, with mix_path, mix_epoch, mix_tokens and mix_tokens_taken.

    ``share`` is the budget as a share of all tokens there are.
    """
    path = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()])
    counted = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), path.alias("mix_path"),
                          (word_count(F.col("text")) if tokens is None else tokens).alias("mix_tokens"))

    def place(epoch: Column | int) -> Column:
        """Where a row stands in an epoch's order."""
        return F.xxhash64(F.lit(seed), F.lit(epoch) if isinstance(epoch, int) else epoch, F.col("row.doc_id"), F.col("row.text"))
    stats = counted.groupBy("mix_path").agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    available = {tuple(r["mix_path"]): r["n"] for r in stats}
    ranges = ranges_for(max((r["rows"] for r in stats), default=0))
    quota = budgets({p: n * max_epochs for p, n in available.items()}, weights, int(sum(available.values()) * share))
    plan = [(list(p), quota[p] // n if n else 0, quota[p] % n if n else 0) for p, n in sorted(available.items())]
    spark = rows.sparkSession
    plans = spark.createDataFrame(plan, "mix_path array<string>, whole int, rest long")
    known = counted.join(F.broadcast(plans), "mix_path")  # at most MAX_LEAVES rows
    at = known.withColumn("at", place(F.col("whole")))
    ranged = at.withColumn("range", F.shiftrightunsigned("at", 64 - (ranges - 1).bit_length()))
    sums = ranged.filter("rest > 0").groupBy("mix_path", "rest", "range").agg(F.sum("mix_tokens").alias("n"))
    along = Window.partitionBy("mix_path").orderBy("range")  # one row per range
    ends = sums.withColumn("upto", F.sum("n").over(along)).filter(F.col("upto") >= F.col("rest")) \
               .groupBy("mix_path").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end")) \
               .select("mix_path", F.col("end.range").alias("end"), F.col("end.before").alias("before"))
    partial = ranged.join(F.broadcast(ends), "mix_path", "left")  # at most MAX_LEAVES rows
    columns = ["row", "mix_path", "mix_epoch", "mix_tokens", "mix_tokens_taken"]
    none = F.array().cast("array<bigint>")
    epochs = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(none),
                      F.when(F.col("range") < F.col("end"), F.array("whole")).otherwise(none))
    taken = partial.withColumn("mix_epoch", F.explode(epochs)).withColumn("mix_tokens_taken", F.col("mix_tokens"))
    order = Window.partitionBy("mix_path").orderBy("at", "row.doc_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = partial.filter(F.col("range") == F.col("end")) \
                  .withColumn("sum", F.col("before") + F.coalesce(F.sum("mix_tokens").over(order), F.lit(0))) \
                  .filter(F.col("sum") < F.col("rest")).withColumn("mix_epoch", F.col("whole")) \
                  .withColumn("mix_tokens_taken", F.least(F.col("mix_tokens"), F.col("rest") - F.col("sum")))
    return taken.select(*columns).unionByName(last.select(*columns))


def ranges_for(rows: int) -> int:
    """Ranges of the hash, a power of two, so that each has some thousands of the largest leaf's rows."""
    return min(MOST_RANGES, max(RANGES, 1 << max(0, rows // RANGE_ROWS).bit_length()))


def mixed_rows(rows: DataFrame, levels: Mapping[str, Column], weights: Mapping[Path, float], share: float,
               max_epochs: int, seed: int, tokens: Column | None = None) -> DataFrame:
    """``mixed`` with the columns of the rows themselves; an added name that is taken gets underscores until it is free."""
    out = mixed(rows, levels, weights, share, max_epochs, seed, tokens)
    used, added = {c.lower() for c in rows.columns}, []
    for c in out.columns[1:]:
        name = c
        while name in used:
            name += "_"
        added.append(F.col(c).alias(name))
    return out.select("row.*", *added)


def cut_texts(mixed: DataFrame) -> DataFrame:
    """Rows of ``mixed`` as they were, without the added columns; a text taken in part ends with its last taken word."""
    word_ends = F.split(F.col("row.text"), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    words = F.array_join(F.slice(word_ends, 1, F.col("mix_tokens_taken").cast("int")), "")
    part = F.col("mix_tokens_taken") < F.col("mix_tokens")
    text = F.when(part, words).otherwise(F.col("row.text"))
    return mixed.select(F.col("row").withField("text", text).alias("row")).select("row.*")
