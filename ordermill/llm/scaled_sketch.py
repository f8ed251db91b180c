"""Threshold-scaled document sketches, with DataFrame functions only.

A sketch keeps every hash of a text's five-word shingles that lies below a fixed fraction of all hashes, and nothing
above it. Sketches of any two texts are therefore samples by the same rule: the sketch of a union is the union of
sketches, and the share of one sketch found in another estimates containment however unequal the texts are. The estimate
rests on the hashes of the smaller text that lie below the threshold, about one in ``SCALE``; README.md has its error.

Where that is few, all hashes are kept beside: texts of at most ``FINE`` shingles are compared exactly with each other. A
short text without any hash below the threshold has no estimate of its containment in a long one (null, not 0).

Nulls are empty. A text of one to four words is one shingle, one without words has an empty sketch; two of these are alike
(1.0). Equal texts have equal sketches, so repeated rows and ties do; rows that share a doc_id stay next to each other.
Extra columns are ignored, an empty table gives no rows. A very long text needs memory for its words and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ordermill.llm.common import with_rid

#: One of so many hashes is kept.
SCALE = 8
SHINGLE = 5
#: Texts of so many shingles keep all hashes.
FINE = 64
COARSE = 1000
BUCKET_ROWS = 4000
BUCKETS = 1_000_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The 64-bit hash of every ``size`` consecutive words of a text, in text order."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # bound as a lambda variable, so that the words are made once and not once for each shingle
    return F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))),
                    lambda i: F.xxhash64(F.slice(w, i + 1, size)))))[0]


def sketch(text: Column, scale: int = SCALE, size: int = SHINGLE) -> Column:
    """A struct: ``low``, the sorted distinct hashes below the threshold, and ``all`` of them (null beyond FINE shingles)."""
    limit = -(1 << 63) + (1 << 64) // scale
    return F.transform(F.array(shingle_hashes(text, size)), lambda h: F.struct(
        F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit))).alias("low"),
        F.when(F.size(h) <= FINE, F.array_sort(F.array_distinct(h))).alias("all")))[0]


def as_text(one: Column) -> Column:
    """The hashes of a sketch; ``all`` of a short text, set off by a mark, as ``low`` follows from them."""
    hexes = lambda hashes: F.array_join(F.transform(hashes, lambda h: F.hex(h)), ",")
    return F.coalesce(F.concat(F.lit("="), hexes(one["all"])), hexes(one["low"]))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _jaccard(a: Column, b: Column, empty: float) -> Column:
    common = _shared(a, b)
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, empty).otherwise(common / union)


def likeness(a: Column, b: Column) -> Column:
    """Share of common shingles among all of two texts (Jaccard): exact for two short texts, else estimated."""
    both = a["all"].isNotNull() & b["all"].isNotNull()
    return F.when(both, _jaccard(a["all"], b["all"], 1.0)).otherwise(_jaccard(a["low"], b["low"], 0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second one has; null where nothing of the first is in its sample."""
    def share(x: Column, y: Column) -> Column:
        return F.when(F.size(x) > 0, _shared(x, y) / F.size(x))
    return F.when(F.size(a["all"]) == 0, 1.0).when(a["all"].isNotNull() & b["all"].isNotNull(), share(a["all"], b["all"])) \
            .otherwise(share(a["low"], b["low"]))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    every = F.array_sort(F.array_union(a["all"], b["all"]))
    return F.struct(F.array_sort(F.array_union(a["low"], b["low"])).alias("low"), F.when(F.size(every) <= FINE, every).alias("all"))


def with_next(docs: DataFrame, order: str) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt so that ``lead`` over the returned window gives the next row by ``order``; the first follows the last.

    Rows move once, into buckets of consecutive numbers of about BUCKET_ROWS rows (more where that would be over
    BUCKETS buckets): quantiles of the numbers cut them coarsely, equal steps within these finely. A copy of every
    bucket's first row goes to the bucket before it, marked __guest, so that no task needs another task's rows; filter
    the guests away after the window.
    """
    ids = docs.select(order)
    n = ids.count()
    buckets = min(BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    coarse_n = min(COARSE, buckets)
    fine = -(-buckets // coarse_n)
    cuts = ids.agg(F.percentile_approx(order, [i / coarse_n for i in range(coarse_n + 1)], 10 * COARSE)).first()[0]
    cuts = sorted(set(cuts or [0]))
    cuts.append(cuts[-1] + 1)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    coarse = F.least(F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col(order))), F.lit(1)), F.lit(len(cuts) - 1))
    low, high = F.element_at(bounds, coarse).cast("double"), F.element_at(bounds, coarse + 1).cast("double")
    step = F.floor((F.col(order).cast("double") - low) / (high - low) * fine)
    bucket = coarse.cast("long") * fine + F.least(F.greatest(step, F.lit(0)), F.lit(fine - 1))
    line = Window.orderBy("__bucket")  # one row for each bucket, of which there are at most about BUCKETS
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ids.withColumn("__bucket", bucket).groupBy("__bucket").agg(F.min(order).alias("__first")).select(
        "__first", F.coalesce(F.lag("__bucket").over(line), F.max("__bucket").over(whole)).alias("__before"))
    rows = docs.join(F.broadcast(firsts), docs[order] == F.col("__first"), "left")
    own = F.struct(bucket.alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__before").alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = rows.select(*docs.columns, F.col("__to.b").alias("__b"), F.col("__to.guest").alias("__guest"))
    return dealt, Window.partitionBy("__b").orderBy("__guest", order)


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Sketches of every text and of the text whose second half the next document's beginning replaces."""
    rows, _ = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    dealt, within = with_next(rows, "rid")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = dealt.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("next_text", F.lead("text").over(within)) \
        .withColumn("sketch", sketch(F.col("text"), scale)) \
        .withColumn("next_sketch", F.lead("sketch").over(within)).filter("not __guest")
    out = out.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch",
                     sketch(F.col("edited"), scale).alias("edited_sketch"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
                      as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                      likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                      containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"))
