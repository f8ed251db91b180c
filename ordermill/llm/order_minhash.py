"""Near-duplicate documents by Order MinHash.

A text's five-word shingles are labelled with their occurrence (first, second, ...). Each of ``BANDS`` hash functions
picks the two smallest labelled shingles and keeps them in text order; texts that share such a pair are candidates,
which favours few edits over the same words in another order. Two texts are near when the banded alignment of their
labelled shingles reaches the threshold: the longest common subsequence M within the band that a pair of the wanted
similarity cannot leave, and M / (n + m - M) >= 0.8. Near pairs make classes, as connected components.

Pairs are never written out. First the members of a bucket are joined to each other where their sketches estimate
``PLAUSIBLE`` or more, by a search that returns one edge per member; the components of these edges are families, and no
plausible pair lies between two families. Buckets of over ``BUCKET`` members are dealt again by pairs of ordered minima
of ``VARIANTS`` further hash functions, so unlike members part while near ones meet in one of them; what is still crowded
then is taken as one family as it is. Then each family's texts come together once, in one block: an index of shingles
gives the exact overlap, which bounds the alignment, and pairs of different classes whose overlap reaches the threshold
are aligned until one class is left or no such pair is. A block returns one link per merge.

Families of over ``BUCKET`` members or ``SHINGLES`` shingles are dealt into parts by hash and each part is a block. Then
the members go into parts by the classes found, and parts of different classes meet two by two; parts of one and the same
class do not, so a family that is one large class costs little more than its size. Between many classes of one such family
the number of blocks grows with the square of its parts; nothing is left out.

Exact copies are put together first, by digest, so that any number of them is one member. Nulls count as empty texts,
which are all copies of each other; texts of one to four words are a single shingle. Repeated rows are copies, ties go to
the smaller row number. A class is named after its smallest doc_id. Extra columns stay as they are, whatever their names;
an empty table gives no rows. A very long text needs memory in proportion to itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import (
    in_batches, kept_lineage_cut, lists_of, map_arrow, mixed, packed_rows, utf8, with_rid, word_hashes, written)
from ordermill.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS = 14
MINIMA = 64
BUCKET = 1500
VARIANTS = 4
#: Shingles of one part of a large family.
SHINGLES = 400_000
#: Four deviations of the estimate below SIMILAR.
PLAUSIBLE = 0.6
#: A text of less than this share of another's shingles cannot be similar to it; below SIMILAR for what rounding may do.
SIZES = 0.75
#: Bytes that are hashed at once.
CHUNK = 1 << 20
_C = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE + 4, dtype=np.uint64) | np.uint64(1)
_ORDER = np.random.default_rng(6).integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingle hashes of texts laid end to end (text i is data[at[i]:at[i + 1]]), and how many each has."""
    inside = np.r_[False, ~_SPACE[data], False]
    if len(at) > 2:  # a word ends where its text does
        edges = at[1:-1]
        joint = edges[(edges > 0) & (edges < len(data))]
    else:
        joint = at[:0]
    change = np.diff(inside.astype(np.int8))
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = joint[inside[joint] & inside[joint + 1]]  # two texts touch without white space between
    start, stop = np.sort(np.r_[start, cut]), np.sort(np.r_[stop, cut])
    words = word_hashes(data, start, stop)
    count = np.diff(np.searchsorted(start, at))
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    index = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    end = np.repeat(first + count, n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(index), np.uint64)
        for k in range(SHINGLE):
            have = index + k < end
            total[have] += words[index[have] + k] * _C[k]
        hashes = mixed(total)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, doc))
        same = np.r_[False, (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
        if same.any():
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            occurrence = np.empty(len(order), np.uint64)
            occurrence[order] = run
            hashes = np.where(occurrence > 0, mixed(hashes + occurrence * _C[-1]), hashes)
    return hashes, n


def chunks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about CHUNK bytes."""
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK, side="right")) - 1)
        yield begin, end, data[at[begin]:at[end]], at[begin:end + 1] - at[begin]
        begin = end


def sketches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the number of shingles, BANDS bucket keys and MINIMA bytes that agree as often as texts do."""
    counts, keys, bytes_ = [], [], []
    for _, _, part, offsets in chunks(data, at):
        hashes, n = labelled_shingles(part, offsets)
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        place = (np.arange(len(hashes)) - np.repeat(starts, n[some])).astype(np.uint64)
        key, sign = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), MINIMA), np.uint8)
        mask = np.uint64((1 << 26) - 1)  # position in the text, below the order
        for k in range(MINIMA if len(some) else 0):
            with np.errstate(over="ignore"):
                value = ((hashes * _ORDER[k]) & ~mask) | place
            low = np.minimum.reduceat(value, starts)
            one = starts + (low & mask).astype(np.int64)
            sign[some, k] = (hashes[one] >> np.uint64(56)).astype(np.uint8)
            if k < BANDS:
                value[one] = _LAST
                low = np.minimum.reduceat(value, starts)
                two = np.where(low == _LAST, one, starts + (low & mask).astype(np.int64))
                with np.errstate(over="ignore"):
                    key[some, k] = mixed(hashes[np.minimum(one, two)] * _C[0] + hashes[np.maximum(one, two)] * _C[1] + np.uint64(k))
        counts.append(n), keys.append(key), bytes_.append(sign)
    return np.concatenate(counts), np.concatenate(keys), np.concatenate(bytes_)


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(rid, n, keys, sign) for rows (rid, text)."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, sign = sketches(*utf8(batch.column("text")))
        some = np.where(n > 0, BANDS, 0)
        return pa.RecordBatch.from_arrays(
            [batch.column("rid"), pa.array(n, pa.int64()), lists_of(keys[n > 0].ravel().view(np.int64), some, pa.int64()),
             pa.array([s.tobytes() for s in sign], pa.binary())], ["rid", "n", "keys", "sign"])
    return in_batches(docs.select("rid", "text"), make, "rid long, n long, keys array<long>, sign binary")


# ---- families --------------------------------------------------------------------------------

def _joined(n: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a forest over members that joins all whose estimate is plausible, directly or through others."""
    left = np.arange(len(n))
    one, two = [], []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            # sizes bound the share: what cannot reach the threshold is no neighbour
            near = np.minimum(n[left], n[at]) >= SIZES * np.maximum(n[left], n[at])
            near[near] = (sign[left[near]] == sign[at]).mean(axis=1) >= PLAUSIBLE
            found = left[near]
            one.append(np.full(len(found), at))
            two.append(found)
            todo += found.tolist()
            left = left[~near]
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which lie one after another, as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
        for s, e in zip(starts, [*starts[1:], len(key)]):
            if last is not None and tuple(key[s].tolist()) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[s].tolist())
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _sent(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) in batches of some thousands."""
    held, size = [], 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)], ["a", "b"])
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)], ["a", "b"])


def bucket_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b) that join the plausible members of each bucket, for rows (key, rid, n, sign)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for table in _runs(batches, ["key"]):
                if table.num_rows < 2:
                    continue
                rid = table.column("rid").to_numpy()
                sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(rid), -1)
                one, two = _joined(table.column("n").to_numpy(), sign)
                if len(one):
                    yield rid[one], rid[two]
        yield from _sent(pairs())
    dealt = members.select("key", "rid", "n", "sign").repartition("key").sortWithinPartitions("key", "rid")
    return map_arrow(dealt, run, "a long, b long")


def family_edges(signs: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are the families of rows (rid, n, keys, sign)."""
    at = signs.select("rid", "n", "sign", "keys", F.posexplode("keys").alias("band", "key"))
    hot = written(at.groupBy("key").count().filter(F.col("count") > BUCKET).select("key"), "hot-buckets")
    if not hot.limit(1).count():
        return bucket_edges(at)
    further = F.transform(F.sequence(F.lit(1), F.lit(VARIANTS)), lambda k: F.xxhash64(
        "key", F.element_at("keys", ((F.col("band") + k) % F.size("keys") + 1).cast("int")), k))
    again = at.join(hot, "key", "left_semi").select("rid", "n", "sign", F.explode(further).alias("key"))
    crowded = written(again.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("rid").alias("first"))
                      .filter(F.col("count") > BUCKET).select("key", "first"), "crowded-buckets")
    whole = again.select("rid", "key").join(crowded, "key").filter("rid != first").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    calm = at.join(hot, "key", "left_anti").select("key", "rid", "n", "sign") \
             .unionByName(again.join(crowded, "key", "left_anti").select("key", "rid", "n", "sign"))
    return bucket_edges(calm).unionByName(whole)


# ---- classes ---------------------------------------------------------------------------------

def aligned(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """The share of labelled shingles that two texts have in common in the same order, within the band."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    band = (n + m) // 9 + 1  # a pair at or over the threshold has no match further off the diagonal
    by_a, by_b = np.argsort(a), np.argsort(b)
    at = np.searchsorted(b[by_b], a[by_a])
    at = np.minimum(at, m - 1)
    hit = b[by_b][at] == a[by_a]
    i, j = by_a[hit], by_b[at[hit]]
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])].tolist()
    tails: list[int] = []
    for x in j:
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    common = len(tails)
    return common / (n + m - common)


class _Classes:
    """Classes of a block's members, merged as links are found."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def merge(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def all(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def block_links(shingles: list[np.ndarray], labels: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Near pairs that make one class of all members that near pairs, or equal labels, join; one for each merge."""
    m = len(shingles)
    classes, links = _Classes(labels), []
    size = np.fromiter(map(len, shingles), np.int64, m)
    owner = np.repeat(np.arange(m), size)
    _, code = np.unique(np.concatenate(shingles) if m else np.zeros(0, np.uint64), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    tried: set[tuple[int, int]] = set()

    def meet(i: int, j: int) -> None:
        tried.add((min(i, j), max(i, j)))
        if aligned(shingles[i], shingles[j]) >= similar:
            links.append((i, j))
            classes.merge(i, j)

    # each member meets the one that owns most of its shingles, and owns those that nobody does
    owned = np.full(int(code.max(initial=-1)) + 1, -1)
    for i in range(m):
        own = code[at[i]:at[i + 1]]
        have = owned[own]
        have = have[have >= 0]
        if len(have):
            j = int(np.bincount(have).argmax())
            if classes.root(i) != classes.root(j) and min(size[i], size[j]) >= similar * max(size[i], size[j]):
                common = len(np.intersect1d(own, code[at[j]:at[j + 1]]))
                if common >= similar * (size[i] + size[j] - common):
                    meet(i, j)
        owned[own[owned[own] < 0]] = i
    # then all pairs of different classes: one of the two is not in the largest class
    now = classes.all()
    largest = np.bincount(now).argmax() if m else 0
    rest = np.flatnonzero(now != largest)
    if not len(rest):
        return links
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    begin = np.searchsorted(code[order], np.arange(len(owned) + 1))
    for i in rest.tolist():
        own = code[at[i]:at[i + 1]]
        if not len(own):
            continue
        count = begin[own + 1] - begin[own]
        index = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        common = np.bincount(holders[index], minlength=m)
        share = common / (size + size[i] - common)
        share[i] = 0
        near = np.flatnonzero(share >= similar)
        for j in near[np.argsort(-share[near], kind="stable")].tolist():
            if classes.root(i) != classes.root(j) and (min(i, j), max(i, j)) not in tried:
                meet(i, j)
    return links


def block_edges(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Near pairs (a, b) that make the classes of each block, for rows (family, p, q, rid, label, text)."""
    keys = ["family", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for table in _runs(batches, keys):
                rid, label = table.column("rid").to_numpy(), table.column("label").to_numpy()
                if len(rid) < 2 or (label == label[0]).all():
                    continue
                shingles = []
                for column in table.column("text").chunks:
                    for _, _, part, offsets in chunks(*utf8(column)):
                        hashes, n = labelled_shingles(part, offsets)
                        shingles += np.split(hashes, np.cumsum(n)[:-1])
                found = block_links(shingles, label, similar)
                if found:
                    one, two = np.array(found).T
                    yield rid[one], rid[two]
        yield from _sent(pairs())
    dealt = rows.select(*keys, "rid", "label", "text").repartition(*keys).sortWithinPartitions(*keys, "rid")
    return map_arrow(dealt, run, "a long, b long")


def met_blocks(members: DataFrame) -> DataFrame:
    """Blocks (family, p, q, rid, label) of large families, for rows (family, rid, n, label): all members of two classes meet.

    Classes that fill a part have parts of their own; the others share parts, each class in one.
    """
    sizes = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles")) \
        .withColumn("own", _parts("count", "shingles"))
    shared = sizes.filter("own = 1").groupBy("family").agg(_parts(F.sum("count"), F.sum("shingles")).alias("all"))
    named = sizes.join(shared, "family", "left").select("family", "label", "own", "all")
    pure = F.col("own") > 1
    part = F.when(pure, F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("rid"), F.col("own"))), F.lit(1 << 40))) \
        .otherwise(F.pmod(F.xxhash64("label"), F.col("all")) - (1 << 20))
    placed = written(members.join(named, ["family", "label"]).select(
        "family", "rid", "label", part.cast("long").alias("part"), F.when(pure, F.col("label")).alias("only")), "family-parts")
    parts = placed.groupBy("family", "part").agg(F.when(F.min("only") == F.max("only"), F.max("only")).alias("only"))
    other = parts.select("family", F.col("part").alias("other"), F.col("only").alias("other_only"))
    meets = parts.join(other, "family").filter(
        F.when(F.col("part") == F.col("other"), F.col("only").isNull())
        .otherwise(~F.coalesce(F.col("only") == F.col("other_only"), F.lit(False)))) \
        .select("family", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    return placed.join(meets, ["family", "part"]).select("family", "p", "q", "rid", "label")


def _parts(count: str | Column, shingles: str | Column) -> Column:
    count, shingles = (F.col(c) if isinstance(c, str) else c for c in (count, shingles))
    return F.greatest(F.ceil(count / BUCKET), F.ceil(shingles / SHINGLES), F.lit(1)).cast("long")


def links(signs: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Near pairs (a, b) whose components are the classes, for sketches and rows (rid, text)."""
    families = components(written(family_edges(signs).distinct(), "family-edges")) \
        .select(F.col("node").alias("rid"), F.col("label").alias("family"))
    members = families.join(signs.select("rid", "n"), "rid")
    sizes = members.groupBy("family").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    members = written(members.join(sizes, "family"), "families")
    texts = docs.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    first = members.withColumn("p", F.pmod(F.xxhash64("rid"), F.col("parts"))).select(
        "family", "p", F.col("p").alias("q"), "rid", F.col("rid").alias("label"))
    # a broadcast of the members' numbers, where they are few enough, spares all other texts the way through the shuffle
    some = texts.join(members.select("rid"), "rid", "left_semi")
    edges = written(block_edges(first.join(some, "rid"), similar), "links")
    large = members.filter("parts > 1")
    if not large.limit(1).count():
        return edges
    found = components(edges).select(F.col("node").alias("rid"), "label")
    blocks = met_blocks(large.join(found, "rid", "left").select("family", "rid", "n", F.coalesce("label", "rid").alias("label")))
    # of all texts only those of large families move
    again = texts.join(large.select("rid"), "rid", "left_semi")
    return edges.unionByName(written(block_edges(blocks.join(again, "rid"), similar), "links"))


def classes(docs: DataFrame, similar: float = SIMILAR, repeats: bool = True) -> DataFrame:
    """(rid, doc_id, class_rid, class_id) for every row of rows (rid, doc_id, text).

    class_rid is the smallest rid of the class, class_id that row's doc_id. ``repeats``: a rid may stand for several equal rows.
    """
    rows = docs.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = rows.select("rid", "doc_id", F.md5("text").alias("digest"))
    first = digests.groupBy("digest").agg(F.min("rid").alias("rep"))
    members = written(digests.join(first, "digest").select("rid", "doc_id", "rep"), "copies")
    reps = members.filter("rid = rep").select("rid").distinct()
    once = rows.dropDuplicates(["rid"]) if repeats else rows
    signs = written(sketch_rows(once).join(reps, "rid", "left_semi"), "sketches")
    found = components(links(signs, once, similar)).select(F.col("node").alias("rep"), F.col("label").alias("class_rid"))
    out = kept_lineage_cut(members.join(found, "rep", "left").select("rid", "doc_id", F.coalesce("class_rid", "rep").alias("class_rid")))
    names = out.filter("rid = class_rid").groupBy("class_rid").agg(F.min("doc_id").alias("class_id"))
    return out.join(names, "class_rid").select("rid", "doc_id", "class_rid", "class_id")


def document_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    rows, repeats = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return classes(rows, similar, repeats)


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are the smallest of their class; of equal rows one."""
    rows, repeats = with_rid(packed_rows(docs))
    found = classes(rows.select("rid", "doc_id", "text"), similar, repeats)
    kept = rows.select("rid", "row").join(found.filter("rid = class_rid").select("rid").distinct(), "rid", "left_semi")
    return (kept.dropDuplicates(["rid"]) if repeats else kept).select("row.*")
