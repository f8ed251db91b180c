"""Hard negatives from Hilbert-ordered blocks with zone maps.

Rows (vec_id, label, embedding) with a null label, a null vector, or a null or non-finite component take no part. A
component x becomes floor(256 x); a pair's score is the inner product, a whole number. An anchor's positives are its
``POSITIVES`` best other rows of its label, and the negatives of each positive the best ``NEGATIVES`` rows of other
labels whose score lies between 50 and 95 hundredths of the positive's; ties go by vec_id (null last), then by place.

Rows are sorted by label and by the index of a Hilbert curve through the leading principal axes, and written as Parquet
blocks of ``BLOCK`` rows with the least and greatest value of every dimension: the zone map. ``UNIT`` blocks in a row
are one unit of work. For an anchor and a zone map interval arithmetic gives bounds of all scores inside. An anchor is
sent only to units that can hold one of its positives (the bound reaches the last of the best in its own block) or a
score in one of its windows, and reads only the blocks of them that can. Nothing else is left out, so results are exact,
whatever the data; on vectors without structure the bounds exclude little and all blocks are read.

A task holds one unit, and anchors stream by in batches; results shrink to the best few per anchor and unit before they
meet. The driver and the tasks get at most ``ZONES`` unit zone maps; beyond that many units, ranges of them share one.
Principal axes come from a sample of ``SAMPLE`` rows and only shape the order. Hot labels are many units.

Empty tables give no rows. Vectors of different lengths have no score together. A null vec_id belongs to no anchor.
Repeated rows are rows of their own, also as partners of each other, and every anchor row of a repeated id has its own
results. Extra columns are ignored. Scores are exact while they fit a long; larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.llm.common import lower_part, map_arrow, written

BLOCK = 512
UNIT = 32
ZONES = 4096
SAMPLE = 4096
AXES, BITS = 6, 5
POSITIVES, NEGATIVES = 5, 3
#: Shares of a positive's score, in hundredths, between which its negatives lie.
LOW, HIGH = 50, 95
#: Bytes of a block's vectors at most, and scores held at once.
BLOCK_BYTES, SCORES = 1 << 20, 1 << 21

BLOCKS = ("part int, unit long, block long, label int, dim int, ids array<long>, vectors binary, low array<double>, "
          "high array<double>, anchors array<int>, floors array<double>")


# ---- the order -------------------------------------------------------------------------------

def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (one row of coordinates below 2 ** bits) along a Hilbert curve, by Skilling's method."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the levels above
        mask = np.uint64((1 << level) - 1)
        for i in range(n):
            turned = (x[i] >> np.uint64(level)) & np.uint64(1) == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & mask).astype(np.uint64)
            x[0] ^= np.where(turned, mask, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(level)) & np.uint64(1) == 1, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return out.astype(np.int64)


@dataclass
class Curve:
    """Centre, leading principal axes, and cell edges along each."""

    centre: np.ndarray
    axes: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray) -> Curve:
        centre = sample.mean(axis=0)
        _, vectors = np.linalg.eigh(np.cov((sample - centre).T).reshape(sample.shape[1], -1))
        axes = vectors[:, ::-1][:, :AXES]
        edges = np.quantile((sample - centre) @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)
        return cls(centre, axes, edges)

    def index(self, rows: np.ndarray) -> np.ndarray:
        placed = (rows - self.centre) @ self.axes
        return hilbert_index(np.stack([np.searchsorted(e, p) for e, p in zip(self.edges.T, placed.T)], axis=1), BITS)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding of doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding")) \
               .filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)


def curves_of(rows: DataFrame) -> dict[int, Curve]:
    """A curve for every length of vectors with enough rows in the sample; others lie in the order of their ids."""
    hashed = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("hash"))
    some = hashed.filter(F.col("hash") <= lower_part(rows.count(), SAMPLE))  # so that tasks hand on few rows in all
    drawn = some.orderBy("hash").limit(SAMPLE).toPandas()["embedding"]
    by_size: dict[int, list] = {}
    for x in drawn:
        by_size.setdefault(len(x), []).append(x)
    return {n: Curve.of(np.stack(some)) for n, some in by_size.items() if n and len(some) > 1}


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def ordered(rows: DataFrame) -> DataFrame:
    """(label, dim, place, vec_id, embedding) with floored components and the place along the curve."""
    curves = curves_of(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == dim))
                x = np.floor(256 * _matrix(some.column("embedding"), dim))
                at = curves[dim].index(x / 256) if dim in curves else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column("label"), pa.array(np.full(len(x), dim, np.int32)), pa.array(at), some.column("vec_id"),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))
                     if dim else some.column("embedding")], ["label", "dim", "place", "vec_id", "embedding"])
    return map_arrow(rows, place, "label int, dim int, place long, vec_id long, embedding array<double>")


# ---- blocks ----------------------------------------------------------------------------------

#: How vectors are stored, the narrowest first: as whole numbers where all fit.
_KINDS = ((np.int16, 1 << 15), (np.int32, 1 << 31))


def _packed(x: np.ndarray) -> bytes:
    most = np.abs(x).max(initial=0)
    kind = next((k for k, bound in _KINDS if most < bound), np.float64)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[data[0]]
    return np.frombuffer(data, kind, offset=1).reshape(-1, dim).astype(np.float64) if dim else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exactly: floats where no sum can leave their range, else longs."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) @ \
        np.array([[int(v) for v in r] for r in b], object).reshape(b.shape).T
    return np.array([[int(v) for v in r] for r in whole], np.int64).reshape(len(a), len(b))  # raises where no long holds it


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that each anchor can have with rows between ``low`` and ``high`` (one row per zone).

    Sums of floats are widened by what their rounding may lose.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T * (1e-14 * max(1, anchors.shape[1]))
    return least - slack, most + slack


def _id_order(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The rank of each id, null last, equal ids by place."""
    out = np.empty(len(ids), np.int64)
    out[np.lexsort((np.arange(len(ids)), ids, null))] = np.arange(len(ids))
    return out


def _best(scores: np.ndarray, rank: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Of the columns ``among`` the ``most`` with the highest score, ties by rank."""
    if len(among) > most:
        floor = np.partition(scores[among], len(among) - most)[len(among) - most]
        among = among[scores[among] >= floor]
    return among[np.lexsort((rank[among], -scores[among]))[:most]]


def blocks(rows: DataFrame, every: int) -> DataFrame:
    """Blocks with zone maps, written. Rows whose vec_id ``every`` divides are anchors; each gets the score of the last of
    its best positives within its block (null where there are too few), which is the least it can ask of others."""
    order = [F.col("label"), F.col("dim"), F.col("place"), F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    dealt = ordered(rows).repartitionByRange(*order[:4]).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = unit = filled = 0
        label = dim = None
        held: list[pa.RecordBatch] = []

        def block(some: pa.Table) -> pa.RecordBatch:
            nonlocal made, unit, filled
            if filled == UNIT:
                unit, filled = unit + 1, 0
            ids = some.column("vec_id").combine_chunks()
            x = np.concatenate([_matrix(c, dim) for c in some.column("embedding").chunks])
            null = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            own = np.flatnonzero(~null & (number % every == 0))
            floors = []
            if len(own):
                scores, rank = products(x[own], x), _id_order(number, null)
                for a, s in zip(own.tolist(), scores):
                    best = _best(s, rank, np.delete(np.arange(len(x)), a), POSITIVES)
                    floors.append(float(s[best[-1]]) if len(best) == POSITIVES else None)
            low, high = (x.min(axis=0), x.max(axis=0)) if dim else (x[:0].ravel(),) * 2
            out = pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([(task << 32) + unit], pa.int64()), pa.array([(task << 32) + made], pa.int64()),
                 pa.array([label], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                 pa.array([_packed(x)], pa.binary()), pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64())),
                 pa.array([own], pa.list_(pa.int32())), pa.array([floors], pa.list_(pa.float64()))], _NAMES)
            made, filled = made + 1, filled + 1
            return out

        def full(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim or 1))))
            have = sum(b.num_rows for b in held)
            if have < most and not rest or not have:
                return
            table, at = pa.Table.from_batches(held), 0
            while have - at >= most or (rest and at < have):
                yield block(table.slice(at, most))
                at += most
            held = [b for b in table.slice(at).to_batches() if b.num_rows] if at < have else []

        for batch in batches:
            key = np.stack([batch.column("label").to_numpy(), batch.column("dim").to_numpy()], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                if (label, dim) != tuple(key[s].tolist()):
                    yield from full(True)
                    label, dim = key[s].tolist()
                    unit, filled = unit + (filled > 0), 0
                held.append(batch.slice(s, e - s))
                yield from full(False)
        yield from full(True)
    return written(map_arrow(dealt, cut, BLOCKS), "blocks")


_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


# ---- zone maps -------------------------------------------------------------------------------

@dataclass
class Zones:
    """Bounds of at most ZONES ranges of units, each of vectors of one length."""

    number: np.ndarray
    dim: np.ndarray
    label: np.ndarray  # least and greatest
    low: list[np.ndarray]
    high: list[np.ndarray]

    def wanted(self, anchors: np.ndarray, label: int, windows: tuple[np.ndarray, np.ndarray], same: bool) -> list[tuple[int, np.ndarray]]:
        """(zone, which anchors) for every zone that may hold a row of the same label, or of another one, with a score
        inside one of an anchor's windows (least and greatest, one row per anchor)."""
        fits = (self.label[:, 0] <= label) & (label <= self.label[:, 1]) if same else \
            (self.label[:, 0] != label) | (self.label[:, 1] != label)
        at = np.flatnonzero(fits & (self.dim == anchors.shape[1]))
        if not len(at):
            return []
        least, most = bounds(anchors, np.stack([self.low[i] for i in at]), np.stack([self.high[i] for i in at]))
        need = _meets(least, most, windows)
        return [(int(self.number[i]), np.flatnonzero(need[:, k])) for k, i in enumerate(at) if need[:, k].any()]


def _meets(least: np.ndarray, most: np.ndarray, windows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For anchors and zones, whether the bounds meet one of the anchor's windows."""
    out = np.zeros(least.shape, bool)
    for low, high in zip(windows[0].T, windows[1].T):
        out |= (most >= low[:, None]) & (least <= high[:, None])
    return out


def zones_of(made: DataFrame) -> tuple[DataFrame, Zones]:
    """The blocks with their ``zone``, and the bounds of all zones."""
    units = made.select("unit").distinct().count()
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    # few units: each is a zone. Many: partitions, or runs of them, are
    zone = F.col("unit") if units <= ZONES else F.floor(F.col("part") / -(-parts // ZONES)).cast("long")
    rows = made.withColumn("zone", zone)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                low, high = np.array(row["low"]), np.array(row["high"])
                have = found.setdefault((row["zone"], row["dim"]), [row["least"], row["most"], low, high])
                found[row["zone"], row["dim"]] = [min(have[0], row["least"]), max(have[1], row["most"]),
                                                  np.minimum(have[2], low), np.maximum(have[3], high)]
        if found:
            yield pa.RecordBatch.from_pylist([
                {"zone": z, "dim": d, "least": v[0], "most": v[1], "low": v[2].tolist(), "high": v[3].tolist()}
                for (z, d), v in found.items()], pa.schema([("zone", pa.int64()), ("dim", pa.int32()), ("least", pa.int32()),
                                                            ("most", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
    kind = "zone long, dim int, least int, most int, low array<double>, high array<double>"
    some = rows.select("zone", "dim", F.col("label").alias("least"), F.col("label").alias("most"), "low", "high")
    once = map_arrow(map_arrow(some, merge, kind).repartition("zone"), merge, kind).collect()
    return rows, Zones(np.array([r.zone for r in once], np.int64), np.array([r.dim for r in once], np.int64),
                       np.array([(r.least, r.most) for r in once], np.int64).reshape(-1, 2),
                       [np.array(r.low) for r in once], [np.array(r.high) for r in once])


# ---- searches --------------------------------------------------------------------------------

#: An anchor's place is ROWS times its block's number plus its row; slots hold what is sought, up to POSITIVES an anchor.
ROWS = 1 << 10
SENT = ("unit long, side int, block long, label int, dim int, ids array<long>, vectors binary, low array<double>, "
        "high array<double>, places array<long>, slots array<array<long>>")


def _sent(made: DataFrame, zones: Zones, same: bool) -> DataFrame:
    """Anchors (block rows with ``places`` and ``slots``: for each anchor the least score, or its positives' scores) for each
    zone that they need, as rows like those of units."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = _unpacked(row["vectors"], row["dim"])[np.array(row["places"], np.int64) % ROWS] if row["dim"] else \
                    np.zeros((len(row["places"]), 0))
                for zone, which in zones.wanted(x, row["label"], _windows(row["slots"], same), same):
                    out.append({"zone": zone, "block": row["block"], "label": row["label"], "dim": row["dim"],
                                "ids": [], "vectors": _packed(x[which]), "places": [row["places"][i] for i in which],
                                "slots": [row["slots"][i] for i in which]})
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, _CHOSEN)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _CHOSEN)
    schema = "zone long, block long, label int, dim int, ids array<long>, vectors binary, places array<long>, slots array<array<long>>"
    return map_arrow(made.select("block", "label", "dim", "vectors", "places", "slots"), choose, schema)


_CHOSEN = pa.schema([("zone", pa.int64()), ("block", pa.int64()), ("label", pa.int32()), ("dim", pa.int32()),
                     ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("places", pa.list_(pa.int64())),
                     ("slots", pa.list_(pa.list_(pa.int64())))])


def _windows(slots: list[list[int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each window, one row per anchor; empty ones ask for less than they start with."""
    low = np.full((len(slots), 1 if same else POSITIVES), np.inf)
    high = np.full(low.shape, -np.inf)
    for i, some in enumerate(slots):
        if same:
            low[i], high[i] = some[0] if some else -np.inf, np.inf
            continue
        for k, score in enumerate(some):
            low[i, k], high[i, k] = -(-LOW * score // 100), HIGH * score // 100
    high[high < low] = -np.inf
    return low, high


def _searched(rows: DataFrame, zones: Zones, anchors: DataFrame, same: bool) -> DataFrame:
    """(place, slot, found, vec_id, score): each anchor's best rows of its label, or of others inside each window, per unit."""
    units = rows.select("zone", "unit").distinct()
    asked = _sent(anchors, zones, same).join(units, "zone")
    none = F.lit(None)
    asked = asked.select("unit", F.lit(1).alias("side"), "block", "label", "dim", "ids", "vectors", none.cast("array<double>").alias("low"),
                         none.cast("array<double>").alias("high"), "places", "slots")
    held = rows.select("unit", F.lit(0).alias("side"), "block", "label", "dim", "ids", "vectors", "low", "high",
                       none.cast("array<long>").alias("places"), none.cast("array<array<long>>").alias("slots"))
    dealt = held.unionByName(asked).repartition("unit").sortWithinPartitions("unit", "side", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: _Unit | None = None
        for batch in batches:
            out = _Found()
            waiting: list[dict] = []
            for row in batch.to_pylist():
                if unit is None or unit.number != row["unit"]:
                    if waiting:
                        unit.meet(waiting, same, out)
                        waiting = []
                    unit = _Unit(row["unit"], row["label"], row["dim"])
                if row["side"] == 0:
                    unit.add(row)
                elif row["dim"] == unit.dim and (row["label"] == unit.label) == same:
                    waiting.append(row)
            if waiting:
                unit.meet(waiting, same, out)
            yield from out.batches()
    return map_arrow(dealt, search, "place long, slot int, found long, vec_id long, score long")


class _Found:
    """Rows that go out: place of the anchor, slot, place and id of what was found, score."""

    def __init__(self) -> None:
        self.columns: list[list] = [[], [], [], [], []]

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)],
                                             ["place", "slot", "found", "vec_id", "score"])


class _Unit:
    """The rows of one unit, and the zone maps of its blocks."""

    def __init__(self, number: int, label: int, dim: int):
        self.number, self.label, self.dim = number, label, dim
        self.parts: list[dict] = []
        self.rows: np.ndarray | None = None

    def add(self, row: dict) -> None:
        self.parts.append(row)

    def _lay_out(self) -> None:
        if self.rows is not None:
            return
        self.rows = np.concatenate([_unpacked(p["vectors"], self.dim) if self.dim else np.zeros((len(p["ids"]), 0)) for p in self.parts])
        self.ids = [i for p in self.parts for i in p["ids"]]
        null = np.array([i is None for i in self.ids])
        self.places = np.concatenate([p["block"] * ROWS + np.arange(len(p["ids"])) for p in self.parts])
        self.rank = _id_order(np.array([0 if i is None else i for i in self.ids], np.int64), null)
        self.low, self.high = (np.array([p[k] for p in self.parts], np.float64).reshape(len(self.parts), self.dim) for k in ("low", "high"))
        self.sizes = np.array([len(p["ids"]) for p in self.parts])
        self.parts = []

    def meet(self, asked: list[dict], same: bool, out: _Found) -> None:
        """Scores the anchors against the blocks that may hold what they seek."""
        if not self.parts and self.rows is None:
            return
        self._lay_out()
        x = np.concatenate([_unpacked(r["vectors"], self.dim) if self.dim else np.zeros((len(r["places"]), 0)) for r in asked])
        places = [p for r in asked for p in r["places"]]
        slots = [s for r in asked for s in r["slots"]]
        windows = _windows(slots, same)
        least, most = bounds(x, self.low, self.high)
        need = _meets(least, most, windows)
        step = max(1, SCORES // max(1, len(self.rows)))
        for begin in range(0, len(x), step):
            some = slice(begin, begin + step)
            read = np.flatnonzero(np.repeat(need[some].any(axis=0), self.sizes))
            if not len(read):
                continue
            scores, rank = products(x[some], self.rows[read]), self.rank[read]
            for k, s in enumerate(scores):
                place = places[begin + k]
                if same:
                    floor = windows[0][begin + k, 0]
                    self._put(out, place, 0, read, s, _best(s, rank, np.flatnonzero((s >= floor) & (self.places[read] != place)), POSITIVES))
                    continue
                low, high = windows[0][begin + k], windows[1][begin + k]
                among = np.flatnonzero((s >= low.min()) & (s <= high.max()))
                for slot in range(len(slots[begin + k])):
                    inside = among[(s[among] >= low[slot]) & (s[among] <= high[slot])]
                    self._put(out, place, slot, read, s, _best(s, rank, inside, NEGATIVES))

    def _put(self, out: _Found, place: int, slot: int, read: np.ndarray, scores: np.ndarray, best: np.ndarray) -> None:
        for i in best.tolist():
            row = int(read[i])
            for column, value in zip(out.columns, (place, slot, int(self.places[row]), self.ids[row], int(scores[i]))):
                column.append(value)


def _ranked(found: DataFrame, most: int, *more: str) -> DataFrame:
    """The best ``most`` per anchor (and slot), numbered from 1 as ``rank``."""
    best = Window.partitionBy("place", *more).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("found"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows whose vec_id ``every`` divides."""
    made, zones = zones_of(blocks(usable(rows), every))
    with_anchors = made.filter(F.size("anchors") > 0)
    base = F.col("block") * ROWS
    seeds = with_anchors.select("block", "label", "dim", "vectors", F.transform("anchors", lambda a: base + a).alias("places"),
                                F.transform("floors", lambda f: F.when(f.isNull(), F.array().cast("array<long>")).otherwise(
                                    F.array(f.cast("long")))).alias("slots"))
    best = written(_ranked(_searched(made, zones, seeds, True), POSITIVES), "positives")
    lists = best.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("slots")) \
                .select(F.floor(F.col("place") / ROWS).alias("block"), "place", F.col("slots.score").alias("slots"))
    seekers = lists.groupBy("block").agg(F.collect_list(F.struct("place", "slots")).alias("anchors")) \
                   .select("block", F.col("anchors.place").alias("places"), F.col("anchors.slots").alias("slots"))
    asking = seekers.join(with_anchors.select("block", "label", "dim", "vectors"), "block")
    found = _ranked(_searched(made, zones, asking, False), NEGATIVES, "slot")
    ids = made.select(F.explode(F.transform("anchors", lambda a: F.struct(
        (base + a).alias("place"), F.element_at("ids", a + 1).alias("anchor_id")))).alias("a")).select("a.*")
    positives = best.join(ids, "place").select("place", (F.col("rank") - 1).alias("slot"), "anchor_id",
                                               F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positives, ["place", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, every: int = 7) -> Column:
    """The label, raised by one modulo ten where ``every`` divides vec_id."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
