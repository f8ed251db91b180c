"""Helpers shared by the text operators: reading, row identities, scratch tables, byte views of Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.ranking import globally_sorted, with_position
from ordermill.session import scratch_path, shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of one Arrow batch; a batch of very long texts stays this small, but for its last row.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches and, in local mode, lets the Python workers import this package.

    On a cluster the package reaches the executors like any other (installed, or with --py-files).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.master.startswith("local"):
        environment = spark.sparkContext.environment
        if ROOT not in environment.get("PYTHONPATH", ""):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """Freed memory goes back to the system: Python workers outlive their tasks and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches, and nothing freed held on to at the end of a task."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()
    return df.mapInArrow(run, schema)


def in_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over every Arrow batch; it gets and returns whole record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out
    return map_arrow(df, run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_part(total: int, rows: int) -> int:
    """A bound below which about twice ``rows`` of ``total`` evenly spread 64-bit hashes lie.

    A draw of the ``rows`` smallest filters by it first, so that tasks hand on few rows in all, however many tasks there are.
    """
    return (1 << 63) - 1 if total <= 2 * rows else (1 << 65) * rows // total - (1 << 63)


def kept_lineage_cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, whose files go when the frame does (cleanCheckpoints)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows as one struct, so that working columns cannot meet names of the user's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def with_rid(docs: DataFrame, rid: str = "rid") -> tuple[DataFrame, bool]:
    """Adds a long that orders the rows by doc_id, nulls first; and tells whether equal rows may share one.

    It is doc_id itself where that is unique and has no null, which one pass over that column tells. Else it is the
    position of (doc_id, text) among all distinct ones, so that equal rows share one number and act as one document.
    """
    ids = docs.select("doc_id")
    clash = ids.groupBy("doc_id").count().filter("doc_id is null or `count` > 1").limit(1).count()
    if not clash:
        return docs.withColumn(rid, F.col("doc_id").cast("long")), False
    keyed = docs.withColumn("__h", F.sha2(F.coalesce("text", F.lit("")), 256)) \
                .withColumn("__null", F.col("text").isNull())
    names = keyed.select("doc_id", "__h", "__null").distinct().withColumnRenamed("doc_id", "__id") \
                 .withColumnRenamed("__h", "__k").withColumnRenamed("__null", "__n")
    ranked = with_position(globally_sorted(names, [F.col("__id").asc_nulls_first(), "__k", "__n"]), rid)
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__h"] == F.col("__k")) & (keyed["__null"] == F.col("__n"))
    return keyed.join(ranked, same).drop("__id", "__k", "__n", "__h", "__null"), True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after another, and where each starts (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def texts_of(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def lists_of(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of ``values`` as a list column."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# ---- rolling hashes of all substrings ------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _power_tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 1 << bits), _powers(_INVERSE, 1 << bits)


class Substrings:
    """Hashes of any substrings of some bytes: the same for equal substrings, wherever they lie."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(max(16, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * power[:len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, size: int) -> np.ndarray:  # of data of at most BLOCK bytes or so; else see window_hashes
        """The hash of every substring of ``size`` bytes."""
        n = max(0, len(self.sums) - size)
        with np.errstate(over="ignore"):
            return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n else self.sums[:0]


#: Bytes whose power table is held at once.
BLOCK = 1 << 19


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of every substring of ``size`` bytes of data of any length."""
    n = max(0, len(data) - size + 1)
    parts = [Substrings(data[at:min(at + BLOCK, n) + size - 1]).all_of(size) for at in range(0, n, BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hashes of data[start[i]:stop[i]] for spans in order that do not overlap."""
    parts, at = [], 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(stop, start[at] + BLOCK, side="right")))
        low = int(start[at])
        parts.append(Substrings(data[low:stop[upto - 1]]).hashes(start[at:upto] - low, stop[at:upto] - low))
        at = upto
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))
