"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of every window of ``LENGTH`` bytes the leftmost ``GRAM`` bytes with the smallest hash are
its anchor, so equal windows have equal anchors at the same place, and a run of windows shares one. The suffixes that begin
at anchors are dealt to index parts by the hash of their first bytes. An index part takes its suffixes in document order,
batch by batch: each batch is sorted into a suffix array (by anchor, then by context, which is the whole run of windows),
merge-scanned against the levels there are, and becomes a level itself; levels of like size merge, so there are
logarithmically many. The order among suffixes is that of the hashes of their first bytes and of their runs, not that of
the bytes: the scan only asks for equal ones. Runs whose context occurs earlier in the same task's batch are settled before
anything is shuffled.

The scan tells a run whose whole context occurred before (all of it goes) and anchors with several contexts. Only of these
are the bytes fetched, and their windows compared one by one, byte by byte. Anchors with over ``CONTEXTS`` contexts are dealt
again first, by a second anchor of each window under another hash, so that unlike surroundings part; what is still that
many then has its windows dealt out one by one, so it splits over any number of tasks.

Whole contexts, and windows that are dealt out one by one, count as equal where 128 bits of hashes are (anchor and context,
or two of the window); nothing else rests on hashes.

"Earlier" is by doc_id (nulls first, then by text), then by position; rows equal in doc_id and text are one document, and
each is reported. Nulls are empty; texts under ``LENGTH`` bytes have no windows; an empty table gives no rows. Extra columns
stay as they are, whatever their names. A very long text is sampled in pieces and needs memory in proportion to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import Substrings, in_batches, map_arrow, mixed, packed_rows, utf8, window_hashes, with_rid, written

LENGTH = 100
GRAM = 32
STEP = 1 << 18  # windows that are sampled at once
LEVEL_ROWS = 1 << 16
#: Anchors with more contexts than this are dealt again.
CONTEXTS = 5_000
SLICE = 1 << 20
_C = np.random.default_rng(7).integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, again: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that share an anchor: (text number, first window, last window, anchor hash, context hash).

    ``again`` orders by another hash, so that most windows get another anchor.
    """
    if not GRAM < length <= GRAM + 96:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 96}")  # a run's size is kept in 7 bits
    span = length - GRAM + 1
    for begin in range(0, max(0, len(data) - length + 1), STEP):
        part = data[begin:begin + STEP + length - 1]
        n = len(part) - length + 1
        sub = Substrings(part)
        gram = sub.all_of(GRAM)
        with np.errstate(over="ignore"):
            low = ((mixed(gram * _C[4]) if again else gram) & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= span:  # minima of doubling widths, then of the span as two that overlap
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        anchor = (low[:n] & _LOW).astype(np.int64)
        # windows inside one text
        change = np.zeros(n + 1, np.int32)
        first, last = np.searchsorted(at, begin, side="right") - 1, np.searchsorted(at, begin + n - 1, side="right")
        starts, ends = at[first:last] - begin, at[first + 1:last + 1] - begin - length + 1
        some = ends > starts
        np.add.at(change, np.clip(starts[some], 0, n), 1)
        np.add.at(change, np.clip(ends[some], 0, n), -1)
        inside = np.cumsum(change[:-1]) > 0
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        edge = new | np.r_[True, ~inside[:-1]]
        s = np.flatnonzero(inside & edge)
        if not len(s):
            continue
        stop = np.r_[new[1:], True] | np.r_[~inside[1:], True]
        e = np.flatnonzero(inside & stop)
        with np.errstate(over="ignore"):
            back = (anchor[s] - s).astype(np.uint64)
            context = mixed(sub.hashes(s, e + length) + back * _C[0] + (e - s).astype(np.uint64) * _C[1])
        doc = np.searchsorted(at, s + begin, side="right") - 1
        yield doc, s + begin - at[doc], e + begin - at[doc], gram[anchor[s]], context


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sampled suffixes (key, context, rid, span) of rows (rid, text); span holds the first window and the run's size.

    Rows with an odd span are settled already: bytes span >> 8 up to ``context`` of the text were seen before.
    """
    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column("text"))
        rid = batch.column("rid").to_numpy()
        found = list(runs(data, at, length))
        if not found:
            return None
        doc, s, e, key, context = (np.concatenate(c) for c in zip(*found))
        own = rid[doc]
        both = mixed(key * _C[2] + context)
        order = np.lexsort((s, own, both))
        again = np.zeros(len(s), bool)
        k, c = key[order], context[order]
        again[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        # settled runs that follow each other become one span
        head, tail = _ends(again, doc)
        spread = mixed(own[head].astype(np.uint64) * _C[3] + s[head].astype(np.uint64))
        rest = ~again
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (
            np.r_[key[rest], spread].view(np.int64), np.r_[context[rest].view(np.int64), e[tail] + length],
            np.r_[own[rest], own[head]], np.r_[(s[rest] << 8) | ((e - s)[rest] << 1), (s[head] << 8) | 1])],
            ["key", "context", "rid", "span"])
    return in_batches(docs.select("rid", "text"), sample, "key long, context long, rid long, span long")


class Levels:
    """Suffix arrays of growing size over batches that come in document order."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, key: np.ndarray, context: np.ndarray, rid: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Takes a batch in document order; True where the same anchor and context came before."""
        order = np.lexsort((context, key))  # the batch's suffix array; equal ones stay in document order
        k, c = key[order], context[order]
        repeat = np.r_[False, (k[1:] == k[:-1]) & (c[1:] == c[:-1])]
        seen = np.zeros(len(key), bool)
        seen[order[repeat]] = True
        order = order[~repeat]
        k, c = key[order], context[order]
        several = np.r_[False, k[1:] == k[:-1]] | np.r_[k[1:] == k[:-1], False]
        known = np.zeros(len(order), bool)
        for level in self.levels:  # merge-scan
            lo, hi = np.searchsorted(level["key"], k, "left"), np.searchsorted(level["key"], k, "right")
            met = np.flatnonzero(hi > lo)
            if not len(met):
                continue
            both = mixed(k[met].astype(np.uint64) * _C[2] + c[met].astype(np.uint64))
            at = np.minimum(np.searchsorted(level["both"], both), len(level["both"]) - 1)
            same = (level["both"][at] == both) & (level["check"][at] == c[met])
            known[met[same]] = True
            other = met[~same]
            several[other] = True
            change = np.zeros(len(level["key"]) + 1, np.int64)
            np.add.at(change, lo[other], 1)
            np.add.at(change, hi[other], -1)
            level["several"] |= np.cumsum(change[:-1]) > 0
        seen[order[known]] = True
        new = ~known
        both = mixed(k[new].astype(np.uint64) * _C[2] + c[new].astype(np.uint64))
        by_both = np.argsort(both, kind="stable")
        self._put({"key": k[new], "both": both[by_both], "check": c[new][by_both], "rid": rid[order][new], "span": span[order][new], "several": several[new]})
        return seen

    def _put(self, level: dict[str, np.ndarray]) -> None:
        if not len(level["key"]):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) <= 2 * len(self.levels[-1]["key"]):
            b, a = self.levels.pop(), self.levels.pop()
            order = np.argsort(np.r_[a["key"], b["key"]], kind="stable")
            merged = {n: np.r_[a[n], b[n]][order] for n in ("key", "rid", "span", "several")}
            order = np.argsort(np.r_[a["both"], b["both"]], kind="stable")
            merged |= {n: np.r_[a[n], b[n]][order] for n in ("both", "check")}
            self.levels.append(merged)

    def several(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, rid, span) of all suffixes whose anchor has several contexts."""
        for level in self.levels:
            if level["several"].any():
                yield tuple(level[n][level["several"]] for n in ("key", "rid", "span"))


def scanned(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (rid, start, stop, key): bytes to remove (key null), or windows start..stop to compare within their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, n = Levels(), [], 0

        def out(rid, start, stop, key=None):
            key = pa.nulls(len(rid), pa.int64()) if key is None else pa.array(key)
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array(stop), key], ["rid", "start", "stop", "key"])

        def take():
            key, context, rid, span = (np.concatenate(c) for c in zip(*held))
            seen = index.add(key, context, rid, span)
            return out(rid[seen], span[seen] >> 8, (span[seen] >> 8) + ((span[seen] & 255) >> 1) + length)
        for batch in batches:
            key, context, rid, span = (batch.column(c).to_numpy() for c in ("key", "context", "rid", "span"))
            settled = (span & 1) == 1
            if settled.any():
                yield out(rid[settled], span[settled] >> 8, context[settled])
            held.append(tuple(c[~settled] for c in (key, context, rid, span)))
            n += int((~settled).sum())
            if n >= LEVEL_ROWS:
                yield take()
                held, n = [], 0
        if n:
            yield take()
        for key, rid, span in index.several():
            yield out(rid, span >> 8, (span >> 8) + ((span & 255) >> 1), key)
    return map_arrow(rows.repartition("key").sortWithinPartitions("rid", "span"), run,
                     "rid long, start long, stop long, key long")


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal ones; spans that touch are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.r_[True, start[1:] > stop[:-1]] if len(start) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(start) else new
    return start[new], stop[last]


def _result(raw: bytes, start: np.ndarray, stop: np.ndarray, texts: bool) -> dict:
    start, stop = merged_spans(start, stop)
    cuts = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
    return {"n_bytes": len(raw), "n_removed": int((stop - start).sum()), "n_spans": len(start),
            "kept_sha256": hashlib.sha256(kept).hexdigest(), "data": kept.decode("utf-8", "ignore").encode() if texts else None}


_FIELDS = "kind int, rid long, start long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()),
                     ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("data", pa.binary())])
DONE, WAITING, CONTEXT = 0, 1, 2


def _first_pass(docs: DataFrame, found: DataFrame, texts: bool, length: int) -> DataFrame:
    """Finished texts, waiting ones (compressed) and the bytes of contexts to compare."""
    marks = found.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "key")).alias("marks"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {n: [] for n in _SCHEMA.names}
        rid, packed = batch.column("rid").to_pylist(), batch.column("packed").to_pylist()
        marks_of = batch.column("marks")
        inner = marks_of.flatten()
        begin = np.r_[0, np.cumsum([len(m) if m.is_valid else 0 for m in marks_of])] if marks_of.null_count else \
            np.asarray(marks_of.offsets) - marks_of.offsets[0].as_py()
        start, stop = (inner.field(n).to_numpy(zero_copy_only=False) for n in ("start", "stop"))
        open_ = np.asarray(inner.field("key").is_valid())
        key = inner.field("key").fill_null(0).to_numpy(zero_copy_only=False)
        for i, r in enumerate(rid):
            raw = zstandard.decompress(packed[i])
            part = slice(int(begin[i]), int(begin[i + 1]))
            s, e, o, k = start[part], stop[part], open_[part], key[part]
            if o.any():
                for a, b, c in zip(s[o].tolist(), e[o].tolist(), k[o].tolist()):
                    _append(out, {"kind": CONTEXT, "rid": r, "start": a, "key": c, "data": raw[a:b + length]})
                sure = np.stack(merged_spans(s[~o], e[~o]), axis=1).astype("<i8")
                _append(out, {"kind": WAITING, "rid": r, "n_spans": len(sure), "data": sure.tobytes() + packed[i]})
            else:
                _append(out, {"kind": DONE, "rid": r} | _result(raw, s, e, texts))
        return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column("text"))
        squeeze = zstandard.ZstdCompressor(level=1)
        packed = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(packed, pa.binary())], ["rid", "packed"])
    joined = in_batches(docs.select("rid", "text"), pack, "rid long, packed binary").join(marks, "rid", "left")
    return in_batches(joined, cut, _FIELDS)


def _append(out: dict[str, list], row: dict) -> None:
    for n in out:
        out[n].append(row.get(n))


def _earlier_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For contexts laid end to end, in document order within each key: True at windows that an earlier context has."""
    n = max(0, len(data) - length + 1)
    inside = np.zeros(len(data), bool)
    size = np.diff(at) - length + 1
    index = np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    inside[index] = True
    where = np.flatnonzero(inside[:n])
    hashed = window_hashes(data, length)[where]
    order = np.argsort(hashed, kind="stable")
    same = np.r_[False, hashed[order][1:] == hashed[order][:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later, first = where[order[same]], where[order[head[same]]]
    words = np.lib.stride_tricks.as_strided(np.r_[data, np.zeros(8, np.uint8)], (len(data) + 1, 8), (1, 1))
    equal = np.ones(len(later), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        equal &= (words[later + offset] == words[first + offset]).all(axis=1)
    out = np.zeros(len(data), bool)
    out[later[equal]] = True
    for w, f in zip(later[~equal].tolist(), first[~equal].tolist()):  # different bytes with one hash
        own = data[w:w + length].tobytes()
        rivals = where[order[same]][(first == f)]
        out[w] = any(data[x:x + length].tobytes() == own for x in rivals.tolist() if x < w)
    return out


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (rid, start, stop) of windows that an earlier context of the same key has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            data, at = utf8(table.column("data").combine_chunks())
            again = _earlier_windows(data, at, length)
            change = np.diff(np.r_[False, again, False].astype(np.int8))
            s, e = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            own = np.searchsorted(at, s, side="right") - 1
            rid, start = table.column("rid").to_numpy(), table.column("start").to_numpy()
            shift = start[own] - at[own]
            return pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(s + shift), pa.array(e - 1 + shift + length)],
                                              ["rid", "start", "stop"])
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SLICE:  # cut before the last key, which may go on
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                begin = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
                if begin:
                    yield emit(table.slice(0, begin))
                    held = table.slice(begin).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held))
    sorted_ = contexts.select("key", "rid", "start", "data").repartition("key").sortWithinPartitions("key", "rid", "start")
    return map_arrow(sorted_, run, "rid long, start long, stop long")


def _redealt(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of crowded keys as shorter ones (key, rid, start, data) by a second anchor of each window, and the spans
    (rid, start, stop) of those that an earlier one of the same Arrow batch equals."""
    def deal(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, at = utf8(batch.column("data"))
        found = list(runs(data, at, length, again=True))
        if not found:
            return None
        own, s, e, key, _ = (np.concatenate(c) for c in zip(*found))
        with np.errstate(over="ignore"):
            key = mixed(key * _C[5] + batch.column("key").to_numpy()[own].view(np.uint64)).view(np.int64)
        rid, start = batch.column("rid").to_numpy()[own], batch.column("start").to_numpy()[own] + s
        order = np.lexsort((start, rid))
        known: set[tuple[int, bytes]] = set()
        out, stop = [None] * len(order), start + (e - s) + length
        first = (at[own] + s).tolist()
        size = (e - s + length).tolist()
        for i in order.tolist():
            part = data[first[i]:first[i] + size[i]].tobytes()
            name = (int(key[i]), part)
            if name not in known:
                known.add(name)
                out[i] = part
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rid), pa.array(start), pa.array(stop), pa.array(out, pa.binary())],
                                          ["key", "rid", "start", "stop", "data"])
    rows = written(in_batches(contexts.select("key", "rid", "start", "data"), deal,
                              "key long, rid long, start long, stop long, data binary"), "redealt")
    return rows.filter("data is not null").select("key", "rid", "start", "data"), \
        rows.filter("data is null").select("rid", "start", "stop")


def _crowded(contexts: DataFrame) -> DataFrame | None:
    """The keys with more than CONTEXTS contexts, if there are any."""
    hot = contexts.groupBy("key").count().filter(F.col("count") > CONTEXTS).select("key", F.lit(True).alias("hot"))
    hot = written(hot, "crowded-anchors")
    return hot if hot.limit(1).count() else None


def _spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (rid, start, stop) of windows that an earlier context of their key has."""
    hot = _crowded(contexts)
    if hot is None:
        return _compared(contexts, length)
    marked = contexts.join(hot, "key", "left")
    again, settled = _redealt(marked.filter("hot"), length)
    out = _compared(marked.filter("hot is null"), length).unionByName(settled)
    hot = _crowded(again)
    if hot is None:
        return out.unionByName(_compared(again, length))
    marked = again.join(hot, "key", "left")
    return out.unionByName(_compared(marked.filter("hot is null"), length)).unionByName(_spread(marked.filter("hot"), length))


def _spread(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans for keys with very many contexts, whose windows are dealt out one by one.

    Windows that an earlier context of the same Arrow batch has are settled there, so a window that very many contexts
    share is a row for each batch; of the others the first in document order stays.
    """
    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column("data"))
        size = np.diff(at) - length + 1
        own = np.repeat(np.arange(len(size)), size)
        index = at[own] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        one = window_hashes(data, length)[index]
        two = window_hashes(data[::-1].copy(), length)[len(data) - length - index]  # of the bytes read backwards
        rid, start = batch.column("rid").to_numpy()[own], batch.column("start").to_numpy()[own] + index - at[own]
        order = np.lexsort((start, rid, two, one))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        head, tail = _ends(again, own)
        rest = ~again
        stop = np.r_[np.zeros(int(rest.sum()), np.int64), start[tail] + length]
        spread = mixed(rid[head].astype(np.uint64) * _C[3] + start[head].astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (
            np.r_[one[rest].view(np.int64), spread], np.r_[two[rest].view(np.int64), spread],
            np.r_[rid[rest], rid[head]], np.r_[start[rest], start[head]], stop)], ["one", "two", "rid", "start", "stop"])
    schema = "one long, two long, rid long, start long, stop long"
    windows = in_batches(contexts.select("rid", "start", "data"), explode, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            one, two, rid, start, stop = (batch.column(c).to_numpy() for c in ("one", "two", "rid", "start", "stop"))
            open_ = np.flatnonzero(stop == 0)
            key = np.stack([one[open_], two[open_]], axis=1)
            before = np.vstack([key[:1] - 1 if last is None else last, key])[:-1]
            again = (key == before).all(axis=1)
            last = key[-1:] if len(key) else last
            out = np.r_[open_[again], np.flatnonzero(stop > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(start[out]), pa.array(
                np.where(stop[out] > 0, stop[out], start[out] + length))], ["rid", "start", "stop"])
    return map_arrow(windows.repartition("one", "two").sortWithinPartitions("one", "two", "rid", "start"), run,
                     "rid long, start long, stop long")


def _ends(marked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of marked places with one owner."""
    index = np.flatnonzero(marked)
    if not len(index):
        return index, index
    cut = (np.diff(index) != 1) | (own[index[1:]] != own[index[:-1]])
    return index[np.r_[True, cut]], index[np.r_[cut, True]]


def removed(docs: DataFrame, texts: bool = False, length: int = LENGTH) -> DataFrame:
    """(rid, n_bytes, n_removed, n_spans, kept_sha256, data) of rows (rid, text), whose rid must be unique.

    ``data`` holds the remaining bytes where ``texts`` asks for them, without characters that were removed in part.
    """
    found = written(scanned(suffixes(docs, length), length), "suffix-marks")
    first = written(_first_pass(docs, found, texts, length), "suffix-pass")
    contexts = first.filter(F.col("kind") == CONTEXT)
    spans = _spans(contexts, length)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("more"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {n: [] for n in _SCHEMA.names}
        for rid, n, data, more in zip(*(batch.column(c).to_pylist() for c in ("rid", "n_spans", "data", "more"))):
            sure = np.frombuffer(data[:16 * n], "<i8").reshape(-1, 2)
            both = np.concatenate([sure, np.array([(m["start"], m["stop"]) for m in more or []], np.int64).reshape(-1, 2)])
            _append(out, {"kind": DONE, "rid": rid} | _result(zstandard.decompress(data[16 * n:]), both[:, 0], both[:, 1], texts))
        return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
    waiting = first.filter(F.col("kind") == WAITING).select("rid", "n_spans", "data").join(spans, "rid", "left")
    names = ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "data"]
    return first.filter(F.col("kind") == DONE).select(*names).unionByName(in_batches(waiting, finish, _FIELDS).select(*names))


def deduplicated(docs: DataFrame, texts: bool = False, length: int = LENGTH) -> DataFrame:
    """``removed`` for any rows with doc_id and text, with doc_id in front; each row is reported."""
    rows, repeats = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if not repeats:
        out = removed(rows, texts, length)
        return out.withColumn("doc_id", F.col("rid"))
    return rows.select("rid", "doc_id").join(removed(rows.dropDuplicates(["rid"]), texts, length), "rid")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all columns, the text without its repeated strings.

    A character whose bytes were removed in part is dropped. A null text stays null; a text of which nothing is left is
    empty.
    """
    rows, repeats = with_rid(packed_rows(docs))
    once = rows.select("rid", "text")
    left = removed(once.dropDuplicates(["rid"]) if repeats else once, True, length)
    # valid UTF-8: no second Python worker beside the one that cut the texts
    texts = left.select("rid", F.col("data").cast("string").alias("left"))
    kept = rows.select("rid", F.col("row").dropFields("text").alias("others") if len(docs.columns) > 2 else F.lit(None).alias("others"),
                       "doc_id", F.col("text").isNull().alias("none")).join(texts, "rid")
    columns = [F.when(~F.col("none"), F.col("left")).alias(c) if c == "text" else F.col("doc_id") if c == "doc_id" else
               F.col("others").getField(c).alias(c) for c in docs.columns]
    return kept.select(*columns)
