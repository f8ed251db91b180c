"""Best-fit packing of tokenised documents into sequences, improved by swaps between underfull ones.

``token_pieces`` cuts every document's ids into pieces; ``place`` deals the slim piece rows into blocks of at most
``block_rows`` rows each and packs every block on its own: best fit in falling order of length, then local search.
The search takes the emptiest sequence and moves documents out of it, exchanges one for one, two for one or one for
two with other underfull sequences, always so that the sum of squared fills grows, until sequences are empty or the
block holds as few as its tokens allow. Then the pieces of all sequences with more than ``SLACK`` of room are dealt anew,
other pieces together, and packed again, round after round, until rounds bring nothing or one block holds them all; so
lengths that only fit those of other blocks meet them.

The search is local: it gives up after ``TRIES`` of the emptiest sequences in a row, considers pairs of a sequence's rows
that lie within ``NEAR`` places, and no exchange of more rows. So a packing can miss the fewest sequences possible; nothing
is left out of it. README.md has figures.

Nulls and empty texts have only the end id; an empty table gives no rows. Repeated rows are packed as often as they come;
equal lengths are taken in (doc_id, piece) order. Very long texts are cut into pieces. Other columns of the pieces stay;
``sequence_id`` and ``offset`` are added, so the pieces may not have them.
"""

from __future__ import annotations

import functools
import itertools
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import in_batches, texts_of, word_hashes, written

#: Distinct strings between white space that a Python worker remembers; beyond it all go.
CACHE = 500_000
#: Tokens of room beyond which a sequence is packed again with those of other blocks.
SLACK = 64
#: Sequences in a row that the search fails to empty before it ends, and how far apart rows of a pair may lie.
TRIES, NEAR = 96, 40
#: How word-level vocabularies of this kind cut lower-cased text; other files of the kind have the same pattern.
_BEYOND = re.compile("[\u0234-\U0010ffff]").search  # below, lower() is all that normalisation does
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SUFFIX = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Known:
    """Ids of strings by their hash, in a few sorted arrays: about 30 bytes for each string."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []  # hash, mark, where its ids begin, how many
        self.flat = np.zeros(0, "<u4")

    def find(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of each string's ids, and which are not known."""
        if sum(len(level[0]) for level in self.levels) > CACHE:
            self.__init__()
        begin, size, new = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.ones(len(key), bool)
        for keys, marks, begins, sizes in self.levels:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (marks[at] == mark)
            begin[hit], size[hit], new[hit] = begins[at[hit]], sizes[at[hit]], False
        return begin, size, new

    def add(self, key: np.ndarray, mark: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Strings in order of their hash, with their ids."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        level = (key, mark, begin, size.astype(np.int32))
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):  # like sizes merge
            both = [np.concatenate(c) for c in zip(self.levels.pop(), level)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(c[order] for c in both)
        self.levels.append(level)
        return begin, size


class WordIds:
    """Ids of whole texts as little-endian 32-bit numbers; each distinct word is encoded once by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(WORDS).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocabulary.items() if w.endswith(SUFFIX)]] = True
        self.known = Known()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Texts with letters beyond Latin go to the library whole, as its Unicode tables may differ from Python's."""
        plain = [None if _BEYOND(t) is not None or "<|" in t else t.lower() for t in texts]
        coded = iter(self._plain([t for t in plain if t is not None]))
        whole = iter(self._encoded([t for t, p in zip(texts, plain) if p is None]))
        return [next(whole) if p is None else next(coded) for p in plain]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Lower-cased texts: what lies between white space is told apart by its hash, and looked up once."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join([*coded, b""])
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in coded])
        change = np.diff(np.r_[False, ~_SPACE[data], False].astype(np.int8))
        start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        hashed = word_hashes(data, start, stop)
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        mark = (stop - start) * 65536 + data[start].astype(np.int64) * 256 + data[stop - 1]
        if (mark != mark[first][which]).any():  # two strings with one hash: tell them apart by themselves
            chunks = [raw[s:e] for s, e in zip(start.tolist(), stop.tolist())]
            _, first, which = np.unique(np.array(chunks, object), return_index=True, return_inverse=True)
            order = np.argsort(hashed[first], kind="stable")
            first, which = first[order], np.argsort(order)[which]
        key, mark = hashed[first], mark[first]
        begin, size, new = self.known.find(key, mark)
        if new.any():
            at = first[new]
            words = [self.find(raw[s:e].decode("utf-8", "surrogatepass")) for s, e in zip(start[at].tolist(), stop[at].tolist())]
            each = list(set().union(*words))
            ids = dict(zip(each, self._words(each)))
            begin[new], size[new] = self.known.add(key[new], mark[new], [b"".join(map(ids.__getitem__, row)) for row in words])
        count = size[which]
        upto = np.cumsum(count)
        at = np.repeat(begin[which] - (upto - count), count) + np.arange(count.sum())
        out = self.known.flat[at].tobytes()
        cuts = np.r_[0, np.r_[0, upto][np.searchsorted(start, ends)]] * 4
        return [out[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of single words, many words in one call."""
        lines = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
        coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(c.ids, "<u4") for c in coded]])
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): every document's ids and the end id, cut only where too long."""
    end = np.uint32(end_id).tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = _word_ids(path), texts_of(batch.column("text"))
        row, piece, parts = [], [], []
        for n, whole in enumerate(ids.ids(texts)):
            whole += end
            for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                row.append(n), piece.append(k), parts.append(whole[at:at + 4 * capacity])
        piece = np.array(piece, np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
             pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Groups of row numbers, each of at most ``capacity`` in sum; as few groups as the search finds."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    some = 0  # bit c is set where room[c] has a bin
    for item in order:
        size = sizes[item]
        fits = some >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            at = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            bins[at].append(item)
            left -= size
        else:
            at, left = len(bins), capacity - size
            bins.append([item])
        room[left].append(at)
        some |= 1 << left
    return _improved(bins, lengths, capacity)


def _improved(bins: list[list[int]], lengths: np.ndarray, capacity: int, tries: int = TRIES) -> list[list[int]]:
    """Empties underfull groups by moves and exchanges, each of which increases the sum of squared fills.

    Ends where the total allows no fewer groups, or where ``tries`` of the emptiest in a row could not be emptied.
    """
    fewest = -(-int(lengths.sum()) // capacity)
    owner = np.empty(len(lengths), np.int64)
    for n, rows in enumerate(bins):
        owner[rows] = n
    fill = np.bincount(owner, lengths, len(bins)).astype(np.int64)
    failed: list[int] = []
    while int((fill > 0).sum()) > fewest and len(failed) < tries:
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        under = np.setdiff1d(under, failed)
        if len(under) < 2:
            break
        donor = int(under[np.argmin(fill[under])])
        while fill[donor] > 0:
            step = _step(owner, fill, lengths, capacity, donor)
            if step is None:
                break
            taker, given, got = step
            owner[given], owner[got] = taker, donor
            moved = int(lengths[given].sum() - lengths[got].sum())
            fill[donor] -= moved
            fill[taker] += moved
        failed = failed + [donor] if fill[donor] > 0 else []
    groups: dict[int, list[int]] = {}
    for item, n in enumerate(owner.tolist()):
        groups.setdefault(n, []).append(item)
    return list(groups.values())


def _step(owner, fill, lengths, capacity, donor):
    """The best exchange as (taker, rows given, rows got), or None if none increases the squares."""
    gap = np.where((fill > 0) & (np.arange(len(fill)) != donor), capacity - fill, 0)
    items = np.flatnonzero(gap[owner] > 0)
    items = items[np.argsort(owner[items], kind="stable")]
    takers = np.flatnonzero(gap > 0)
    mine = np.flatnonzero(owner == donor)
    distinct = {int(lengths[i]): [int(i)] for i in mine}
    twos = {int(lengths[a] + lengths[b]): [int(a), int(b)] for n, a in enumerate(mine) for b in mine[n + 1:n + NEAR]}
    single = (np.r_[lengths[items], np.zeros(len(takers), np.int64)], np.r_[owner[items], takers],
              lambda k: [int(items[k])] if k < len(items) else [])
    best = _best(distinct, *single, gap, fill, donor)
    if best is None:
        best = _best(twos, *single, gap, fill, donor)
    if best is None:  # one for two neighbours in one group
        x = np.concatenate([np.flatnonzero(owner[items[:-d]] == owner[items[d:]]) for d in range(1, NEAR) if d < len(items)] or [items[:0]])
        y = np.concatenate([np.flatnonzero(owner[items[:-d]] == owner[items[d:]]) + d for d in range(1, NEAR) if d < len(items)] or [items[:0]])
        best = _best(distinct, lengths[items[x]] + lengths[items[y]], owner[items[x]],
                     lambda k: [int(items[x[k]]), int(items[y[k]])], gap, fill, donor)
    return best


def _best(given, back, taker, rows, gap, fill, donor):
    best, out = 0, None
    for size, mine in given.items():
        moved = size - back
        gain = np.where((moved > 0) & (moved <= gap[taker]), moved * (fill[taker] - fill[donor] + moved), 0)
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best, out = int(gain[k]), (int(taker[k]), mine, rows(k))
    return out


def place(pieces: DataFrame, capacity: int = 4096, block_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to slim piece rows (doc_id, piece, start, length and any others)."""
    rows, names = written(pieces, "pieces"), pieces.columns
    done: list[DataFrame] = []
    left, deal, held = rows, F.monotonically_increasing_id(), None
    for n in itertools.count():
        count = left.count()
        blocks = max(1, -(-count // block_rows))
        packed = written(_packed(left, deal, blocks, capacity, n), "packed")
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        before, held = held, fills.agg(F.count("*").alias("n"), F.count_if(F.col("fill") < capacity - SLACK).alias("open")).first()
        # what was packed again and is no better than before has nothing to gain from one more round
        if blocks == 1 or held.open < 2 or (before is not None and before.open - held.n < blocks):
            return reduce(DataFrame.unionByName, [*done, packed])
        full = fills.filter(F.col("fill") >= capacity - SLACK).select("sequence_id")
        done.append(packed.join(full, "sequence_id", "left_semi"))
        left = written(packed.join(full, "sequence_id", "left_anti").select(*names), "underfull")
        deal = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(n)), 1)


def _packed(rows: DataFrame, deal: Column, blocks: int, capacity: int, turn: int) -> DataFrame:
    """The rows packed block by block; numbers of sequences tell the round and the block."""
    # row numbers of a written table are the same on every read; dealing them out in turn splits any hot key
    dealt = rows.withColumn("__block", F.pmod(deal, F.lit(blocks)))
    schema = dealt.schema.simpleString()[7:-1].replace(",__block:bigint", "") + ",sequence_id:bigint,offset:bigint"

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for n, rows_of in enumerate(pack(lengths, capacity)):
            sequence[rows_of] = (turn << 56) | (int(frame["__block"].iat[0]) << 24) | n
            offset[rows_of] = np.cumsum(lengths[rows_of]) - lengths[rows_of]
        return frame.drop(columns="__block").assign(sequence_id=sequence, offset=offset)
    return dealt.groupBy("__block").applyInPandas(packed, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids themselves: one row (sequence_id, ids, doc_ids) for each sequence of pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most ``capacity`` pieces
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.to_binary(F.lit(""), F.lit("utf-8")), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
