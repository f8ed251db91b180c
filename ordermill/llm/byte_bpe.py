"""Byte-level BPE: vectorised pre-tokenisation, cached merging, and decoding by retained offsets.

The code points of a batch of texts become classes (letter, number, white space, other) and then, with the next two code
points in view, one of nine symbols. A small automaton over these symbols says where a pre-token begins. Each symbol is a
function from states to states; the functions under composition form a finite monoid, whose product is a table, so the
states come out of a blocked prefix scan: every row of a block is composed at once, the rows' totals are scanned the same
way, and the states within the rows follow from the states before them. No regular expression takes part. The
boundaries are those of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each slice between boundaries is looked up among the slices known to the worker; new ones are merged by rank (the lowest
rank first, the leftmost of equal ones), a slice that is itself in the vocabulary is that token. All tokens of a batch
then come out of one gather, and their byte offsets are kept beside them; decoding puts each token's bytes at its offset.

Nulls and empty texts have no tokens. Rows are independent: repeated rows, ties, null ids and extra columns change nothing.
Scans go over ``PIECE`` code points and merges over ``SLICES`` slices at a time, so a very long text needs memory in
proportion to itself only. The memory of known slices is dropped beyond ``CACHE`` bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import in_batches, lists_of, texts_of

PIECE = 1 << 20
SLICES = 200_000
CACHE = 64 << 20
WIDTH = 64
LETTER, NUMBER, SPACE, REST = range(4)
#: Symbols: letter, number, other; an apostrophe that may begin a contraction of two or three characters; white space
#: before white space or the end; a blank, or other white space, before anything else; between two texts.
L, N, O, TWO, THREE, V, P, W, RESET = range(9)
#: States: inside letters, numbers, others or white space; after a blank that the next pre-token takes in; one or two more
#: characters of a contraction; a new pre-token begins in any case.
IN_L, IN_N, IN_O, IN_V, BLANK, ONE_MORE, TWO_MORE, FRESH = range(8)

# fixed values: letters and numbers of Unicode 16 that an older character database does not have yet
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
               (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
               (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
               (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# fixed values: white space
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], REST) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for low, high in ranges:
            out[low:high + 1] = kind
    out[list(SPACES)] = SPACE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]: whether a pre-token begins with the symbol."""
    goes, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    fresh = {L: IN_L, N: IN_N, O: IN_O, TWO: ONE_MORE, THREE: TWO_MORE, V: IN_V, P: BLANK, W: FRESH, RESET: FRESH}
    for symbol, state in fresh.items():
        goes[:, symbol] = state
    for state, symbols, into in ((IN_L, (L,), IN_L), (IN_N, (N,), IN_N), (IN_O, (O, TWO, THREE), IN_O), (IN_V, (V,), IN_V),
                                 (BLANK, (L,), IN_L), (BLANK, (N,), IN_N), (BLANK, (O, TWO, THREE), IN_O),
                                 (TWO_MORE, (L,), ONE_MORE), (ONE_MORE, (L,), FRESH)):
        for symbol in symbols:
            goes[state, symbol], begins[state, symbol] = into, False
    return goes, begins


GOES, BEGINS = _automaton()


@functools.lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that symbols compose to: [function, state], products by 16 * first + second, and each symbol's number."""
    unit = tuple(range(8))
    known = {unit: 0}
    todo = [unit]
    symbols = [tuple(GOES[:, s].tolist()) for s in range(9)]
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    assert len(known) <= 16  # so that two numbers fit one byte
    product = np.zeros((16, 16), np.uint8)
    for f, i in known.items():
        for g, j in known.items():
            product[i, j] = known[tuple(g[x] for x in f)]
    return np.array(list(known), np.uint8), product.ravel(), np.array([known[s] for s in symbols], np.uint8)


#: GOES and BEGINS by 16 * state + symbol.
_GOES = np.pad(GOES, ((0, 0), (0, 7))).ravel()
_BEGINS = np.pad(BEGINS, ((0, 0), (0, 7))).ravel()


def _prefixes(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """For each function the product of all before it."""
    n = len(functions)
    if n <= 1:
        return np.zeros(n, np.uint8)
    width = min(WIDTH, n)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)  # number 0 changes nothing
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    inside = np.zeros((width, rows), np.uint8)
    total = columns[0]
    for k in range(1, width):
        inside[k] = total
        total = product.take((total << 4) | columns[k])
    before = _prefixes(total, product) if rows > 1 else np.zeros(1, np.uint8)
    return product.take((before << 4)[None, :] | inside).T.reshape(-1)[:n]


def scanned(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where pre-tokens begin, and the last state."""
    functions, product, of = _monoid()
    n = len(symbols)
    rows = -(-n // WIDTH)
    padded = np.full(rows * WIDTH, RESET, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, WIDTH).T)
    numbers = of.take(columns)
    total = numbers[0]
    for k in range(1, WIDTH):
        total = product.take((total << 4) | numbers[k])
    now = functions[_prefixes(total, product), state]
    begins = np.empty((WIDTH, rows), bool)
    last = (n - 1) % WIDTH
    end = state
    for k in range(WIDTH):
        now = (now << 4) | columns[k]
        begins[k] = _BEGINS.take(now)
        now = _GOES.take(now)
        if k == last:
            end = int(now[-1])
    return begins.T.reshape(-1)[:n], end


def symbols_of(points: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The symbols of code points, of which the last two are only looked at; ``between`` marks those that part two texts."""
    kind = code_point_classes()[points]
    n = len(points) - 2
    here, one, two = points[:n], points[1:n + 1], points[2:]
    inside = (kind[1:n + 1] != SPACE) & ~between[1:n + 1]
    out = np.array([L, N, V, O], np.uint8)[kind[:n]]
    space = kind[:n] == SPACE
    out[space & inside] = W
    out[(here == 32) & inside] = P
    quote = np.flatnonzero((here == 39) & inside)
    after, then = one[quote], np.where(between[quote + 2], 0, two[quote])
    out[quote[np.isin(after, [ord(c) for c in "stmd"])]] = TWO
    three = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        three |= (after == ord(a)) & (then == ord(b))
    out[quote[three]] = THREE
    out[between[:n]] = RESET
    return out


def boundaries(points: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The indices of code points with which a pre-token, or what parts two texts, begins."""
    points, between = np.r_[points, 0, 0], np.r_[between, True, True]
    out, state = [], FRESH
    for at in range(0, len(points) - 2, PIECE):
        begins, state = scanned(symbols_of(points[at:at + PIECE + 2], between[at:at + PIECE + 2]), state)
        out.append(np.flatnonzero(begins) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the first and last byte (exclusive) of every pre-token, and the text each is in."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    between = np.zeros(len(points), bool)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    between[ends[:-1]] = True
    begin = boundaries(points, between)
    size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte = np.cumsum(size, dtype=np.int64) - size
    data = joined.encode("utf-8")
    first = byte[begin]
    stop = np.r_[first[1:], len(data)]
    real = ~between[begin]
    return data, first[real], stop[real], np.searchsorted(ends, begin[real], side="right")


class Vocabulary:
    """Ranks of byte strings, the bytes of each rank, and what is known of slices so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        top = max(self.ranks.values(), default=-1) + 1
        self.size = np.zeros(top, np.int64)
        for token, rank in self.ranks.items():
            self.size[rank] = len(token)
        self.at = np.cumsum(self.size) - self.size
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.flat = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.count, self.tokens, self.held = array("q"), array("q"), array("i"), 0

    def merged(self, word: bytes) -> list[int]:
        """The tokens of one slice."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ranks, n = self.ranks, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at i
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = stop[i]
            if middle < 0 or middle >= n or stop[middle] != end:  # one of the two is not there any more
                continue
            stop[i], stop[middle] = end, -1
            if end < n:
                before[end] = i
                if (rank := ranks.get(word[i:stop[end]])) is not None:
                    heapq.heappush(heap, (rank, i, stop[end]))
            if before[i] >= 0 and (rank := ranks.get(word[before[i]:end])) is not None:
                heapq.heappush(heap, (rank, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:stop[i]]])
            i = stop[i]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all slices, one after another, and how many each has."""
        if self.held > CACHE:
            self.forget()
        for word in set(words).difference(self.known):
            tokens = self.merged(word)
            self.known[word] = len(self.first)
            self.first.append(len(self.tokens))
            self.count.append(len(tokens))
            self.tokens.extend(tokens)
            self.held += len(word) + 100
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        count = np.frombuffer(self.count, np.int64)[which]
        return _gathered(np.frombuffer(self.tokens, np.int32), np.frombuffer(self.first, np.int64)[which], count), count


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first[i]:first[i] + count[i]] for all i, one after another."""
    index = np.repeat(first - (np.cumsum(count) - count), count)
    index += np.arange(len(index))
    return values[index]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, one after another, and how many each has."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    data, first, stop, owner = slices(texts)
    tokens, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    for at in range(0, len(first), SLICES):
        some = [data[a:b] for a, b in zip(first[at:at + SLICES].tolist(), stop[at:at + SLICES].tolist())]
        ids, count = words.encode(some)
        tokens.append(ids)
        counts += np.bincount(owner[at:at + SLICES], weights=count, minlength=len(texts)).astype(np.int64)
    return np.concatenate(tokens), counts


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ends): the tokens of every row's whole text, and the byte at which each ends."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(path)
        ids, counts = encode_texts(texts_of(batch.column("text")), words)
        ends = np.cumsum(words.size[ids])
        upto = np.cumsum(counts)
        base = np.r_[0, ends][upto - counts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), lists_of(ids, counts, pa.int32()),
             lists_of((ends - np.repeat(base, counts)).astype(np.int32), counts, pa.int32())], ["doc_id", "ids", "ends"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, encode, "doc_id long, ids array<int>, ends array<int>")


def decode_tokens(ids: np.ndarray, ends: np.ndarray, counts: np.ndarray, words: Vocabulary) -> Iterator[bytes]:
    """The bytes of each run of tokens, put where their offsets say."""
    upto = np.cumsum(counts)
    for begin, end in zip((upto - counts).tolist(), upto.tolist()):
        out = bytearray(int(ends[end - 1]) if end > begin else 0)
        view = np.frombuffer(out, np.uint8)
        for at in range(begin, end, SLICES):
            some, stop = ids[at:min(at + SLICES, end)], ends[at:min(at + SLICES, end)]
            size = words.size[some]
            low = int(stop[0] - size[0])
            place = np.repeat(stop - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            view[place] = _gathered(words.flat, words.at[some], size)
            assert low + int(size.sum()) == int(stop[-1])  # the offsets belong to these tokens
        yield bytes(out)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows (ids, ends and any others) with ``decoded``, the bytes of their tokens."""
    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = batch.column("ids"), batch.column("ends")
        counts = np.diff(ids.offsets.to_numpy())
        flat = ids.flatten().to_numpy(), ends.flatten().to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_tokens(*flat, counts, vocabulary(path)), pa.binary())],
                                          [*batch.schema.names, "decoded"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return in_batches(rows, decode, fields + ", decoded binary")
