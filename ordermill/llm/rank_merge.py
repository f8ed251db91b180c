"""Token counts by rank-synchronous merging.

The distinct pre-tokens of an Arrow batch lie in one ragged numpy array of symbols. In every round each pre-token
finds its own lowest-ranked neighbouring pair, and all pre-tokens apply theirs at once; those without a pair are done.
The number of symbols left is the number of tokens. Counts of pre-tokens are kept from batch to batch within a Python
worker, up to ``CACHE`` entries, then dropped.

Special strings of the vocabulary inside a text count as one token each, as the library's default has it.
Nulls and empty texts have no tokens; rows are independent, so ties, repeats and extra columns do not matter.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import in_batches, texts_of

CACHE = 1_000_000
#: Longest pre-tokens go through in slices of so many symbols at once.
SLICE = 2_000_000


class RankTable:
    """Pair -> rank and pair -> merged symbol, as two hashed arrays; built from a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        shown = _shown_bytes()
        self.first = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        codes = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in merges], np.uint64)
        into = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.bits = max(16, int(len(codes)).bit_length() + 3)
        self.levels = []
        left = np.arange(len(codes))
        multiplier = 0x9E3779B97F4A7C15
        while len(left):  # what collides in one table goes to the next
            multiplier = (multiplier * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1
            key, rank = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            slot = self._slot(codes[left], np.uint64(multiplier))
            _, keep = np.unique(slot, return_index=True)
            key[slot[keep]], rank[slot[keep]] = codes[left[keep]], left[keep] + 1
            self.levels.append((np.uint64(multiplier), key, rank))
            left = np.delete(left, keep)
        self.into = into
        self.none = len(codes)

    def _slot(self, codes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * multiplier) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; ``none`` for pairs that never merge."""
        codes = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(len(codes), self.none, np.int64)
        todo = np.arange(len(codes))
        for multiplier, key, rank in self.levels:
            slot = self._slot(codes[todo], multiplier)
            hit = (key[slot] == codes[todo]) & (rank[slot] > 0)
            out[todo[hit]] = rank[slot[hit]] - 1
            todo = todo[~hit]
        return out


def _shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[b] = chr(256 + n)
    return out


def count_symbols(pieces: list[bytes], ranks: RankTable) -> np.ndarray:
    """The number of tokens of every byte string."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.zeros(len(pieces), np.int64)
    done = 0
    while done < len(pieces):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(lengths[done:]), SLICE)) + done)
        out[done:upto] = _merged(pieces[done:upto], lengths[done:upto], ranks)
        done = upto
    return out


def _merged(pieces: list[bytes], lengths: np.ndarray, ranks: RankTable) -> np.ndarray:
    out = lengths.copy()
    symbols = ranks.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    pair = np.full(len(symbols), ranks.none, np.int64)  # rank of (i, i + 1)
    stale = np.arange(len(symbols))
    while len(symbols) > 1:
        stale = stale[stale < len(symbols) - 1]
        pair[-1] = ranks.none
        inside = owner[stale] == owner[stale + 1]
        pair[stale] = ranks.none
        stale = stale[inside]
        pair[stale] = ranks.ranks(symbols[stale], symbols[stale + 1])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        low = np.minimum.reduceat(pair, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        going = low < ranks.none
        if not going.all():  # sequences without a pair are done
            finished = owner[starts[~going]]
            out[finished] = sizes[~going]
            keep = np.repeat(going, sizes)
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            low, sizes = low[going], sizes[going]
            if not len(symbols):
                break
        chosen = pair == np.repeat(low, sizes)
        at = np.flatnonzero(chosen)
        # of a row of overlapping pairs (aaa), every other one merges, from the left
        run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
        first = at[np.r_[True, np.diff(at) != 1]]
        at = at[(at - first[run]) % 2 == 0]
        symbols[at] = ranks.into[pair[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
        new = moved[at]
        stale = np.unique(np.r_[new[new > 0] - 1, new])
        if not len(symbols):
            break
    if len(symbols) == 1:
        out[owner[0]] = 1
    return out


@functools.lru_cache(maxsize=4)
def _table(path: str) -> RankTable:
    return RankTable(path)


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = _table(path)
        self.find = regex.compile(pattern).findall
        special = "|".join(regex.escape(s) for s in sorted(self.ranks.special, key=len, reverse=True))
        self.special = regex.compile(special) if special else None
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        found, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            found.append([w for p in parts for w in self.find(p)] if len(parts) > 1 else self.find(text))
        out = []
        for begin in range(0, len(texts), 512):
            some = found[begin:begin + 512]
            if len(self.known) > CACHE:
                self.known = {}
            known = self.known
            new = list(set().union(*some).difference(known))
            known.update(zip(new, count_symbols([w.encode("utf-8") for w in new], self.ranks).tolist()))
            out += [sum(map(known.__getitem__, words)) for words in some]
        return [a + b for a, b in zip(out, extra)]


@functools.lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row's whole text."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = _counter(path, pattern).counts(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                          ["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return in_batches(rows, count, "doc_id long, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
