"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts have more often than chance
allows. The test is binomial, and its level is divided by the number of words (or beginnings) that were tried, so the
lexicon grows with the vocabulary and the labels and nothing is cut from it; ``MOST`` entries are an error, not a limit.
Short terms match exactly; the trie of all is run together with a Levenshtein automaton of one edit for longer ones; the
product is made deterministic once, as one table (state, letter class) -> state, and all words of an Arrow batch walk
through that table at once, letter by letter. Nothing is looked up per word, so misspelled terms cost as much as any.

Each hit is weighed by its term's log odds and by its context, a window of words around it: quotation marks and words
of reporting ("said", "quoted") speak for quotation, words of address ("you") for abuse. To the few words of these kinds
given here come those that the labelled texts teach: words in the windows of hits that hits of clean texts, or of toxic
ones, have more often than chance allows. A logistic model over the sums of hits by kind, and over the strongest, gives
the score.

Nulls and empty texts have no hits and get the score of that; an empty table gives no rows. Equal texts get equal scores,
so ties and repeated rows do; null ids are rows like others. Extra columns are ignored. Very long texts are walked some
millions of characters at a time, but for one that is longer by itself. The lexicon and the model use at most ``fit_rows``
labelled rows. Without any labelled row every score is one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.common import in_batches, kept_lineage_cut, texts_of
from ordermill.llm.gam import fold_of, labelled_sample

FIT_ROWS = 30_000
#: Level of the test of a whole vocabulary, and the least odds and number of toxic texts that an entry has.
LEVEL, ODDS, LEAST = 0.01, 2.0, 3
MOST = 200_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
LONGEST = 64
FUZZY_FROM = 5  # shorter words have too many neighbours
WINDOW = 8
# Words that report speech, words of address (to which learned ones come), quotation marks.
REPORTING = ("said", "says", "quote", "quoted", "quotes", "called", "wrote", "word", "term", "reported", "citation")
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "dein", "tu", "toi", "vous", "te", "usted")
QUOTES = "\"“”„«»‹›"
WEIGHTS = {"exact": 1.0, "fuzzy": 0.8, "stem": 0.9}


def chance(with_it: np.ndarray, texts: np.ndarray, share: float) -> np.ndarray:
    """The probability that so many or more of ``texts`` are toxic, if each is with probability ``share`` (log)."""
    out = np.zeros(len(texts))
    for n in np.unique(texts).tolist():
        k = np.arange(n + 1)
        logs = np.cumsum(np.r_[0.0, np.log(np.arange(1, n + 1))])
        p = logs[n] - logs[k] - logs[n - k] + k * np.log(share) + (n - k) * np.log1p(-share)
        top = np.maximum.accumulate(p[::-1])[::-1]  # sums from the end, in logs
        upper = np.log(np.cumsum(np.exp(p - p.max())[::-1])[::-1].clip(1e-300)) + p.max()
        own = np.flatnonzero(texts == n)
        out[own] = np.maximum(upper, top)[with_it[own].astype(np.int64)]
    return out


def significant(counts: DataFrame, toxic: int, clean: int, tried: int) -> dict[str, float]:
    """(term, t, c) rows as term -> log odds, of those that pass the test among ``tried`` ones."""
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    rows = counts.withColumn("odds", odds).filter((F.col("t") >= LEAST) & (F.col("odds") >= ODDS)).limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} terms")
    if not len(rows):
        return {}
    t, n = rows["t"].to_numpy(np.int64), (rows["t"] + rows["c"]).to_numpy(np.int64)
    keep = chance(t, n, toxic / (toxic + clean)) + np.log(max(1, tried)) < np.log(LEVEL)
    return dict(sorted(zip(rows["term"][keep], rows["odds"][keep].astype(float))))


def learned_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with their log odds, from rows (text, mark)."""
    totals = sample.groupBy("mark").count().collect()
    toxic, clean = (sum(r["count"] for r in totals if r["mark"] == m) for m in (1, 0))
    if not toxic or not clean:
        return {}, {}
    words = sample.select("mark", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")) \
                  .filter(F.char_length("term").between(2, LONGEST))

    def counted(rows: DataFrame) -> tuple[DataFrame, int]:
        counts = rows.groupBy("term").agg(F.sum("mark").alias("t"), F.sum(1 - F.col("mark")).alias("c"))
        return kept_lineage_cut(counts.filter("t > 0")), counts.count()
    texts = sample.select("mark", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w"))
    beginnings = F.array_distinct(F.flatten(F.transform("w", lambda w: F.filter(
        F.array(*[F.when(F.char_length(w) > n, F.substring(w, 1, n)) for n in STEM_LENGTHS]), lambda x: x.isNotNull()))))
    stems = texts.select("mark", F.explode(beginnings).alias("term"))
    return significant(*_args(counted(words), toxic, clean)), significant(*_args(counted(stems), toxic, clean))


def _args(counted: tuple[DataFrame, int], toxic: int, clean: int) -> tuple[DataFrame, int, int, int]:
    return counted[0], toxic, clean, counted[1]


def learned_cues(sample: DataFrame, automaton: Automaton) -> dict[str, int]:
    """Words near hits that tell quotation (1) from abuse (2), from rows (text, mark)."""
    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(words) for words in nearby(texts_of(batch.column("text")), automaton)]
        return pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(found, pa.list_(pa.string()))], ["mark", "near"])
    rows = kept_lineage_cut(in_batches(sample.select("text", "mark"), near, "mark int, near array<string>").filter(F.size("near") > 0))
    totals = {r["mark"]: r["count"] for r in rows.groupBy("mark").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return {}
    words = rows.select("mark", F.explode("near").alias("term"))
    out: dict[str, int] = {}
    for kind, mark in ((2, F.col("mark")), (1, 1 - F.col("mark"))):
        counts = words.groupBy("term").agg(F.sum(mark).alias("t"), F.sum(1 - mark).alias("c"))
        tried = counts.count()
        out |= {w: kind for w in significant(counts.filter("t > 0"), totals[kind - 1], totals[2 - kind], tried)}
    return out


class Automaton:
    """The trie of all terms times a Levenshtein automaton of one edit, as one deterministic table."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], learned: dict[str, int] | None = None):
        cues = (learned or {}) | {w: 1 for w in REPORTING} | {w: 2 for w in ADDRESS}
        letters = sorted({c for w in [*terms, *stems, *cues] for c in w})
        self.classes = {c: n + 1 for n, c in enumerate(letters)}  # 0: any other letter
        self.low = np.zeros(0x250, np.int64)
        for c, n in self.classes.items():
            if ord(c) < 0x250:
                self.low[ord(c)] = n
        self.longest = max(map(len, [*terms, *stems, *cues]), default=0) + 1
        # trie: children, and at the end of a term (weight, edits), stem weight or cue
        child: list[dict[int, int]] = [{}]
        term_at: dict[int, tuple[float, int]] = {}
        stem_at: dict[int, float] = {}
        cue_at: dict[int, int] = {}

        def put(word):
            node = 0
            for c in word:
                node = child[node].setdefault(self.classes[c], len(child))
                if node == len(child):
                    child.append({})
            return node
        for w, odds in terms.items():
            term_at[put(w)] = (odds, 1 if len(w) >= FUZZY_FROM else 0)
        for w, odds in stems.items():
            stem_at[put(w)] = odds
        for w, cue in cues.items():
            cue_at[put(w)] = cue
        reach = [0] * len(child)  # edits that some term below a node allows
        for node in range(len(child) - 1, -1, -1):
            reach[node] = max([term_at.get(node, (0, 0))[1], *[reach[n] for n in child[node].values()]])

        def closed(states: dict[int, int]) -> frozenset:
            todo = list(states.items())
            while todo:
                node, edits = todo.pop()
                for n in child[node].values():  # a letter of the term is missing
                    if edits + 1 <= reach[n] and states.get(n, 9) > edits + 1:
                        states[n] = edits + 1
                        todo.append((n, edits + 1))
            return frozenset(states.items())
        start = closed({0: 0})
        number, order, rows = {start: 1}, [start], []  # 0: dead
        for state in order:
            row = np.zeros(len(letters) + 1, np.int32)
            for c in range(len(letters) + 1):
                after: dict[int, int] = {}
                for node, edits in state:
                    if c in child[node]:
                        n = child[node][c]
                        after[n] = min(after.get(n, 9), edits)
                    if edits + 1 <= reach[node]:  # a letter too many
                        after[node] = min(after.get(node, 9), edits + 1)
                    for n in child[node].values():  # another letter
                        if edits + 1 <= reach[n]:
                            after[n] = min(after.get(n, 9), edits + 1)
                if after:
                    key = closed(after)
                    if key not in number:
                        number[key] = len(order) + 1
                        order.append(key)
                    row[c] = number[key]
            rows.append(row)
        self.table = np.vstack([np.zeros((1, len(letters) + 1), np.int32), *rows])
        n = len(self.table)
        self.exact, self.fuzzy, self.stem, self.cue = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for i, state in enumerate(order, 1):
            for node, edits in state:
                if node in term_at and edits <= term_at[node][1]:
                    kind = self.fuzzy if edits else self.exact
                    kind[i] = max(kind[i], term_at[node][0])
                if not edits:
                    self.stem[i] = max(self.stem[i], stem_at.get(node, 0.0))
                    self.cue[i] = max(self.cue[i], cue_at.get(node, 0))
        self.fuzzy[self.exact > 0] = 0

    def letters(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        low = points < 0x250
        out[low] = self.low[points[low]]
        for c, n in self.classes.items():
            if ord(c) >= 0x250:
                out[points == ord(c)] = n
        return out

    def walk(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state at the end of every word (0: none), and the stem weight met on the way."""
        final, stems = np.zeros(len(start), np.int64), np.zeros(len(start))
        active = np.arange(len(start))
        state = np.ones(len(start), np.int64)
        for i in range(self.longest + 1):
            ended = length[active] == i
            final[active[ended]] = state[ended]
            active, state = active[~ended], state[~ended]
            if not len(active):
                break
            state = self.table[state, letters[start[active] + i]]
            met = self.stem[state]
            hit = met > 0
            stems[active[hit]] = np.maximum(stems[active[hit]], met[hit])
            alive = state > 0
            active, state = active[alive], state[alive]
        return final, stems


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points below 0x10000 are letters or digits, and which are quotation marks."""
    word = np.array([chr(c).isalnum() for c in range(0x10000)])
    quote = np.zeros(0x10000, bool)
    quote[[ord(c) for c in QUOTES]] = True
    return word, quote


_WORD, _QUOTE = _tables()
FEATURES = ("weight", "hits", "strongest", "density", "quoted", "addressed", "any", "strong")
#: Log odds beyond which a term by itself is nearly sure.
SURE = 3.0


def features_of(texts: list[str], automaton: Automaton) -> np.ndarray:
    """One row of FEATURES for every text."""
    out = np.zeros((len(texts), len(FEATURES)))
    begin = 0
    while begin < len(texts):  # about four million characters at once
        upto, size = begin, 0
        while upto < len(texts) and (upto == begin or size + len(texts[upto]) < 4_000_000):
            size += len(texts[upto])
            upto += 1
        out[begin:upto] = _features([t.lower() for t in texts[begin:upto]], automaton)
        begin = upto
    return out


def _words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, its code points, their low halves, and first, end and text of every word."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = np.minimum(points, 0xFFFF)
    word = _WORD[low] | (points > 0xFFFF)
    # one sign between two letters belongs to the word, as in a term with a masked letter
    inner = ~word[1:-1] & word[:-2] & word[2:] & (points[1:-1] > 32) & ~_QUOTE[low[1:-1]] & (points[1:-1] != 39) \
        & (points[1:-1] != 45) & (points[1:-1] != 44) & (points[1:-1] != 46)
    word = word.copy()
    word[1:-1] |= inner
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return joined, points, low, start, stop, np.searchsorted(ends, start, side="right")


def _hits(points: np.ndarray, start: np.ndarray, stop: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The last state and the weight of every word."""
    final, stems = automaton.walk(automaton.letters(points), start, stop - start)
    weight = np.maximum(WEIGHTS["exact"] * automaton.exact[final], WEIGHTS["fuzzy"] * automaton.fuzzy[final])
    return final, np.maximum(weight, WEIGHTS["stem"] * stems)


def nearby(texts: list[str], automaton: Automaton) -> list[set[str]]:
    """The words within WINDOW of each text's hits, without the hits."""
    out = []
    for text in texts:
        joined, points, _, start, stop, _ = _words([text.lower()])
        _, weight = _hits(points, start, stop, automaton)
        hit = np.flatnonzero(weight > 0)
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, np.maximum(hit - WINDOW, 0), 1)
        np.add.at(change, np.minimum(hit + WINDOW + 1, len(start)), -1)
        near = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (weight == 0) & (stop - start <= LONGEST))
        out.append({joined[a:b] for a, b in zip(start[near].tolist(), stop[near].tolist())})
    return out


def _features(texts: list[str], automaton: Automaton) -> np.ndarray:
    _, points, low, start, stop, doc = _words(texts)
    final, weight = _hits(points, start, stop, automaton)
    hit = np.flatnonzero(weight > 0)
    # context: marks and cues within WINDOW words to either side, inside the same text
    first = np.searchsorted(doc, np.arange(len(texts)))
    last = np.searchsorted(doc, np.arange(len(texts)), side="right")
    left, right = np.maximum(hit - WINDOW, first[doc[hit]]), np.minimum(hit + WINDOW + 1, last[doc[hit]])
    marks = np.r_[0, np.cumsum(_QUOTE[low])]
    before = marks[start[hit]] - marks[start[left]] if len(hit) else np.zeros(0)
    after = marks[stop[right - 1]] - marks[stop[hit]] if len(hit) else np.zeros(0)
    cue = automaton.cue[final]
    said, you = np.r_[0, np.cumsum(cue == 1)], np.r_[0, np.cumsum(cue == 2)]
    quoted = ((before > 0) & (after > 0)) | (said[right] - said[left] > 0) if len(hit) else np.zeros(0, bool)
    addressed = you[right] - you[left] > 0 if len(hit) else np.zeros(0, bool)
    n, d = len(texts), doc[hit]
    strength = weight[hit]
    total = np.bincount(d, strength * np.where(quoted, 0.3, 1.0) * np.where(addressed, 1.2, 1.0), n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, d, strength)
    hits = np.bincount(d, minlength=n)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    each = np.maximum(hits, 1)
    return np.stack([np.log1p(total), np.log1p(hits), strongest, np.log1p(1000 * total / words) / 4,
                     np.bincount(d, quoted, n) / each, np.bincount(d, addressed, n) / each,
                     hits > 0, np.maximum(strongest - SURE, 0)], axis=1)


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1):
        self.mean, self.scale = x.mean(axis=0) if len(x) else 0.0, (x.std(axis=0) if len(x) else 1.0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.beta = np.zeros(z.shape[1])
        penalty = np.diag([1e-6, *[ridge] * (z.shape[1] - 1)])
        for _ in range(30 if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (y - p) - penalty @ self.beta
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, slope)
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.beta, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Automaton, Logistic]:
    sample = kept_lineage_cut(labelled_sample(docs, labels, "toxic", 3, 1, fit_rows))
    lexicon = learned_lexicon(sample)
    automaton = Automaton(*lexicon)
    cues = learned_cues(sample, automaton)
    if cues:
        automaton = Automaton(*lexicon, cues)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of(texts_of(batch.column("text")), automaton)
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column("mark")], [*FEATURES, "mark"])
    rows = in_batches(sample, features, ", ".join(f"{n} double" for n in FEATURES) + ", mark int").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy(np.float64).reshape(-1, len(FEATURES) + 1)
    return automaton, Logistic(rows[:, :-1], rows[:, -1])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    automaton, model = fitted(docs, labels)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of(texts_of(batch.column("text")), automaton)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x))],
                                          ["doc_id", "held_out", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return in_batches(rows, score, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
