"""Each operator against a plain version of its rule, with nulls, empty texts, ties, repeated rows and extra columns."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from ordermill.llm import (
    gam, lev_trie, mixing, order_minhash, packing, queries, rank_merge, rules_forest, scaled_sketch, suffix_levels,
    text_stats, warc)
from ordermill.llm.common import Substrings, lower_part, utf8, window_hashes, word_hashes

ODD = [None, "", " ", "\n\n", "a", "word", "a a a a a", "naïve café 한국어 🤖", "x" * 5000, "ab " * 4000, "<|endoftext|> a<|endoftext|>",
       "it's we'll\u00a0DON'T 12345", "\x1c\x1d split \x85 here", "İstanbul ΣΑΣ"]
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + [prose(rng, rng.randrange(1, 300)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Texts with a few repeated ones, in several partitions, and columns whose names operators use themselves."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", len(t or ""), "x") for i, t in enumerate([*texts, *texts[5:9]])]
    return spark.createDataFrame(rows, EMPTY + ", rid string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


def table(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# ---- helpers --------------------------------------------------------------------------------

def test_substring_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    other = np.concatenate([rng.integers(97, 100, 777).astype(np.uint8), data])
    assert (Substrings(data).all_of(40) == Substrings(other).all_of(40)[777:]).all()
    assert (window_hashes(data, 40) == Substrings(data).all_of(40)).all()
    start = np.arange(0, 2900, 50)
    assert (word_hashes(data, start, start + 20) == word_hashes(other, start + 777, start + 797)).all()
    at = Substrings(data).all_of(12)
    whole = [data[i:i + 12].tobytes() for i in range(len(at))]
    assert len(set(at.tolist())) == len(set(whole))


# ---- mixing ---------------------------------------------------------------------------------

def test_shortages_go_to_siblings_before_ancestors():
    capacity = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 50, ("b", "y"): 20}
    got = mixing.budgets(capacity, {("a",): 1.0, ("b",): 1.0}, 200)
    assert got == {("a", "x"): 10, ("a", "y"): 120, ("b", "x"): 50, ("b", "y"): 20}
    assert sum(mixing.budgets(capacity, {}, 10 ** 6).values()) == 1080
    assert mixing.budgets(capacity, {("a", "y"): 0.0}, 200)[("a", "y")] == 0
    assert mixing.budgets({}, {}, 5) == {}


def test_mix_takes_whole_epochs_and_an_exact_prefix(spark, docs, nothing):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mixed_rows(docs, levels, {("en",): 5.0}, 0.9, 3, 7)
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = out.collect()
    have = Counter()
    for r in docs.collect():
        have[(r.lang or "", r.source)] += len((r.text or "").encode().split())
    want = mixing.budgets({p: 3 * n for p, n in have.items()}, {("en",): 5.0}, int(sum(have.values()) * 0.9))
    taken = Counter()
    for r in rows:
        taken[tuple(r.mix_path)] += r.mix_tokens_taken
        assert 0 <= r.mix_tokens_taken <= r.mix_tokens
    assert {p: n for p, n in taken.items() if n} == {p: n for p, n in want.items() if n}
    assert max(Counter((r.doc_id, r.mix_epoch) for r in rows).values()) == 1
    packed = mixing.mixed(docs, levels, {("en",): 5.0}, 0.9, 3, 7)
    cut = Counter((r.doc_id, r.rid, r.text) for r in mixing.cut_texts(packed).collect())
    whole = docs.select("doc_id", "text").collect()
    for r in rows:
        text = next(w.text for w in whole if w.doc_id == r.doc_id)
        if r.mix_tokens_taken < r.mix_tokens:  # the first words, and what is between them, as they are
            text = re.match(r"(?:[ \t-\r]*[^ \t-\r]+){%d}" % r.mix_tokens_taken, text).group() if r.mix_tokens_taken else ""
        cut[(r.doc_id, r.rid, text)] -= 1
    assert not any(cut.values())
    assert mixing.mixed_rows(nothing, levels, {}, 0.5, 2, 7).count() == 0


def plain_hash(*values):
    """The engine's 64-bit hash of numbers and strings, as an unsigned number, by the published algorithm."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v & (2 ** 64 - 1)).to_bytes(8, "little") if not isinstance(v, Int) else \
                (v.v & (2 ** 32 - 1)).to_bytes(4, "little")
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


class Int:
    def __init__(self, v):
        self.v = v


def test_epoch_prefix_takes_the_rows_that_its_order_says(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 30)), ("a", "b", "c")[min(2, rng.randrange(6))], "x", "y", "z") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_path string, mix_tokens string, row string").repartition(3)
    out = mixing.mixed_rows(df, {"source": F.col("source")}, {("a",): 2.0}, 0.7, 2, 9)
    assert out.columns == [*df.columns, "mix_path_", "mix_epoch", "mix_tokens_", "mix_tokens_taken"]
    have = Counter()
    for r in rows:
        have[r[2]] += len(r[1].split())
    want = mixing.budgets({(s,): 2 * n for s, n in have.items()}, {("a",): 2.0}, int(sum(have.values()) * 0.7))
    expected = []
    for (source,), budget in want.items():
        own = [r for r in rows if r[2] == source]
        whole, rest = divmod(budget, have[source])
        expected += [(r[0], e, len(r[1].split())) for e in range(whole) for r in own]
        for r in sorted(own, key=lambda r: (plain_hash(Int(9), Int(whole), r[0], r[1]), r[0])):
            if rest <= 0:
                break
            expected.append((r[0], whole, min(rest, len(r[1].split()))))
            rest -= len(r[1].split())
    got = [(r.doc_id, r.mix_epoch, r.mix_tokens_taken) for r in out.collect()]
    full = lambda rows: sorted(x for x in rows if x[2])  # noqa: E731  empty texts take nothing
    assert full(got) == full(expected)
    assert {r.mix_tokens for r in out.collect()} == {"y"} and {r.row for r in out.collect()} == {"z"}


def test_ranges_grow_with_the_largest_leaf():
    assert mixing.ranges_for(0) == mixing.RANGES
    assert mixing.ranges_for(10 ** 9) >= 10 ** 9 // (2 * mixing.RANGE_ROWS)
    assert mixing.ranges_for(10 ** 15) == mixing.MOST_RANGES


# ---- quality rules and classifiers -----------------------------------------------------------

def test_rule_statistics(texts):
    for t in texts:
        t = t or ""
        words = t.encode().split()
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        got = dict(zip(text_stats.NAMES, text_stats.stats_of(t)))
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(len(w.decode()) for w in words)
        assert got["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert got["n_repeat_words"] == len(covered)
        assert got["n_dup_lines"] == len(lines) - len(set(lines))


def test_forest_isolates_outliers_and_handles_constants():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 0.1, (500, 3)), [[5, 5, 5]]])
    scores = rules_forest.Forest(rows, trees=50).scores(rows)
    assert scores.argmax() == 500 and scores[500] > 0.6
    assert len(set(rules_forest.Forest(np.zeros((9, 2)), trees=5).scores(np.zeros((4, 2))))) == 1
    assert (rules_forest.Forest(np.zeros((0, 2))).scores(np.zeros((3, 2))) == 0).all()


def test_forest_path_lengths_by_hand():
    forest = rules_forest.Forest(np.array([[0.0], [1.0]]), trees=3, tree_rows=2)
    assert np.allclose(forest.scores(np.array([[0.0], [1.0]])), 0.5)  # one split sets both apart: path 1, expected 1


def test_threshold_keeps_good_rows():
    counts = [(b, 1, 10) for b in range(3000, 4000)] + [(b, 0, 1) for b in range(3900, 4500)]
    t = rules_forest.threshold_of(counts, 0.01)
    assert 0.3988 <= t <= 0.3991
    assert rules_forest.threshold_of([(5, 1, 3)]) == rules_forest.DEFAULT_THRESHOLD


def plain_path(tree, row):
    """The path length of a row in one tree, node by node."""
    column, cut, child, path = tree
    node = 0
    while child[node]:
        node = child[node] + int(row[column[node]] >= cut[node])
    return path[node]


def test_verdicts_equal_a_walk_of_the_trees(spark):
    rng = random.Random(14)
    rows = []
    for i in range(300):
        t = prose(rng, rng.randrange(40, 120)) + "."
        if i % 9 == 0:
            t = " ".join(w + "$$$" for w in t.split())
        if i % 50 == 7:
            t = " ".join("%x" % rng.getrandbits(400) for _ in range(60))  # long words of digits: odd in other shares only
        rows.append((i, t))
    labels = [(i, int(i % 9 != 0), 0) for i in range(300) if i % 3 == 0 and i % 50 != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in rules_forest.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    # the sample is all rows here, in the order of a hash that the forests do not depend on but for their draws
    stats = {i: text_stats.stats_of(t) for i, t in rows}
    order = {i: plain_hash(Int(11), i, *stats[i]) for i in stats}
    signed = lambda h: h - 2 ** 64 if h >= 2 ** 63 else h
    sample = np.array([stats[i] for i in sorted(stats, key=lambda i: signed(order[i]))], np.int64)
    forests = (rules_forest.Forest(rules_forest.split_shares(sample), seed=11),
               rules_forest.Forest(text_stats.shares(sample), tree_rows=rules_forest.ALL_TREE_ROWS, seed=12))
    scores = {}
    for i, s in stats.items():
        both = (rules_forest.split_shares(np.array([s]))[0], text_stats.shares(np.array([s]))[0])
        scores[i] = [2 ** (-np.mean([plain_path(t, x) for t in f.trees]) / f.norm) for f, x in zip(forests, both)]
        assert np.allclose([got[i].anomaly, got[i].anomaly_all], scores[i], atol=1e-9)
    passing = {i for i in stats if stats[i][0] >= 50 and 100 * stats[i][4] <= 50 * stats[i][0]}
    good = [scores[i] for i, q, _ in labels if q and i in passing]
    kept = {i for i, r in got.items() if r.kept}
    assert kept <= passing and {i for i, q, _ in labels if q and i in passing} <= kept
    assert not kept & {i for i in passing if i % 9 == 0}  # the bad kind falls, labelled or not
    assert not kept & {i for i in passing if scores[i][1] > max(b for _, b in good) + 1e-4}
    assert not kept & {i for i in passing if i % 50 == 7 and i % 9}


def test_judged_rows(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (20, None, 1), (30, 1, 0)], "doc_id long, quality int, toxic int")
    rows = rules_forest.judged(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert rules_forest.judged(nothing, labels.limit(0)).count() == 0


def test_additive_scores_and_steps_equal_plain_ones():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(600, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (rng.random(600) < 0.05)).astype(float)
    model = gam.AdditiveModel(x, y, rounds=20, pair_rounds=5)
    for row, got in zip(x[:80], model.scores(x[:80])):  # one addition per bin
        total = model.base + sum(t[bisect.bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, row))
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[bisect.bisect_right(model.coarse[a].tolist(), row[a]), bisect.bisect_right(model.coarse[b].tolist(), row[b])]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    slope, weight = rng.normal(size=12), rng.random(12) + 0.1
    value = lambda s, w: s / (w + 1)
    gain = lambda part: slope[part].sum() * value(slope[part].sum(), weight[part].sum())
    cut = max(range(1, 12), key=lambda k: gain(slice(0, k)) + gain(slice(k, 12)))
    want = [value(slope[p].sum(), weight[p].sum()) for p in (slice(0, cut), slice(cut, 12))]
    assert np.allclose(gam._tree(slope, weight, 1), np.repeat(want, [cut, 12 - cut]))
    s, w = rng.normal(size=(gam.GRID, gam.GRID)), rng.random((gam.GRID, gam.GRID)) + 0.1

    def quarters(i, j):
        return [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, None)) for c, d in ((0, j), (j, None))]
    best = max(((i, j) for i in range(1, gam.GRID) for j in range(1, gam.GRID)),
               key=lambda ij: sum(s[q].sum() * value(s[q].sum(), w[q].sum()) for q in quarters(*ij)))
    step, explained = gam._quadrants(s, w)
    for q in quarters(*best):
        assert np.allclose(step[q], value(s[q].sum(), w[q].sum()))
    assert math.isclose(explained, sum(s[q].sum() * value(s[q].sum(), w[q].sum()) for q in quarters(*best)), rel_tol=1e-9)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells
    model = gam.AdditiveModel(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert model.pairs[0] == (0, 1)
    assert np.allclose(gam.AdditiveModel(x[:0], y[:0]).scores(x[:2]), 0.5)


def _quality_set(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = prose(rng, rng.randrange(60, 150))
        toxic = rng.random() < 0.3
        if toxic:
            w = t.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumbold", "snivelard", "blatherskite"])
            t = " ".join(w)
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", "s", len(t)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, EMPTY), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, docs, nothing):
    some, labels = _quality_set(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for scored, mark, folds, held in ((gam.scored, "quality", 5, 0), (lev_trie.scored, "toxic", 3, 1)):
        rows = scored(some, labels).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
        test = [r for r in rows if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id][mark] for r in test]) > 0.95
        everything = scored(docs, labels).collect()  # nulls and empty texts have a score, too
        assert len(everything) == docs.count() and all(0 <= r.score <= 1 for r in everything)
        assert scored(nothing, labels.limit(0)).count() == 0
    kept = gam.accepted(some, labels)
    assert kept.columns == some.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in gam.scored(some, labels).collect() if r.predicted}


def test_a_draw_filters_by_the_hash_first_and_stays_the_same(spark):
    ids = spark.range(20_000)
    rows = ids.orderBy(F.xxhash64("id")).limit(500).collect()
    lower = ids.filter(F.xxhash64("id") <= lower_part(ids.count(), 500))
    assert 800 < lower.count() < 1200 and lower.orderBy(F.xxhash64("id")).limit(500).collect() == rows
    for total, n in ((0, 5), (10, 5), (11, 5), (10 ** 15, 1)):
        assert -(1 << 63) <= lower_part(total, n) < 1 << 63


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {"idle": 3.0, "idiom": 2.0, "idiot": 5.0, "worth": 4.0}
    auto = lev_trie.Automaton(terms, {"scar": 1.5})
    words = ["".join(rng.choice("idlomtwrhsca") for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    for t in terms:
        for _ in range(60):
            w = list(t)
            w[rng.randrange(len(w))] = rng.choice("idlomtwrhé")
            words.append("".join(w))
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length + 1) - length - 1
    final, stems = auto.walk(auto.letters(points), start, length)
    for w, s, stem in zip(words, final, stems):
        assert auto.exact[s] == terms.get(w, 0)
        near = max([v for t, v in terms.items() if len(t) >= 5 and edits(t, w) == 1], default=0)
        assert auto.fuzzy[s] == (0 if w in terms else near)
        assert stem == (1.5 if w.startswith("scar") else 0)


def test_quoted_terms_weigh_less():
    auto = lev_trie.Automaton({"idiot": 5.0}, {})
    names = lev_trie.FEATURES
    abuse, quote, none = (dict(zip(names, row)) for row in lev_trie.features_of(
        ["you idiot you are one", 'he wrote \u201cidiot\u201d there', ""], auto))
    assert abuse["weight"] > quote["weight"] > 0 and quote["quoted"] == 1 and abuse["addressed"] == 1
    assert not any(none.values())


def plain_score_row(text, terms, stems, cues):
    """The feature row of a text, word by word."""
    text = text.lower()
    word = [c.isalnum() for c in text]
    inside = list(word)
    for i in range(1, len(text) - 1):  # one sign between two letters
        if not word[i] and word[i - 1] and word[i + 1] and ord(text[i]) > 32 and text[i] not in lev_trie.QUOTES + "'-,.":
            inside[i] = True
    words, at = [], 0
    while at < len(text):
        if inside[at]:
            end = at
            while end < len(text) and inside[end]:
                end += 1
            words.append((at, end, text[at:end]))
            at = end
        else:
            at += 1

    def weigh(w):
        exact = terms.get(w, 0.0)
        fuzzy = 0.0 if exact else max([v for t, v in terms.items() if len(t) >= 5 and edits(t, w) == 1], default=0.0)
        stem = max([v for t, v in stems.items() if w.startswith(t)], default=0.0)
        return max(exact, 0.8 * fuzzy, 0.9 * stem)
    hits, total, strongest, quoted, addressed = 0, 0.0, 0.0, 0, 0
    for i, (a, b, w) in enumerate(words):
        if not (v := weigh(w)):
            continue
        near = words[max(0, i - 8):i + 9]
        before, after = text[near[0][0]:a], text[b:near[-1][1]]
        said = any(cues.get(x) == 1 for *_, x in near)
        q = said or (any(c in lev_trie.QUOTES for c in before) and any(c in lev_trie.QUOTES for c in after))
        you = any(cues.get(x) == 2 for *_, x in near)
        hits, strongest, quoted, addressed = hits + 1, max(strongest, v), quoted + q, addressed + you
        total += v * (0.3 if q else 1) * (1.2 if you else 1)
    each, n = max(hits, 1), max(len(words), 1)
    return [np.log1p(total), np.log1p(hits), strongest, np.log1p(1000 * total / n) / 4, quoted / each, addressed / each,
            float(hits > 0), max(strongest - 3, 0)]


def test_score_rows_equal_a_walk_word_by_word():
    rng = random.Random(8)
    terms, stems = {"idiot": 5.0, "scum": 4.0, "fool": 2.5, "ass": 3.0, "worthless": 6.0}, {"trash": 3.5, "loser": 2.0}
    cues = dict.fromkeys(lev_trie.REPORTING, 1) | dict.fromkeys(lev_trie.ADDRESS, 2) | {"novel": 1}
    auto = lev_trie.Automaton(terms, stems, {"novel": 1})
    pool = ["idiot", "idoit", "id1ot", "i*iot", "scum", "scums", "ass", "as", "trashy", "losers", "worthles", "you", "said", "novel", "“", "”",
            '"', "it's", "and", "the", "\n", "naïve", "x.y", "end.", "(fool)", "FOOL", "worth-less"]
    texts = ["", " ", "“scum”", "x" * 3000] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    got = lev_trie.features_of(texts, auto)
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_score_row(t, terms, stems, cues)), t
    model = lev_trie.Logistic(got, (np.arange(len(got)) % 3 == 0).astype(float))
    z = (got - got.mean(axis=0)) / (got.std(axis=0) + 1e-9)
    assert np.allclose(model.scores(got), 1 / (1 + np.exp(-(model.beta[0] + z @ model.beta[1:]))))


def test_chance_is_the_binomial_tail():
    for k, n, p in ((0, 5, 0.1), (3, 5, 0.1), (5, 5, 0.3), (20, 200, 0.05), (90, 95, 0.12)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert math.isclose(math.exp(lev_trie.chance(np.array([k]), np.array([n]), p)[0]), want, rel_tol=1e-6)


def test_lexicon_holds_every_significant_term_and_no_chance_one(spark):
    rng = random.Random(5)
    slurs = [f"slur{chr(97 + i)}{chr(97 + j)}q" for i in range(20) for j in range(20)] + ["zq"]  # far more than 200
    rows = []
    for i in range(6000):
        toxic = i % 3 == 0
        words = prose(rng, 30).split() + [f"w{rng.randrange(3000)}" for _ in range(10)] + (rng.sample(slurs, 8) + ["zq"] if toxic else [])
        rows.append((" ".join(words), int(toxic)))
    terms, stems = lev_trie.learned_lexicon(spark.createDataFrame(rows, "text string, mark int"))
    assert set(slurs) <= set(terms) and not any(t.startswith("w") for t in terms) and len(terms) <= len(slurs) + 3
    assert "slur" in stems
    quoted = [(f"he novelly wrote {rng.choice(slurs)} there {rng.choice(['a', 'b'])}", 0) for _ in range(200)] + \
             [(f"look {rng.choice(slurs)} here {rng.choice(['a', 'b'])}", 1) for _ in range(200)]
    auto = lev_trie.Automaton(terms, stems)
    cues = lev_trie.learned_cues(spark.createDataFrame(quoted, "text string, mark int"), auto)
    assert cues["novelly"] == 1 and cues["look"] == 2 and "a" not in cues
    assert lev_trie.learned_cues(spark.createDataFrame(quoted[:50], "text string, mark int"), auto) == {}


# ---- packing and token counts -------------------------------------------------------------------

def test_ids_and_counts_equal_the_library(texts):
    from tokenizers import Tokenizer
    rng = random.Random(6)
    odd = [t or "" for t in texts] + ["".join(rng.choice([chr(rng.randrange(32, 600)), chr(rng.randrange(0x3000, 0xd000)), " ", "'s"])
                                             for _ in range(30)) for _ in range(200)]
    for name, own in (("word_bpe_49k.json", lambda p: [len(x) // 4 for x in packing.WordIds(p).ids(odd)]),
                      ("byte_bpe_50k.json", lambda p: rank_merge.Counter(p, public_tokenizers.PATTERN).counts(odd))):
        path = public_tokenizers.path(name)
        want = Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)
        assert own(path) == [len(w.ids) for w in want]
        if name.startswith("word"):
            assert packing.WordIds(path).ids(odd) == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_overlapping_pairs_merge_from_the_left():
    ranks = rank_merge.RankTable(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for w in ("a" * 37, "ab" * 20, "ooooo", "x"):
        assert rank_merge.count_symbols([w.encode(), b"z"], ranks)[0] == len(tok.encode(w).ids)


def test_swaps_empty_a_bin_that_best_fit_leaves():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit opens four bins of 10; three hold all
    bins = packing.pack(lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 700)
    bins = packing.pack(lengths, 4096)
    assert all(lengths[b].sum() <= 4096 for b in bins) and len(bins) == -(-lengths.sum() // 4096)
    assert packing.pack(np.zeros(0, np.int64), 10) == []


def test_pieces_and_places(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(docs, path)
    placed = packing.place(pieces, block_rows=40)
    rows = placed.collect()
    ids = packing.WordIds(path)
    for doc_id, text in table(docs).items():
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        whole = ids.ids([text or ""])[0] + np.uint32(1).tobytes()
        assert b"".join(r.ids for r in mine) == whole
        assert [r.start for r in mine] == [4096 * k for k in range(len(mine))]
        assert all(r.length == 4096 for r in mine[:-1])
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    assert all(len(whole[s]) == 4 * sum(r.length for r in g) for s, g in by.items())
    assert packing.place(packing.token_pieces(nothing, path)).count() == 0


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in rank_merge.token_counts(docs, path, public_tokenizers.PATTERN, 512).collect()}
    for doc_id, text in table(docs).items():
        assert rows[doc_id].n_bytes == len((text or "").encode())
        assert rows[doc_id].over_limit == (rows[doc_id].n_tokens > 512)
    assert rank_merge.token_counts(nothing, path, public_tokenizers.PATTERN, 512).count() == 0


@pytest.mark.parametrize("lengths", [[3000, 1096], [1024] * 3 + [1023, 1], [2000, 1500, 596]])
def test_lengths_that_fit_those_of_other_blocks(spark, lengths):
    """Whole sequences can be made of these lengths, but most blocks hold too many of one kind."""
    sets = 400
    rows = [(i, 0, 0, n, "x") for i, n in enumerate(n for n in lengths for _ in range(sets))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, extra string").repartition(4, "length")
    placed = packing.place(pieces, block_rows=len(rows) // 8)
    got = placed.collect()
    assert sorted((r.doc_id, r.length, r.extra) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    fewest = -(-sum(r[3] for r in rows) // 4096)
    assert max(fill.values()) <= 4096 and len(fill) <= fewest * 1.01 + 1


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x"), (7, "x"), (7, None), (8, "")]
    placed = packing.place(packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")))
    got = placed.orderBy("offset").collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("7", 1), ("7", 2), ("7", 2), ("8", 1), ("None", 4), ("None", 4)]
    assert [r.offset for r in got] == np.r_[0, np.cumsum([r.length for r in got])[:-1]].tolist()


# ---- near duplicates ------------------------------------------------------------------------------

def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_classes(spark, nothing):
    rng = random.Random(12)
    base = [prose(rng, rng.randrange(80, 300)) for _ in range(30)]
    rows = [None, "", "a b", "a  b", "a b c"]
    for t in base:
        rows.append(t)
        for _ in range(rng.randrange(0, 4)):
            w = t.split()
            w[rng.randrange(len(w))] = "other"
            rows.append(" ".join(w))
    rows += base[:3] * 3
    data = list(enumerate(rows))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in order_minhash.document_classes(df).collect()}
    assert len(got) == len(rows)
    names = {}
    for i, t in enumerate(rows):
        for j in range(i):
            a, b = shingles(t), shingles(rows[j])
            if (t or "") == (rows[j] or "") or a | b and len(a & b) / len(a | b) >= 0.8:
                assert got[i].class_id == got[j].class_id, (i, j)
            elif not a & b:
                names.setdefault((got[i].class_id, got[j].class_id), (i, j))
    assert all(a != b for a, b in names)
    assert all(got[r.class_id].doc_id == min(x.doc_id for x in got.values() if x.class_id == r.class_id) for r in got.values())
    assert order_minhash.document_classes(nothing).count() == 0
    kept = order_minhash.one_of_each(df.withColumn("n_links", F.lit("x")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()})


def test_crowded_buckets_are_split_and_linked(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 8)
    rng = random.Random(4)
    w = prose(rng, 400).split()
    rows = []
    for i in range(60):
        v = list(w)
        v[rng.randrange(len(v))] = f"z{i}"
        rows.append((i, " ".join(v)))
    got = order_minhash.document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def _true_classes(rows):
    """The smallest id of each text's component over all pairs of aligned similarity 0.8 or more."""
    found = []
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        found.append(order_minhash.labelled_shingles(data, np.array([0, len(data)]))[0])
    label = [i for i, _ in rows]
    for i, x in enumerate(found):
        for j in range(i):
            if order_minhash.aligned(found[j], x) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return {i: v for (i, _), v in zip(rows, label)}


def test_members_whose_likest_fail_go_on(spark):
    rng = random.Random(21)
    w = prose(rng, 400).split()
    v = list(w)
    for k in range(20, 400, 50):
        v[k] = f"edit{k}"
    rows = []  # rotations estimate as alike but do not align; the same rotation of an edited text does
    for turn in range(0, 400, 50):
        for x in (w, v):
            rows.append((len(rows), " ".join(x[turn:] + x[:turn])))
    got = order_minhash.document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _true_classes(rows)
    assert len({r.class_id for r in got}) == 8


def test_every_pair_of_classes_of_a_large_family_meets(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 20)
    rng = random.Random(23)
    label = {i: 0 if i < 130 else rng.randrange(130, i + 1) for i in range(300)}
    rows = order_minhash.met_blocks(spark.createDataFrame([(5, i, 10, v) for i, v in label.items()], "family long, rid long, n long, label long")).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault((r.p, r.q), []).append(r.rid)
    assert max(map(len, blocks.values())) <= 4 * 20 and all(len(b) == len(set(b)) for b in blocks.values())
    met = {(a, b) for block in blocks.values() for a in block for b in block}
    assert all((a, b) in met for a in label for b in label if a != b and label[a] != label[b])
    assert not any({label[i] for i in block} == {0} for block in blocks.values())


def test_blocks_make_the_classes_of_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(6)]
    for _ in range(30):
        rows = []
        for _ in range(int(rng.integers(0, 40))):
            x = base[rng.integers(0, 6)].copy()
            x[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
            rows.append(x[:rng.integers(40, 61)] if rng.random() < 0.5 else np.roll(x, int(rng.integers(0, 2)) * 30))
        rows = [np.unique(x, return_index=True) for x in rows]
        rows = [v[np.argsort(at)] for v, at in rows]
        given = np.where(rng.random(len(rows)) < 0.2, -1, np.arange(len(rows)))
        want, got = order_minhash._Classes(given), order_minhash._Classes(given)
        for i in range(len(rows)):
            for j in range(i):
                if order_minhash.aligned(rows[i], rows[j]) >= 0.8:
                    want.merge(i, j)
        found = order_minhash.block_links(rows, given)
        for i, j in found:
            assert order_minhash.aligned(rows[i], rows[j]) >= 0.8 and got.root(i) != got.root(j)
            got.merge(i, j)
        assert got.all().tolist() == want.all().tolist()


@pytest.mark.parametrize("shingles", [400_000, 900])
def test_loose_families_in_crowded_buckets(spark, monkeypatch, shingles):
    monkeypatch.setattr(order_minhash, "BUCKET", 6)
    monkeypatch.setattr(order_minhash, "SHINGLES", shingles)
    rng = random.Random(31)
    w = prose(rng, 300).split()
    rows = []
    for i in range(40):
        v = list(w)
        for _ in range(rng.choice((2, 4, 8))):
            v[rng.randrange(len(v))] = f"z{i}"
        rows.append((i, " ".join(v)))
    got = order_minhash.document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _true_classes(rows)


def test_only_texts_of_families_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 6)
    plans, run = [], order_minhash.block_edges

    def seen(rows, similar):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return run(rows, similar)
    monkeypatch.setattr(order_minhash, "block_edges", seen)
    rng = random.Random(37)
    w = prose(rng, 300).split()
    rows = [(i, " ".join([*w[:i], f"z{i}", *w[i + 1:]]) if i < 20 else prose(rng, 60)) for i in range(40)]
    got = order_minhash.document_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _true_classes(rows)
    assert len(plans) == 2 and all("LeftSemi" in p for p in plans)  # the family is a large one: its parts meet


def test_alignment_minds_the_order():
    a = np.arange(100, dtype=np.uint64)
    assert order_minhash.aligned(a, a) == 1.0
    assert order_minhash.aligned(a, np.r_[a[50:], a[:50]]) < 0.8
    assert order_minhash.aligned(a, a[:0]) == 0.0 and order_minhash.aligned(a[:0], a[:0]) == 1.0
    assert order_minhash.aligned(a, np.r_[a[:90], a[90:] + np.uint64(1000)]) == 90 / 110


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (3, "x"), (3, "y"), (3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order_minhash.document_classes(df).count() == 5
    assert order_minhash.one_of_each(df).count() == 3
    assert suffix_levels.deduplicated(df).count() == 5
    assert scaled_sketch.fingerprints(df).count() == 5


# ---- repeated strings --------------------------------------------------------------------------------

def brute_removed(data, length=100):
    seen, out = set(), {}
    for i, t in sorted(data):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for j, c in enumerate(cover) if c and (j == 0 or not cover[j - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowded", [5000, 2])
def test_repeated_strings(spark, monkeypatch, nothing, crowded):
    monkeypatch.setattr(suffix_levels, "CONTEXTS", crowded)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghijk éü") for _ in range(rng.randrange(40, 260))) for _ in range(8)]
    data = [(0, None), (1, ""), (2, "ab" * 150), (3, "x" * 300), (4, "x" * 99), (5, "x" * 100)]
    for i in range(6, 120):
        parts = [rng.choice(pool) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(0, 6))]
        data.append((i * 3, "".join(parts)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_levels.deduplicated(df).collect()}
    assert got == brute_removed(data)
    assert suffix_levels.deduplicated(nothing).count() == 0
    left = suffix_levels.without_repeats(df.withColumn("data", F.lit(1)))
    assert left.columns == ["doc_id", "text", "data"] and left.count() == len(data)
    texts = table(left)
    assert texts[0] is None and texts[1] == "" and len(texts[3].encode()) == 300 - got[3][1]


def test_levels_stay_few_and_find_what_came_before():
    rng = np.random.default_rng(2)
    levels, known, first = suffix_levels.Levels(), set(), 0
    for _ in range(40):
        key, context = rng.integers(0, 60, 25).astype(np.int64), rng.integers(0, 4, 25).astype(np.int64)
        rid = np.arange(first, first + 25)
        first += 25
        seen = levels.add(key, context, rid, rid * 256)
        for k, c, s in zip(key.tolist(), context.tolist(), seen.tolist()):
            assert s == ((k, c) in known)
            known.add((k, c))
        assert len(levels.levels) <= 8
    several = {int(k) for keys, _, _ in levels.several() for k in keys}
    count = Counter(k for k, _ in known)
    assert several == {k for k, n in count.items() if n > 1}


# ---- archives -------------------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    same = "<p>\u00e4" + warc.VERSION + "twice " + warc.VERSION + "</p>\r\n\r\n"
    rows = [(5, "http://a/\r\nX: y", same), (2, None, same), (9, "http://b", same), (3, "http://c", None), (4, "http://d", ""),
            (7, "http://e", "z" * 100_000), (None, "http://f", same), (8, "http://g", "end\r\n\r\n")]
    df = spark.createDataFrame(rows, "id long, url string, html string").repartition(3)
    records = df.select("id", "url", F.col("html").cast("binary").alias("payload"))
    path = str(tmp_path / "out")
    got = {r.id: r for r in warc.archived(spark, records, "2024-01-01T00:00:00Z", path=path).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[None if i is None else str(i)]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {
        "2": ("response", None), "5": ("revisit", "2"), "9": ("revisit", "2"), None: ("revisit", "2"), "3": ("response", None),
        "4": ("revisit", "3"), "7": ("response", None), "8": ("response", None)}
    back = {r.headers["X-Source-Id"]: bytes(r.payload) for r in warc.read(spark, path).filter("headers['WARC-Type'] = 'response'").collect()}
    assert back["2"] == same.encode() and back["7"] == b"z" * 100_000 and back["8"] == b"end\r\n\r\n"
    large = warc.resolved(records, minimum=1000)
    assert large.filter("record_type = 'revisit'").count() == 0
    assert warc.archived(spark, records.limit(0), "2024-01-01T00:00:00Z").count() == 0


# ---- sketches ----------------------------------------------------------------------------------------------

def test_sketches(docs, nothing):
    rows = {r.doc_id: r for r in scaled_sketch.fingerprints(docs).collect()}
    data = sorted(table(docs).items())
    for n, (i, t) in enumerate(data):
        t, following = t or "", data[(n + 1) % len(data)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1
    by_text = {}
    for i, t in data:
        assert by_text.setdefault(t or "", rows[i].fingerprint) == rows[i].fingerprint
    assert scaled_sketch.fingerprints(nothing).count() == 0


def test_sketches_estimate_containment_and_merge(spark):
    rng = random.Random(9)
    small, more = prose(rng, 1500), prose(rng, 6000)
    df = spark.createDataFrame([(small, small + " " + more, more)], "a string, b string, c string")
    s = {c: scaled_sketch.sketch(F.col(c)) for c in "abc"}
    row = df.select(scaled_sketch.containment(s["a"], s["b"]).alias("inside"), scaled_sketch.likeness(s["a"], s["b"]).alias("like"),
                    scaled_sketch.merged(s["a"], s["c"]).alias("both"), s["b"].alias("whole")).first()
    assert row.inside > 0.95 and abs(row.like - 0.2) < 0.06
    assert set(row.both.low) <= set(row.whole.low) and len(row.whole.low) - len(row.both.low) <= 4  # shingles over the joint


def plain_sketch(text):
    """Hashes below the threshold, and all of a short text."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = {plain_hash(*words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    signed = sorted(h - 2 ** 64 if h >= 2 ** 63 else h for h in found)
    return [h for h in signed if h < -2 ** 63 + 2 ** 61], signed if max(1, len(words) - 4) * bool(words) <= 64 else None


def test_sketches_equal_plain_ones(spark, docs):
    rows = {r.doc_id: r for r in scaled_sketch.fingerprints(docs).collect()}
    data = sorted(table(docs).items())
    shown = lambda hashes: ",".join("%X" % (h % 2 ** 64) for h in hashes)

    def like(a, b):
        (low_a, all_a), (low_b, all_b) = a, b
        x, y, empty = (set(all_a), set(all_b), 1.0) if all_a is not None and all_b is not None else (set(low_a), set(low_b), 0.0)
        return len(x & y) / len(x | y) if x | y else empty
    for n, (i, t) in enumerate(data):
        t, following = t or "", data[(n + 1) % len(data)][1] or ""
        half = len(t) // 2
        own, after, edited = (plain_sketch(x) for x in (t, following, t[:len(t) - half] + following[:half]))
        for got, (low, every) in ((rows[i].fingerprint, own), (rows[i].edited_fingerprint, edited)):
            assert got == (shown(low) if every is None else "=" + shown(every))
        assert (rows[i].near_edited, rows[i].near_next) == (like(own, edited), like(own, after))


def test_short_texts_are_never_told_to_be_missing(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(200):
        words = prose(rng, 210).split()
        at = rng.randrange(200)
        rows.append((" ".join(words[at:at + 10]), " ".join(words), " ".join(words[at:at + 30])))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    s = {c: scaled_sketch.sketch(F.col(c)) for c in "abc"}
    got = df.select(scaled_sketch.containment(s["a"], s["b"]).alias("far"), scaled_sketch.containment(s["a"], s["c"]).alias("near"),
                    scaled_sketch.containment(s["b"], s["a"]).alias("back")).collect()
    assert {r.far for r in got} <= {None, 1.0} and any(r.far for r in got)
    assert all(abs(r.near - min(1.0, r.near)) < 1e-9 and r.near > 0 for r in got)
    assert all(r.back is not None and r.back < 0.4 for r in got)


# ---- the whole --------------------------------------------------------------------------------------------------

def test_registry():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def test_archive_query_equals_its_sql(spark):
    import duckdb
    folder = "/root/testdata/sf0.001"
    rows = queries.op8_warc_revisits(spark, folder)
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
        expected = db.execute(queries.ORACLES["op8_warc_revisits"]).fetchall()
    order = lambda r: r[0]
    assert sorted(map(tuple, rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                  key=order) == sorted(expected, key=order)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n", F.lit(1)).withColumn("rid", F.lit("x")) \
                .withColumn("mix_tokens", F.col("doc_id")).withColumn("whole", F.col("doc_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        kept = {r.doc_id for r in out.select("doc_id").collect()}  # clashing columns keep their values
        assert out.filter("n <> 1 or rid <> 'x' or mix_tokens <> doc_id or whole <> doc_id").count() == 0 and len(kept) == out.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
    twice = spark.createDataFrame([(7, "w " * 80 + "Fine, it is so.", "en", "s", 1, "r", "m"), (7, "w " * 80 + "Fine, it is so.", "en", "s", 1, "r", "m"),
                                   (None, "other text " * 60, "de", None, 2, "q", "k"), (7, None, None, "s", 3, "p", "j")],
                                  "doc_id long, text string, lang string, source string, n_chars long, rid string, row string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # ids that repeat
        rows = stage(spark, twice, folder).collect()
        assert rows and {(r.rid, r.row) for r in rows} <= {("r", "m"), ("q", "k"), ("p", "j")}, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
