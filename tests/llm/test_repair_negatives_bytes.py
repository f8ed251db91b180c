"""Conversation repair, hard negatives and byte-level BPE against plain versions of their rules."""

import base64
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from ordermill.llm import byte_bpe, queries, turn_repair, zone_negatives

# ---- conversation repair ---------------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """(cost, audit) by a best-first search over all states, the first of equal cost in ASCII order."""
    need = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(heap, (cost + 2, audit + "I", i, need[last]))
        if i == len(rows):
            continue
        kind, cut, gone = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
        if not gone:
            heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, need[last]))
            if kind == need[last] or (kind == "s" and last == ""):
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, kind))
    raise AssertionError


def code(row):
    kind, cut, gone = row
    return {"s": 1, "u": 2, "a": 3}.get(kind, 0) | (turn_repair.GONE if gone else turn_repair.CUT if cut else 0)


@pytest.mark.parametrize("kinds", ["ua", "sua", "suax"])
def test_edits_are_the_cheapest_and_the_first(kinds):
    rng = random.Random(kinds)
    for _ in range(1500):
        rows = [(rng.choice(kinds), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randrange(0, 9))]
        rows = [(k, c and not g, g) for k, c, g in rows]
        assert turn_repair.cheapest_edits(bytes(map(code, rows))) == plain_edits(rows), rows


def test_bounds_never_exceed_the_cost():
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("suax"), False, rng.random() < 0.1) for _ in range(rng.randrange(0, 12))]
        codes = bytes(map(code, rows))
        assert turn_repair.lower_bounds(codes)[turn_repair.START][0] <= plain_edits(rows)[0]


def test_long_conversation_takes_one_bound():
    rng = random.Random(2)
    rows = [("ua"[(i + (rng.random() < 0.05)) % 2], rng.random() < 0.05, False) for i in range(20_000)]
    cost, audit = turn_repair.cheapest_edits(bytes(map(code, rows)))
    assert cost == plain_edits(rows)[0] and sum(e != "I" for e in audit) == len(rows)


def plain_repair(rows):
    """Digest columns of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, marks, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        end = text.rstrip(BLANK)
        fault = ("blank" if not end else "duplicate" if (role, text) in seen else
                 "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marks.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds = [m[0] for m in marks]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = plain_edits(marks)
    out, last, at = [], "", 0
    for edit in audit:
        want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if edit == "I":
            out.append(want + ":")
            last = want[0]
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        role = want if edit == "R" else role
        out.append(f"{role}:{text}")
        last = role[0]
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            convs[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return convs


CONVERSATION = "conv_id long, turn long, role string, text string, alive boolean, place string"


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice(["Yes.", "no", "", " \n", "What? ", "a.b", None, "Güt!\x85", "it is so. " * 30])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", None, "", "tool"][:3 + 3 * (conv is None or conv > 60)]),
                         text, False, "x"))
    rows += rows[:40] + [(500, t, "ua"[t % 2] + "x", "Fine.", True, "y") for t in range(3000)]
    rows.append((501, 0, "user", "é " * 2_000_000 + ".", True, "z"))
    folder = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, CONVERSATION).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return rows, str(folder)


def test_repairs_of_damaged_conversations(spark, talks):
    rows, folder = talks
    want = {conv: plain_repair(some) for conv, some in plain_damage([r[:4] for r in rows]).items()}
    got = queries.op11_turn_repair(spark, folder)
    assert got.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                          ("audit", "string"), ("repaired_sha256", "string")]
    found = got.collect()
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_repairs_without_rows(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert turn_repair.repairs(none).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a", False, "")], CONVERSATION)
    assert [tuple(r)[1:] for r in turn_repair.repairs(gone, "alive").collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# ---- hard negatives --------------------------------------------------------------------------

def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by brute force over all pairs; rows are (vec_id, label, vector)."""
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows
            if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, label, x) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other == label) for b, (i, other, y) in enumerate(rows)
                  if b != a and len(x) == len(y)]
        for ps, positive, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            fit = sorted((s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)[:3]
            out += [(anchor, positive, k + 1, i, ps, ns) for k, (ns, i, _) in enumerate(fit)]
    return sorted(map(str, out))


VECTORS = "vec_id long, embedding array<float>, label int, unit string, block string"


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).tolist(), int(rng.integers(0, 4)), "u", "b") for i in range(400)]
    rows += rows[50:52] + rows[100:103]  # repeated rows, an anchor among them
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1, "u", "b"), (1050, [nan] * 6, 1, "u", "b"), (1100, [inf] + [0.0] * 5, 1, "u", "b"), (1150, [None] + [1.0] * 5, 1, "u", "b"),
             (1200, [1.0] * 6, None, "u", "b"), (None, [1.0] * 6, 1, "u", "b"), (None, [0.9] * 6, 2, "u", "b"), (1250, [1.0] * 6, 1, None, None),
             (1300, [1.0, 0.5], 1, "u", "b"), (1301, [1.0, 0.25], 1, "u", "b"), (1302, [0.5, 0.25], 2, "u", "b"), (1350, [], 1, "u", "b"),
             (1351, [], 1, "u", "b"), (1352, [], 2, "u", "b"), (1400, [0.0] * 6, 2, "u", "b"), (-50, [0.1] * 6, 0, "u", "b")]
    rows += [(2000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], i % 2, "u", "b") for i in range(120)]  # ties
    got = zone_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(4))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives([(r[0], r[2], r[1]) for r in rows])
    assert zone_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_negatives_over_many_blocks_with_a_hot_label(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(6000):
        x = centres[rng.integers(0, 12)] + 0.2 * rng.normal(size=8)
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), 0 if rng.random() < 0.4 else int(rng.integers(1, 4)), "", ""))
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    made, zones = zone_negatives.zones_of(zone_negatives.blocks(zone_negatives.usable(df), 50))
    assert made.count() > 12 and made.agg(F.sum(F.size("ids"))).first()[0] == 6000
    got = zone_negatives.hard_negatives(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives([(r[0], r[2], r[1]) for r in rows])


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    at = zone_negatives.hilbert_index(cells, 3)
    assert sorted(at.tolist()) == list(range(512))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_and_products_are_exact():
    rng = np.random.default_rng(6)
    rows, anchors = rng.integers(-300, 300, (50, 7)).astype(float), rng.integers(-300, 300, (9, 7)).astype(float)
    least, most = zone_negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = zone_negatives.products(anchors, rows)
    assert (scores == anchors.astype(int) @ rows.astype(int).T).all()
    assert (scores >= least).all() and (scores <= most).all()
    large = np.array([[2.0 ** 40 + 1, 3.0]])
    assert zone_negatives.products(large, np.array([[2.0 ** 20, 1.0]])).tolist() == [[(2 ** 40 + 1) * 2 ** 20 + 3]]
    with pytest.raises(OverflowError):
        zone_negatives.products(large, large)


# ---- byte-level BPE --------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_odd_texts(library):
    rng = random.Random(1)
    signs = "''''  \t\n aslremtvd'Sé1२٣!?.#한🤖\x1c\x85 ΣA\0"
    texts = ["", " ", "'s", "  's", "it's we'll don't've 'rx \n\n  hi  \n", "!'s''ll", "a" * 3000, "ab " * 700, " " * 900, "x" + "\n" * 300 + "y"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 70))) for _ in range(4000)]
    words = byte_bpe.vocabulary(PATH)
    for _ in range(2):  # then all slices are known
        ids, counts = byte_bpe.encode_texts(texts, words)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_class_of_the_library(library):
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or 0xA600 <= c < 0xAC00 or c % 31 == 0)]
    ids, counts = byte_bpe.encode_texts(texts, byte_bpe.vocabulary(PATH))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_scan_equals_a_walk():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 5000):
        symbols = rng.choice(9, n, p=[.3, .1, .1, .05, .05, .1, .1, .1, .1]).astype(np.uint8)
        state, want = byte_bpe.FRESH, []
        for s in symbols.tolist():
            want.append(bool(byte_bpe.BEGINS[state, s]))
            state = int(byte_bpe.GOES[state, s])
        begins, end = byte_bpe.scanned(symbols, byte_bpe.FRESH)
        assert begins.tolist() == want and end == state


def test_pieces_of_a_scan_join(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "PIECE", 37)
    monkeypatch.setattr(byte_bpe, "SLICES", 5)
    texts = ["it's  we'll\n\n\t don't 'rest 've" * 9, "", "1234 五六 ...!!! 'll" * 5]
    ids, counts = byte_bpe.encode_texts(texts, byte_bpe.vocabulary(PATH))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_rows(spark, library):
    texts = [None, "", " ", "naïve café 한국어 🤖", "<|endoftext|> a", "x" * 5000, "it's we'll  DON'T\n" * 400, "word é" * 600_000]
    rows = [(i if i != 3 else None, t, "c", "d") for i, t in enumerate([*texts, *texts[3:6]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, ends string").repartition(3)
    done = byte_bpe.decoded(byte_bpe.encoded(docs, PATH), PATH).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in done) == want
    sizes = [len(library.decode_single_token_bytes(t)) for r in done if len(r.ids) < 9000 for t in r.ids]
    assert sizes == [b - a for r in done if len(r.ids) < 9000 for a, b in zip([0, *r.ends], r.ends)]
    assert byte_bpe.encoded(spark.createDataFrame([], docs.schema), PATH).count() == 0


def test_byte_query_equals_the_library(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
