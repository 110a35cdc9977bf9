"""Near duplicates, tokenization and toxicity."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest

from isohyet.llm import bpe, jaccard, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return collections.Counter((d, len(s), find(d) if d is not None else None) for d, s in sets)


def words(r, n):
    return [r.choice("abcdefgh") + str(r.randint(0, 500)) for _ in range(n)]


def near_copies(r, n, size, edits):
    base = words(r, size)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice("xyz") + str(r.randint(0, 9999))
        out.append(" ".join(w))
    return out


def cases():
    r = random.Random(4)
    texts = [" ".join(words(r, r.choice([1, 2, 4, 5, 6, 8, 9, 12, 30, 90]))) for _ in range(60)]
    texts += near_copies(r, 40, 60, 4) + near_copies(r, 30, 24, 1) + near_copies(r, 12, 400, 14) + near_copies(r, 20, 8, 1)
    passage = " ".join(words(r, 50))
    texts += [" ".join([*words(r, 40), passage, *words(r, 40)]) for _ in range(30)]
    rows = list(enumerate(texts))
    yield "mixed", rows
    yield "odd", [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four"), (5, "one TWO three four"), (6, "ÉA b c d e"), (7, "éA b c d e"), (8, "w" * 3000), (9, "w" * 3000), (None, "one two three four"), (10, "a b c d e f"), (10, "a b c d e f"), (11, " ".join(words(r, 30000)))]
    yield "copies", [(i, texts[60] if i % 3 else t) for i, t in enumerate(texts[:60])]
    yield "empty", []


@pytest.mark.parametrize("name,rows", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_jaccard(spark, name, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as component_id", "1 as n", "2 as fp")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect())
    assert got == brute(rows)


def test_jaccard_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK", 7)
    monkeypatch.setattr(jaccard, "ROUNDS", (1, None))
    rows = dict(cases())["mixed"]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(0)
    for n in [5, 6, 9, 14, 20, 33, 64, 150, 400, 1500]:
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = int((len(a) * 2) / 9)
            gone = r.integers(0, most // 2 + 1)
            b = np.unique(np.r_[a[gone:], r.integers(0, 1 << 63, r.integers(0, most - gone + 1), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b))) or jaccard.class_of(a) == jaccard.class_of(b)
                x, y = jaccard.sketch(a), jaccard.sketch(b)
                assert jaccard.bits_apart(x, y) <= len(a) + len(b) - 2 * both


def test_subsets_of_parts_are_signed():
    """Brute force over places of the differences: whichever elements go, a subset of n2 - 1 subparts stays whole."""
    r = np.random.default_rng(1)
    schemes = {jaccard.scheme(j) for j in range(14)}
    assert 2 in schemes and schemes - {2}
    for n in [40, 60, 200, 700]:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        d = (len(a) * 2) // 10
        for start in range(0, len(a) - d, max(1, len(a) // 40)):  # runs of neighbours and evenly spread ones
            for gone in (np.arange(start, start + d), np.arange(start % 5, len(a), 5)[:d]):
                b = np.delete(a, gone)
                assert 100 * len(b) < 80 * len(a) or len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))


def test_jaccard_in_many_lots(spark, monkeypatch):
    """Hot signatures: lots of few sets are tied in two steps, thousands of near copies and a passage that all share."""
    r = random.Random(9)
    passage = " ".join(words(r, 60))
    texts = near_copies(r, 300, 60, 2) + [" ".join([*words(r, 8), passage, *words(r, 8)]) for _ in range(120)] + [" ".join([passage, *words(r, k % 30)]) for k in range(60)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "_FLUSH", 1500)
    monkeypatch.setattr(jaccard, "_SEEN", 3)
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "_PIECE", 50)
    monkeypatch.setattr(jaccard, "_HOT_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "_BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join_components(df).collect())
    assert got == brute(rows)


def test_one_entry_a_lot_for_a_hot_signature():
    pairs = jaccard._paired(np.array([7] * 5000 + [9] * 3, np.int64), np.arange(5003, dtype=np.int64))
    entries, hot, members = jaccard._part(pairs)
    assert len(entries) == 4 and hot.tolist() == [(7, 0)] and len(members) == 5000


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 5, 17, 400])
def test_tree_encoding(codec, leaf):
    encoding, tokens = codec
    r = random.Random(leaf)
    parts = ["a", "b", "'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "é", "中", "!", "?!", "🙂", "x" * 40, " " * 30, "\u3000", "\u0301", "\r\n", "<|endoftext|>", "\u2019s", "٣", "\u00b2", "\x1f"]
    for _ in range(400):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 80)))
        ids = bpe.encode_text(s, encoding, leaf).tolist()
        assert ids == encoding.encode_ordinary(s)
        assert bpe.decode_ids(ids, tokens) == s.encode()


def test_long_pieces(codec):
    encoding, _ = codec
    for s in ("a" * 100_000, " " * 70_000, "ab " * 30_000, "word. " * 20_000 + "é" * 9000):
        assert bpe.encode_text(s, encoding).tolist() == encoding.encode_ordinary(s)


def test_windows_grow_over_sides_without_a_boundary(codec):
    encoding, _ = codec
    for s in ("." * 3000 + "a b", "a b" + "'" * 3000, "a b" + " !" * 2000 + "c d", "中" * 5000, "é\u0301" * 900 + " x"):
        x = bpe._reduce(s, 0, len(s), 64, encoding)
        assert x.head is None or b"".join(x.runs) == bpe._packed(s[x.head : x.tail], encoding)
        assert bpe.encode_text(s, encoding, 64).tolist() == encoding.encode_ordinary(s)


def test_codec_columns(spark, codec):
    ranks = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    rows = [(1, None, 5), (2, "", None), (None, "hello  world", 1), (3, "hello  world", 1), (3, "hello  world", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df.withColumnRenamed("ids", "decoded"), "text", **ranks), "ids", **ranks).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == ["", "", "hello  world", "hello  world", "hello  world"]
    assert not bpe.encode(df.where("false"), "text", **ranks).collect()


def toxic_texts(n, seed=0):
    r = random.Random(seed)
    syllables = ["an", "er", "on", "st", "re", "in", "ha", "ti"]
    rows = []
    for i in range(n):
        w = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 150))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilezz", "grumqk"]) + r.choice(["a", "ed", "ing", ""]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark):
    rows = toxic_texts(400)
    extra = [(1000, None), (1001, ""), (None, "an er on"), (1002, "x" * 5000), (1003, " ".join(["an"] * 20_000) + " vilezzing grumqked vilezz")]
    docs = spark.createDataFrame([*((d, t) for d, t, _ in rows), *extra], "doc_id long, text string").selectExpr("*", "0.5 as score", "'q' as predicted")
    labels = spark.createDataFrame([*((d, y) for d, _, y in rows), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    test = [(y, got[d].predicted) for d, _, y in rows if got[d].held_out]
    assert sum(y == p for y, p in test) >= 0.95 * len(test)
    assert got[1003].predicted == 1 and got[1000].score == got[1001].score and not got[1000].predicted
    kept = {r.doc_id for r in toxicity.accept(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}
    assert toxicity.train(docs, labels.where("false")) == {"constant": 0.0}


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_network(1).items()}
    inputs = r.normal(size=(12, 6))
    steps = r.integers(0, 12, (toxicity.WINDOW, 3))
    real = np.arange(toxicity.WINDOW)[:, None] < np.array([5, 64, 20])
    y = np.array([1.0, 0.0, 1.0])
    grads, _ = toxicity.gradients(p, inputs, steps, real, y)
    for k in p:
        at = tuple(r.integers(0, s) for s in p[k].shape)
        moved = {s: dict(p) for s in (1, -1)}
        for s in (1, -1):
            moved[s][k] = p[k].copy()
            moved[s][k][at] += s * 1e-3
        slope = (toxicity.gradients(moved[1], inputs, steps, real, y)[1] - toxicity.gradients(moved[-1], inputs, steps, real, y)[1]) / 2e-3
        assert slope == pytest.approx(grads[k][at], rel=0.05, abs=2e-5)
