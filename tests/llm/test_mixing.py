import random
import re

import pytest

from isohyet.llm import mixing

WORD = re.compile(mixing.WORD)


def water_fill(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Stop at the cap, hand the excess on by weight, repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            got |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def rows_of(n, sources, seed=0):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 5, 30, 200]))), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("case", ["even", "hot", "nulls", "one", "empty"])
def test_targets_and_taken(spark, case):
    rows = {
        "even": rows_of(400, ["a", "b", "c", "d", "Z", "é"]),
        "hot": rows_of(400, ["a"] * 8 + ["b", "c", "d"]),
        "nulls": [*rows_of(200, ["a", None, "b"]), (None, "x y z", None), (7, None, "a"), (7, "again the id", "b"), (8, "", None)],
        "one": [(1, "just five words of text", "s")],
        "empty": [],
    }[case]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as copies", "3 as target")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    aims = water_fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        # Of a source of one document all or nothing more can be taken.
        fine = case in ("even", "hot") or sum(r.source == s for r in out) > 20
        assert abs(taken[s] - aims[s]) <= (max(10, 0.02 * aims[s]) if fine else max(r.size for r in out if r.source == s))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))


def test_inclusion_follows_the_odds(spark):
    """One source, documents of 1, 16 and 64 words: the shares taken once more have odds in proportion to the roots."""
    docs = spark.range(60_000).selectExpr("id as doc_id", "element_at(array(1, 16, 64), cast(id % 3 as int) + 1) as n").selectExpr("doc_id", "repeat('w ', n) as text", "'s' as source")
    more = docs.selectExpr("doc_id + 100000 as doc_id", "text", "'t' as source").where("doc_id % 7 = 0")
    out = mixing.mix(docs.union(more), weights=(1, 9)).where("source = 's'").groupBy("size").agg({"copies": "avg"}).collect()
    share = {r["size"]: r["avg(copies)"] % 1 for r in out}
    odds = {k: v / (1 - v) for k, v in share.items()}
    assert 0.02 < share[1] < share[16] < share[64] < 0.98
    assert odds[16] / odds[1] == pytest.approx(4, rel=0.12) and odds[64] / odds[16] == pytest.approx(2, rel=0.12)


def test_equal_and_null_ids_are_free_of_each_other(spark):
    """A source whose rows all have a null id, and one whose rows all have one id, are sampled like any other."""
    docs = spark.range(1500).selectExpr("case when id % 2 = 0 then null else 7 end as doc_id", "'five words are in here' as text", "case when id % 2 = 0 then 'null' else 'seven' end as source")
    out = mixing.mix(docs, weights=(1, 2), share=1.2).collect()
    for source, wanted in (("null", 0.8), ("seven", 1.6)):
        copies = [r.copies for r in out if r.source == source]
        assert len(copies) == 750 and len(set(copies)) == 2 and sum(copies) == pytest.approx(wanted * 750, abs=1)


def test_documents_larger_than_a_target(spark):
    docs = spark.createDataFrame([(1, "w " * 5000, "a"), (2, "w", "a"), (3, "w " * 10, "b")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 400), share=0.5).collect()}
    assert 0 <= out[1].taken <= 10_000 and out[3].taken == 20 and out[1].copies in (0, 1)
