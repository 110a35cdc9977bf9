"""Exact and approximate vector search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.llm import ann, queries, topk, vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")


def sparse(df):
    t = F.transform("embedding", lambda x, i: F.struct(i.alias("term"), F.floor(x.cast("double") * 64).alias("weight")))
    df = df.where(vectors.finite(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.filter(t, lambda p: p["weight"] != 0).alias("t"))
    return df.select("id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def brute(rows, k, score, is_query):
    one = {}
    for i, v in rows:
        one[i] = v
    out = []
    for q, v in one.items():
        if is_query(q):
            found = sorted((-score(v, w), c) for c, w in one.items() if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def valid(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def vector_rows(n, d, seed=0, hot=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 3).astype(np.float32)
    x[:hot] = x[0]
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


CASES = {
    "plain": vector_rows(150, 8),
    "hot": vector_rows(120, 6, hot=50),
    "odd": [*vector_rows(45, 4), (None, [1.0] * 4), (60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan"), 1.0, 0.0, 0.0]), (63, [float("inf"), 1.0, 0.0, 0.0]), (40, [0.5, 0.5, 0.5, 0.5]), (40, [0.5, 0.5, 0.5, 0.5])],
    "few": vector_rows(3, 4),
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_exact(spark, case, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "CHUNK", 5)
    rows = CASES[case]
    df = sparse(frame(spark, [(i, v, 1, 2) for i, v in rows]))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df.where("id % 5 = 0"), df, 7).collect())
    ok = [(i, v) for i, v in rows if i is not None and valid(v)]
    # Of rows with one id the smallest counts: fewest leading terms, then weights.
    form = lambda v: tuple(zip(*[(t, w) for t, w in enumerate(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v) if w], strict=True))
    ok = sorted(ok, key=lambda r: (r[0], form(r[1])), reverse=True)
    score = lambda a, b: int(sum(int(np.floor(np.float64(x) * 64)) * int(np.floor(np.float64(y) * 64)) for x, y in zip(np.float32(a), np.float32(b), strict=True)))
    assert got == brute(ok, 7, score, lambda i: i % 5 == 0)


@pytest.mark.parametrize("case", CASES)
def test_approximate(spark, case):
    rows = [(i, v) for i, v in CASES[case]]
    got = ann.search(frame(spark, [(i, v, 1, 2) for i, v in rows]), lambda i: i % 5 == 0, 7).collect()
    ok = {i: v for i, v in rows if i is not None and valid(v) and any(v)}
    wanted = {}
    for q, v in ok.items():
        if q % 5 == 0:
            wanted[q] = sorted((-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), c) for c, w in ok.items() if c != q)[:7]
    assert {r.query_id for r in got} == {q for q in wanted if wanted[q]}
    found = 0
    for q, best in wanted.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert all(m[2] == pytest.approx(float(np.dot(np.float64(np.float32(ok[q])), np.float64(np.float32(ok[m[1]]))))) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        found += len({m[1] for m in mine} & {c for _, c in best})
    total = sum(map(len, wanted.values()))
    assert total == 0 or case == "hot" or found >= 0.9 * total


def test_sums_beyond_64_bits():
    """They are held to the largest number; all others are exact, in blocks with such rows as well."""
    at = lambda w: pa.table({"id": [1, 2], "terms": [[0], [0]], "weights": [[w], [w]]}, schema=pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))]))
    assert topk._search_block(at(1 << 40), at(1 << 40), 2)["score"].to_pylist() == [2**63 - 1] * 2
    assert topk._search_block(at(1 << 40), at(-(1 << 40)), 2)["score"].to_pylist() == [1 - 2**63] * 2
    r = np.random.default_rng(8)
    schema = pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))])
    x = r.integers(-(1 << 20), 1 << 20, (40, 5))
    x[3], x[20, 2], x[31] = 1 << 50, -(1 << 62), r.integers(-(1 << 40), 1 << 40, 5)
    t = pa.table({"id": np.arange(40), "terms": [list(range(5))] * 40, "weights": x.tolist()}, schema=schema)
    got = {(a, b): s for a, b, s in zip(*(c.to_pylist() for c in topk._search_block(t, t, 39).columns), strict=True)}
    exact = lambda a, b: max(1 - 2**63, min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x[a], x[b], strict=True))))
    assert got == {(a, b): exact(a, b) for a in range(40) for b in range(40) if a != b}
    assert topk._search_block(at(1 << 31), at(-(1 << 30)), 1)["score"].to_pylist() == [-(1 << 61)] * 2


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.float64(r.embedding) for r in df.collect()}
    got = ann.search(df, lambda i: i % 20 == 0, 20).collect()
    hit = total = 0
    for q in (i for i in rows if i % 20 == 0):
        best = {c for _, c in sorted((-float(rows[q] @ v), c) for c, v in rows.items() if c != q)[:20]}
        hit += len(best & {r.vec_id for r in got if r.query_id == q})
        total += len(best)
    assert hit >= 0.9 * total


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(1000, 16))
    parts = ann.balanced_parts(ann.neighbours(x, 10), 16, 1)
    assert np.ptp(np.bincount(parts)) <= 8 and ann.fit(x)["probes"] <= ann.PARTS


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_ann_finds_k_in_small_clusters(spark):
    r = np.random.default_rng(2)
    x = np.repeat(r.standard_normal((40, 16)), 12, axis=0) + 0.01 * r.standard_normal((480, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ann.search(_vectors(spark, x), lambda i: i % 20 == 0, 20).groupBy("query_id").count().collect()
    assert len(got) == 24 and {r["count"] for r in got} == {20}


def test_ann_recall_beyond_the_sample(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3 * ann.SAMPLE, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for q in ann.search(_vectors(spark, x), lambda i: i % 60 == 0, 20).collect():
        found.setdefault(q.query_id, set()).add(q.vec_id)
    s = x[::60] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 60)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(found[60 * k] & set(b.tolist())) / 20 for k, b in enumerate(best)]) >= 0.94


def test_op1_of_huge_components(spark, tmp_path):
    """A finite component beyond any long: its weight is the largest long, other rows' results are theirs."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(61, [1e30, 0.0]), (80, [-1e30, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.QUERIES["op1_exact_topk"](spark, str(tmp_path)).collect()}
    assert {q for q, _ in got} == {0, 20, 40, 80} and got[20, 1] == (61, 2**63 - 1) and got[20, 2] == (6, 64 * 64 * 37)
    assert got[80, 1] == (0, 128 * 64) and got[0, 1] == (80, 128 * 64) and got[0, 2] == (1, 64 * 64)
