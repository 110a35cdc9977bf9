"""Every registered query over whole tables against SQL or a brute-force version, and their results on empty tables."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from test_text import brute

from isohyet.llm import bpe, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    return {name: read(name) for name in ("documents", "embeddings", "labels", "pages")}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, wanted = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(df.columns) == sorted(wanted.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in wanted.columns) for r in df.collect())
    assert got == collections.Counter(tuple(plain(v) for v in r) for r in wanted.fetchall())


def test_op2(spark, rows):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op2_ngram_jaccard"](spark, SF).collect())
    assert got == brute([r[:2] for r in rows["documents"]])


def test_op6(spark, rows):
    encoding = bpe.codec(**queries.tokenizer())[0]
    wanted = set()
    for d, text, *_ in rows["documents"]:
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        wanted.add((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op6_byte_bpe"](spark, SF).collect()} == wanted


def test_common_texts_are_reduced_over_a_tree(rows):
    """State how many documents have more than one leaf: it must not be an exception."""
    assert np.mean([len(r[1] or "") > bpe.LEAF for r in rows["documents"]]) > 0.2


def test_op7(spark, rows):
    out = queries.QUERIES["op7_shard"](spark, SF).collect()
    raw = [(r[1] or "").encode() for r in rows["documents"]]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((r[0], len(b) + 1, zlib.crc32(b)) for r, b in zip(rows["documents"], raw, strict=True))
    sizes = collections.Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in out} == {(s, k) for s, n in sizes.items() for k in range(n)} and {r.law for r in out} == {"rows"}


def test_op9(spark, rows):
    x = {r[0]: np.float64(r[1]) for r in rows["embeddings"]}
    got = collections.defaultdict(list)
    for r in sorted(queries.QUERIES["op9_ann"](spark, SF).collect(), key=lambda r: r.rank):
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))
        got[r.query_id].append(r.vec_id)
    hit = total = 0
    for q in (i for i in x if i % 20 == 0):
        best = [c for _, c in sorted((-float(x[q] @ v), c) for c, v in x.items() if c != q)[:20]]
        assert len(got[q]) == len(best)
        hit, total = hit + len(set(best) & set(got[q])), total + len(best)
    assert hit >= 0.9 * total


def test_windows_by_a_plain_loop():
    """Each window's logit by scalar steps of the network."""
    r = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_network(2).items()}
    inputs, ids = r.normal(size=(30, 6)), r.integers(0, 29, 150)
    bounds = np.array([0, 5, 5, 150])
    starts, doc = toxicity.window_table(bounds)
    assert doc.tolist() == [0, 1, *[2] * len(toxicity.windows_of(145))]
    got = toxicity.window_logits(p, inputs, ids, starts)
    squash, h = lambda v: 1 / (1 + math.exp(-v)), toxicity.HIDDEN
    for k, (a, end) in enumerate(starts):
        words = [ids[a + t] if a + t < end else 29 for t in range(toxicity.WINDOW)]
        states = {}
        for d, order in (("f", range(toxicity.WINDOW)), ("b", reversed(range(toxicity.WINDOW)))):
            s = np.zeros(h)
            for t in order:
                x, g = inputs[words[t]] @ p[f"w{d}"] + p[f"c{d}"], s @ p[f"u{d}"]
                new = np.zeros(h)
                for j in range(h):
                    reset, keep = squash(x[j] + g[j]), squash(x[h + j] + g[h + j])
                    new[j] = (1 - keep) * math.tanh(x[2 * h + j] + reset * g[2 * h + j]) + keep * s[j]
                s = new
                states[d, t] = s
        real = [t for t in range(toxicity.WINDOW) if t == 0 or a + t < end]
        both = {t: np.r_[states["f", t], states["b", t]] for t in real}
        weight = {t: math.exp(float(np.tanh(both[t] @ p["a"] + p["ab"]) @ p["v"])) for t in real}
        pooled = sum(weight[t] * both[t] for t in real) / sum(weight.values())
        assert got[k] == pytest.approx(float(pooled @ p["o"] + p["ob"][0]), abs=1e-4)


def test_op8(spark, rows):
    got = {r.doc_id: r for r in queries.QUERIES["op8_toxicity"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows["documents"]}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_toxicity_of_no_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "an er on"), (1, "an er on"), (2, "st re")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 3 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert toxicity.score(docs.where("false"), model).collect() == [] and toxicity.train(docs.where("false"), labels) == {"constant": 0.0}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "labels", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(folder)).collect() == []
