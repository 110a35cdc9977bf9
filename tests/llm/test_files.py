"""Archives, shards, URL rules, and the pipeline."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from isohyet.llm import sharding, urlfilter, warc


def pages_of(case):
    r = random.Random(1)
    big = ["<p>" + "".join(r.choice("abc é") for _ in range(n)) + "</p>" for n in (1200, 3000, 995)]
    if case == "empty":
        return []
    rows = [(i, f"https://www{i % 3}.Example.com/en/{i % 7}", r.choice(big) if i % 2 else "small") for i in range(60)]
    return [*rows, (100, None, None), (101, "no scheme", ""), (102, "http://x/\na", big[0]), (None, "http://n.example/", big[1]), (7, "http://again.example/", big[0])]


@pytest.mark.parametrize("case", ["mixed", "empty"])
def test_warc(spark, tmp_path, case):
    rows = pages_of(case)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as bytes").repartition(3)
    folder = str(tmp_path)
    directory = warc.write(df, folder)
    got = warc.read_all(directory, folder).collect()
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    wanted = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        n = sum((x[2] or "").encode() == b for x in rows)
        to = last.get(b) if n > 1 and last.get(b) != i else None
        wanted[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to)] += 1
    assert collections.Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    if rows:
        keys = [r.k for r in df.select(warc.sort_key(F.col("url")).alias("k")).collect()]
        key = "com,example,www1)/en/1"
        asked = spark.createDataFrame([(key,), (key,), ("nowhere)",), ("",), (None,)], "key string")
        assert key in keys and warc.search(directory, folder, asked).count() == keys.count(key) + keys.count("")
        every = df.select(warc.sort_key(F.col("url")).alias("key"))
        assert collections.Counter((r.id, r.url, r.payload_digest) for r in warc.search(directory, folder, every).collect()) == collections.Counter((r.id, r.url, r.payload_digest) for r in got)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 500])
def test_shards(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    rows = [(i if i % 9 else None, f"t{i % 5}") for i in range(n)] + [(3, "same"), (3, "same")] * (n > 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot")
    out = sharding.shuffle_into_shards(df, ["doc_id", "text"], 16, seed=5).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(map(str, out)) == sorted(map(str, sharding.shuffle_into_shards(df.repartition(5), ["doc_id", "text"], 16, seed=5).collect()))


def test_equal_rows_are_shuffled_like_others(spark):
    """A third of all rows equal: their counts by shard and by stretch of slots are those of a uniform shuffle."""
    n = 12_000
    df = spark.range(n).selectExpr("if(id % 3 = 0, 0, id) as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text").repartition(7)
    out = sharding.shuffle_into_shards(df, ["doc_id", "text"], 16, seed=5)
    again = sharding.shuffle_into_shards(df.repartition(3), ["doc_id", "text"], 16, seed=5)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    cells = collections.Counter((r.shard, r.slot // 125) for r in out.where("doc_id = 0").collect())
    wanted = n / 3 / 96
    chi = sum((cells.get((s, k), 0) - wanted) ** 2 for s in range(16) for k in range(6)) / (wanted * 2 / 3)  # without replacement
    assert 50 < chi < 150  # 95 degrees of freedom: 99.98 % lie between


def test_hypergeometric_law():
    r = random.Random(2)
    draws = [sharding.hypergeometric(r, 30, 70, 20) for _ in range(20000)]
    mean, var = sum(draws) / len(draws), 20 * 0.3 * 0.7 * 80 / 99
    assert abs(mean - 6) < 0.06 and abs(sum((d - mean) ** 2 for d in draws) / len(draws) - var) < 0.15
    assert sharding.hypergeometric(r, 5, 0, 3) == 3 and sharding.hypergeometric(r, 0, 9, 4) == 0 and sharding.hypergeometric(r, 10**10, 10**11, 10**6) > 0
    m = sharding.communication_matrix([5, 0, 100, 33], 16, 1)
    assert [sum(x) for x in m] == [5, 0, 100, 33] and max(map(sum, zip(*m, strict=True))) - min(map(sum, zip(*m, strict=True))) <= 1


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.b.c", "", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "com/en/1", "http://com/en/", "https://www.Example.COM/en/7?q#f", "https://example.com/en/8", "http://xexample.com/en/7", "ftp://a.example.net/de/81", "http://example.net/de/9", "http://org/es/", "http://x.org/es", "http://x.org?es/", "http://É.com/en/é", "http://a.b.c", "http://q.a.b.c/zzz", "a://b://com/en/", "http:///en/7", "http://com\n/en/", "http://" + "x." * 2000 + "com/en/" + "y" * 5000]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 3)] + [(None, "http://com/en/")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'p' as path", "'r' as rule", "'k' as key")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect())
    assert got == collections.Counter((i, *judged(u)) for i, u in rows)
    assert not urlfilter.judge(df.where("false"), rules).collect()
    assert {r.verdict for r in urlfilter.judge(df, rules.where("false")).collect()} == {"allow"}


def test_urls_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    monkeypatch.setattr(urlfilter, "BROADCAST_PAIRS", 0)
    test_urls(spark)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as k")
    words = urlfilter.bloom_words(keys, "k", 1024).first().words
    table = spark.createDataFrame([(words,)], "w array<bigint>")
    test = lambda k: F.element_at(table.scalar(), urlfilter._block(k, 1024) + 1).bitwiseAND(urlfilter._mask(k)) == urlfilter._mask(k)
    assert keys.where(test(F.col("k"))).count() == 5000
    assert spark.range(20000).selectExpr("concat('z', id) as k").where(test(F.col("k"))).count() < 4000


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    from isohyet.llm import jaccard, mixing, runtime, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(900_001, None, "en", None, 0), (900_002, "", None, "src1", None), (None, "a null id", "en", "src2", 9), (900_003, "the same five words here", "en", "src3", 1), (900_003, "the same five words here", "en", "src3", 1)]
    docs = runtime.cut(docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("copies", F.lit("extra")), "test-docs")
    names = docs.columns
    kept = runtime.cut(pipeline.reject_toxic(spark, docs, sf), "test-1")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = sorted(str(r.doc_id) for r in toxicity.score(docs, model).where("predicted = 0").collect())
    assert kept.columns == names and sorted(str(r.doc_id) for r in kept.collect()) == clean
    single = runtime.cut(pipeline.drop_near_duplicates(spark, kept, sf), "test-2")
    ids = collections.Counter(r.doc_id for r in single.collect())
    groups = {r.component_id for r in jaccard.join_components(kept).where("doc_id is not null").collect()}
    assert single.columns == names and {i for i in ids if i is not None} == groups and max(ids.values()) == 1
    mixed = runtime.cut(pipeline.mix_sources(spark, single, sf), "test-3")
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert mixed.columns == names and collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({d: c for d, c in copies.items() if c})
    out = pipeline.encode_ids(spark, mixed, sf).collect()
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    assert len(out) == sum(copies.values())
    for r in out[:50]:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert zlib.crc32(b"") == 0


def test_search_in_small_blocks(spark, tmp_path, monkeypatch):
    """Keys that span blocks and files, keys between and beyond all others."""
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "RANGE", 10)
    rows = [(i, f"http://h{min(i // 4 % 9, 4)}.org/p{i // 8 % 5 if i % 3 else 0}", f"body {i}") for i in range(120)]
    folder = str(tmp_path / "w")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.write(pages, folder)
    wanted = {}
    for i, k in pages.select("page_id", warc.sort_key(F.col("url"))).collect():
        wanted.setdefault(k, []).append(i)
    for key in [*wanted, "", "nowhere)", "\uffff", "org,h1)/p"]:
        got = warc.search(directory, folder, spark.createDataFrame([(key,)], "key string")).collect()
        assert sorted(r.id for r in got) == wanted.get(key, [])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40])
def test_spans(n):
    r = random.Random(n)
    marks = sorted(r.choice("abcdefgh") for _ in range(2 * n))
    keys = list(zip(marks[::2], marks[1::2], strict=True))
    for key in " abcdefghz":
        assert list(warc.spans(keys, key)) == [i for i, (low, high) in enumerate(keys) if low <= key <= high]


def test_archives_by_the_specification(spark, tmp_path):
    """Each archive read member by member: a warcinfo first, mandatory fields, unique ids, revisits of responses that are there."""
    import datetime
    import re
    import zlib

    rows = [*[(i, f"http://x{i % 5}.org/{i}", "long " * 300 if i % 2 else f"text {i}") for i in range(50)], (-7, None, "é" * 900), (2**62, "http://a/\nb", "é" * 900), (None, "http://n/", "long " * 300)]
    folder = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder)
    ids, refers, pages = [], [], collections.Counter()
    for file in tmp_path.glob("w/*.warc.gz"):
        raw, first = file.read_bytes(), True
        while raw:
            d = zlib.decompressobj(31)
            record = d.decompress(raw)
            raw = d.unused_data
            head, _, rest = record.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            h = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and len(h) == len(lines) and rest[int(h["Content-Length"]) :] == b"\r\n\r\n"
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", h["WARC-Record-ID"])
            datetime.datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")
            ids.append(h["WARC-Record-ID"])
            assert (h["WARC-Type"] == "warcinfo") == first and (first or h["WARC-Target-URI"])
            if not first:
                http, _, body = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n") and h["Content-Type"].startswith("application/http")
                pages[warc.page_of(h["WARC-Record-ID"])] += 1
                if h["WARC-Type"] == "revisit":
                    assert not body and "WARC-Profile" in h
                    refers.append((h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"]))
                else:
                    assert hashlib.sha1(body).hexdigest() == h["WARC-Payload-Digest"].removeprefix("sha1:")
            first = False
    assert len(set(ids)) == len(ids) and {r for r, _ in refers} <= set(ids) and len(refers) == 26
    assert pages == collections.Counter(i for i, _, _ in rows)


PROSE = ["the quick brown fox jumps over the lazy dog near a river bank today", "rain falls on northern hills while shepherds count their sheep at dusk again", "many ships left the old harbour before winter storms closed every channel there"]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = PROSE
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, c, "x"), (5, c, "x"), (7, b, "x"), (8, None, "x"), (8, "", "x"), (None, a, "x"), (None, a, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a, "x"), (5, b, "y"), (5, c, "x"), *rows[6:]], key=str)


def test_each_row_has_its_own_copies(spark):
    from isohyet.llm import mixing

    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None if i % 3 == 0 else i // 6, f"{PROSE[i % 3]} {i} " + "more " * (i % 7), "xyz"[i % 3 if i % 2 else i % 2]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted, got = {}, {}
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id, r.source, r.size] = wanted.get((r.doc_id, r.source, r.size), 0) + r.copies
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    for r in mixed.select("doc_id", "source", mixing.words(F.col("text")).alias("size")).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}
