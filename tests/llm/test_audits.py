"""Source divergence, SimHash and the filter audit against plain loops, on small tables with every special case."""

import collections
import itertools
import re

import numpy as np
import pytest
import xxhash

from isohyet.llm import divergence, filteraudit, queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, value long"


def table_of(spark, rows):
    """rows: doc_id, text, lang, source; with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS).repartition(3)


def bundled(spark):
    return [tuple(r)[:4] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


WORDS = "alpha Beta gamma delta Épée épée zeta eta theta ſtraße x1y İi naïve日本 #".split()


def made(seed, n=120):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(WORDS, r.integers(0, 60)))
        rows.append((i, text, ["en", "de", None, ""][r.integers(0, 4)], [None, "a", "B", "é", "src"][r.integers(0, 5)]))
    rows += [(None, "alpha beta", "en", "a"), (None, None, "en", "only null"), (7, "another text of seven", "en", "a"), (3, None, None, None), (900, "", "fr", "q"), (901, "rare words", "fr", "r")]
    rows += [rows[0]] * 4 + [(200 + k, "the same text " * 40, "en", "hot") for k in range(60)]
    rows.append((902, "w%d " * 3000 % tuple(range(3000)), "en", "long"))
    return rows


# Source divergence.
def divergences(rows, least=10, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in here for t in set(d[2]))
        kept = [t for t, c in seen.items() if c >= least]
        groups = {s: collections.Counter() for s in {d[1] for d in here}}
        for _, s, terms in here:
            groups[s].update(t for t in terms if t in kept)
        whole = sum(groups.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in groups.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in groups.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(found if part == "pair" else found[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("chunk,block", [(8192, 64), (3, 2)])
def test_divergence(spark, chunk, block):
    """Whatever the size of chunks and blocks; a lang that keeps no term has pairs of value 0."""
    rows = made(1)
    got = collections.Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(table_of(spark, rows), chunk=chunk, block=block).collect())
    assert got == divergences(rows)
    assert any(x[0] == "fr" and x[2] == "pair" and x[4] == 0 for x in got) and not any(x[0] == "fr" and x[2] == "term" for x in got)


def test_long_texts_in_pieces(monkeypatch):
    text = ("Abc-dé1日本 " * 50).encode()
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert divergence.terms_of(text) == whole == {b"abc": 50, "dé".encode(): 50, "日本".encode(): 50} and divergence.terms_of(b"") == {}


def test_counts_are_sent_in_lots(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 5)
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"lang": ["a"] * 3, "source": ["s"] * 3, "text": ["x y z x", "u v w x", "x"]})
    sums = collections.Counter()
    for out in divergence._count([b, b]):
        for r in out.to_pylist():
            sums[r["term"]] += r["n"] * 1000 + r["docs"]
    assert sums[b"x"] == 8006 and sums[b"u"] == 2002 and len(sums) == 6


def test_probability_is_exact():
    for counts, whole in (([0, 5, 10**9], 10**9 + 40), ([0, 1, 3 * 10**13], 10**14 + 7), ([0, 10**15], 3 * 10**15), ([0], 4)):
        assert divergence.probability(np.array(counts, np.int64), whole).tolist() == [1 + 10**9 * (c + 2) // whole for c in counts]


def test_dense_is_exact():
    n = np.array([(1 << 55) + 1, (1 << 55) + 2, 3], np.int64)
    got = divergence.dense([b"a", b"b", "é".encode()], 2, np.array([0, 0, 1]), [b"b", b"b", "é".encode()], n)
    assert got.tolist() == [[0, (1 << 56) + 3, 0], [0, 0, 3]]


# SimHash.
def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points):
    """{point: smallest rep reachable} of {point: rep}, by comparing all pairs."""
    values = list(points)
    label = {v: points[v] for v in values}
    edges = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4]
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def simhashes(rows):
    fps = [(d, simhash_of(t)) for d, t, *_ in rows]
    reps = {}
    for d, f in fps:
        if d is not None:
            reps[f] = min(d, reps.get(f, d))
    label = classes(reps)
    return collections.Counter((d, f"{f:016x}", None if d is None else label[f]) for d, f in fps)


def near_copies(seed=3):
    r = np.random.default_rng(seed)
    rows = made(seed)
    base = [f"w{k}" for k in r.integers(0, 900, 400)]
    for k in range(80):
        words = list(base)
        for at in r.integers(0, len(words), k % 7):
            words[at] = f"n{r.integers(0, 10**6)}"
        rows.append((1000 + k, " ".join(words), "en", "near"))
    return rows


def found(df):
    return collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"homes": 4, "visitors": 8}, {"homes": 3, "visitors": 5, "least_shards": 2}])
def test_simhash(spark, limits):
    """As brute force has it, also where shards are dealt out in pieces."""
    rows = near_copies()
    got = found(simhash.near_duplicates(table_of(spark, rows), **limits))
    assert got == simhashes(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_op12(spark):
    assert found(queries.QUERIES["op12_simhash"](spark, SF)) == simhashes(bundled(spark))


def test_fingerprints_of_pieces(monkeypatch):
    text = " ".join(f"Wörd{k}\t" for k in range(500))
    whole = simhash.fingerprint(text.encode())
    assert whole == simhash_of(text)
    monkeypatch.setattr(simhash, "_PIECE", 11)
    assert simhash.fingerprint(text.encode()) == whole and simhash.fingerprint(b"a  b ") == simhash_of("a b") and simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("kind", ["random", "ball", "clusters"])
def test_tree_loses_no_pair(kind):
    """Routing and the local tree link what comparing all pairs links."""
    r = np.random.default_rng(5)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 3000, dtype=np.uint64)
    if kind != "random":
        centers = x[: 1 if kind == "ball" else 60]
        x = centers[r.integers(0, len(centers), 3000)]
        for _ in range(7):
            x = np.where(r.random(3000) < 0.6, x ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)), x)
    x = np.unique(x)
    nodes = simhash.plant(x[::10], 4)
    homes, edges = collections.Counter(), []
    shards = collections.defaultdict(lambda: [x[:0], x[:0]])
    for s, visiting, p in simhash.routed(x, nodes):
        shards[s][visiting] = p
        homes.update([] if visiting else p.tolist())
    assert homes == collections.Counter(x.tolist())
    for home, guest in shards.values():
        f = simhash.Forest(np.concatenate([home, guest]))
        f.inside(np.arange(len(home)))
        f.across(np.arange(len(home), len(home) + len(guest)), np.arange(len(home)))
        edges += [(f.points[i], f.points[j]) for i, j in f.links]
    assert all(simhash.apart(a, b) <= simhash.RADIUS for a, b in edges)
    one, all_ = simhash.Forest(x), simhash.Forest(x)
    all_.blocks(np.arange(len(x)), np.arange(len(x)))
    at = {v: k for k, v in enumerate(x.tolist())}
    for a, b in edges:
        i, j = one.root(at[int(a)]), one.root(at[int(b)])
        one.parent[max(i, j)] = min(i, j)
    every = np.arange(len(x))
    assert np.array_equal(one.roots(every), all_.roots(every))


# Filter audit.
def audits(rows, labels):
    docs = [(d, t or "", lang or "") for d, t, lang, _ in rows]
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t] = min(d, smallest.get(t, d))
    fails = []
    for d, t, lang in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and smallest[t] < d]
        fails.append((lang, d, {c for c, f in zip("ABCDE", flags, strict=True) if f}))
    out, total = [], collections.Counter()
    for part in {f[0] for f in fails}:
        here = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [f for f in here if c in f[2] and not f[2] & before]
                total[part, c] += len(gone)
                late = sum(c in f[2] and bool(f[2] & before) for f in here)
                kept = sum(not f[2] & (before | {c}) for f in here)
                out.append((part, "".join(order), k + 1, kept, len(gone), late, sum(f[2] == {c} for f in here), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone), c))
    return collections.Counter((*r[:-1], total[r[0], r[-1]]) for r in out)


def test_filter_audit(spark):
    rows = made(2) + [(500, "A B C " * 50, "en", "a"), (501, "a" * 3 + " $ " + " ".join(f"u{k}" for k in range(200)), "en", "a")]
    rows += [(600 + k, " ".join(f"v{(j * k) % 331}" for j in range(150)), "de", "a") for k in range(1, 20)]
    labels = [(d, d % 2, d % 3 == 0) for d in range(0, 700, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    df = filteraudit.audit(table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = collections.Counter((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())
    assert got == audits(rows, labels)


def test_words_are_not_shuffled(spark):
    """One exchange of texts, none of (document, word) rows."""
    rows = table_of(spark, made(4)).selectExpr("doc_id", "xxhash64(text) as key", "text", "spark_partition_id() as task")
    plan = filteraudit.word_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^\n]*word#", plan) and plan.count("HashAggregate") + plan.count("SortAggregate") >= 4
