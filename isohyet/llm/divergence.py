"""Source divergence audit by integer-dictionary encoding.

Each task counts the terms of its documents by (lang, source) and sends sums. Terms in at least `least` documents of a lang
are kept; sorted by UTF-8 they are cut into chunks, the dictionary: an id is a chunk and a place in it, so ids keep the
order of terms. A chunk's counts of a block of sources meet its sorted terms in one task: searchsorted gives ids, bincount a
dense vector for each source. Vectors of two blocks give the divergences of all their pairs, chunk by chunk, summed by
Spark. Ties are broken by the order of ids, which is that of terms.

All arithmetic is exact. A term's p is 1 + floor(SCALE * (count + 2) / (N + 2V)), N a group's kept occurrences and V the
number of kept terms; two groups' divergence is the sum of floor((p - q)^2 / (p + q)) over all kept terms. A task holds at
most CHUNK terms of two blocks of BLOCK sources, whatever the number of terms or sources.

Defined results: null text, lang and source are ''. Only A-Z are lower-cased. A group without terms is a group all the same;
a lang without kept terms has value 0 for all its pairs. Rows are documents, also where they repeat. An empty table has no
groups.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut, release

#: Bytes of a term are letters and whatever is not ASCII; A-Z become a-z.
_TERM = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 10**9
#: Terms of a chunk; sources of a block.
CHUNK, BLOCK = 8192, 64
#: Distinct terms held before a task sends its counts; rows of an Arrow batch; bytes of a piece of a long text.
_HELD, _ROWS, _PIECE = 400_000, 20_000, 1 << 20
#: (lang, source) groups are broadcast up to this many, counted first.
MAX_BROADCAST = 100_000
_DOC = 1 << 40


def terms_of(raw: bytes) -> dict[bytes, int]:
    """The terms of a UTF-8 text and how often they occur; long texts in pieces that end between terms."""
    counts: dict[bytes, int] = {}
    plain = raw.translate(_TERM)
    a = 0
    while a < len(plain):
        end = len(plain) if len(plain) - a <= 2 * _PIECE else plain.find(b" ", a + _PIECE) % (len(plain) + 1)
        for t in plain[a:end].split():
            counts[t] = counts.get(t, 0) + 1
        a = end
    return counts


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches):
    """Occurrences and documents of each term by lang and source, as often as many terms are held."""

    def sums(held):
        for (lang, source), counts in held.items():
            terms, both = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for a in range(0, len(terms), _ROWS):
                some, v = terms[a : a + _ROWS], both[a : a + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(v % _DOC), pa.array(v // _DOC)], schema=_COUNTS)

    held, n = defaultdict(dict), 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), strict=True):
            group = held[lang, source]
            n -= len(group)
            for t, c in terms_of(text.as_buffer().to_pybytes()).items():
                group[t] = group.get(t, 0) + c + _DOC  # documents above, occurrences below
            n += len(group)
            if n >= _HELD:
                yield from sums(held)
                held, n = defaultdict(dict), 0
    yield from sums(held)


def _chunks(size: int):
    """Sorted (lang, term, total) of a range, as chunks of one lang."""

    def run(batches):
        lang, terms, totals, number = None, [], [], TaskContext.get().partitionId() << 32

        def row():
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number], pa.int64()), pa.array([terms], pa.list_(pa.binary())), pa.array([totals], pa.list_(pa.int64()))], ["lang", "chunk", "terms", "totals"])

        for b in batches:
            for l, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if terms and (l != lang or len(terms) >= size):
                    yield row()
                    number, terms, totals = number + 1, [], []
                lang = l
                terms.append(t)
                totals.append(n)
        if terms:
            yield row()

    return run


def probability(counts: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / whole), exactly; whole a number, or one for each row."""
    a, d = counts + 2, np.asarray(whole)
    if int(d.max(initial=0)) >= 1 << 48:
        return (1 + SCALE * a.astype(object) // d.astype(object)).astype(np.int64)
    high, low = np.divmod(a * 31250, d)  # SCALE = 31250 * 32000; both products stay below 2^63
    return 1 + high * 32000 + low * 32000 // d


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def dense(terms: list[bytes], rows: int, place: np.ndarray, term: list[bytes], n: np.ndarray) -> np.ndarray:
    """Counts by row and id: ids by searchsorted in sorted terms, sums by bincount."""
    ids = np.searchsorted(_objects(terms), _objects(term))
    at, size = place * len(terms) + ids, rows * len(terms)
    low, high = (np.bincount(at, x, size).astype(np.int64) for x in (n & 0xFFFFFF, n >> 24))  # each exact in 53 bits
    return (low + (high << 24)).reshape(rows, len(terms))


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


_VECTORS = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("block", pa.int32()), ("source", pa.string()), ("term", pa.binary()), ("value", pa.int64()), ("p", pa.binary())])


def _encode(top: int):
    """A chunk and a block of sources: the sources' probabilities as one dense matrix, and each source's `top` terms in this chunk."""

    def run(counts: pa.Table, header: pa.Table) -> pa.Table:
        h = header.to_pylist()[0]
        rows, wholes = len(h["sources"]), np.array(h["wholes"], np.int64)
        if not h["terms"]:
            return pa.table([[h["lang"]], [h["chunk"]], [h["block"]], [None], [None], [None], [b""]], schema=_VECTORS)
        n = np.zeros((rows, len(h["terms"])), np.int64)
        if counts.num_rows:
            n = dense(h["terms"], rows, counts["place"].to_numpy().astype(np.int64), counts["term"].to_pylist(), counts["n"].to_numpy())
        p, q = probability(n, wholes[:, None]), probability(np.array(h["totals"], np.int64), h["whole"])
        f = divergence(p, q)
        source, term, value = [None], [None], [None]
        for k in range(rows):
            at = np.flatnonzero((n[k] > 0) & (p[k] > q))
            at = at[np.argsort(-f[k][at], kind="stable")][:top]
            source += [h["sources"][k]] * len(at)
            term += [h["terms"][x] for x in at]
            value += f[k][at].tolist()
        same = [[h[c]] * len(source) for c in ("lang", "chunk", "block")]
        return pa.table([*same, source, term, value, [p.tobytes()] + [None] * (len(source) - 1)], schema=_VECTORS)

    return run


_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _compare(block: int):
    """The divergences of a chunk, of all pairs between two blocks' sources, or within one."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        blocks, sizes = t["block"].to_pylist(), t["sources"].to_pylist()
        one, two = (np.frombuffer(t["p"][k].as_buffer(), np.int64).reshape(sizes[k], -1) for k in (0, len(blocks) - 1))
        a, b, value = [], [], []
        for k, p in enumerate(one):
            first = k + 1 if len(blocks) == 1 else 0
            a.append(np.full(sizes[-1] - first, blocks[0] * block + k))
            b.append(blocks[-1] * block + np.arange(first, sizes[-1]))
            value.append(divergence(p, two[first:]).sum(axis=1))
        return pa.table([[t["lang"][0].as_py()] * sum(map(len, a)), *(np.concatenate(x).astype(np.int64) for x in (a, b, value))], schema=_SUMS)

    return run


def audit(docs: DataFrame, least: int = 10, top: int = 10, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """docs: text, lang, source. lang, source, part (pair or term), item, value, rank: see the module."""
    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least)
    ordered = kept.select("lang", "term", "total").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    dictionary = cut(ordered.mapInArrow(_chunks(chunk), "lang string, chunk long, terms array<binary>, totals array<long>"), "divergence-dictionary")
    known = dictionary.select("lang", "chunk", F.explode("terms").alias("term"))
    encoded = cut(counted.drop("docs").join(known, ["lang", "term"]), "divergence-encoded")

    langs = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda s, x: s + x)).alias("all"))
    groups = rows.select("lang", "source").distinct().join(encoded.groupBy("lang", "source").agg(F.sum("n").alias("kept")), ["lang", "source"], "left").join(langs, "lang", "left")
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", place.cast("long").alias("k"), (F.coalesce("kept", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("own"), (F.coalesce("all", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"))
    groups = cut(groups.withColumn("block", (F.col("k") / block).cast("int")), "divergence-groups")
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("k", "source", "own"))).alias("s"), F.max("whole").alias("whole"))
    blocks = blocks.select("lang", "block", F.col("s.source").alias("sources"), F.col("s.own").alias("wholes"), "whole")
    # A chunk without terms, so that langs that keep none have pairs as well.
    none = [F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<binary>").alias("terms"), F.array().cast("array<bigint>").alias("totals")]
    headers = dictionary.union(groups.select("lang").distinct().select("lang", *none)).join(blocks, "lang")
    placed = groups.select("lang", "source", "block", (F.col("k") % block).cast("int").alias("place"))
    placed = F.broadcast(placed) if placed.count() <= MAX_BROADCAST else placed
    counts = encoded.join(placed, ["lang", "source"]).groupBy("lang", "chunk", "block")
    vectors = counts.cogroup(headers.groupBy("lang", "chunk", "block")).applyInArrow(_encode(top), "lang string, chunk long, block int, source string, term binary, value long, p binary")
    vectors = cut(vectors, "divergence-vectors")

    term = vectors.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "chunk", "term")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", "part", "item", "value", "rank")

    count = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    size = groups.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("sources"))
    sent = vectors.where("p is not null").select("lang", "chunk", "block", "p").join(count, "lang").join(size, ["lang", "block"])
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("lang", "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sources", "p")
    sums = sent.groupBy("lang", "chunk", "i", "j").applyInArrow(_compare(block), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = cut(sums.withColumn("ab", F.explode(F.array(F.array("a", "b"), F.array("b", "a")))).select("lang", F.col("ab")[0].alias("k"), F.col("ab")[1].alias("o"), "value"), "divergence-sums")
    names = groups.select("lang", "k", "source")
    pair = both.join(names, ["lang", "k"]).join(names.select("lang", F.col("k").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    out = cut(pair.union(term), "divergence-audit")
    release(counted, dictionary, encoded, groups, vectors, both)
    return out
