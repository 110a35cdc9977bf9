"""SimHash near duplicates: 64-bit fingerprints, vantage-point trees over Hamming distance, exact components.

A fingerprint bit is set where over half the hashes of a text's shingles have it. Distinct fingerprints are partitioned by
a vantage-point tree: a node has a fingerprint v and a radius m; what is at most m away from v goes inside, the rest
outside. Its leaves are shards, and each fingerprint is at home in one. Of two fingerprints within RADIUS of each other
that part at a node, the inner one is at least m - RADIUS + 1 away from v (triangle bound), so inner fingerprints that near
the boundary also visit the outer side, and as visitors go wherever their ball reaches, until they meet the other one in
its home. All other branches are pruned; no pair is lost. In a shard the homes, and the visitors against the homes, go down
a tree of its own the same way, to blocks of which every distance is taken. Points of one component are not compared
again, and each task sends a spanning forest of links, so that thousands of near copies send thousands of links.

A shard with more than `homes` points (a ball of near copies that no vantage point can cut) is dealt out in pieces. Each
piece is joined in itself first; pieces meet pair by pair with the components known by then, and only points of different
components are compared. The tree is fitted on a bounded sample in one task; it decides where points go, not what links.

Defined results: texts that are null or have no words have fingerprint zero, linked like any other. Rows with a null id
take no part in links and have a null component. Repeated rows stay and share a component. An empty table has no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .jaccard import components
from .runtime import cut, release

WORDS, SEED, RADIUS = 4, 42, 4
#: Bytes of a piece of a long text.
_PIECE = 1 << 20
#: Points at home in a shard, visitors of a task, most shards, points of the tree's sample for each shard.
HOMES, VISITORS, MAX_SHARDS, SAMPLE = 1 << 16, 1 << 20, 1 << 14, 64
#: Final components are broadcast up to this many fingerprints, counted first.
MAX_BROADCAST = 500_000
#: Points routed together; points of a block of distances.
_LOT, _LEAF = 1 << 16, 256
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces that end with white space."""
    a = 0
    while len(raw) - a > 2 * _PIECE and (end := _SPACE.search(raw, a + _PIECE)):
        yield raw[a : end.end()]
        a = end.end()
    yield raw[a:]


def fingerprint(raw: bytes) -> int:
    """The SimHash of a UTF-8 text, unsigned."""
    ones, total, rest = np.zeros(64, np.int64), 0, []
    hashes = lambda shingles, n: np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    for piece in pieces(raw):
        words = rest + piece.lower().split()
        if (n := len(words) - WORDS + 1) > 0:
            ones += _bit_counts(hashes(map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)), n))
            total += n
        rest = words[1 - WORDS :]
    if not total and rest:
        ones, total = _bit_counts(hashes([b" ".join(rest)], 1)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    out = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[a : a + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        out += bits.sum(axis=0, dtype=np.uint16)
    return out


def _fingerprints(batches):
    for b in batches:
        values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])


def apart(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _near_boundary(d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Which balls of RADIUS around points d away from the vantage point reach inside, and outside."""
    return d <= m + RADIUS, d >= m + 1 - RADIUS


def choose(points: np.ndarray) -> tuple[np.uint64, int]:
    """A vantage point and its radius, for about half the points inside: of some candidates, the one with the fewest points at its boundary."""
    best = None
    some = points[:: max(1, len(points) // 512)]
    for v in points[:: max(1, len(points) // 8)][:8]:
        counts = np.bincount(apart(some, v), minlength=65)
        m = int(np.abs(2 * np.cumsum(counts) - len(some)).argmin())
        held = counts[max(0, m + 1 - RADIUS) : m + RADIUS + 1].sum() + abs(2 * counts[: m + 1].sum() - len(some))
        if best is None or held < best[0]:
            best = held, v, m
    return best[1], best[2]


class Forest:
    """Points, their components so far, and the links that joined them."""

    def __init__(self, points: np.ndarray, labels: np.ndarray | None = None):
        self.points, self.links = points, []
        self.parent = np.arange(len(points))
        if labels is not None:
            _, first, of = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = first[of.ravel()]

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[at] = r
        return r

    def root(self, i: int) -> int:
        while (p := int(self.parent[i])) != i:
            i = p
        return i

    def block(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.roots(a), self.roots(b)
        if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == ra[0]).all():
            return
        near = apart(self.points[a][:, None], self.points[b]) <= RADIUS
        if not near.any():
            return
        while True:
            open_ = near & (ra[:, None] != rb)
            if not len(rows := np.flatnonzero(open_.any(axis=1))):
                return
            for i, j in zip(a[rows].tolist(), b[open_[rows].argmax(axis=1)].tolist(), strict=True):
                x, y = self.root(i), self.root(j)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.links.append((i, j))
            ra, rb = self.roots(a), self.roots(b)

    def blocks(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), _LEAF):
            for j in range(i if a is b else 0, len(b), 4 * _LEAF):
                self.block(a[i : i + _LEAF], b[j : j + 4 * _LEAF])

    def inside(self, h: np.ndarray) -> None:
        """Links among the points h."""
        if len(h) <= 2 * _LEAF:
            return self.blocks(h, h) if len(h) > 1 else None
        v, m = choose(self.points[h])
        d = apart(self.points[h], v)
        inner = d <= m
        if min(n := int(inner.sum()), len(h) - n) < len(h) // 16:
            return self.blocks(h, h)
        self.inside(h[inner])
        self.inside(h[~inner])
        self.across(h[inner & _near_boundary(d, m)[1]], h[~inner])

    def across(self, a: np.ndarray, h: np.ndarray) -> None:
        """Links between a and h."""
        if not len(a) or not len(h):
            return
        if len(h) <= _LEAF or len(a) * len(h) <= _LEAF * _LEAF:
            return self.blocks(a, h)
        v, m = choose(self.points[h])
        inner = apart(self.points[h], v) <= m
        if min(n := int(inner.sum()), len(h) - n) < len(h) // 16:
            return self.blocks(a, h)
        into, out = _near_boundary(apart(self.points[a], v), m)
        self.across(a[into], h[inner])
        self.across(a[out], h[~inner])

    def table(self) -> pa.Table:
        at = np.array(self.links, np.int64).reshape(-1, 2)
        both = self.points[at].view(np.int64)
        return pa.table([both[:, 0], both[:, 1]], schema=_LINKS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def plant(points: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """The tree's nodes (vantage point as a signed number, radius) in heap order."""
    level, nodes = [points], []
    for _ in range(depth):
        below = []
        for p in level:
            v, m = choose(p) if len(p) else (np.uint64(0), 32)
            inner = apart(p, v) <= m
            nodes.append((int(np.uint64(v).view(np.int64)), m))
            below += [p[inner], p[~inner]]
        level = below
    return nodes


def _plant(depth: int):
    def run(t: pa.Table) -> pa.Table:
        nodes = plant(np.sort(t["fp"].to_numpy()).view(np.uint64), depth)
        return pa.table([np.arange(len(nodes)), [v for v, _ in nodes], [m for _, m in nodes]], names=["node", "v", "m"])

    return run


def routed(points: np.ndarray, nodes: list[tuple[int, int]]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, visiting, points) of the shards that points are at home in or visit."""
    stack = [(0, points, points[:0])]
    while stack:
        node, home, guest = stack.pop()
        if not len(home) and not len(guest):
            continue
        if node >= len(nodes):
            yield from ((node - len(nodes), k, p) for k, p in ((False, home), (True, guest)) if len(p))
            continue
        v, m = np.int64(nodes[node][0]).view(np.uint64), nodes[node][1]
        d, e = apart(home, v), apart(guest, v)
        inner, (into, out) = d <= m, _near_boundary(e, m)
        stack.append((2 * node + 1, home[inner], guest[into]))
        stack.append((2 * node + 2, home[~inner], np.concatenate([home[inner & _near_boundary(d, m)[1]], guest[out]])))


_ROUTED = pa.schema([("shard", pa.int32()), ("visiting", pa.bool_()), ("n", pa.int64()), ("points", pa.binary())])


def _route(nodes: list[tuple[int, int]]):
    def lot(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = list(routed(np.concatenate(held).view(np.uint64), nodes))
        columns = [[s for s, _, _ in rows], [k for _, k, _ in rows], [len(p) for _, _, p in rows], [p.tobytes() for _, _, p in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += len(held[-1])
            if n >= _LOT:
                yield lot(held)
                held, n = [], 0
        if n:
            yield lot(held)

    return run


def _scrambled(points: np.ndarray) -> np.ndarray:
    x = points * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _split(raw: bytes, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    points = np.frombuffer(raw, np.uint64)
    if parts == 1:
        yield 0, points
        return
    to = _scrambled(points) % np.uint64(parts)
    yield from ((k, points[to == k]) for k in range(parts))


_DEALT = "shard int, i int, j int, visiting boolean, points binary"


def _deal(batches):
    """Each piece of homes to all its pieces of visitors, and the other way round."""
    for b in batches:
        for r in b.to_pylist():
            rows = []
            for k, points in _split(r["points"], r["guest_pieces" if r["visiting"] else "home_pieces"]):
                for o in range(r["home_pieces" if r["visiting"] else "guest_pieces"]) if len(points) else ():
                    rows.append((r["shard"], *((o, k) if r["visiting"] else (k, o)), r["visiting"], points.tobytes()))
            for a in range(0, len(rows), 64):
                columns = zip(*rows[a : a + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["shard", "i", "j", "visiting", "points"])


def _joined(t: pa.Table, mask: list[bool]) -> np.ndarray:
    """Points in one order, whatever order the rows came in."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p.as_buffer(), np.uint64) for p, keep in zip(t["points"], mask, strict=True) if keep)]))


def _task(t: pa.Table) -> pa.Table:
    guests = t["visiting"].to_pylist()
    home, guest = _joined(t, [not g for g in guests]), _joined(t, guests)
    forest = Forest(np.concatenate([home, guest]))
    at = np.arange(len(home))
    if t["j"][0].as_py() == 0:
        forest.inside(at)
    forest.across(np.arange(len(home), len(home) + len(guest)), at)
    return forest.table()


def _meet(t: pa.Table) -> pa.Table:
    """Links between two pieces of a shard's homes, of points whose components differ so far."""
    t = t.sort_by([("piece", "ascending"), ("fp", "ascending")])
    piece = t["piece"].to_numpy()
    forest = Forest(t["fp"].to_numpy().view(np.uint64), t["label"].to_numpy())
    forest.across(np.flatnonzero(piece == piece.min()), np.flatnonzero(piece != piece.min()))
    return forest.table()


def _unpack(batches):
    for b in batches:
        for r in b.to_pylist():
            for k, points in _split(r["points"], r["home_pieces"]):
                for a in range(0, len(points), _LOT):
                    some = points[a : a + _LOT]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), v, np.int32)) for v in (r["shard"], k, r["home_pieces"])] + [pa.array(some.view(np.int64))], ["shard", "piece", "pieces", "fp"])


def links(points: DataFrame, homes: int = HOMES, visitors: int = VISITORS, least_shards: int = 16) -> DataFrame:
    """points: fp long, distinct. a, b: pairs within RADIUS that connect whatever such pairs connect. A table of cut."""
    spark, n = points.sparkSession, points.count()
    depth = max(0, math.ceil(math.log2(min(MAX_SHARDS, max(least_shards, n / homes)))))
    stride = max(1, n // (SAMPLE << depth))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(stride)) == 0).select("fp", F.lit(0).alias("all"))
    nodes = [(r.v, r.m) for r in sample.groupBy("all").applyInArrow(_plant(depth), "node long, v long, m long").orderBy("node").collect()]
    sent = cut(points.select("fp").mapInArrow(_route(nodes), "shard int, visiting boolean, n long, points binary"), "simhash-routed")
    pieces_of = lambda test, most: F.greatest(F.lit(1), F.ceil(F.sum(F.when(test, F.col("n")).otherwise(0)) / (2 * most))).cast("int")
    sizes = sent.groupBy("shard").agg(pieces_of(~F.col("visiting"), homes).alias("home_pieces"), pieces_of(F.col("visiting"), visitors).alias("guest_pieces"))
    sized = sent.join(F.broadcast(sizes), "shard")  # a row a shard: MAX_SHARDS at most
    found = cut(sized.mapInArrow(_deal, _DEALT).groupBy("shard", "i", "j").applyInArrow(_task, "a long, b long"), "simhash-links")
    large = sized.where("home_pieces > 1 and not visiting")
    if large.isEmpty():
        release(sent)
        return found
    labels = components(found, "a", "b")
    known = large.mapInArrow(_unpack, "shard int, piece int, pieces int, fp long").join(labels.select(F.col("id").alias("fp"), "label"), "fp", "left")
    known = known.select("shard", "piece", "fp", F.coalesce("label", "fp").alias("label"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")).where("piece <> other")
    tasks = known.select("shard", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "fp", "label")
    both = cut(found.union(tasks.groupBy("shard", "i", "j").applyInArrow(_meet, "a long, b long")), "simhash-links")
    release(sent, found, labels)
    return both


def near_duplicates(docs: DataFrame, **limits: int) -> DataFrame:
    """docs: doc_id, text. One row per row of docs: doc_id, fp (signed), fingerprint (16 hex digits), component_id. limits: those of `links`."""
    told = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-fingerprints")
    points = cut(told.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-points")
    found = links(points, **limits)
    labels = components(found, "a", "b")
    named = points.join(labels.select(F.col("id").alias("fp"), "label"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    final = cut(named.join(least, "label").select("fp", "component"), "simhash-components")
    release(points, found, labels)
    final = F.broadcast(final) if final.count() <= MAX_BROADCAST else final
    fingerprint_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return told.join(final, "fp", "left").select("doc_id", "fp", fingerprint_, F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
