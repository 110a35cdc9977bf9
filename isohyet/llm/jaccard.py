"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two sets of sizes a <= b with Jaccard at least
num/den differ in at most d = (a + b)(den - num)/(den + num) elements. Sizes fall into bands; a set takes part in its own
band and, if a partner could lie there, in the next. In a band the hash range is cut into n1 parts of n2 subparts; sets
that differ in at most d elements differ by one at most (k2 = 1) in any part but d // 2 of them, so of any d // 2 + 1 + t
parts at least 1 + t agree on all subparts but one. Each set signs, of its first d(size) // 2 + 1 + t parts, every subset
of n2 - 1 subparts. n2 is what a band's cost table says (`scheme`): more subparts are more signatures, but wider and so
rarer ones. With n2 = 2 the subsets are single subparts, any d + 1 + t of which hold 1 + t that agree.
Empty subsets agree without meaning; a set signs them only when so many of its parts have some (more than its slack t)
that no full one need agree, and a partner for which that matters has as many. No pair at or above the threshold is lost.

Equal sets are one class from the start. Classes that share a signature are tied to the smallest of them, their center.
Tasks sign in lots; a signature that HOT classes of a lot have sends one entry for the lot, its smallest class, and its
members travel apart from each other, in pieces. They find their center by a join on the signature, which Spark may split,
so that a signature of N near copies is never gathered in one task. Sets are first compared with their center alone, so
thousands of near copies cost thousands of comparisons. All sets tied to a center that is left with several components
are then compared pair by pair between components, in blocks: sets that share a signature have its center in common.
Before sets are fetched, pairs are dropped by size and by parity sketches (four to eight bits a shingle: differing
bits are a lower bound of the difference, so none is lost). What is left is decided by the exact intersection. Only
signatures, sketches and the sets of pairs that pass are shuffled; nothing but counts reaches the driver.

Defined results: texts that are null or have no words have an empty set and link with nothing. Rows with a null id take
no part in links and have a null component. Repeated rows stay and share a component. Hashes are 64-bit: two different
shingles of one pair of documents collide with a probability near n^2 / 2^64.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut, lean, release, trim

WORDS, NUM, DEN = 5, 80, 100
#: Bytes of one signature entry; bytes a bucket of signatures should hold; entries signed together; classes a task remembers.
_ENTRY, _BUCKET_BYTES, _FLUSH, _SEEN = 16, 2 << 20, 1 << 19, 1 << 17
#: Classes of one lot from which on a signature is hot; pairs of a piece of its members; hot signatures that are broadcast, counted first.
HOT, _PIECE, _HOT_BROADCAST = 32, 1 << 15, 200_000
#: Ids of documents whose sets are fetched are broadcast up to this many, counted first.
MAX_BROADCAST = 500_000
#: Members of a block of a group; nearest classes of other components compared in each round, None for all.
_BLOCK, ROUNDS = 1024, (2, 16, None)
_U = np.uint64
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEAR = 64


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return mix(np.arange(_NEAR * 256, dtype=np.uint64) + _U(1 << 40))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes; each byte counts with its place in its word, A-Z as a-z."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(np.r_[0, starts].astype(np.int32), np.diff(np.r_[0, starts, len(data)]))
    code = (place.astype(np.int64) << 8) | _LOWER[data]
    far = place >= _NEAR
    value = _byte_table()[np.where(far, 0, code)]
    if far.any():
        value[far] = mix(code[far].astype(np.uint64) + _U(1 << 40))
    value[space] = 0
    return starts, mix(np.add.reduceat(value, starts))


def shingle_sets(texts: pa.Array, segment: int = 1 << 17):
    """Sorted distinct shingle hashes (uint64) of each text, whole texts, in order."""
    texts = texts.cast(pa.large_binary())
    group, size = [], 0
    for t in texts:
        raw = t.as_py() or b""
        if group and size + len(raw) > segment:
            yield from _sets(group, segment)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _sets(group, segment)


def _sets(group: list[bytes], segment: int):
    blob = np.frombuffer(b" ".join(group), np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(blob):  # long texts in pieces that end with white space
        b = min(a + 2 * segment, len(blob))
        while b < len(blob) and not _SPACE[blob[b - 1]]:
            gap = np.flatnonzero(_SPACE[blob[b : b + segment]])
            b = b + int(gap[0]) + 1 if len(gap) else min(b + segment, len(blob))
        s, h = word_hashes(blob[a:b])
        starts.append(s + a)
        hashes.append(h)
        a = b
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ends = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group]))
    begin = np.r_[0, ends[:-1]]
    full = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        full = words[: len(words) - WORDS + 1] * _MULT[0]
        for k in range(1, WORDS):
            full = full + words[k : len(words) - WORDS + 1 + k] * _MULT[k]
        full = mix(full)
    for a, b in zip(begin, ends, strict=True):
        if b - a >= WORDS:
            h = np.sort(full[a : b - WORDS + 1])
            yield h[np.r_[True, h[1:] != h[:-1]]]
        elif b > a:
            yield mix(np.array([sum(int(w) * int(m) for w, m in zip(words[a:b], _MULT, strict=False)) + int(b - a) * 977 & (1 << 64) - 1], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def class_of(h: np.ndarray) -> int:
    """One signed 64-bit number for the whole set."""
    return int(mix(np.array([(int(mix(h ^ _MULT[1]).sum(dtype=np.uint64)) + len(h) * 0x9E3779B1) & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def sketch(h: np.ndarray) -> bytes:
    """Parities of the elements' counts in 2^k cells by their low bits, at least four cells an element, as 64-bit words."""
    k = max(6, math.ceil(math.log2(max(1, len(h)))) + 2)
    return np.packbits((np.bincount((h & _U((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1).astype(np.uint8)).tobytes()


def folded(s: bytes, words: int) -> np.ndarray:
    """A sketch folded to so many words."""
    x = np.frombuffer(s, "<u8")
    return x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def bits_apart(x: bytes, y: bytes) -> int:
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


# Bands of sizes. Band 0 starts at the smallest size that can link with a different set.
def least_partner(s: int) -> int:
    return -(-s * NUM // DEN)


@lru_cache(maxsize=None)
def band(j: int) -> tuple[int, int]:
    """First and last size of band j."""
    low = DEN // (DEN - NUM) - 1 if j == 0 else band(j - 1)[1] + 1
    return low, low * DEN * DEN // (NUM * NUM)


def difference(x: int, j: int) -> int:
    """In how many elements a set of size x and a partner in band j differ at most."""
    return min(x * (DEN - NUM) // NUM, (x + band(j)[1]) * (DEN - NUM) // (DEN + NUM))


#: Elements a set shares by chance (a quoted passage) as a share of it, and what a false candidate costs in signatures.
_COMMON, _FALSE = 0.5, 16.0


def parts_of(x: int, j: int, n2: int) -> tuple[int, int]:
    """Parts that a set of size x signs in band j with n2 subparts, and its slack."""
    d = difference(x, j)
    slack = d // 4 + 2 if n2 == 2 else d // 8 + 1
    return (d if n2 == 2 else d // 2) + 1 + slack, slack


@lru_cache(maxsize=None)
def scheme(j: int) -> int:
    """n2 of band j: the cheapest by signatures and the false candidates they bring, of those whose subsets are seldom empty."""
    low, top = band(j)

    def cost(n2: int) -> float:
        parts, slack = parts_of(top, j, n2)
        subsets, held = (1, low / parts) if n2 == 2 else (n2, low / parts * (n2 - 1) / n2)
        if n2 > 2 and parts * subsets * math.exp(-held) > (1 + slack) / 2:
            return math.inf
        return parts * subsets * (1 + _FALSE * _COMMON**held)

    return min((2, 3, 4), key=cost)


@lru_cache(maxsize=100_000)
def shape(s: int, j: int) -> tuple[int, int, int, int]:
    """For a set of size s in band j: subparts of a part, parts of the range, parts it signs, how many with an empty subset make it sign these."""
    n2 = scheme(j)
    return n2, parts_of(band(j)[1], j, n2)[0], parts_of(s, j, n2)[0], 1 + parts_of(least_partner(s), j, n2)[1]


def bands_of(s: int) -> list[int]:
    j = 0
    if s < least_partner(band(0)[0]):
        return []
    while band(j)[1] < s:
        j += 1
    return [j, j + 1] if s >= least_partner(band(j + 1)[0]) else [j]


def signatures(h: np.ndarray) -> np.ndarray:
    """The signatures of a set, as 64-bit numbers that carry band, part and subset."""
    out = []
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _MULT[2]), dtype=np.uint64)])
    for j in bands_of(len(h)):
        n2, parts, signed, many = shape(len(h), j)
        cells = 1 if n2 == 2 else n2
        edges = np.arange(signed * cells + 1, dtype=np.uint64) * _U((1 << 64) // (parts * cells))
        at = np.searchsorted(h, edges)
        if signed == parts:
            at[-1] = len(h)
        content, held = (total[at[1:]] - total[at[:-1]]).reshape(signed, cells), (at[1:] - at[:-1]).reshape(signed, cells)
        if cells > 1:  # all subparts of a part but one
            content, held = content.sum(axis=1, keepdims=True, dtype=np.uint64) - content, held.sum(axis=1, keepdims=True) - held
        full = held > 0
        place = np.arange(signed * cells, dtype=np.uint64).reshape(signed, cells) + _U((j + 1) << 32)
        sig = mix(content + mix(place))
        out.append(sig.ravel() if signed - full.all(axis=1).sum() >= many else sig[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _describe(batches):
    for b in batches:
        ids, texts = _columns(b, ["doc_id", "text"])
        n, fp, marks = [], [], []
        for h in shingle_sets(texts):
            n.append(len(h))
            fp.append(class_of(h) if len(h) else None)
            marks.append(sketch(h) if bands_of(len(h)) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "n", "fp", "sketch"])
    trim()


_PAIR = np.dtype([("s", "<u8"), ("f", "<i8")])


def _packed(to: np.ndarray, pairs: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Pairs by their buckets: ascending buckets and what goes to each."""
    order = np.argsort(to, kind="stable")
    to, pairs = to[order], pairs[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(to)]
    return to[starts].tolist(), [pairs[a:b].tobytes() for a, b in zip(starts, ends, strict=False)]


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Distinct pairs, ordered."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])] if len(first) else np.zeros(0, bool)
    out = np.empty(int(new.sum()), _PAIR)
    out["s"], out["f"] = first[new].view(np.uint64), second[new]
    return out


def _starts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each signature begins in ordered (signature, class) and how many classes it has."""
    s = entries["s"]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(s)])


def _part(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a lot's distinct, ordered (signature, class): the entries to send; those of them that stand for hot signatures; these signatures' members."""
    starts, sizes = _starts(entries)
    hot = sizes >= HOT
    within = np.repeat(hot, sizes)
    first = np.zeros(len(entries), bool)
    first[starts] = True
    return entries[first | ~within], entries[starts[hot]], entries[within]


def _sign(buckets: int):
    """Signatures in lots, to the buckets of signatures; members of hot ones to buckets of their own."""

    def flush(sigs, fps):
        lot, hot, members = _part(_paired(np.concatenate(sigs).view(np.int64), np.repeat(np.array([x for x, _ in fps], np.int64), [k for _, k in fps])))
        of = lambda x: ((x >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        rows = [(k, x, None, None) for k, x in zip(*_packed(of(lot["s"]), lot), strict=True)]
        rows += [(k, None, x, None) for k, x in zip(*_packed(of(hot["s"]), hot), strict=True)]
        for a in range(0, len(members), _PIECE):
            piece = members[a : a + _PIECE]
            rows.append((-1 - int(mix(piece["s"][:1] ^ piece["f"][:1].view(np.uint64))[0] >> _U(2)), None, None, piece.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "entries", "hot", "members"])

    def run(batches):
        seen: set[int] = set()
        sigs, fps, held = [], [], 0
        for b in batches:
            for h in shingle_sets(_columns(b, ["text"])[0]):
                if not bands_of(len(h)) or (f := class_of(h)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(f)
                sigs.append(signatures(h))
                fps.append((f, len(sigs[-1])))
                held += len(sigs[-1])
                if held >= _FLUSH:
                    yield flush(sigs, fps)
                    sigs, fps, held = [], [], 0
        if held:
            yield flush(sigs, fps)
        trim()

    return run


_GROUPS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
#: What a row of _group says: a center and a class tied to it; a hot signature and its center; a hot signature and a member.
_TIED, _CENTER, _MEMBER = 0, 1, 2


def _group(t: pa.Table) -> pa.Table:
    """A bucket's pairs. Each once, but for members, of whom each lot tells."""
    held = {c: _paired(*_joined([np.frombuffer(x.as_buffer(), _PAIR) for x in t[c] if x.is_valid])) for c in ("entries", "hot", "members")}
    entries = held["entries"]
    starts, sizes = _starts(entries)
    many = np.repeat(sizes > 1, sizes)
    tied = _paired(np.repeat(entries["f"][starts], sizes)[many], entries["f"][many])
    hot = np.unique(held["hot"]["s"])
    center = entries["f"][np.searchsorted(entries["s"].view(np.int64), hot.view(np.int64))] if len(hot) else np.zeros(0, np.int64)
    a = np.concatenate([tied["s"].view(np.int64), hot.view(np.int64), held["members"]["s"].view(np.int64)])
    b = np.concatenate([tied["f"], center, held["members"]["f"]])
    return pa.table([np.repeat(np.array([_TIED, _CENTER, _MEMBER], np.int32), [len(tied), len(hot), len(held["members"])]), a, b], schema=_GROUPS)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.concatenate(parts) if parts else np.zeros(0, _PAIR)
    return raw["s"].view(np.int64), raw["f"]


def _may_link(n1, n2, apart) -> np.ndarray:
    return (apart * (DEN + NUM) <= (n1 + n2) * (DEN - NUM)) & (np.minimum(n1, n2) * DEN >= np.maximum(n1, n2) * NUM)


def _prune(batches):
    for b in batches:
        n1, n2, s1, s2 = _columns(b, ["n1", "n2", "s1", "s2"])
        apart = np.array([bits_apart(x, y) for x, y in zip(s1.to_pylist(), s2.to_pylist(), strict=True)], np.int64)
        keep = _may_link(n1.to_numpy(), n2.to_numpy(), apart)
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _pairs(keep: int):
    """From blocks of groups: for each class its `keep` nearest classes of other components that may link, by sketches."""

    def run(t: pa.Table) -> pa.Table:
        names = ("gid", "i", "j", "fp", "label", "n")
        gid, bi, bj, fp, label, n = (t[c].to_numpy() for c in names)
        one, two = (t[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
        marks = t["sketch"].to_pylist()
        order = np.lexsort((bj, bi, gid))
        new = np.r_[True, (np.diff(gid[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)]
        starts = np.r_[np.flatnonzero(new), len(order)]
        found = []
        for a, b in zip(starts, starts[1:], strict=False):
            at = order[a:b]
            words = min(len(marks[k]) for k in at) // 8
            folds = np.stack([folded(marks[k], words) for k in at])
            left, right = np.flatnonzero(one[at]), np.flatnonzero(two[at])
            f, l, m = fp[at], label[at], n[at]
            apart = np.zeros((len(left), len(right)), np.int64)
            for c in range(0, words, 256):  # bits apart, some columns at a time
                some = np.ascontiguousarray(folds[:, c : c + 256])
                for k, x in enumerate(left):
                    apart[k] += np.bitwise_count(some[x] ^ some[right]).sum(axis=1, dtype=np.int64)
            ok = _may_link(m[left][:, None], m[right], apart) & (l[left][:, None] != l[right])
            if not ok.any():
                continue
            # Each pair is put forward by the member whose component is the smaller one here.
            counts = dict(zip(*np.unique(l, return_counts=True), strict=True))
            rank = np.argsort(np.lexsort((l, np.array([counts[v] for v in l]))))
            by_left = rank[left][:, None] < rank[right]
            far = apart / (m[left][:, None] + m[right])
            for d, x, y in ((np.where(ok & by_left, far, np.inf), left, right), (np.where(ok & ~by_left, far, np.inf).T, right, left)):
                some = np.flatnonzero(d.min(axis=1) < np.inf)
                k = min(keep, d.shape[1] - 1)
                best = np.argpartition(d[some], k, axis=1)[:, : k + 1] if k < d.shape[1] - 1 else np.tile(np.arange(d.shape[1]), (len(some), 1))
                value = np.take_along_axis(d[some], best, axis=1)
                i, j = np.nonzero(value < np.inf)
                found.append((f[x[some[i]]], f[y[best[i, j]]], value[i, j]))
        if not found:
            return _NEAR_PAIRS.empty_table()
        x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
        first = np.unique(np.stack([x, y]), axis=1, return_index=True)[1]
        return pa.table([x[first], y[first], d[first].astype(np.float64)], schema=_NEAR_PAIRS)

    return run


_NEAR_PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("far", pa.float64())])


def _fetch(batches):
    for b in batches:
        fps, sets = [], []
        for h in shingle_sets(_columns(b, ["text"])[0]):
            fps.append(class_of(h) if len(h) else 0)
            sets.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "items"])
    trim()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, label: each node of the edges with the smallest node it can reach. Smallest labels spread and are followed at once."""
    both = cut(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(b, a)).distinct(), "component-edges")
    labels = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("label"))
    last = cut(labels, "component-labels")
    while True:
        labels = last.select("id", "label")
        seen = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        moved = labels.join(seen, labels["id"] == seen["src"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = cut(moved.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "component-labels")
        release(last)
        last = after
        if after.where("old <> label").isEmpty():
            release(both)
            return after


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b of classes whose exact Jaccard reaches the threshold. Each class's set comes from one of its texts."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    needed = cut(needed.join(classes.select("fp", F.col("rep").alias("doc_id")), "fp"), "jaccard-needed")
    ids = needed.select("doc_id").distinct()
    if needed.count() <= MAX_BROADCAST:
        ids = F.broadcast(ids)
    sets = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_fetch, "fp long, items array<long>")
    sets = cut(sets.join(needed.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "jaccard-sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    links = cut(both.where(F.col("i") * DEN >= (F.col("n") - F.col("i")) * NUM).select("a", "b"), "jaccard-links")
    release(needed, sets)
    return links


def _tie(docs: DataFrame, buckets: int) -> DataFrame:
    """center, fp: each class that shares a signature with a smaller one and the smallest that has this signature, which is also tied to itself."""
    signed = docs.select("text").mapInArrow(_sign(buckets), "bucket long, entries binary, hot binary, members binary")
    told = cut(signed.groupBy("bucket").applyInArrow(_group, "kind int, a long, b long"), "jaccard-told")
    centers = cut(told.where(F.col("kind") == _CENTER).select("a", F.col("b").alias("center")), "jaccard-hot")
    few = F.broadcast(centers) if centers.count() <= _HOT_BROADCAST else centers
    hot = told.where(F.col("kind") == _MEMBER).select("a", F.col("b").alias("fp")).join(few, "a").select("center", "fp")
    groups = cut(told.where(F.col("kind") == _TIED).select(F.col("a").alias("center"), F.col("b").alias("fp")).union(hot).distinct(), "jaccard-groups")
    release(told, centers)
    return groups


def _open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """gid, fp, label, blocks of the members of groups that are still in several components."""
    label = labels.select(F.col("id").alias("fp"), "label")
    told = groups.join(label, "fp", "left").select(F.col("center").alias("gid"), "fp", F.coalesce("label", "fp").alias("label"))
    open_ = told.groupBy("gid").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return cut(told.join(open_.select("gid", F.ceil(F.col("members") / _BLOCK).cast("int").alias("blocks")), "gid"), "jaccard-members")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class (equal sets share it), component_id."""
    with lean(docs.sparkSession):
        return _join_components(docs, doc_id, text)


def _join_components(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = cut(docs.mapInArrow(_describe, "doc_id long, n long, fp long, sketch binary"), "jaccard-described")
    classes = described.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = cut(classes, "jaccard-classes")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, math.ceil(shingles * _ENTRY / _BUCKET_BYTES))

    groups = _tie(docs.where("doc_id is not null"), buckets)

    known = classes.where("sketch is not null").select("fp", "n", "sketch")
    one = known.select(F.col("fp").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = known.select(F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    stars = groups.where("center <> fp").select(F.col("center").alias("a"), F.col("fp").alias("b"))
    stars = stars.join(one, "a").join(two, "b").where(f"least(n1, n2) * {DEN} >= greatest(n1, n2) * {NUM}")
    stars = cut(stars.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(_prune, "a long, b long"), "jaccard-stars")
    links = _linked(docs, stars, classes)
    labels, kept = components(links, "a", "b"), [links]

    # Groups whose sets are still in several components hold pairs that the stars have not compared. Each class first meets its nearest
    # few of other components, which joins most of them; the last round takes whatever pairs are left between components.
    tested, spent = stars, [stars]
    for keep in ROUNDS:
        members = _open_groups(groups, labels)
        if members.isEmpty():
            release(members)
            break
        rows = members.select(F.col("gid"), "fp", "label", "blocks").join(known, "fp")
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("gid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") >= F.col("other")).alias("second"), "fp", "label", "n", "sketch")
        near = rows.groupBy(F.xxhash64("gid", "i", "j").alias("block")).applyInArrow(_pairs(keep or 1 << 30), "x long, y long, far double")
        near = near.groupBy("x", "y").agg(F.min("far").alias("far"))
        if keep:
            near = near.withColumn("k", F.row_number().over(W.partitionBy("x").orderBy("far", "y")))
        near = cut(near, "jaccard-near")
        more = (near.where(F.col("k") <= keep) if keep else near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        more = cut(more.join(tested, ["a", "b"], "left_anti"), "jaccard-more")
        found = _linked(docs, more, classes)
        last = not keep or near.where(F.col("k") > keep).isEmpty()
        release(members, near)
        spent.append(more)
        kept.append(found)
        if not found.isEmpty():
            links = links.union(found)
            release(labels)
            labels = components(links, "a", "b")
        if last:
            break
        tested = tested.union(more)
    release(groups, labels, *spent)

    ids = classes.select("fp", "rep")
    named = links.join(ids.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    reached = components(named.where("x <> y"), "x", "y")
    final = ids.join(reached.select(F.col("id").alias("rep"), "label"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component"))
    final = cut(final, "jaccard-components")
    release(classes, reached, *kept)
    out = described.select("doc_id", "n", "fp").join(final, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("fp").alias("class"), component.alias("component_id"))
