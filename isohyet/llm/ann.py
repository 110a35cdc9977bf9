"""Approximate nearest neighbours by inner product over learned partitions.

Fitting, on the driver, on at most SAMPLE distinct vectors (those with the smallest hash of their id): a graph of each
vector's GRAPH_K nearest is cut into PARTS balanced parts by recursive bisection (split at the median of a slow
eigenvector of the graph, then swaps that cut fewer edges); a small network learns to predict in which parts a vector's
neighbours lie; and the number of parts to probe is the least that finds TARGET_RECALL of the
neighbours of other vectors, up to HELD, that neither graph nor network has seen.

Indexing covers every row: its most probable part, in blocks of bounded size, so that a part in which one vector makes
up a third of all rows is split too. A query goes to the blocks of its most probable parts, to more of them where
these hold too few rows, and is reranked there by the exact inner product. The model (a few thousand floats) is all that travels to every task.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; of
rows with one id the smallest counts. Shorter vectors count as filled up with zeros. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut
from .vectors import BLOCK_QUERIES, BLOCK_ROWS, best, finite, matrix, one_per_id, select_top

#: Bound of the sample the index is fitted on, the graph's degree, and the parts.
SAMPLE, GRAPH_K, PARTS = 6000, 16, 32
#: Most vectors beside the sample that probes are chosen on; of small tables a sixth.
HELD = 1000
HIDDEN, EPOCHS, TARGET_RECALL = 96, 40, 0.95
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def neighbours(x: np.ndarray, k: int, rows: int | None = None) -> np.ndarray:
    """Row numbers of the k largest inner products of each of the first `rows` rows (of all), itself left out."""
    k, rows = min(k, len(x) - 1), len(x) if rows is None else rows
    out = np.empty((rows, k), np.int64)
    for a in range(0, rows, 512):
        s = x[a : min(a + 512, rows)] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + 512]
    return out


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes, of sizes one apart at most, with few edges a-b between them."""
    local = np.full(n, -1)
    local[nodes] = np.arange(len(nodes))
    keep = (local[a] >= 0) & (local[b] >= 0)
    u, v, m = local[a[keep]], local[b[keep]], len(nodes)
    degree = np.bincount(u, minlength=m) + 1.0
    f = rng.standard_normal(m)
    for _ in range(60):  # the second eigenvector of the lazy walk
        f -= (f * degree).sum() / degree.sum()
        f = (f * degree + np.bincount(u, weights=f[v], minlength=m)) / (2 * degree)
        f /= np.abs(f).max() + 1e-30
    side = np.zeros(m, bool)
    side[np.argsort(f, kind="stable")[m // 2 :]] = True
    for _ in range(20):  # swap the nodes whose moves cut the most edges, in pairs
        gain = np.bincount(u, weights=np.where(side[u] != side[v], 1.0, -1.0), minlength=m)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        size = min(len(left), len(right))
        good = int((gain[left[:size]] + gain[right[:size]] > 2).sum())
        if not good:
            break
        good = max(1, good // 4)
        side[left[:good]], side[right[:good]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(near: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """A part for each node of the graph; all parts nearly equal."""
    n, rng = len(near), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [h for g in groups for h in bisect(g, a, b, n, rng)]
    out = np.empty(n, np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.maximum(x @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, seed: int) -> dict:
    """One hidden layer, Adam, cross entropy against the soft labels y."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], y.shape[1]
    scale = math.sqrt(2 / d)
    p = {"w1": rng.standard_normal((d, HIDDEN)) * scale / max(1e-9, x.std() * math.sqrt(d)), "b1": np.zeros(HIDDEN), "w2": rng.standard_normal((HIDDEN, m)) * 0.05, "b2": np.zeros(m)}
    first, second, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            at = order[a : a + 128]
            h = np.maximum(x[at] @ p["w1"] + p["b1"], 0)
            z = h @ p["w2"] + p["b2"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - y[at]) / len(at)
            dh = (dz @ p["w2"].T) * (h > 0)
            grads = {"w1": x[at].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ dz + 1e-4 * p["w2"], "b2": dz.sum(0)}
            t += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 0.004 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return p


def fit(x: np.ndarray, parts: int = PARTS, seed: int = 5, recall: float = TARGET_RECALL) -> dict:
    """The router for distinct vectors x, with `probes`, the number of parts to search: chosen on a part of x left out of the training."""
    d = x.shape[1]
    order = np.random.default_rng(seed).permutation(len(x))
    every, aside = x[order], min(HELD, len(x) // 6)
    x = every[aside:]
    while parts > 1 and len(x) < 4 * parts:
        parts //= 2
    if parts == 1:
        return {"w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 1)), "b2": np.zeros(1), "probes": 1}
    near = neighbours(x, GRAPH_K)
    part = balanced_parts(near, parts, seed)
    y = np.zeros((len(x), parts))
    np.add.at(y, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    y[np.arange(len(x)), part] += near.shape[1] / 2
    model = train(x, y / y.sum(axis=1, keepdims=True), seed)
    p = probabilities(model, every)
    home = p.argmax(axis=1)
    position = np.argsort(np.argsort(-p[:aside], axis=1), axis=1)
    near = neighbours(every, GRAPH_K, aside)
    rank = position[np.repeat(np.arange(aside), near.shape[1]), home[near].ravel()]
    found = np.cumsum(np.bincount(rank, minlength=parts)) / len(rank)
    return model | {"probes": int(np.searchsorted(found, recall) + 1)}


def exact_products(queries: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that equal vectors get equal scores."""
    out = np.zeros(len(i))
    for d in range(rows.shape[1]):
        out += queries[i, d] * rows[j, d]
    return out


def _search_block(queries: pa.Table, rows: pa.Table, k: int, width: int) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        return _FOUND.empty_table()
    rows = rows.sort_by("id")
    ids, q_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
    x, q, out = matrix(rows["vector"], width), matrix(queries["vector"], width), []
    for a in range(0, len(q), 128):
        chunk, names = q[a : a + 128], q_ids[a : a + 128]
        scores = chunk @ x.T
        own = np.searchsorted(ids, names)
        mine = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == names))
        scores[mine, own[mine]] = -np.inf
        if len(ids) > k:  # all that could be among the best whatever the rounding, then in the exact order
            margin = 1e-9 * (np.abs(chunk).sum(axis=1) * np.abs(x).max() + 1e-300)
            keep = scores >= (np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - margin)[:, None]
            keep &= scores > -np.inf
        else:
            keep = scores > -np.inf
        i, j = np.nonzero(keep)
        exact = exact_products(chunk, x, i, j)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        out.append(pa.table([names[i[top]], ids[j[top]], exact[top]], schema=_FOUND))
    return pa.concat_tables(out)


def search(df: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", recall: float = TARGET_RECALL, seed: int = 5) -> DataFrame:
    """The rows of df for which is_query(Column of the id) holds, each against all other rows. Returns query_id, rank, vec_id, score."""
    clean = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    clean = clean.where(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    rows = one_per_id(clean)
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE + HELD).toArrow()
    x = np.unique(matrix(sample["vector"], width), axis=0) if sample.num_rows else np.zeros((0, width))
    model = fit(x, seed=seed, recall=recall)

    def route(batches):
        for b in batches:
            p = probabilities(model, matrix(b["vector"], width))
            ranked = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, ranked.shape[1], dtype=np.int32)), pa.array(ranked.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], b["vector"], lists], ["id", "vector", "parts"])

    index = cut(rows.mapInArrow(route, "id long, vector array<double>, parts array<int>"), "ann-index")
    home = F.element_at("parts", 1)
    held = {r["part"]: r["n"] for r in index.groupBy(home.alias("part")).agg(F.count("*").alias("n")).collect()}
    # The first `probes` parts, and more until they hold k rows beside the query's own or are all.
    counts = F.array(*[F.lit(held.get(p, 0)).cast("long") for p in range(PARTS)])
    none = F.struct(F.array().cast("array<int>").alias("p"), F.lit(0).cast("long").alias("n"))
    more = lambda acc, part: F.when((F.size(acc["p"]) < model["probes"]) | (acc["n"] <= k), F.struct(F.concat(acc["p"], F.array(part)).alias("p"), (acc["n"] + F.element_at(counts, part + 1)).alias("n"))).otherwise(acc)
    queries = index.where(is_query(F.col("id"))).select("id", "vector", F.explode(F.aggregate("parts", none, more)["p"]).alias("part"))
    asked = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.array(*[F.lit(max(1, math.ceil(held.get(p, 0) / BLOCK_ROWS))) for p in range(PARTS)])
    groups = F.array(*[F.lit(max(1, math.ceil(asked.get(p, 0) / BLOCK_QUERIES))) for p in range(PARTS)])
    of = lambda array, part: F.element_at(array, part + 1)
    spread = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    part = F.col("part")
    right = index.withColumn("part", home).select("id", "vector", "part", spread(2, of(blocks, part)).alias("cb"), F.explode(F.sequence(F.lit(0), of(groups, part) - 1)).alias("qb"))
    left = queries.where(part.isin([p for p in held]))
    left = left.select("id", "vector", "part", spread(1, of(groups, part)).alias("qb"), F.explode(F.sequence(F.lit(0), of(blocks, part) - 1)).alias("cb"))
    keys = ["part", "cb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda q, c: _search_block(q, c, k, width), "query_id long, vec_id long, score double")
    return best(found, k)
