"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: parallel arrays of terms and integer weights. A block of rows, shuffled once, becomes an inverted index.
The queries are files in the shared folder; each block's task reads them a batch at a time, as many times as there are
blocks, so that no row is copied for the queries' sake. A batch goes through the index term by term, each query
scattering its weight times the posting's weight into its dense array of scores; the best k are selected by partition,
and the blocks' bests merged. Every query meets every row; memory is a block, a batch and the scores of CHUNK queries.

Defined results: rows with a null id take no part; of rows with one id the smallest counts; an empty vector scores 0
with all. A query's own row is never its candidate. Ties go to the smaller id. Fewer than k candidates: all of them.
Sums beyond 64 bits count as the largest or smallest number below 2^63 in size; rows and queries that could reach them are
summed apart, in numbers of any length. An empty table has no results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import cut, location
from .storage import batches_of
from .vectors import best, one_per_id, ragged, row_blocks, select_top

#: Queries whose dense score arrays are held at once.
CHUNK = 64
#: Weights of a row, and sums of a query's, from which on products are summed in numbers of any length.
_LARGE = 1 << 31
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def index_postings(terms: np.ndarray, slots: np.ndarray, weights: np.ndarray, n_rows: int) -> dict:
    """{term: (row numbers, weights)}; a list that most rows are on has None for its numbers and a weight, maybe 0, for every row."""
    order = np.argsort(terms, kind="stable")
    terms, slots, weights = terms[order], slots[order], weights[order]
    bounds = [*np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]), len(terms)] if len(terms) else []
    out = {}
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[int(terms[a])] = (slots[a:b], weights[a:b])
        if 2 * (b - a) >= n_rows:
            full = np.zeros(n_rows, weights.dtype)
            np.add.at(full, slots[a:b], weights[a:b])
            out[int(terms[a])] = (None, full)
    return out


def accumulate(query_postings: dict, n_queries: int, postings: dict, n_rows: int, dtype) -> np.ndarray:
    """Scores of the queries against the index, both inverted: term by term, weights scatter into the dense scores."""
    scores, product = np.zeros((n_queries, n_rows), dtype), np.empty((n_queries, n_rows), dtype)
    for term, (rows, weights) in query_postings.items():
        if (found := postings.get(term)) is None:
            continue
        slots, posted = found
        if rows is None and slots is None:
            scores += np.multiply(weights[:, None], posted, out=product)
        elif slots is None:
            scores[rows] += weights[:, None] * posted
        elif rows is None:
            scores[:, slots] += weights[:, None] * posted
        else:
            scores[np.ix_(rows, slots)] += weights[:, None] * posted
    return scores


def _saturated_sums(offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, own_terms: np.ndarray, own_weights: np.ndarray) -> np.ndarray:
    """One vector's inner products with many, exact before they are held to 64 bits."""
    own: dict[int, int] = {}
    for t, w in zip(own_terms.tolist(), own_weights.tolist(), strict=True):
        own[t] = own.get(t, 0) + w
    products = [own.get(t, 0) * w for t, w in zip(terms.tolist(), weights.tolist(), strict=True)]
    most = 2**63 - 1
    return np.array([max(-most, min(most, sum(products[a:b]))) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64)


def _search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        return _FOUND.empty_table()
    ids, q_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
    offsets, terms = ragged(rows["terms"])
    weights = ragged(rows["weights"])[1]
    q_offsets, q_terms = ragged(queries["terms"])
    q_weights = ragged(queries["weights"])[1]
    sizes = lambda o, w, f: np.array([f(np.abs(w[x:y].astype(np.float64)), initial=0) for x, y in zip(o, o[1:], strict=False)])
    # 32 bits hold every partial sum where the largest weight times the heaviest query's sum does not reach them.
    heaviest = np.add.reduceat(np.r_[np.abs(q_weights.astype(np.float64)), 0.0], q_offsets[:-1]).max() if len(q_weights) else 0
    bound = heaviest * float(np.abs(weights.astype(np.float64)).max(initial=0))
    large, q_large = np.zeros(len(ids), bool), np.zeros(len(q_ids), bool)
    if bound >= 2**63 - 1:
        large, q_large = sizes(offsets, weights, np.max) >= _LARGE, sizes(q_offsets, q_weights, np.sum) >= _LARGE
        exact = {k: _saturated_sums(q_offsets, q_terms, q_weights, terms[offsets[k] : offsets[k + 1]], weights[offsets[k] : offsets[k + 1]]) for k in np.flatnonzero(large).tolist()}
        q_exact = {k: _saturated_sums(offsets, terms, weights, q_terms[q_offsets[k] : q_offsets[k + 1]], q_weights[q_offsets[k] : q_offsets[k + 1]]) for k in np.flatnonzero(q_large).tolist()}
        weights, q_weights = np.where(np.repeat(large, np.diff(offsets)), 0, weights), np.where(np.repeat(q_large, np.diff(q_offsets)), 0, q_weights)
    narrow = bound < 2**31 - 1
    dtype = np.int32 if narrow else np.int64
    weights, q_weights = (weights.astype(dtype), q_weights.astype(dtype)) if narrow else (weights, q_weights)
    postings = index_postings(terms, np.repeat(np.arange(len(ids)), np.diff(offsets)), weights, len(ids))
    out, floor = [], np.iinfo(dtype).min
    for at in range(0, len(q_ids), CHUNK):
        end = min(at + CHUNK, len(q_ids))
        a, b = q_offsets[at], q_offsets[end]
        row_of = np.repeat(np.arange(end - at), np.diff(q_offsets[at : end + 1]))
        inverted = index_postings(q_terms[a:b], row_of, q_weights[a:b], end - at)
        scores = accumulate(inverted, end - at, postings, len(ids), dtype)
        for row in np.flatnonzero(large).tolist():
            scores[:, row] = exact[row][at:end]
        for row in np.flatnonzero(q_large[at:end]).tolist():
            scores[row] = q_exact[at + row]
        own = np.searchsorted(ids, q_ids[at:end])
        mine = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids[at:end]))
        scores[mine, own[mine]] = floor
        i, j = select_top(scores, ids, k, floor)
        out.append(pa.table([q_ids[at:end][i], ids[j], scores[i, j].astype(np.int64)], schema=_FOUND))
    return pa.concat_tables(out)


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """queries, rows: id long, terms array<int>, weights array<bigint> without nulls. Returns query_id, rank, vec_id, score."""
    queries, rows = (cut(one_per_id(x.select("id", "terms", "weights")), f"topk-{n}") for x, n in ((queries, "queries"), (rows, "rows")))
    asked = location(queries)

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        found = [_search_block(q, block, k) for q in batches_of(asked, ["id", "terms", "weights"])]
        return pa.concat_tables(found) if found else _FOUND.empty_table()

    found = row_blocks(rows).groupBy("block").applyInArrow(run, "query_id long, vec_id long, score long")
    return best(found, k)
