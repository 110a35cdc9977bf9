"""What the vector searches share: valid rows, blocks of queries against blocks of rows, and the merge of their best."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a block and queries that meet them in one task, give or take the hash.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def finite(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(ok(x), F.lit(False)))


def one_per_id(df: DataFrame) -> DataFrame:
    """df (id, then other columns) without null ids; of rows with one id, the smallest."""
    rest = [c for c in df.columns if c != "id"]
    return df.where("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The list column's vectors as rows, short ones filled up with zeros."""
    offsets, values = ragged(column)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def row_blocks(rows: DataFrame) -> DataFrame:
    """rows with the number of their block, by a hash of their id."""
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query_id over all blocks, ranked; ties to the smaller vec_id. Each block has sent k at most."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def select_top(scores: np.ndarray, ids: np.ndarray, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest by partition; ties to the smaller id, as ids ascend. Scores at `floor` are out."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = [], []
    for i, (s, x) in enumerate(zip(scores, least, strict=True)):
        at = np.flatnonzero(s >= x)
        at = at[np.argsort(-s[at], kind="stable")][:k]
        at = at[s[at] > floor]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)
