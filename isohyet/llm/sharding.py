"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes. DataFrame functions only.

Rows fall into P blocks by a hash of their identity and, where rows are equal, of their number among the equal ones, so
that copies are as free of each other as any rows, and a third of all rows being equal is no hot key. The driver draws the P x S matrix of how many rows of each
block go to each shard, exactly as a uniform random permutation would send them: shard by shard for one block
after another, each a hypergeometric draw from what is left. Each block permutes its rows locally, cuts them by
its row of the matrix, exchanges, and each shard permutes again in pieces. Shard sizes differ by one row at most.

Everything is drawn from the seed and block counts, and blocks come from hashes, not from physical partitions,
so a recomputed task yields the same rows. The matrix and the table of pieces have CELLS longs at most, so that they may
be broadcast; blocks grow with the input, but a block is a hash bucket of rows, not a key, and holds N / P rows.

Defined results: a null text has no bytes (size 1, crc32 0). Rows with null or repeated ids are placed like others;
of rows that identity does not tell apart, which gets which place is arbitrary. An empty table has no rows. More shards
than rows: the first ones get a row each.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut, release

#: Rows a block should hold, and cells of a table that may be broadcast.
BLOCK_ROWS, CELLS = 20_000, 1 << 20
#: Repeated identities are broadcast up to this many, counted first.
MAX_BROADCAST = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls from an urn are good: inversion from the mode outwards, by ratios of probabilities."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) + 1
    a, b = max(low, mode - int(14 * spread) - 10), min(high, mode + int(14 * spread) + 10)
    up = np.arange(mode, b, dtype=np.float64)
    down = np.arange(mode, a, -1, dtype=np.float64)
    right = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    left = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([left[::-1], [1.0], right])
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return a + int(min(at, len(weights) - 1))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each block sends to each shard; rows sum to the block's count, columns to sizes one apart at most."""
    rng, total = random.Random(seed), sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, need, rest = [], n, sum(left)
        for s in range(shards):
            rest -= left[s]
            got = hypergeometric(rng, left[s], rest, need)
            row.append(got)
            need -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _literal(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table from a JSON literal; the rows are as bounded as the matrix."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def number_among_equal(df: DataFrame, identity: list[str]) -> DataFrame:
    """df, a table of cut, with __id, a hash of identity, and __k: the row's number among rows of equal identity, from 0 without gaps.

    Equal rows are counted file by file, so that a file's rows are numbered from where the files before it end: no group
    is gathered, whatever part of all rows it is.
    """
    names = df.columns
    rows = df.select(*names, F.xxhash64(*identity).alias("__id"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    repeated = cut(rows.groupBy("__id").count().where("count > 1").select("__id"), "shard-repeated")
    many = repeated.count()
    if not many:
        release(repeated)
        return rows.select(*names, "__id", F.lit(0).cast("long").alias("__k"))
    listed = F.broadcast(repeated) if many <= MAX_BROADCAST else repeated
    again = rows.join(listed, "__id", "left_semi")
    per_file = again.groupBy("__id", "__file").count()
    starts = per_file.withColumn("__start", F.sum("count").over(W.partitionBy("__id").orderBy("__file")) - F.col("count")).drop("count")
    again = again.withColumn("__n", F.row_number().over(W.partitionBy("__id", "__file").orderBy("__at")) - 1).join(starts, ["__id", "__file"])
    numbered = again.select(*names, "__id", (F.col("__start") + F.col("__n")).cast("long").alias("__k"))
    return rows.join(listed, "__id", "left_anti").select(*names, "__id", F.lit(0).cast("long").alias("__k")).union(numbered)


def number_equal(df: DataFrame, identity: list[str]) -> DataFrame:
    """df, a table of cut, with __key: a hash of identity and of the row's number among rows of equal identity."""
    return number_among_equal(df, identity).select(*df.columns, F.xxhash64("__id", "__k").alias("__key"))


def shuffle_into_shards(df: DataFrame, identity: list[str], shards: int = 16, seed: int = 17) -> DataFrame:
    """df with shard (0 .. shards-1) and slot (gapless from 0 in each shard).

    identity: columns that tell rows apart. df should be narrow, or carry keys to join back on: it is written once
    in the shared folder, as each pass must see the same rows. Columns named shard or slot are replaced.
    """
    if not 0 < shards <= CELLS // 16:
        raise ValueError(f"shards: 1 to {CELLS // 16}")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    written = cut(df.select(*names), "shard-rows")
    total = written.count()
    blocks = min(CELLS // shards, max(16, math.ceil(total / BLOCK_ROWS)))
    pieces = min(CELLS // shards, max(4, math.ceil(total / shards / BLOCK_ROWS)))
    rows = cut(number_equal(written, identity).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(blocks)).cast("int")), "shard-blocks")
    release(written)
    counted = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}
    ids = sorted(counted)
    matrix = communication_matrix([counted[b] for b in ids], shards, seed)
    cuts = [{"__block": b, "__cuts": [int(x) for x in np.cumsum(row)]} for b, row in zip(ids, matrix, strict=True)]
    cuts = _literal(df, cuts, "__block:int,__cuts:array<bigint>")

    local = W.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 1), "__key"), "__key", *identity)
    sent = rows.withColumn("__rank", F.row_number().over(local)).join(F.broadcast(cuts), "__block")
    sent = sent.withColumn("shard", F.size(F.filter("__cuts", lambda x: x < F.col("__rank"))))
    sent = sent.withColumn("__draw", F.xxhash64(F.lit(seed + 2), "__key")).drop("__rank", "__cuts", "__block", "__key")
    # The order of __draw in a shard is cut into pieces by its leading bits, so that no shard is one task.
    sent = sent.withColumn("__piece", F.floor((F.shiftright("__draw", 11) / F.lit(float(1 << 53)) + 0.5) * pieces).cast("int"))
    sent = cut(sent, "shard-sent")
    release(rows)
    sizes = sent.groupBy("shard", "__piece").count()
    starts = sizes.withColumn("__start", F.sum("count").over(W.partitionBy("shard").orderBy("__piece")) - F.col("count")).drop("count")
    slot = F.row_number().over(W.partitionBy("shard", "__piece").orderBy("__draw", *identity)) - 1
    out = sent.withColumn("__slot", slot).join(F.broadcast(starts), ["shard", "__piece"])
    return out.select(*names, "shard", (F.col("__start") + F.col("__slot")).cast("long").alias("slot"))
