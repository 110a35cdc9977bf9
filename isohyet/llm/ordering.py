"""Token-id binary output in training order.

Documents' ids are cut into sequences of at most `length`; the sequences are numbered 0 .. N-1 as the table is read, and
a keyed Feistel permutation of [0, N), by cycle-walking from the next power of four, gives each its global slot. Slots
fall into shards of equal counts; each shard is written as one file of fixed-stride records in slot order, so record k
of a shard is at k * stride, any slot can be sought, and reading on from it is sequential.

A record is 16 bytes (document id, part, number of ids with the top bit for a null document id; little-endian) and
`length` ids of `width` bytes, filled up with zeros. The numbering comes from two readings of the same files: the first
counts each partition's sequences, the second checks that it finds the same number. Shard files have the name of the
attempt that wrote them and are listed in a manifest table, so lost tasks leave at worst files nothing refers to.

Defined results: null and empty ids give no sequence. Repeated rows are separate sequences.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .runtime import cut, scratch
from .storage import attempt_name, open_fs

#: Document id, part, number of ids.
_HEADER, _HEADER_BYTES = "<qII", 16
_NULL = 1 << 31
#: Level of zstd for ids on disk between the passes, bytes of a page of them, and bytes of ids that a task compresses together, a block for each shard.
LEVEL, PAGE, TOGETHER = 9, 8 << 20, 16 << 20
_U = np.uint64


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + _U(key)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    return [int(_round(np.array([seed * 64 + r], np.uint64), 0x243F6A8885A308D3)[0]) for r in range(rounds)]


def permute(index: np.ndarray, total: int, keys: list[int]) -> np.ndarray:
    """The slot of each index in [0, total): a bijection."""
    bits = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    low, shift = _U((1 << bits) - 1), _U(bits)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys:
            left, right = right, left ^ (_round(right, k) & low)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= _U(total))):  # cycle-walking: less than four steps expected
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def materialise(df: DataFrame, folder: str, length: int, width: int = 1, shard_bytes: int = 16 << 20, seed: int = 1, doc_id: str = "doc_id", ids: str = "ids", is_table: bool = False) -> DataFrame:
    """Write the sequences of df's packed ids (binary, `width` bytes each) below folder; returns the manifest: shard, file, first_slot, records.

    is_table: df only reads files, so that both passes see the same partitions; otherwise it is written first.
    """
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    if not is_table:
        df = cut(df, "order-ids", **{"compression": "zstd", "parquet.compression.codec.zstd.level": str(LEVEL), "parquet.page.size": str(PAGE)})
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    step, stride, keys = length * width, _HEADER_BYTES + length * width, round_keys(seed)
    per_row = F.ceil(F.coalesce(F.octet_length("ids"), F.lit(0)) / step)
    counted = {r["p"]: r["n"] for r in df.select(F.spark_partition_id().alias("p"), per_row.alias("k")).groupBy("p").agg(F.sum("k").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counted):
        starts[p], total = total, total + counted[p]
    per_shard = max(1, shard_bytes // stride)

    def cut_up(batches):
        p, done = TaskContext.get().partitionId(), 0
        docs, parts, bodies, held = [], [], [], 0
        for b in chain(batches, [None]):
            if docs and (b is None or held >= TOGETHER):
                slots = permute(np.arange(len(docs)) + (starts.get(p, 0) + done), total, keys)
                done += len(docs)
                yield _packed(slots, docs, parts, bodies, per_shard)
                docs, parts, bodies, held = [], [], [], 0
            for d, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if b else ():
                held += len(body or b"")
                for k in range(0, len(body or b""), step):
                    docs.append(d)
                    parts.append(k // step)
                    bodies.append(body[k : k + step])
        if done != counted.get(p, 0):
            raise RuntimeError(f"partition {p} has {done} sequences where {counted.get(p, 0)} were counted: its files have changed")

    def write(t: pa.Table) -> pa.Table:
        shard, rows = t["shard"][0].as_py(), []
        for packed, raw in zip(t["packed"], t["raw"].to_pylist(), strict=True):
            rows += _unpacked(pa.decompress(packed.as_buffer(), raw, "zstd", asbytes=True))
        rows.sort(key=lambda r: r[0])
        first = shard * per_shard
        if [r[0] for r in rows] != list(range(first, min(first + per_shard, total))):
            raise RuntimeError(f"shard {shard} lacks slots")
        fs, root = open_fs(folder)
        name = attempt_name(f"shard-{shard:07d}", ".bin")
        with fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
            for _, d, null, part, body in rows:
                out.write(struct.pack(_HEADER, d, part, len(body) // width | (_NULL if null else 0)) + body.ljust(step, b"\0"))
        return pa.table({"shard": [shard], "file": [name], "first_slot": [first], "records": [len(rows)]})

    # What a task holds together for a shard travels as one compressed block; a task holds one shard.
    blocks = df.mapInArrow(cut_up, "shard long, raw long, packed binary")
    return cut(blocks.groupBy("shard").applyInArrow(write, "shard long, file string, first_slot long, records long"), "order-manifest")


def _packed(slots: np.ndarray, docs: list, parts: list, bodies: list, per_shard: int) -> pa.RecordBatch:
    """A row for each shard: its sequences (slot, document, null flag, part, length, then the bodies), compressed."""
    order = np.argsort(slots, kind="stable")
    shard = slots[order] // per_shard
    bounds = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(order)] if len(order) else np.zeros(1, int)
    ids = np.array([d or 0 for d in docs], np.int64)
    null, part, size = np.array([d is None for d in docs], np.int32), np.array(parts, np.int32), np.array([len(x) for x in bodies], np.int32)
    out, codec = [], pa.Codec("zstd", compression_level=LEVEL)
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = order[a:b]
        raw = b"".join([np.int64(len(at)).tobytes(), slots[at].tobytes(), ids[at].tobytes(), null[at].tobytes(), part[at].tobytes(), size[at].tobytes(), *[bodies[k] for k in at]])
        out.append((int(shard[a]), len(raw), codec.compress(raw, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["shard", "raw", "packed"])


def _unpacked(raw: bytes) -> list[tuple]:
    n = int.from_bytes(raw[:8], "little")
    slots, ids = np.frombuffer(raw, np.int64, n, 8).tolist(), np.frombuffer(raw, np.int64, n, 8 + 8 * n).tolist()
    null, part, size = (np.frombuffer(raw, np.int32, n, 8 + 16 * n + 4 * n * k) for k in range(3))
    ends = 8 + 28 * n + np.cumsum(size)
    return [(s, d, z, p, raw[e - w : e]) for s, d, z, p, w, e in zip(slots, ids, null.tolist(), part.tolist(), size.tolist(), ends.tolist(), strict=True)]


def read(manifest: DataFrame, folder: str, length: int, width: int = 1, bodies: bool = True) -> DataFrame:
    """Every record in the shards: slot, shard, byte_offset, doc_id, part, n_ids, crc32 of the ids, ids (null unless bodies)."""
    stride = _HEADER_BYTES + length * width
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_ids", pa.int32()), ("crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for shard, file, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f:
                    for at in range(0, n, 2048):
                        yield _records(f.read(min(2048, n - at) * stride), stride, width, shard, first + at, at, bodies, schema)

    files = manifest.select("shard", "file", "first_slot", "records").repartition(max(1, min(manifest.count(), 4096)))
    return files.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, part int, n_ids int, crc32 long, ids binary")


def _records(raw: bytes, stride: int, width: int, shard: int, slot: int, at: int, bodies: bool, schema: pa.Schema) -> pa.RecordBatch:
    rows = []
    for k in range(len(raw) // stride):
        d, part, n = struct.unpack_from(_HEADER, raw, k * stride)
        body = raw[k * stride + _HEADER_BYTES : k * stride + _HEADER_BYTES + (n & ~_NULL) * width]
        rows.append((slot + k, shard, (at + k) * stride, None if n & _NULL else d, part, n & ~_NULL, zlib.crc32(body), body if bodies else None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def seek(manifest: DataFrame, folder: str, slot: int, count: int, length: int, width: int = 1) -> list[tuple[int, bytes]]:
    """`count` records from `slot` on, as (document id, ids): where a reader that stopped goes on. Only the shards they lie in are read."""
    fs, root = open_fs(folder)
    stride, out = _HEADER_BYTES + length * width, []
    for r in manifest.where((F.col("first_slot") < slot + count) & (F.col("first_slot") + F.col("records") > slot)).orderBy("first_slot").collect():
        a, b = max(slot, r["first_slot"]) - r["first_slot"], min(slot + count, r["first_slot"] + r["records"]) - r["first_slot"]
        with fs.open_input_file(f"{root}/{r['file']}") as f:
            f.seek(a * stride)
            raw = f.read((b - a) * stride)
        for k in range(b - a):
            d, _, n = struct.unpack_from(_HEADER, raw, k * stride)
            out.append((None if n & _NULL else d, raw[k * stride + _HEADER_BYTES : k * stride + _HEADER_BYTES + (n & ~_NULL) * width]))
    return out


def round_trip(df: DataFrame, length: int, width: int = 1, is_table: bool = False) -> DataFrame:
    """df's sequences written in the shared folder in training order, and read back without their ids."""
    folder = scratch(df.sparkSession, "order-shards")
    return read(materialise(df, folder, length, width, is_table=is_table), folder, length, width, bodies=False).drop("ids")
