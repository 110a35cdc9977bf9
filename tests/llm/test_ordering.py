import zlib

import numpy as np
import pytest

from isohyet.llm import bpe, ordering, queries


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    keys = ordering.round_keys(9)
    slots = ordering.permute(np.arange(n), n, keys)
    assert sorted(slots) == list(range(n))
    if n > 100:
        assert not (slots == np.arange(n)).all() and (ordering.permute(np.arange(n), n, ordering.round_keys(10)) != slots).any()


@pytest.mark.parametrize("rows", [[], [(1, None), (None, b"abcd"), (2, b""), (3, bytes(range(256)) * 9), (3, b"xy"), (4, b"z" * 64)]])
def test_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, ids binary").selectExpr("*", "1 as slot", "2 as shard").repartition(3)
    manifest = ordering.materialise(df, str(tmp_path), length=32, width=2, shard_bytes=80 * 20)
    got = ordering.read(manifest, str(tmp_path), 32, 2).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert len(got) == sum(-(-len(b or b"") // 64) for _, b in rows)
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.part, len(r.ids))):
        whole.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert sum(map(len, sum(whole.values(), []))) == sum(len(b or b"") for _, b in rows)
    if rows:
        assert b"".join(x for x in whole[3] if x != b"xy") == rows[3][1] and whole[None] == [b"abcd"]
        by_slot = {r.slot: (r.doc_id, bytes(r.ids)) for r in got}
        assert ordering.seek(manifest, str(tmp_path), 5, 12, 32, 2) == [by_slot[k] for k in range(5, 17)]


def test_query_writes_token_ids(spark):
    sf, encoding = "/root/testdata/sf0.001", bpe.codec(**queries.tokenizer())[0]
    wanted = []
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(encoding.encode(text or "", disallowed_special=()), "<u2")
        wanted += [(d, k // 512, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    got = queries.QUERIES["op3_training_order"](spark, sf).collect()
    assert sorted((r.doc_id, r.part, r.n_ids, r.crc32) for r in got) == sorted(wanted)
    assert sorted(r.slot for r in got) == list(range(len(wanted)))
