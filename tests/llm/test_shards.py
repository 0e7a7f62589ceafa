import zlib

import numpy as np

from stratapool.llm import shards


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_against_scalar_and_growth():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    for n in (1, 2, 24, 1000):
        got = shards.jump(keys, n)
        assert got.tolist() == [brute_jump(int(k), n) for k in keys]
        more = shards.jump(keys, n + 1)
        assert set(more[more != got].tolist()) <= {n}
    moved = (shards.jump(keys, 25) != shards.jump(keys, 24)).mean()
    assert abs(moved - 1 / 25) < 0.01


def test_slots_gapless_with_ties_nulls_and_other_columns(spark):
    rows = [(i, f"t{i}é", i) for i in range(500)] + [(7, "same", 0)] * 10_000 + [(None, None, 1), (3, "", 2)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert shards.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    mask = 2**64 - 1
    key = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in {d for d, _, _ in rows}], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    for r in got:  # the shards of Spark's path are those of the scalar definition
        assert (r.shard, r.grown_shard) == (brute_jump(key[r.doc_id] & mask, 24), brute_jump(key[r.doc_id] & mask, 25))
