import hashlib
import zlib

import numpy as np

from stratapool.llm import media
from stratapool.llm.common import Workspace


def test_gear_is_local_and_cuts_cover():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (100_000, 60_000, 60_000))
    h = media.gear(np.frombuffer(a[:100], np.uint8))
    want = sum(int(media.GEAR[a[50 - k]]) << k for k in range(32)) % 2**32
    assert int(h[50]) == want
    for data in (a, b"", b"x" * 64, b"\0" * 200_000):
        parts = media.chunks(media.payload(data))
        assert b"".join(parts) == media.payload(data) and all(parts) and max(map(len, parts)) <= media.LARGEST
        assert all(len(p) >= media.SMALLEST for p in parts[:-1])
    shared = set(media.chunks(b + a)) & set(media.chunks(c + b"!" + a))
    assert sum(map(len, shared)) > 60_000


def test_columns_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    big = "".join(r.text for r in docs.collect())[:200_000]
    rows = [(r.doc_id, r.text, b"") for r in docs.collect()] + [(1000, None, b""), (1001, "", b""), (1002, "é" * 32, b""), (None, big, b""), (1003, "x" + big, b""), (1003, "x" + big, b"")]
    got = media.columns(spark.createDataFrame(rows, "doc_id long, text string, media binary")).collect()
    want = []
    for d, t, _ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, tuple(r)[2:]) == tuple(r)[2:]
    assert media.columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_chunk_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_SHARE", 3)
    common = "".join(chr(33 + i % 90) + str(i) for i in range(9000))
    rows = [(i, common[:40_000] + "z" * 3000 + str(i)) for i in range(1200)]
    with Workspace(spark) as ws:
        s = media.write(ws, spark.createDataFrame(rows, "doc_id long, text string"))
        assert s.features().count() == 1200
        stored = s.packs.selectExpr("explode(frames) f").count()
        assert stored < 1200 + 200
