import numpy as np

from stratapool.llm import bpe, tokencounts


def test_documents_against_the_codec(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, 1) for r in docs.collect()] + [(None, None, 2), (900, "", 3), (900, "", 3), (901, "a " * 5000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file int")
    c = bpe.Codec(bpe.read_ranks())
    want = sorted(repr((d, len(c.encode([t or ""])[0]) // 4)) for d, t, _ in rows)
    for block, size in ((100, 4096), (1 << 18, 1 << 26)):
        got = tokencounts.of_documents(df, block_tokens=block, range_bytes=size).collect()
        assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == want
        by = {}
        for r in sorted(got, key=lambda r: (r.file, r.ordinal)):
            assert r.first_token == by.get(r.file, 0)
            by[r.file] = r.first_token + r.n_tokens + 1
    assert tokencounts.of_documents(df.limit(0)).count() == 0


def test_flat_files_against_plain_loop(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = []
    for i, n in enumerate((0, 1, 7, 1000, 1003)):
        ids = rng.integers(0, 5, n).astype("<u2") if i != 2 else np.ones(7, "<u2")
        (tmp_path / f"f{i}.bin").write_bytes(ids.tobytes())
        at, k = 0, 0
        for p in [*np.flatnonzero(ids == 3).tolist(), None]:
            if p is not None:
                want.append((i, k, p - at, at, True))
                at, k = p + 1, k + 1
            elif at < n:
                want.append((i, k, n - at, at, False))
    for block, size in ((1, 6), (3, 100), (64, 1), (5000, 1 << 26)):  # the large files lie in several ranges
        blocks = tokencounts.flat_files(spark, str(tmp_path), 2, block, size)
        got = [(int(r.file.rsplit("f", 1)[1][0]), r.ordinal, r.n_tokens, r.first_token, r.closed) for r in tokencounts.count(blocks, 3, 2).collect()]
        assert sorted(got) == sorted(want)


def test_files_that_are_no_identifiers(spark, tmp_path):
    import pytest

    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        tokencounts.flat_files(spark, str(tmp_path), 2)
    assert tokencounts.count(tokencounts.flat_files(spark, str(tmp_path / "none"), 2), 3, 2).count() == 0
