import hashlib
import struct

import corpus_pipeline
from stratapool.llm import bpe

from .test_similar import brute_kept
from .test_substrings import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]

    kept = stage["language_id"](spark, docs, sf_dir)
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and len(left) >= 0.99 * len(rows) and left.items() <= rows.items()

    near = stage["simhash_near_dedup"](spark, kept, sf_dir)
    one = {r.doc_id: r.text for r in near.collect()}
    assert near.columns == docs.columns and set(one) == brute_kept(left.items())

    cut = stage["substring_dedup"](spark, near, sf_dir)
    want = {d: (one[d] if not gone else b" ".join(k).decode()) for d, n, gone, _, k in brute(sorted(one.items())) if gone < n or not n}
    got = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and got == want and all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = stage["mixing"](spark, cut, sf_dir)
    assert mixed.columns == docs.columns
    total = sum(len(t.encode().split()) for t in got.values())
    assert abs(sum(len(r.text.encode().split()) for r in mixed.collect()) - total) < 0.05 * total

    coded = stage["byte_bpe"](spark, mixed, sf_dir).collect()
    c = bpe.Codec(bpe.read_ranks())
    wanted = []
    for r in mixed.collect():
        ids = c.encode([r.text])[0]
        wanted.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, coded)) == sorted(wanted) and struct.calcsize("<I") == 4


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
