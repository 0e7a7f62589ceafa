import hashlib
import random
import tempfile

import numpy as np

from stratapool.llm import substrings


def brute(rows, window=50):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = b" ".join(w[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[b" ".join(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return out


def shape(rows):
    return sorted(map(repr, rows))


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    a, b, c = text(400), text(49), text(50)
    rows += [(5000, a), (5001, f"x {b} y {a[:700]}"), (5002, f"{b}\n{c}"), (5003, f"q {c}\t{c} {b} z"), (5004, a), (5004, a), (5004, text(80)), (None, a), (5005, None), (5006, ""), (5007, " ".join(a.split()[100:149])), (4999, "p " + " ".join(a.split()[13:63]) + " q"), (5008, "z " * 200), (5009, "z " * 120)]
    got = substrings.report(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, same int"))
    assert shape((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == shape(x[:4] for x in brute(rows))
    assert sum(x[2] for x in brute(rows)) > 1000


def test_dedup_keeps_columns_and_drops_empty(spark):
    p = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"{p}\n end", 0), (2, f"new {p} more", 1), (3, p, 2), (3, "short text", 3), (None, p, 4)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string, _id int")).collect()
    assert shape(map(tuple, got)) == shape([(1, f"{p}\n end", 0), (2, "new more", 1), (3, "short text", 3), (None, p, 4)])
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0


def test_hash_helpers():
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    for k in (1, 2, 13, 25, 50):
        got = substrings.window_hashes(h, k, substrings.R1)
        assert len(got) == 301 - k and (got[7] == substrings.window_hashes(h[7 : 7 + k], k, substrings.R1)[0])
        assert substrings.sliding_min(h, k).tolist() == [min(h[i : i + k].tolist()) for i in range(301 - k)]


def test_frequent_keys_and_the_sql(spark, monkeypatch):
    from stratapool.llm import queries

    from ..oracle import compare, connect

    d = "/root/testdata/sf0.01"
    assert compare(queries.op4_substring_dedup(spark, d), connect(d), queries.oracle_sql()["op4_substring_dedup"]) is None
    rng = random.Random(9)
    passage = " ".join(rng.choices([f"w{i}" for i in range(500)], k=70))
    rows = [(i, f"{passage} a{i}" if i % 2 else f"b{i} c{i} {passage}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 3, 1000):  # rows of frequent keys go another way to the same result
        monkeypatch.setattr(substrings, "HOT", most)
        assert shape((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect()) == shape(x[:4] for x in brute(rows))


def test_only_texts_that_may_lose_words_are_shuffled(spark):
    rng = random.Random(2)
    p = " ".join(f"a{i}" for i in range(60))
    rows = [(i, f"{p} x{i}" if i in (3, 150) else " ".join(rng.randbytes(20).hex() for _ in range(1000))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path := f"{tempfile.mkdtemp(prefix='spark-')}/docs")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        before = written()
        got = [(r.doc_id, r.text) for r in substrings.dedup(spark.read.parquet(path)).collect()]
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert shape(got) == shape((d, "x150" if d == 150 else t) for d, t in rows)
    assert 0 < moved < 0.5 * sum(len(t) for _, t in rows)


def test_sieve_loses_no_key(spark):
    from stratapool.llm.common import Sieve, Workspace

    rows = spark.range(20_000).selectExpr("id - 10000 AS k", "CAST(id AS STRING) AS t").unionByName(spark.createDataFrame([(None, "x")], "k long, t string"))
    with Workspace(spark) as ws:
        for step in (1, 7, 20_001):
            keys = rows.where(f"pmod(k, {step}) = 3")
            likely, none = Sieve(ws, keys.select("k")).part(rows.withColumnRenamed("k", "own"), "own")
            a, b = likely.collect(), none.collect()
            wanted = {r.k for r in keys.collect()}
            assert likely.columns == none.columns == ["own", "t"] and len(a) + len(b) == 20_001
            assert wanted <= {r.own for r in a} and len(a) <= 1.2 * len(wanted) + 2500
