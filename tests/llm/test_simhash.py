import itertools

import xxhash

from stratapool.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
    return sum(1 << k for k in range(64) if grams and 2 * bits[k] > len(grams))


def brute_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in fps}


TEXTS = [None, "", "a", "A b", "one two three four", "ONE two\tthree\nfour", "x " * 3000, "é É ü", "one two three four", " \n"]


def test_fingerprints_and_components_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    made = {r.doc_id: r for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {d: brute_fp(t) for d, t in rows}
    assert {d: r.fp & (2**64 - 1) for d, r in made.items()} == fps
    assert {d: r.component_id for d, r in made.items()} == brute_components(fps)


def test_chain_and_split_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    fps, x = [], int(rng.integers(0, 2**63))
    for _ in range(300):  # a chain: each two bits from the one before
        for b in rng.integers(0, 63, 2).tolist():
            x ^= 1 << b
        fps.append(x)
    fps += [int(f) for f in rng.integers(0, 2**63, 300)]
    fps = sorted(set(fps))
    want = brute_components({f: f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (4, 1 << 16):
        got = {r.node: r.root for r in simhash.link_classes(df, block_rows=block).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        wanted = {}
        for f, r in want.items():
            wanted.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_large_group_forest():
    import numpy as np

    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(0, 2**63))
    fps = np.unique(np.array([base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (1500, 2))], np.uint64))
    u, v = simhash.forest(fps, 2)
    assert len(u) == len(fps) - 1 and set(v.tolist()) == {int(fps.min())}


def test_empty_table_nulls_and_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(empty).count() == 0
    rows = [(3, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (2, "q r s t u v w", 4), (2, "q r s t u v w", 4)]
    rows += [(1, "wholly other words that no one else has", 5), (None, "alone with no id", 6), (None, "alone with no id", 6), (7, None, 7), (8, " \n", 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    # one row of each class: repeated ids with other texts are judged apart, repeated rows are one
    assert sorted((r.doc_id or 0, r.fp) for r in simhash.near_dedup(docs).collect()) == [(0, 6), (1, 2), (1, 5), (2, 4), (7, 7)]
    assert simhash.near_dedup(docs.limit(0)).count() == 0
