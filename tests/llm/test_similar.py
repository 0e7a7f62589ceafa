import itertools
import random

import corpus_pipeline

from stratapool.llm import similar, simhash
from stratapool.llm.common import Workspace


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The smallest id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {find(d) for d in root}


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=60)  # common to many that aren't near
    texts = ["", None, "a b", "A b", "a b c d e"]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(20, 150))
        texts.append(" ".join(base + passage if rng.random() < 0.5 else base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(1000)
            texts.append(" ".join(copy))
    base = rng.choices(words, k=100)
    for i in range(120):  # one large group of near copies
        copy = list(base)
        copy[rng.randrange(100)] = f"y{i}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_against_brute_force_jaccard(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert len(want) < len(rows) - 120
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == want


def test_all_paths_give_the_same_classes(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = []
    for few, sample in ((0, 10), (0, 10_000), (10**9, 1)):
        with Workspace(spark) as ws:
            rows = similar.prefixes(ws, docs, sample=sample)
            roots = similar.similar_classes(ws, docs, rows, few=few)
            got.append(sorted(map(tuple, roots.collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_nearest_and_all_pairs_of_a_group():
    import numpy as np

    rng = np.random.default_rng(3)
    sim = rng.integers(0, 2**63, 1500).astype(np.uint64)
    sim[700:] = sim[5] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    n, comp = rng.integers(80, 120, 1500), rng.integers(0, 900, 1500)
    g = similar.Group(sim, n, n, comp, 0.8, 24)
    bits = np.bitwise_count(sim[:, None] ^ sim[None, :])
    ok = (bits <= 24) & g.fits(np.arange(1500)[:, None], np.arange(1500)[None, :])
    u, v = g.pairs(np.arange(1500), 24, False)
    assert {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())} == set(zip(*(x.tolist() for x in np.nonzero(np.triu(ok)))))
    u, v = g.pairs(np.arange(1500), 24, True)
    best = np.where(ok, bits, 255).min(axis=1)
    assert sorted(u.tolist()) == np.flatnonzero(best < 255).tolist() and (bits[u, v] == best[u]).all()


def test_pipeline_stage_against_brute_force_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_parity_bits_lose_no_pair_and_leave_few_others():
    import numpy as np

    rng = np.random.default_rng(5)
    pool, sets = rng.integers(0, 2**63, 260).astype(np.uint64), []
    for _ in range(300):
        own = np.concatenate([pool[rng.random(len(pool)) < 0.55 + 0.4 * rng.random()], rng.integers(0, 2**63, rng.integers(0, 25)).astype(np.uint64)])
        sets.append(np.unique(own))
    n = np.array([len(h) for h in sets])
    odd = np.frombuffer(b"".join(similar.parities(h) for h in sets), np.uint64).reshape(len(n), -1)
    g = similar.Group(np.zeros(300, np.uint64), n, n, np.arange(300), 0.8, 64, odd)
    i, j = np.triu_indices(300, 1)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    near = shared >= 0.8 * (n[i] + n[j] - shared)
    left = g.bounded(i, j)
    assert near.any() and not (near & ~left).any()
    assert left.sum() < near.sum() + 0.2 * (~near).sum()
    assert similar.parities(sets[0][:0]) == bytes(64)
    u, v = g.pairs(np.arange(300), 64, False)
    assert len(u) == (left & g.fits(i, j)).sum()
