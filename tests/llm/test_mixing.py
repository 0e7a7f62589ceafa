import numpy as np

from stratapool.llm import mixing


def test_targets_cap_and_reshare():
    t = mixing.targets([100, 100, 100, 5])
    assert abs(sum(t) - 305) < 1e-9 and t[3] == 15
    assert all(x <= 3 * n + 1e-9 for x, n in zip(t, [100, 100, 100, 5]))
    open_ = [x / w for x, w in zip(t[:3], (5, 2, 1))]
    assert max(open_) - min(open_) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_permutation_and_draws():
    for n in (1, 2, 3, 64, 1000, 1025):
        assert sorted(mixing.permute(np.arange(n), n, [1, 2, n]).tolist()) == list(range(n))
    counts = np.array([1000, 0, 37, 5])
    d = mixing.draw(counts, 7, 3)
    assert d.sum(axis=0).tolist() == counts.tolist() and (d == mixing.draw(counts, 7, 3)).all()
    assert np.ptp(d.sum(axis=1)) <= 1


def test_against_a_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs).taken().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).taken().collect()))
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in got} == words
    names = sorted(set(source.values()))
    sizes = [sum(words[d] for d in words if source[d] == s) for s in names]
    goal = dict(zip(names, mixing.targets(sizes)))
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(mine[0].target - goal[s]) < 1e-6
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 0.05 * goal[s] + 64
    assert all(r.taken <= 3 * r["size"] for r in got)
    made = mixing.mixed_documents(docs).collect()
    taken = {}
    for r in made:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert taken == {r.doc_id: r.taken for r in got if r.taken}


def test_nulls_ties_and_empty(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, None, "x"), (2, "", "x"), (3, "w " * 1000, "y"), (4, "z", "y")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).taken().count() == 0
    assert mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() >= 1
