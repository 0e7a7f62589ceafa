import zlib

import numpy as np

from stratapool.llm import toxicity
from stratapool.llm.queries import op6_toxicity


def test_responses_against_plain_loops():
    net = toxicity.Net(3)
    docs = [toxicity.codes(t) for t in ("you are fine", "", "one", "a b c d e f g")]
    got = net.logits(docs)
    for d, g in zip(docs, got):
        h = np.zeros(len(net.bias))
        x = [net.words[c >> toxicity.STEM_BITS] + net.stems[c & ((1 << toxicity.STEM_BITS) - 1)] for c in d.tolist()]
        for k, f in enumerate(net.filters):
            for i in range(len(x)):
                r = sum(x[i + o] @ f[o] for o in range(f.shape[0]) if i + o < len(x)) + net.bias[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
                h[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] = np.maximum(h[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], r)
        assert abs(h @ net.out + net.base - g) < 1e-4


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op6_toxicity(spark, d).collect()
    assert len(got) == 10_000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    tp, fp, fn = held.count((1, 1)), held.count((1, 0)), held.count((0, 1))
    print(tp, fp, fn)
    assert tp / (tp + fn) > 0.8 and fp / (tp + fp) < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, 0.5), (None, "x", "en", 0.5), (3, "idiot " * 5000, "en", 0.5), (3, "idiot " * 5000, "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    net = toxicity.train(docs, labels, F.lit(True))
    assert [r.score for r in toxicity.score(docs, net).collect()] == [0.0] * 5
    rows = [(f"word{i} other", 0, "en") for i in range(40)] + [(f"bad word{i}", 1, "en") for i in range(40)]
    net = toxicity.fit(rows, steps=100)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert got[1].score == got[2].score and got[1].predicted == 0
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_gradients_against_differences():
    """A step of Adagrad from fresh sums moves each parameter by rate * g / sqrt(1e-4 + g^2): g from differences of the loss."""
    import copy

    net = toxicity.Net(5)
    for name in ("words", "stems", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.words *= 20
    net.base = np.float64(net.base)
    docs = [toxicity.codes(t) for t in ("you are a fine one", "what an awful thing to say", "short", "one more here")]
    label, weight = np.array([1, 0, 1, 0], np.float64), np.ones(4)

    def loss(n):
        z = n.logits(docs)
        return float((np.logaddexp(0, z) - label * z).mean())

    after = copy.deepcopy(net)
    after.step(docs, label, weight, 0.01, {})

    def check(get, put, moved):
        at, eps = get(net), 1e-5
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        put(up, at + eps)
        put(down, at - eps)
        g = (loss(up) - loss(down)) / (2 * eps)
        want = -0.01 * g / np.sqrt(1e-4 + g * g)
        assert abs((moved - at) - want) < 2e-4, (g, moved - at, want)

    def entry(name, *i):
        def put(n, v):
            getattr(n, name)[i] = v

        return (lambda n: getattr(n, name)[i]), put, getattr(after, name)[i]

    for j in (0, 3, 9, 17, 23):
        check(*entry("out", j))
        check(*entry("bias", j))
    for k, f in enumerate(net.filters):
        for i in ((0, 0, 0), (f.shape[0] - 1, 5, 3), (0, 11, 7)):
            def put(n, v, k=k, i=i):
                n.filters[k][i] = v

            check(lambda n, k=k, i=i: n.filters[k][i], put, after.filters[k][i])
    check(lambda n: n.base, lambda n, v: setattr(n, "base", v), after.base)
    row = int(docs[0][0] >> toxicity.STEM_BITS)
    moved, g = after.words[row] - net.words[row], []
    for d in range(toxicity.DIM):
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        up.words[row, d] += 1e-5
        down.words[row, d] -= 1e-5
        g.append((loss(up) - loss(down)) / 2e-5)
    g = np.array(g)
    assert np.abs(moved + 0.01 * g / np.sqrt(1e-4 + (g * g).mean())).max() < 2e-4  # one sum for each embedding


def test_cut_counts_what_rows_stand_for():
    logit, label = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 0, 1, 0])
    assert toxicity.best_cut(logit, label) == 0.5
    assert toxicity.best_cut(logit, label, np.where(label == 1, 1.0, 9.0)) == 2.5


def test_rows_outside_the_start_are_learned(spark):
    """What marks a text is only in texts that the start leaves out by their length; the cuts count all rows held back."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4000):
        toxic = i % 4 == 0
        text = rng.choice(words, 8 if i % 8 < 4 else 60).tolist()
        if toxic:
            text[len(text) // 2] = "bad" if i % 8 < 4 else "vile"
        rows.append((i, " ".join(text), "en", int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"), F.lit(True), per_class=500, max_bytes=100, steps=200)
    got = {r.doc_id: r.predicted for r in toxicity.score(table.drop("toxic"), net).collect()}
    long_ones = [(got[i], y) for i, _, _, y in rows if i % 8 >= 4]
    assert long_ones.count((1, 1)) > 450 and long_ones.count((1, 0)) < 50


def test_weights_are_packed_whole_and_groups_cover_all():
    net, other = toxicity.Net(3), toxicity.Net(4)
    docs = [toxicity.codes(t) for t in ("you are fine", "", "one")]
    net.step(docs, np.array([1, 0, 1], np.float32), np.ones(3, np.float32), 0.1, net.sums)
    other.unpack(np.frombuffer(net.pack(), "<f4"))
    assert other.tables().keys() == net.tables().keys() and all((v == net.tables()[k]).all() for k, v in other.tables().items())
    assert np.array_equal(other.logits(docs), net.logits(docs))
    parts = list(toxicity.groups([np.zeros(n) for n in (3, 50, 1, 1, 1, 1, 0)], 10, 3))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(7)) and max(p.stop - p.start for p in parts) <= 3
