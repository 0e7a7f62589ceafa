from collections import Counter

from stratapool.llm import quality
from stratapool.llm.queries import op8_quality_rules

BLANKS = " \t\n\x0b\f\r"


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


CASES = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\nx \n", "é ü\x0bß|<>##", "a b c d a b c e b c d", "  z z", "w " * 4000, " ".join(f"v{i * i % 9973}" for i in range(30_000))]


def test_statistics_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, 1) for r in docs.collect()] + [(1000 + i, t, 2) for i, t in enumerate(CASES)] + [(None, "a a a a", 3)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), quality.DecisionList()).collect()
    want = sorted(repr([d, brute(t)]) for d, t, _ in rows)
    assert sorted(repr([r.doc_id, {k: r[k] for k in brute("")}]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), quality.DecisionList()).count() == 0


def test_learned_list(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.train(docs, labels)
    print(rules)
    assert rules.rules
    got = {r.doc_id: r for r in op8_quality_rules(spark, d).collect()}
    assert len(got) == 1000
    good = {r.doc_id: r.quality for r in labels.collect()}
    long_ = [i for i in good if not got[i].base_failed]
    right = sum(got[i].kept == bool(good[i]) for i in long_) / len(long_)
    lost = sum(not got[i].kept for i in long_ if good[i]) / sum(good[i] for i in long_)
    print(right, lost)
    assert right > 0.93 and lost < 0.03
    for r in got.values():
        assert r.kept == (not r.base_failed and rules.keeps(quality.features_of(r)))


def test_no_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    rules = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not rules.rules and str(rules) == "keep all"
    assert quality.judge(docs, rules).collect()[0].kept is False
