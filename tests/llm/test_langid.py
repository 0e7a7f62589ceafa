import zlib

from stratapool.llm import langid
from stratapool.llm.queries import op7_language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got) <= 2 and all(0 <= r.score <= 1 for r in got)


def test_und_rejection_and_empty(spark):
    train = [(i, "the cat sat on the mat and the dog ran home " * 3, "en") for i in range(20)] + [(100 + i, "el gato se sienta en la casa y el perro corre " * 3, "es") for i in range(20)]
    schema = "doc_id long, text string, lang string, score int"
    docs = spark.createDataFrame([(*r, 0) for r in train] + [(200, None, "en", 0), (201, "", "en", 0), (202, "12 34 !!", None, 0), (203, "the dog sat", None, 0), (203, "the dog sat", None, 0), (204, "ラリー工場 構造物質", None, 0), (None, "el perro", None, 0)], schema)
    from pyspark.sql import functions as F

    m = langid.train(docs, F.lit(True))
    got = {}
    for r in langid.predict(docs, m).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[d][0].lang_pred for d in (200, 201, 202)] == ["und"] * 3 and all(got[d][0].rejected for d in (200, 201, 202, 204))
    assert got[203][0].lang_pred == "en" and len(got[203]) == 2 and got[None][0].lang_pred == "es" and not got[None][0].rejected
    assert langid.drop_rejected(docs, m).count() == docs.count() - 4
    none = langid.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), m).count() == 0


def plain_grams(text):
    """Strings of one to three of the text's folded letters, with a blank for each run of all else and at both ends."""
    low, out, gap = [" "], {}, True
    for c in text:
        if c.isalpha():
            low.append(c.lower() if len(c.lower()) == 1 else c)
            gap = False
        elif not gap:
            low.append(" ")
            gap = True
    s = "".join(low) + " "
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
    return out


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + (0 if c == " " else ord(c)) + 1) % 2**32
    h = (h ^ h >> 15) * 0x85EBCA6B + (len(gram) - 1) * 0x9E3779B9
    return h % 2**32 >> 32 - langid.BITS


def test_vectors_and_predictions_against_plain_python(spark, sf_dir):
    """Every score is the largest cosine of a plain TF-IDF vector with the model's centroids; no n-gram is lost."""
    import math

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = langid.train(docs, F.pmod("doc_id", F.lit(3)) != 0)
    assert len(set(m.of.tolist())) == len(m.languages) == docs.where("lang is not null").select("lang").distinct().count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs, m).collect()[:60]:
        counts = {}
        for g, n in plain_grams(text[r.doc_id]).items():
            counts[bucket(g)] = counts.get(bucket(g), 0) + n
        v = {b: math.log(1 + n) * float(m.idf[b]) for b, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(float(c[b]) * x for b, x in v.items()) / size for c in m.centroids]
        best = max(range(len(cos)), key=lambda i: cos[i])
        assert abs(r.score - min(1, max(0, cos[best]))) < 1e-4
        assert r.lang_pred == m.languages[m.of[best]] or sorted(cos)[-1] - sorted(cos)[-2] < 1e-5


def test_many_languages_share_the_sample(spark):
    import pytest
    from pyspark.sql import functions as F

    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i % 25)} " * 9, f"l{i % 30:02}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, F.lit(True), sample=60)
    assert m.languages == sorted({x for _, _, x in rows})
    with pytest.raises(ValueError):
        langid.train(docs, F.lit(True), max_languages=29)
