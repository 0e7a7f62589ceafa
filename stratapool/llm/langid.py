"""Language identification by nearest centroids.

A text becomes a vector of hashed character n-grams (1 to 3, letters folded to lower case, all else
one blank), weighed by log(1 + count) times inverse document frequency and normalised. Each
language has several centroids, found by spherical k-means over its training vectors; a text gets
the language of the centroid of the largest cosine. A text whose cosine is below its centroid's
limit is rejected: the limit is ``slack`` times the smallest cosine of that centroid's own
training texts, at least ``floor``, so texts like those that were learned from stay.

Fitted on at most ``per_language`` labelled texts of each language, those of the smallest hashed id,
whole, and at most ``sample`` texts in all: with more languages each gives fewer. More than
``max_languages`` languages are refused, as the centroids are broadcast. Of an id's several texts in
one language the smallest is taken. Only n-gram counts come to the driver, at most 6 << BITS bytes a
text. Null texts and texts without a letter get ``und`` with score 0 and are rejected. Without any
labelled row, an empty table included, every text is ``und``. Of equal cosines the first language by
name wins. A text is held whole by one task, one at a time. Repeated rows stay; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import enter, id_type, local_rows, prepare

BITS = 13
ORDERS = 3
PER_LANGUAGE = 300
CENTROIDS = 4
SLACK = 0.25
FLOOR = 0.05
SEED = 5
SAMPLE = 6000
MAX_LANGUAGES = 500
SALTS = 8
UND = "und"

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 for what is no letter."""
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _table = out
    return _table


def release() -> None:
    global _table
    _table = None


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    p = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = p != 0
    keep[1:] |= p[:-1] != 0  # a run of other characters is one blank
    if not len(p) or not p.any():
        return None
    p = np.concatenate(([0], p[keep], [0])).astype(np.uint32)
    h, out = np.zeros(len(p), np.uint32), np.zeros(1 << BITS, np.int64)
    for k in range(ORDERS):
        h = (h[: len(p) - k] if k else h) * np.uint32(0x01000193) + p[k:] + np.uint32(1)
        if not len(h):
            break
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)
        out += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
        h = h[: len(p) - k - 1] if k + 1 < ORDERS else h
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class Model:
    """idf, centroids (rows of unit length), the language of each, and the limit of each."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, limit: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.limit = languages, idf, centroids, of, limit

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = grams(text) if text else None
        if counts is None or not len(self.of):
            return UND, 0.0, True
        cos = self.centroids @ self.vector(counts)
        best = int(np.argmax(cos))
        return self.languages[self.of[best]], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < self.limit[best])


def fit(rows: list[tuple[np.ndarray, str]], k: int = CENTROIDS, slack: float = SLACK, floor: float = FLOOR, seed: int = SEED) -> Model:
    """rows: (n-gram counts, language), in a fixed order."""
    names = sorted({x for _, x in rows})
    if not rows:
        return Model([], np.ones(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(0))
    df = np.zeros(1 << BITS)
    for c, _ in rows:
        df += c > 0
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 0.05
    model = Model(names, idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(0))
    centroids, of, limits = [], [], []
    for i, name in enumerate(names):
        v = np.stack([model.vector(c) for c, x in rows if x == name])
        rng = np.random.default_rng([seed, i])
        c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
        for _ in range(12):
            at = (v @ c.T).argmax(axis=1)
            c = np.stack([unit(v[at == j].sum(axis=0)) if (at == j).any() else c[j] for j in range(len(c))])
        cos = v @ c.T
        at, best = cos.argmax(axis=1), cos.max(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                centroids.append(c[j])
                of.append(i)
                limits.append(max(floor, slack * float(best[at == j].min())))
    return Model(names, idf, np.stack(centroids).astype(np.float32), np.array(of), np.array(limits))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _lang, buckets as 16-bit and counts as 32-bit integers) of texts with a letter."""
    enter("langid")
    for batch in batches:
        for i, t in enumerate(batch.column(2)):
            if (c := grams(t.as_py())) is not None:
                at = np.flatnonzero(c)
                own = [pa.array([at.astype("<u2").tobytes()]), pa.array([np.minimum(c[at], 2**32 - 1).astype("<u4").tobytes()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *own], ["_id", "_lang", "_at", "_n"])


def train(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES, **options) -> Model:
    """The sample is chosen by ids alone, so that only chosen rows' texts move."""
    spark = prepare(docs.sparkSession)
    kind = id_type(docs, id_col)
    labelled = docs.where(train_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    languages = len(labelled.select(lang_col).distinct().limit(max_languages + 1).collect())
    if not languages:
        return fit([], **options)
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    most = max(1, min(per_language, sample // languages))
    ids = labelled.groupBy(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).agg(F.lit(1))
    salted = ids.select("_id", "_lang", F.xxhash64("_id").alias("_h")).withColumn("_s", F.pmod("_h", F.lit(SALTS)))
    some = salted.withColumn("_n", F.row_number().over(W.partitionBy("_lang", "_s").orderBy("_h", "_id"))).where(F.col("_n") <= most)
    few = some.withColumn("_n", F.row_number().over(W.partitionBy("_lang").orderBy("_h", "_id"))).where(F.col("_n") <= most)
    chosen = few.select("_id", "_lang").collect()  # at most ``most`` of each language
    want = local_rows(spark, [tuple(r) for r in chosen], f"_id {kind}, _lang string")
    found = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(F.broadcast(want), ["_id", "_lang"]).where(F.col("_text").isNotNull())
    one = found.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).mapInArrow(_counts, f"_id {kind}, _lang string, _at binary, _n binary")
    rows = []
    for r in sorted(one.collect(), key=lambda r: (r["_lang"], r["_id"])):
        c = np.zeros(1 << BITS, np.int64)
        c[np.frombuffer(r["_at"], "<u2")] = np.frombuffer(r["_n"], "<u4")
        rows.append((c, r["_lang"]))
    return fit(rows, **options)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.idf, model.centroids, model.of, model.limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        m = Model(*shared.value)
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            lang, score, gone = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without rejected rows; all columns pass through unchanged."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.idf, model.centroids, model.of, model.limit))

    @F.pandas_udf("boolean")
    def rejected(texts):
        import pandas as pd

        enter("langid")
        m = Model(*shared.value)
        return pd.Series([m.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(~rejected(F.col(text_col)))
