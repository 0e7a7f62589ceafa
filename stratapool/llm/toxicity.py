"""Toxicity by a convolutional text classifier, trained in numpy.

A word (lower-cased, outer punctuation off) is the sum of two hashed embeddings, of the word and of
its first letters. Filters of several widths run over the words; each filter's largest response over
the whole text, at least zero, is a feature; a logistic layer gives the score. Only the places of
the largest responses get gradients (Adagrad on the touched rows).

Every labelled row counts: of the rows that may be learned from, a fifth by a hash of the id is held back for
the cuts and all others are fitted to. The fit starts on the driver with at most ``per_class`` ids of either
class, those of the smallest hash with codes up to ``max_bytes``; these only give the weights that the
passes begin with. Then ROUNDS slices of all rows go through the net, long texts included: in each the
rows are dealt into shards by a hash, a task takes its shard's rows one batch after the other, classes weighed
by their counts, and the shards' weights are averaged (an embedding's over the shards that have moved it).
Shards grow in number with the rows up to SHARDS, whatever the cluster; one set of weights goes to the driver.

The output is shifted so that 0.5 is the best cut on the rows held back. Thresholds for each language,
from the same rows, give ``flagged`` beside ``predicted``: only they look at the language column, the
score sees nothing but the text. The held-back rows are counted by their logit in steps of 1 / GRID, and
cuts lie between such steps. If one class has no row held back, or none besides, all rows serve for both.

Of an id's several texts the smallest is taken, of its labels the largest. With fewer than two classes,
or no row at all, every score is the share of class 1. Null and empty texts have no word and get the score of
no response. A text is held whole by one task; texts go through the network in groups of about GROUP_WORDS
words, a longer one alone. Repeated rows stay; other columns are not looked at. An empty table gives an
empty one.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, enter, id_type, prepare

WORD_BITS, STEM_BITS, STEM = 16, 15, 5
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
PER_CLASS, MAX_BYTES = 3000, 16_384
STEPS, BATCH, RATE = 900, 32, 0.1
ROUNDS, PASS_RATE = 3, 0.03
SHARDS, SHARD_ROWS = 64, 4000
GRID = 64
SEED = 11
CACHE = 1 << 18
GROUP_WORDS = 1 << 13
PAD = max(WIDTHS) - 1
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"

_cache: dict[str, int] = {}


def release() -> None:
    _cache.clear()


def _code(word: str) -> int:
    w = word.strip(EDGES) or word
    return (zlib.crc32(w.encode()) >> (32 - WORD_BITS)) << STEM_BITS | zlib.crc32(b"^" + w[:STEM].encode()) >> (32 - STEM_BITS)


def codes(text: str | None) -> np.ndarray:
    """Each word's two buckets in one number."""
    if not text:
        return np.empty(0, np.int64)
    if len(_cache) > CACHE:
        _cache.clear()
    out = []
    for w in text.lower().split():
        c = _cache.get(w)
        if c is None:
            c = _cache[w] = _code(w)
        out.append(c)
    return np.array(out, np.int64)


class Net:
    """Embeddings (one zero row at the end for padding), filters [offset, dim, filter] for each width, logistic layer."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda a: a.astype(np.float32)
        self.words = f32(rng.normal(0, 0.02, ((1 << WORD_BITS) + 1, DIM)))
        self.stems = f32(rng.normal(0, 0.02, ((1 << STEM_BITS) + 1, DIM)))
        self.words[-1] = self.stems[-1] = 0
        self.filters = [f32(rng.normal(0, 0.4, (w, DIM, FILTERS))) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = f32(rng.uniform(0.3, 0.6, len(WIDTHS) * FILTERS) * np.where(np.arange(len(WIDTHS) * FILTERS) % 4 == 3, -1, 1))
        self.base = np.float32(-1.0)
        self.cut = 0.0
        self.limits: dict[str, float] = {}
        self.constant: float | None = None
        self.sums: dict[str, np.ndarray] = {}

    def responses(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(responses of all windows, first window of each text, words, stems); texts padded."""
        size = np.array([len(d) + PAD for d in docs])
        start = np.cumsum(size) - size
        w, s = np.full(size.sum(), 1 << WORD_BITS), np.full(size.sum(), 1 << STEM_BITS)
        at = np.repeat(start, size - PAD) + np.arange((size - PAD).sum()) - np.repeat(np.cumsum(size - PAD) - (size - PAD), size - PAD)
        every = np.concatenate(docs) if docs else np.empty(0, np.int64)
        w[at], s[at] = every >> STEM_BITS, every & ((1 << STEM_BITS) - 1)
        x = self.words[w] + self.stems[s]
        y = np.zeros((len(x), len(self.bias)), np.float32)
        each = [(k, o) for k, f in enumerate(self.filters) for o in range(f.shape[0])]
        z = x @ np.concatenate([self.filters[k][o] for k, o in each], axis=1)
        for j, (k, o) in enumerate(each):
            y[: len(x) - o, k * FILTERS : (k + 1) * FILTERS] += z[o:, j * FILTERS : (j + 1) * FILTERS]
        y += self.bias
        dead = np.ones(len(x), bool)
        dead[at] = False
        y[dead] = 0
        return y, start, w, s

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        y, start, _, _ = self.responses(docs)
        return np.maximum(np.maximum.reduceat(y, start, axis=0), 0) @ self.out + self.base

    def step(self, docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rate: float, sums: dict[str, np.ndarray]) -> None:
        y, start, w, s = self.responses(docs)
        stop = np.append(start[1:], len(y))
        top = np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(start, stop)])
        cols = np.arange(y.shape[1])
        h = np.maximum(y[top, cols], 0)
        p = 1 / (1 + np.exp(-(h @ self.out + self.base)))
        d = ((p - label) * weight / len(docs)).astype(np.float32)
        dh = d[:, None] * self.out * (h > 0)

        def apply(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            sums.setdefault(name, np.full(value.shape, 1e-4, np.float32))
            sums[name] += grad * grad
            value -= rate * grad / np.sqrt(sums[name])

        gw: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        new = []
        for k, f in enumerate(self.filters):
            c = slice(k * FILTERS, (k + 1) * FILTERS)
            grad = np.zeros_like(f)
            for o in range(f.shape[0]):
                at = top[:, c] + o
                ok = at < len(w)
                at = np.minimum(at, len(w) - 1)
                x = self.words[w[at]] + self.stems[s[at]]
                g = dh[:, c] * ok
                grad[o] = np.einsum("bfd,bf->df", x, g)
                gw.append((w[at].ravel(), s[at].ravel(), (g[:, :, None] * f[o].T[None]).reshape(-1, DIM)))
            new.append(grad)
        ws, ss, gs = (np.concatenate(x) for x in zip(*gw))
        for name, table, rows in (("words", self.words, ws), ("stems", self.stems, ss)):
            keys, inv = np.unique(rows, return_inverse=True)
            grad = np.zeros((len(keys), DIM), np.float32)
            np.add.at(grad, inv, gs)
            live = keys < len(table) - 1
            keys, grad = keys[live], grad[live]
            acc = sums.setdefault(name, np.full(len(table), 1e-4, np.float32))
            acc[keys] += (grad * grad).mean(axis=1)
            table[keys] -= rate * grad / np.sqrt(acc[keys])[:, None]
        for k, grad in enumerate(new):
            apply(f"filter{k}", self.filters[k], grad)
        apply("bias", self.bias, dh.sum(axis=0))
        apply("out", self.out, d @ h)
        base = np.array([self.base])
        apply("base", base, np.array([d.sum()], np.float32))
        self.base = base[0]

    def tables(self) -> dict[str, np.ndarray]:
        """All weights and sums of squares, by name."""
        own = {"words": self.words, "stems": self.stems, "bias": self.bias, "out": self.out, "base": np.array([self.base], np.float32)}
        own |= {f"filter{k}": f for k, f in enumerate(self.filters)}
        sums = {n: self.sums.get(n, np.full(len(v) if n in ("words", "stems") else v.shape, 1e-4, np.float32)) for n, v in own.items()}
        return own | {f"sum {n}": v for n, v in sums.items()}

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.tables().values()]).astype("<f4").tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name, old in self.tables().items():
            new = flat[at : at + old.size].astype(np.float32).reshape(old.shape)
            at += old.size
            if name.startswith("sum "):
                self.sums[name[4:]] = new
            elif name.startswith("filter"):
                self.filters[int(name[6:])] = new
            else:
                setattr(self, name, np.float32(new[0]) if name == "base" else new)

    def score(self, logit: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        return 1 / (1 + np.exp(-np.clip(logit - self.cut, -40, 40)))


def best_cut(logit: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The cut of the best F1, in the middle of its gap; weight: how many rows each stands for."""
    order = np.argsort(-logit, kind="stable")
    w = np.ones(len(logit)) if weight is None else weight[order]
    x, hit = logit[order], np.cumsum(w * label[order])
    f1 = 2 * hit / (np.cumsum(w) + hit[-1])
    f1[:-1][x[:-1] == x[1:]] = -1
    k = int(f1.argmax())
    return float((x[k] + (x[k + 1] if k + 1 < len(x) else x[k] - 1)) / 2)


def fit(rows: list[tuple[str | np.ndarray | None, int, str | None]], steps: int = STEPS, seed: int = SEED, stands_for: tuple[float, float] = (1.0, 1.0)) -> Net:
    """rows: (text or its codes, label, language), in a fixed order; every fifth is held back for the cuts.
    stands_for: how many labelled rows of class 0 and 1 there are for each one in rows."""
    net, label = Net(seed), np.array([y for _, y, _ in rows], np.float32)
    if not 0 < label.sum() < len(label):
        net.constant = float(label.mean()) if len(label) else 0.0
        return net
    docs = [t if isinstance(t, np.ndarray) else codes(t) for t, _, _ in rows]
    late = np.arange(len(rows)) % 5 == 4
    if not 0 < label[~late].sum() < (~late).sum() or not 0 < label[late].sum() < late.sum():
        late[:] = False
    pos, neg = (np.flatnonzero(~late & (label == v)) for v in (1, 0))
    rng, sums = np.random.default_rng(seed), {}
    for k in range(steps):
        pick = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        net.step([docs[i] for i in pick], label[pick], np.ones(BATCH, np.float32), RATE * (1 - 0.9 * k / steps), sums)
    net.sums = sums
    held = np.flatnonzero(late) if late.any() else np.arange(len(rows))
    logit = np.concatenate([net.logits([docs[i] for i in held[a : a + 64]]) for a in range(0, len(held), 64)])
    weight = np.where(label[held] == 1, stands_for[1], stands_for[0])
    net.cut = best_cut(logit, label[held], weight)
    for lang in sorted({rows[i][2] for i in held if rows[i][2] is not None}):
        of = np.array([rows[i][2] == lang for i in held])
        own = best_cut(logit[of], label[held][of], weight[of]) if label[held][of].sum() >= 5 else net.cut
        net.limits[lang] = float(1 / (1 + np.exp(-np.clip(own - net.cut, -40, 40))))
    return net


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("toxicity")
    for batch in batches:
        coded = pa.array([codes(t.as_py()).astype("<u4").tobytes() for t in batch.column(4)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], coded], ["h", "late", "y", "lang", "codes"])


def decode(coded: bytes) -> np.ndarray:
    return np.frombuffer(coded, "<u4").astype(np.int64)


def groups(docs: list[np.ndarray], words: int = GROUP_WORDS, most: int | None = None) -> Iterator[slice]:
    """Stretches of about as many words, or at most as many texts."""
    start, held = 0, 0
    for i, d in enumerate(docs):
        held += len(d)
        if held > words or most is not None and i + 1 - start == most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(docs):
        yield slice(start, len(docs))


def _pass(shared, weight: tuple[float, float], rates: tuple[float, float], per_shard: int):
    """One set of weights for each shard: those of the net after all of the shard's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        net, shard, held, done = None, None, [], 0

        def learn(rows: list[tuple[np.ndarray, int]]) -> None:
            docs = [d for d, _ in rows]
            for part in groups(docs, 4 * GROUP_WORDS, BATCH):
                label = np.array([y for _, y in rows[part]], np.float32)
                rate = rates[0] + (rates[1] - rates[0]) * min(1.0, done / per_shard)
                # A step divides by the texts that it is given: fewer weigh less.
                net.step(docs[part], label, np.where(label == 1, weight[1], weight[0]).astype(np.float32) * (len(label) / BATCH), rate, net.sums)

        def result() -> pa.RecordBatch:
            learn(held)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([net.pack()], pa.binary())], ["shard", "weights"])

        for batch in batches:
            for s, y, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != shard:
                    if net is not None:
                        yield result()
                    net, shard, held, done = copy.deepcopy(shared.value), s, [], 0
                held.append((decode(c), y))
                if len(held) == BATCH:
                    learn(held)
                    done += len(held)
                    held = []
        if net is not None:
            yield result()

    return run


def _average(shared):
    """The mean of the shards' weights; of an embedding, over the shards in which it has moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.frombuffer(shared.value.pack(), "<f4")
        moved, times, n = np.zeros(len(start)), np.zeros(len(start), np.int32), 0
        for batch in batches:
            for w in batch.column(1):
                delta = np.frombuffer(w.as_py(), "<f4") - start
                moved += delta
                times += delta != 0
                n += 1
        if n:
            flat = start + moved / np.maximum(times, 1)
            yield pa.RecordBatch.from_arrays([pa.array([flat.astype("<f4").tobytes()], pa.binary())], ["weights"])

    return run


def _logits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        net = shared.value
        for batch in batches:
            docs = [decode(c) for c in batch.column(2).to_pylist()]
            step = np.concatenate([np.empty(0), *(net.logits(docs[part]) for part in groups(docs))])
            step = np.floor(np.clip(step, -40, 40) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(step)], ["y", "lang", "step"])

    return run


def passes(spark: SparkSession, ws: Workspace, net: Net, rows: DataFrame, n: dict[int, int], rounds: int = ROUNDS) -> None:
    """Takes all rows (h, y, lang, codes) through the net, a slice of them in each round; n: how many there are of each class."""
    total = sum(n.values())
    weight = (total / (2 * n[0]), total / (2 * n[1]))
    shards = max(1, min(SHARDS, total // SHARD_ROWS))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        rates = tuple(PASS_RATE * (1 - 0.9 * j / rounds) for j in (k, k + 1))
        part = rows.where(F.pmod("h", F.lit(rounds)) == k).select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "y", "codes", "h")
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "h", "codes").select("shard", "y", "codes")
        each = ws.save(part.mapInArrow(_pass(shared, weight, rates, max(1, total // rounds // shards)), "shard int, weights binary"))
        mean = each.repartition(1).sortWithinPartitions("shard").mapInArrow(_average(shared), "weights binary").collect()  # at most one row
        if mean:
            net.unpack(np.frombuffer(mean[0]["weights"], "<f4"))
        shared.unpersist()
        ws.drop(each)


def set_cuts(spark: SparkSession, net: Net, rows: DataFrame) -> None:
    """The cut and the languages' limits from all rows (y, lang, codes)."""
    shared = spark.sparkContext.broadcast(net)
    got = rows.select("y", "lang", "codes").mapInArrow(_logits(shared), "y int, lang string, step int").groupBy("lang", "step", "y").count().collect()  # at most 80 * GRID steps for each language and class
    shared.unpersist()
    got.sort(key=lambda r: (r["step"], r["y"], r["lang"] or ""))
    x, y, w = (np.array([r[k] for r in got], np.float64) for k in ("step", "y", "count"))
    x = (x + 0.5) / GRID
    net.cut, net.limits = best_cut(x, y, w), {}
    for lang in sorted({r["lang"] for r in got if r["lang"] is not None}):
        of = np.array([r["lang"] == lang for r in got])
        own = best_cut(x[of], y[of], w[of]) if (w * y)[of].sum() >= 5 else net.cut
        net.limits[lang] = float(1 / (1 + np.exp(-np.clip(own - net.cut, -40, 40))))


def labelled(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """(h, late, y, lang, _text) of each id that has a label of 0 or 1 and a text: whole texts, all ids."""
    own = labels.where(train_on & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).where("_y in (0, 1)")
    rows = docs.where(train_on & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    one = rows.hint("shuffle_merge").join(own, "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min(F.struct("_text", "_lang")).alias("t"))
    late = F.pmod(F.xxhash64("_id", F.lit("late")), F.lit(5)) == 4
    return one.select(F.xxhash64("_id").alias("h"), late.alias("late"), F.col("_y").cast("int").alias("y"), F.col("t._lang").alias("lang"), F.col("t._text").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, rounds: int = ROUNDS, **options) -> Net:
    """train_on: which ids' rows may be learned from, of docs as of labels. Options: those of the start, see fit()."""
    spark = prepare(docs.sparkSession)
    with Workspace(spark) as ws:
        rows = ws.save(labelled(docs, labels, train_on, id_col, text_col, lang_col, label_col).mapInArrow(_encode, "h long, late boolean, y int, lang string, codes binary"))
        count = {(r["late"], r["y"]): r["count"] for r in rows.groupBy("late", "y").count().collect()}
        apart = all(count.get((late, y)) for late in (True, False) for y in (0, 1))
        n = {y: sum(c for (late, v), c in count.items() if v == y and not (late and apart)) for y in (0, 1)}
        net = Net()
        if not n[0] or not n[1]:
            net.constant = n[1] / max(1, sum(n.values()))
            return net
        fitted, held = (rows.where("not late"), rows.where("late")) if apart else (rows, rows)
        pick = lambda y: fitted.where((F.col("y") == y) & (F.octet_length("codes") <= max_bytes)).orderBy("h", "codes").limit(per_class).select("h", "y", "codes")
        got = pick(1).unionByName(pick(0)).collect()  # at most 2 * per_class rows of max_bytes
        got.sort(key=lambda r: (zlib.crc32(str(r["h"]).encode()), r["h"]))
        start = fit([(decode(r["codes"]), r["y"], None) for r in got], **options)
        net = start if start.constant is None else net
        passes(spark, ws, net, fitted, n, rounds)
        set_cuts(spark, net, held)
        net.sums = {}
        return net


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, score, predicted, flagged) for each row; flagged: by the threshold of its language."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        net = shared.value
        for batch in batches:
            out, held, words = [], [], 0
            for t in batch.column(1):
                held.append(codes(t.as_py()))
                words += len(held[-1])
                if words > GROUP_WORDS:
                    out.append(net.logits(held))
                    held, words = [], 0
            out.append(net.logits(held))
            p = net.score(np.concatenate(out).astype(np.float64))
            limit = np.array([net.limits.get(x, 0.5) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= limit)], ["doc_id", "score", "predicted", "flagged"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, score double, predicted int, flagged boolean")
