"""Substring dedup: exact repeats of ``window`` words across documents, found by fixed-block anchors.

Every document is cut into non-overlapping blocks of window // 2 words, the index. Any window that
two documents share holds one whole block of either, so probing the index with every rolling
block-long window of every document finds all of them. Rolling windows and blocks meet under a
routing key, the smallest hash of the ``GRAM``-word sequences inside; neighbouring windows mostly
have the same key and travel as one run, about one row for seven words. Keys that two different
texts share, one of them with a block, are hits.

Hits are extended exactly: around them each document gives the 128-bit hash of every window that
touches a hit, and the smallest doc_id is kept for each hash. What later documents share with an
earlier one, window by window, is joined into maximal repeats and taken out. No pairs of documents
are formed. Copies of a whole word sequence are settled beforehand by their SHA-256: all but those of
the smallest doc_id go whole, and stay out of the search.

An empty table gives an empty one. A text is held whole by one task, whatever its length, its windows
in groups. Null texts have no words. Documents below ``window`` words, and rows without doc_id, lose nothing
and take nothing from others. Rows of equal doc_id take nothing from each other. Other columns are
not looked at (``dedup`` passes them through).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Sieve, Workspace, enter, id_type, join_sums, prepare

WINDOW = 50
GRAM = 13
GROUP_BYTES = 1 << 20
GROUP_WINDOWS = 1 << 17
SAMPLE, HOT = 20_000, 1000
R1, R2, R3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_digest
    return np.frombuffer(b"".join([h(w) for w in words]), ">u8").astype(np.uint64)


def window_hashes(h: np.ndarray, k: int, r: int) -> np.ndarray:
    """Polynomial hashes of all k neighbours, put together from those of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    powers, p = {1: (h, r)}, 1
    while 2 * p <= k:
        x, m = powers[p]
        powers[2 * p] = (x[:-p] * np.uint64(m) + x[p:], m * m % 2**64)
        p *= 2
    out, length = powers[p][0][:n], p
    while length < k:
        p //= 2
        if length + p <= k:
            x, m = powers[p]
            out = out * np.uint64(m) + x[length : length + n]
            length += p
    out = (out ^ (out >> np.uint64(32))) * np.uint64(R3)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    n, p = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * p <= k:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[:n], x[k - p : k - p + n])


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES."""
    a = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > GROUP_BYTES:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def identity(joined: bytes) -> int:
    """64 bits of a word sequence, signed."""
    return int.from_bytes(xxhash.xxh3_128_digest(joined)[:8], "little", signed=True)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def _anchor(window: int, gram: int):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            for a, b in groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                words = [(t.as_py() or b"").split() for t in batch.column(1).slice(a, b - a)]
                joined = [b" ".join(w) for w in words]
                n = np.array([len(w) for w in words], np.int64)
                flat = [x for w in words if len(w) >= window for x in w]
                keys = sliding_min(window_hashes(word_hashes(flat), gram, R1), block - gram + 1) if flat else np.empty(0, np.uint64)
                size = np.where(n >= window, n, 0)
                first = np.cumsum(size) - size
                count = np.where(size > 0, size - block + 1, 0)  # rolling windows of each document
                at = np.repeat(first, count) + (pos := np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                doc, key = np.repeat(np.arange(len(n)), count), keys[at]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(key))
                lo = pos[start]
                hi = lo + stop - start  # windows lo to hi - 1
                anchored = (hi - 1) // block * block >= lo
                runs = np.bincount(doc[start], minlength=len(n)) if len(start) else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n), pa.array([identity(j) for j in joined], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                        lists(key[start].view(np.int64), runs, pa.int64()), lists(lo.astype(np.int32), runs, pa.int32()), lists(hi.astype(np.int32), runs, pa.int32()), lists(anchored, runs, pa.bool_()),
                    ],
                    ["doc_id", "n_words", "same", "sha", "key", "lo", "hi", "anchored"],
                )

    return run


def touching(words: list[bytes], runs: pa.StructScalar, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that touch a hit: where they start, and their hashes."""
    block, h, flat = window // 2, word_hashes(words), runs.values
    edge = np.zeros(len(words) - block + 2, np.int64)
    np.add.at(edge, flat.field(0).to_numpy(), 1)
    np.add.at(edge, flat.field(1).to_numpy(), -1)
    hit = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    s = np.flatnonzero(hit[window - block + 1 :] - hit[: -(window - block + 1)] > 0)
    return s, window_hashes(h, window, R1)[s], window_hashes(h, window, R2)[s]


class Frequent:
    """Windows' hashes that are frequent in a bounded sample; of those that share h1 one is held."""

    def __init__(self, h1: list[int], h2: list[int]):
        self.h1, at = np.unique(np.array(h1, np.int64).view(np.uint64), return_index=True)
        self.h2 = np.array(h2, np.int64).view(np.uint64)[at]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each hash here, -1 for none."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def _frequent_lows(window: int, frequent: Frequent):
    """The smallest doc_id of each frequent window among a batch's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            order = pc.sort_indices(batch.column(0)).to_numpy()
            low = np.full(len(frequent.h1), len(order))
            for rank, i in enumerate(order.tolist()):
                words = (batch.column(1)[i].as_py() or b"").split()
                if identity(b" ".join(words)) == batch.column(2)[i].as_py():
                    at = frequent.find(*touching(words, batch.column(3)[i], window)[1:])
                    low[at[at >= 0]] = np.minimum(low[at[at >= 0]], rank)
            own = np.flatnonzero(low < len(order))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0).take(pa.array(order[low[own]]))], ["k", "low"])

    return run


def _windows(window: int, frequent: Frequent):
    """The windows that touch a hit, but for the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            rows = zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True)
            parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0

            def flush(parts=parts, ids=batch.column(0)):
                at = np.repeat([p[0] for p in parts], [len(p[2]) for p in parts])
                same = np.repeat(np.array([p[1] for p in parts], np.int64), [len(p[2]) for p in parts])
                s, h1, h2 = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
                out = pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(same), pa.array(s.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "same", "s", "h1", "h2"])
                parts.clear()
                return out

            for i, (text, same, runs) in enumerate(rows):
                words = (text.as_py() or b"").split()
                if identity(b" ".join(words)) != same:  # another row of this doc_id
                    continue
                s, h1, h2 = touching(words, runs, window)
                cold = frequent.find(h1, h2) < 0
                parts.append((i, same, s[cold], h1[cold], h2[cold]))
                held += int(cold.sum())
                if held > GROUP_WINDOWS:
                    yield flush()
                    held = 0
            if parts:
                yield flush()

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, frequent: Frequent, lows: list):
    """lows: the smallest doc_id of each frequent window."""
    ascending = sorted(lows)
    rank = np.array([bisect.bisect_left(ascending, x) for x in lows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            out = []
            for doc, text, same, starts, runs in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                words = (text.as_py() or b"").split()
                if identity(b" ".join(words)) != same:
                    continue
                at = starts.values.to_numpy(zero_copy_only=False).astype(np.int64) if starts.is_valid else np.empty(0, np.int64)
                if len(rank):
                    s, h1, h2 = touching(words, runs, window)
                    k = frequent.find(h1, h2)
                    s, k = s[k >= 0], k[k >= 0]
                    at = np.r_[at, s[rank[k] < bisect.bisect_left(ascending, doc.as_py())]]
                if not len(at):
                    continue
                gone = covered(len(words), at, window)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = b" ".join([w for w, x in zip(words, gone.tolist()) if not x])
                out.append({"doc_id": doc.as_py(), "same": same, "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "first": edges[::2].tolist(), "stop": edges[1::2].tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", batch.column(0).type), ("same", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("first", pa.list_(pa.int64())), ("stop", pa.list_(pa.int64()))]))

    return run


def hot(sampled: DataFrame, keys: list[str]) -> DataFrame:
    """At most HOT keys that are the most frequent in the rows of a bounded sample of texts."""
    return F.broadcast(sampled.groupBy(*keys).count().where("count > 50").orderBy(F.desc("count"), *keys).limit(HOT).select(*keys))


def among(rows: DataFrame, frequent: DataFrame, keys: list[str], sums: list, where: str) -> DataFrame:
    """rows that fulfil ``where``, which may name their own columns and sums (name, (function, column)) over all rows of their keys.

    Rows are shuffled once, by a window. Those of frequent keys are summed map-side and stay where they
    are; what is taken for frequent decides on that only, not on the result.
    """
    w = W.partitionBy(*keys)
    names = [n for n, _ in sums]
    cold = rows.join(frequent, keys, "left_anti").select("*", *[f(c).over(w).alias(n) for n, (f, c) in sums]).where(where).drop(*names)
    own = rows.join(frequent, keys, "left_semi")
    few = own.groupBy(*keys).agg(*[f(c).alias(n) for n, (f, c) in sums])
    warm = own.join(F.broadcast(few), keys).where(where).drop(*names)
    return cold.unionByName(warm)


def removals(ws: Workspace, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, n_words, n_removed, kept_sha256, first, stop), one row for each of docs.

    first and stop: word numbers of the maximal repeats that go; same: a hash of the word sequence.
    The result reads tables of ws.
    """
    if not 1 <= gram <= window // 2:
        raise ValueError("gram must lie between 1 and window // 2")
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"doc_id {kind}, n_words long, same long, sha string, key array<long>, lo array<int>, hi array<int>, anchored array<boolean>"
    anchors = ws.save(rows.mapInArrow(_anchor(window, gram), schema))
    known = anchors.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))

    first = known.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    n_known = known.count()
    copies = ws.save(join_sums(known.select("doc_id", "same", "sha"), first, ["sha"], "n", n_known).where("doc_id > low").select("doc_id", "same").distinct())

    some = F.pmod(F.xxhash64("sha"), F.lit(-(-n_known // SAMPLE) or 1)) == 0
    spread = lambda df: df.select("doc_id", "same", F.inline(F.arrays_zip("key", "lo", "hi", "anchored")))
    two = [("a", (F.min, "same")), ("b", (F.max, "same")), ("c", (F.max, "anchored"))]
    hits = among(spread(known), hot(spread(known.where(some)), ["key"]), ["key"], two, "a < b and c")
    by_doc = ws.save(hits.groupBy("doc_id", "same").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).join(copies, ["doc_id", "same"], "left_anti"))
    likely, _ = Sieve(ws, by_doc.select("doc_id")).part(rows, "doc_id")  # so only these texts are shuffled
    texts = ws.save(likely.join(by_doc.hint("merge"), "doc_id").select("doc_id", "text", "same", "runs"))

    windows = lambda df, without: df.mapInArrow(_windows(window, without), f"doc_id {kind}, same long, s int, h1 long, h2 long")
    some = F.pmod(F.xxhash64("same"), F.lit(-(-n_known // SAMPLE) or 1)) == 0
    keys = hot(windows(texts.where(some), Frequent([], [])), ["h1", "h2"]).collect()
    frequent, lows = Frequent([k.h1 for k in keys], [k.h2 for k in keys]), []
    if keys:  # windows of frequent passages: HOT smallest doc_ids, looked up where the texts are cut
        least = texts.mapInArrow(_frequent_lows(window, frequent), f"k int, low {kind}").groupBy("k").agg(F.min("low").alias("low")).orderBy("k").collect()
        lows = [r.low for r in least]
    lowest = F.min("doc_id").over(W.partitionBy("h1", "h2"))
    shared = windows(texts, frequent).withColumn("low", lowest).where("doc_id > low")
    shared = ws.save(shared.groupBy("doc_id", "same").agg(F.collect_set("s").alias("starts")))
    cut = texts.join(shared, ["doc_id", "same"], "left" if keys else "inner").select("doc_id", "text", "same", "starts", "runs")
    cut = cut.mapInArrow(_cut(window, frequent, lows), f"doc_id {kind}, same long, n_removed long, kept_sha256 string, first array<long>, stop array<long>")
    cut = cut.dropDuplicates(["doc_id", "same"])

    whole = copies.withColumn("_copy", F.lit(True))
    none = F.array().cast("array<long>")
    every = anchors.select("doc_id", "same", "n_words", "sha").join(whole, ["doc_id", "same"], "left").join(cut, ["doc_id", "same"], "left")
    copy = F.coalesce("_copy", F.lit(False))
    return every.select(
        "doc_id",
        "same",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("first", none)).alias("first"),
        F.when(copy, F.array("n_words")).otherwise(F.coalesce("stop", none)).alias("stop"),
    )


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, first, stop) for each row."""
    with Workspace(docs.sparkSession) as ws:
        return ws.result(removals(ws, docs, window, gram).drop("same"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeats. Texts that lose nothing stay as they were; others become their kept
    words, joined by one space; documents that lose all words go.

    What goes is a checkpoint of numbers; texts are read from docs when the result is, and only those
    that may lose words are shuffled."""
    spark = prepare(docs.sparkSession)
    names = docs.columns
    kind = docs.schema["n_chars"].dataType if "n_chars" in names else None
    with Workspace(spark) as ws:
        gone = ws.result(removals(ws, docs, window, gram, id_col, text_col).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), F.col("n_words").alias("_n"), F.col("n_removed").alias("_gone"), F.col("first").alias("_first"), F.col("stop").alias("_stop")).distinct())

        likely, calm = Sieve(ws, gone.select("_id")).part(docs.select(F.struct(*names).alias("_r"), F.col(id_col).alias("_i")), "_i")

    @F.pandas_udf("long")
    def same(texts):
        import pandas as pd

        return pd.Series([identity(b" ".join((t or b"").split())) for t in texts], dtype="int64")

    @F.pandas_udf("string")
    def cut(texts, firsts, stops):
        import pandas as pd

        kept = []
        for t, a, b in zip(texts, firsts, stops):
            words = (t or b"").split()
            keep = np.ones(len(words), bool)
            for x, y in zip(a, b):
                keep[x:y] = False
            kept.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode())
        return pd.Series(kept)

    text = F.col("_r")[text_col].cast("binary")
    both = likely.withColumn("_own", same(text)).join(gone.hint("merge"), (F.col("_i") == F.col("_id")) & (F.col("_own") == F.col("_same")), "left")
    still = both.where(F.col("_id").isNull())
    left = both.where(F.col("_gone") < F.col("_n")).withColumn("_kept", cut(text, "_first", "_stop"))
    new = {text_col: F.col("_kept")} | ({"n_chars": F.length("_kept").cast(kind)} if kind is not None else {})
    cuts = left.select(*[new.get(c, F.col("_r")[c]).alias(c) for c in names])
    return calm.select("_r.*").unionByName(still.select("_r.*")).unionByName(cuts)
