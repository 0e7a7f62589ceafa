"""Mixing sources to target weights.

Each source's words, in the order of its documents, are packed into blocks of ``block_words``. Every
output shard draws multinomial source counts, with what is left of the targets as weights, so the
counts add up to the targets over all shards. A source's slots are numbered through; slot j stands
for block perm(j mod n) of epoch j div n, where perm is a keyed permutation of the n block numbers,
another one in each epoch. So no block is used more than once more than another. Slots and blocks
are joined by (source, block number), which spreads a hot source over all tasks.

Targets: source s of weight w gets its share of all words, at most ``max_epochs`` times its own
words; the excess is shared again by weight among the others until none is above. Sources are
ordered by code point, null last, and weights repeat in that order. Per-source totals (one row a
source) come to the driver; their number is checked against MAX_SOURCES.

Null and empty texts have no words: they take no block, and none is taken of them. Null ids and
repeated rows are kept, each with words of its own. All draws are keyed by ``seed``: reruns agree.
Ties in the order of documents are settled by size and by a hash of the row. A long text is as many
blocks as it needs; a part of it is a row of numbers, never words. An empty table gives empty ones.
Columns beside doc_id, text and source are not looked at, whatever their names; ``mixed_documents``
knows a row by 128 bits of the SHA-256 of all its columns and passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, local_rows, n_words, prepare, running_offset

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
OUT_SHARDS = 64
SEED = 17
MAX_SOURCES = 20_000
RANGE = 1 << 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_EPOCHS) -> list[float]:
    """Words to take from each source; all words are shared out."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(w[i] for i in open_)
        above = sorted(i for i in open_ if unit * w[i] > cap * sizes[i])
        if not above:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in above:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ -= set(above)
    return out


def draw(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws whose sums over the shards are counts."""
    left, total = counts.astype(np.int64).copy(), int(counts.sum())
    out = np.zeros((shards, len(counts)), np.int64)
    for k in range(shards):
        rng = np.random.default_rng([seed, k])
        n = total * (k + 1) // shards - total * k // shards
        while n:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left) if k < shards - 1 else left.copy()
            out[k] += got
            left -= got
            n -= int(got.sum())
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at x: four Feistel rounds, walked until back in range."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4).tolist()
    out, live = x.astype(np.uint64), np.arange(len(x))
    while len(live):
        a, b = out[live] >> half, out[live] & mask
        for k in keys:
            a, b = b, a ^ (_mix(b, k) & mask)
        out[live] = (a << half) | b
        live = live[out[live] >= n]
    return out.astype(np.int64)


def _slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                j = np.arange(r["first"], r["first"] + r["n"])
                epoch, at = j // r["blocks"], j % r["blocks"]
                block = np.empty(len(j), np.int64)
                for e in np.unique(epoch).tolist():
                    of = epoch == e
                    block[of] = permute(at[of], r["blocks"], [seed, r["sidx"], e])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), r["sidx"], np.int32)), pa.array(block), pa.array(np.full(len(j), r["shard"], np.int32)), pa.array(j)], ["sidx", "block", "shard", "slot"])

    return run


class Mix:
    """What mix() has decided: ``rows`` (one a document: _key, doc_id, sidx, size, source_size, target,
    start), ``parts`` (one a document and block), ``slots`` (one a slot: sidx, block, shard, slot)."""

    def __init__(self, rows: DataFrame, parts: DataFrame, slots: DataFrame):
        self.rows, self.parts, self.slots = rows, parts, slots

    def taken_parts(self) -> DataFrame:
        times = self.slots.groupBy("sidx", "block").agg(F.count("*").alias("times"))
        return self.parts.join(times.hint("merge"), ["sidx", "block"])  # as large as the mix, whatever its ranges' size

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row a document."""
        words = self.taken_parts().groupBy("sidx", "start").agg(F.sum(F.col("length") * F.col("times")).alias("_taken"))
        keyed = self.rows.where("size > 0").join(words, ["sidx", "start"], "left").drop("sidx", "start")
        every = keyed.unionByName(self.rows.where("size = 0").drop("sidx", "start"), allowMissingColumns=True)
        return every.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, out_shards: int = OUT_SHARDS, seed: int = SEED, key: Column | None = None) -> Mix:
    spark = prepare(docs.sparkSession)
    key = F.xxhash64("doc_id") if key is None else key
    base = docs.select(key.alias("_key"), "doc_id", "source", n_words(F.col("text")).alias("size")).checkpoint(eager=True)
    sums = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r.source is None, r.source))
    sizes = [r.n for r in sums]
    goal = targets(sizes, weights, cap)
    blocks = [-(-n // block_words) for n in sizes]
    counts = np.array([min(cap * b, round(t * b / n)) if n else 0 for t, b, n in zip(goal, blocks, sizes)], np.int64)
    drawn = draw(counts, out_shards, seed) if counts.sum() else np.zeros((0, len(sums)), np.int64)
    shard, sidx = np.nonzero(drawn)
    first, n = (np.cumsum(drawn, axis=0) - drawn)[shard, sidx], drawn[shard, sidx]
    parts = -(-n // RANGE)
    at = np.repeat(np.arange(len(n)), parts)
    off = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)) * RANGE
    ranges = pa.table({"sidx": pa.array(sidx[at], pa.int32()), "shard": pa.array(shard[at], pa.int32()), "first": first[at] + off, "n": np.minimum(RANGE, n[at] - off), "blocks": np.array(blocks, np.int64)[sidx[at]]})
    slots = spark.createDataFrame(ranges).mapInArrow(_slots(seed), "sidx int, block long, shard int, slot long")
    kinds = local_rows(spark, [(i, r.source, r.n, t) for i, (r, t) in enumerate(zip(sums, goal))], "sidx int, _source string, source_size long, target double")
    named = base.join(kinds, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = running_offset(named, ["sidx"], ["doc_id", "size", "_key"], F.col("size"), "start").checkpoint(eager=True)
    b = F.lit(block_words)
    at = rows.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    cut = at.select("sidx", "_key", "start", "end", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
    low, high = F.greatest("start", F.col("block") * b), F.least("end", (F.col("block") + 1) * b)
    parts = cut.select("sidx", "block", "_key", "start", "size", (low - F.col("start")).alias("at"), (high - low).alias("length"))
    return Mix(rows, parts, slots)


def row_key(docs: DataFrame) -> Column:
    """128 bits of the SHA-256 of all columns; strings with their lengths, all else as JSON, nulls apart."""
    text = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c))
    one = [F.coalesce(text(f.name) if f.dataType.typeName() == "string" else F.to_json(F.struct(f.name)), F.lit("-")) for f in docs.schema]
    return F.unhex(F.substring(F.sha2(F.concat(*one), 256), 1, 32))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: docs' columns, one row for each document and epoch.

    In epoch r a document holds its blocks that are taken more than r times: all of them, then the
    row is the document as it was; else their words, runs of blocks parted by line breaks.
    """
    names = docs.columns
    m = mix(docs, key=row_key(docs), **options)
    times = m.taken_parts().select("_key", "sidx", "start", "size", "at", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))
    copy = times.groupBy("_key", "sidx", "start", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("_runs"), F.sum("length").alias("_words"))
    once = docs.select(row_key(docs).alias("_key"), F.struct(*names).alias("_row")).groupBy("_key").agg(F.first("_row").alias("_row"))
    both = once.join(copy, "_key")
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    follows = lambda r, i: F.get("_runs", i + 1)["at"] == r["at"] + r["length"]
    span = lambda r: F.array_join(F.slice(F.col("_w"), (r["at"] + 1).cast("int"), r["length"].cast("int")), " ")
    piece = F.array_join(F.transform("_runs", lambda r, i: F.concat(span(r), F.when(follows(r, i), F.lit(" ")).otherwise(F.lit("\n")))), "")
    whole = both.where(F.col("_words") == F.col("size")).select("_row.*")
    part = both.where(F.col("_words") < F.col("size")).withColumn("_w", words).select(*[(F.rtrim(piece, F.lit("\n")) if c == "text" else F.col("_row")[c]).alias(c) for c in names])
    if "n_chars" in names:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(part)
