"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its 3-word shingles.
Fingerprints that differ in at most ``radius`` bits are linked, classes are the connected
components. Every pair within the radius is found:

* Equal fingerprints are one row from the start (grouped map-side), so exact copies cost nothing.
* A fingerprint lies in the tile given by the population counts of its 8 bytes. One changed bit
  changes one count by one, so two fingerprints within the radius lie in tiles whose counts are
  at most ``radius`` apart in sum; all other tile pairs are skipped. A fingerprint goes to its own
  tile and to those half a radius around it: two tiles within the radius always have a tile midway.
* In such a bucket numpy compares blocks of rows by exclusive-or and bit counts, again skipping
  blocks whose total population counts differ beyond the radius, and keeps a spanning forest of the
  links only. A bucket above ``block_rows`` is split into blocks, and each pair of its blocks is a
  group of its own: no group is larger than twice that.

Null and empty texts, and those without a word, have fingerprint zero and are linked like any
other. Null ids are kept, and count only where a class has no other id. Repeated rows and ids are
kept as they are. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import Workspace, connected_components, deal, enter, id_type, prepare, whole_groups

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCK_ROWS = 1 << 16
TILE = 512
SMALL = 16


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """8 bytes, most significant bit first."""
    words = data.lower().split() if data else []
    n = len(words)
    if not n:
        return bytes(8)
    if n < shingle:
        digests, n = xxhash.xxh64_digest(b" ".join(words), seed), 1
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: n - shingle + 1].tolist()
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
        n = n - shingle + 1
    all_bytes, counts = np.frombuffer(digests, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 13):
        counts += np.unpackbits(all_bytes[k : k + (1 << 13)], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("simhash")
    for batch in batches:
        fps = b"".join([fingerprint(x.as_py()) for x in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">u8").astype(np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {id_type(docs, id_col)}, fp long")


def neighbourhood(reach: int, counts: int = 8) -> list[tuple[int, ...]]:
    """Integer vectors whose absolute values sum to at most reach."""
    out = {(0,) * counts}
    for _ in range(reach):
        out |= {tuple(x + (s if i == k else 0) for k, x in enumerate(v)) for v in out for i in range(counts) for s in (-1, 1)}
    return sorted(out)


def buckets_of(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of fingerprint) of all buckets of each fingerprint."""
    counts = np.bitwise_count(fps.astype("<u8").view(np.uint8).reshape(-1, 8)).astype(np.int64)
    place = 16 ** np.arange(8, dtype=np.int64)
    keys, index, every = [], [], np.arange(len(fps))
    for v in neighbourhood((radius + 1) // 2):
        at = counts + np.array(v, np.int64)
        ok = ((at >= 0) & (at <= 8)).all(axis=1)
        keys.append(at[ok] @ place)
        index.append(every[ok])
    return np.concatenate(keys), np.concatenate(index)


def _emit(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key, at = buckets_of(fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at])], ["bucket", "fp"])

    return run


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest fingerprint of its class) among one group's fingerprints."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    root = np.arange(len(fps))
    tiles = [slice(a, min(a + TILE, len(fps))) for a in range(0, len(fps), TILE)]
    for i, s in enumerate(tiles):
        for t in tiles[i:]:
            if pop[t.start] - pop[s.stop - 1] > radius:
                break
            near = (np.bitwise_count(fps[s, None] ^ fps[None, t]) <= radius) & (root[s, None] != root[None, t])
            a, b = np.nonzero(near)
            a, b = a + s.start, b + t.start
            while len(a):  # each round hangs every root that is named onto the lowest root named with it
                ra, rb = root[a], root[b]
                low = np.arange(len(root))
                np.minimum.at(low, np.maximum(ra, rb), np.minimum(ra, rb))
                while (low != low[low]).any():
                    low = low[low]
                root = low[root]
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
    least = np.full(len(fps), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, root, fps)
    least = least[root]
    other = least != fps
    return fps[other], least[other]


def links(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups; equal keys lie together."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat((size > 1) & (size <= SMALL), size)
    f, k = fps[small], key[small]
    us, vs = [], []
    for d in range(1, SMALL):
        if len(f) <= d:
            break
        at = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
        us.append(f[at])
        vs.append(f[at + d])
    for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        u, v = forest(fps[a : a + n], radius)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            key, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            u, v = links(key, fps.view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def link_classes(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root) of the distinct fingerprints (column fp) that have a partner."""
    prepare(distinct.sparkSession)
    at = distinct.select("fp").mapInArrow(_emit(radius), "bucket long, fp long")
    edges = deal(at, "bucket", "fp", block_rows).mapInArrow(_link(radius), "u long, v long")
    return connected_components(edges, "u", "v")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest id reachable by links."""
    prepare(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).checkpoint(eager=True)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint(eager=True)
    roots = link_classes(distinct, radius).withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    member = of.join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = similar.SHINGLE, similarity: float = similar.SIMILARITY) -> DataFrame:
    """docs with one row of each class of near duplicates: that of the smallest id.

    Linked are texts whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or
    more, found by ``similar``. Rows are known by id and text, so rows of one id and different texts
    are judged apart; null ids come last, rows of equal id by their texts' hashes; of rows of equal id
    and text one stays (with the smallest hash of all its columns). All texts without a word are one
    class. Other columns pass through. An empty table stays empty.
    """
    names = docs.columns
    with Workspace(docs.sparkSession) as ws:
        rows = similar.prefixes(ws, docs, id_col, text_col, shingle, similarity)
        roots = similar.similar_classes(ws, docs, rows, text_col, shingle, similarity).withColumnRenamed("node", "fp")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
        one = rows.groupBy("fp").agg(F.min(first).alias("low")).join(roots, "fp", "left").select("low", F.coalesce("root", "fp").alias("root"))
        low = one.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.doc_id").alias("_id"), F.col("low.fp").alias("_fp"))
        copies = rows.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).where("n > 1")
        again = low.join(copies, low["_id"].eqNullSafe(copies["doc_id"]) & (low["_fp"] == copies["fp"]), "left_semi")
        kept, again = ws.result(low), ws.result(again)
    # What a text without a word is named differs from its hash, so its row is known by the hash alone.
    word = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.select(F.struct(*names).alias("_r"), F.col(id_col).alias("_i"), F.when(word, similar.identity(F.col(text_col))).otherwise(F.lit(similar.NO_WORD)).alias("_f"))
    own = lambda df: named["_i"].eqNullSafe(df["_id"]) & (named["_f"] == df["_fp"])
    # Nearly all rows stay, so their list is as long as the table: never broadcast, at no size.
    if again.isEmpty():
        return named.join(kept.hint("merge"), own(kept), "left_semi").select("_r.*")
    left = kept.join(again, kept["_id"].eqNullSafe(again["_id"]) & (kept["_fp"] == again["_fp"]), "left_anti")
    many = named.join(again, own(again), "left_semi").groupBy("_i", "_f").agg(F.min_by("_r", F.xxhash64("_r")).alias("_r"))
    return named.join(left.hint("merge"), own(left), "left_semi").select("_r.*").unionByName(many.select("_r.*"))
