"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero, so equal
passages are cut alike wherever they stand. The store keeps one compressed frame for each chunk
digest, found by a Spark join of the chunk lists of all distinct payloads with the distinct chunks,
and packs frames and their references into rows of bounded size. Reading back sends each frame to
the payloads that refer to it; a payload is put together in the order of its list and must have the
SHA-256 under which it was stored.

Frames are compressed with a dictionary, trained on the chunks of a bounded sample of payloads (SAMPLE
of the smallest hashed ids); it changes sizes only.

Bytes are shuffled once to find equal chunks and once to put payloads together, compressed both
times. Equal payloads are one from the start. A chunk referred to by more than one in HOT_SHARE of
all references is dealt out over several groups (at most HOT_SHARE such chunks exist, so their list
is broadcast), each of which stores a copy.

A null text is an empty one; the payload is padded by zero bytes to a positive multiple of 64. A
payload is held whole by one task; groups of payloads never are. Repeated rows stay. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, id_type, prepare

UNIT = 64
SMALLEST, BITS, LARGEST = 2048, 12, 32768
LEVEL = 13
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 112_640, 400, 8 << 20
HOT_SHARE = 2000
PACK_BYTES, PACK_REFS = 1 << 18, 4096
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def payload(data: bytes | None) -> bytes:
    data = data or b""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of its last 32 bytes' table values, each shifted by its distance: five doublings."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes) -> list[int]:
    """The chunks' ends."""
    n, out, last = len(data), [], 0
    if n <= SMALLEST:
        return [n]
    at = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    while n - last > SMALLEST:
        k = int(np.searchsorted(at, last + SMALLEST))
        last = min(int(at[k]) if k < len(at) else n, last + LARGEST, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda x: hashlib.sha256(x).digest()
    for batch in batches:
        size, media, lists = [], [], []
        for t in batch.column(1):
            text = t.as_py() or b""
            data = payload(text)
            size.append(len(text))
            media.append(digest(data))
            lists.append([digest(c) for c in chunks(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "chunks"])


def dictionary(texts: list[bytes]) -> bytes:
    """A compression dictionary from the chunks of a few payloads; empty if they are too few for one."""
    import zstandard

    samples = [c for t in texts for c in chunks(payload(t))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shared(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _frames(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Each chunk's digest and compressed bytes; what this task has just sent isn't sent again."""
    import zstandard

    z, sent = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(words)), set()
    for batch in batches:
        keys, frames, held = [], [], 0
        for t in batch.column(1):
            for c in chunks(payload(t.as_py())):
                key = hashlib.sha256(c).digest()
                if key in sent:
                    continue
                sent.add(key)
                keys.append(key)
                frames.append(z.compress(c))
                held += len(frames[-1])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(frames, pa.binary())], ["chunk", "frame"])
                keys, frames, held = [], [], 0
        if len(sent) > 1 << 18:
            sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(frames, pa.binary())], ["chunk", "frame"])


PACK = pa.schema([("frames", pa.list_(pa.binary())), ("media", pa.list_(pa.binary())), ("seq", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("frame", pa.list_(pa.int32()))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, media, seq, n, frame) sorted by chunk: rows of frames and of references to them."""
    pack: dict[str, list] = {k: [] for k in PACK.names}
    last, held = None, 0
    for batch in batches:
        for key, media, seq, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
            if held > PACK_BYTES or len(pack["seq"]) >= PACK_REFS:
                yield pa.RecordBatch.from_pylist([pack], PACK)
                pack, last, held = {k: [] for k in PACK.names}, None, 0
            if key != last:
                pack["frames"].append(frame)
                last, held = key, held + len(frame)
            for k, v in (("media", media), ("seq", seq), ("n", n), ("frame", len(pack["frames"]) - 1)):
                pack[k].append(v)
    if pack["seq"]:
        yield pa.RecordBatch.from_pylist([pack], PACK)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            frames, media, seq, n, at = (c[i].values for c in batch.columns)
            yield pa.RecordBatch.from_arrays([media, seq, n, frames.take(at)], ["media", "seq", "n", "frame"])


def feature(data: bytes, n_chunks: int) -> str:
    """Chunks, distinct byte values, mean and entropy of the bytes."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return f"{n_chunks}:{len(p)}:{float(n @ np.arange(256)) / len(data):.3f}:{float(-(p * np.log2(p)).sum()):.4f}"


FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuild(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Frames sorted by (media, seq): payloads, checked against the digest that names them."""
    import zstandard

    z, out = zstandard.ZstdDecompressor(dict_data=_shared(words)), []
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def rows() -> Iterator[tuple[bytes, int, bytes]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    def flush() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        out.clear()
        return made

    for media, of in itertools.groupby(rows(), key=lambda r: r[0]):
        parts = list(of)
        frames = [f for _, _, f in parts]
        data = b"".join([z.decompress(f) for f in frames])
        sha = hashlib.sha256(data)
        if len(parts) != parts[0][1] or sha.digest() != media:
            raise ValueError(f"payload {media.hex()} can't be put together from its chunks")
        stored = b"".join(frames)
        out.append((media, len(data), sha.hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data, len(parts))))
        if len(out) >= 2000:
            yield flush()
    if out:
        yield flush()


class Store:
    """lists: one row a document (doc_id, n_bytes, media, chunks); packs: the chunk frames with references;
    words: the compression dictionary that all frames need."""

    def __init__(self, lists: DataFrame, packs: DataFrame, words: bytes):
        self.lists, self.packs, self.words = lists, packs, words

    def frames(self) -> DataFrame:
        """(media, seq, n, frame): the ordered frames of each distinct payload."""
        return self.packs.mapInArrow(_unpack, "media binary, seq int, n int, frame binary")

    def features(self) -> DataFrame:
        """One row for each distinct payload, from its bytes as read back."""
        return self.frames().repartition("media").sortWithinPartitions("media", "seq").mapInArrow(partial(_rebuild, words=self.words), FEATURES)


def sample(docs: DataFrame, id_col: str, text_col: str) -> list[bytes]:
    """Texts of the SAMPLE smallest hashed ids, SAMPLE_BYTES in all at most, for the dictionary only."""
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).join(F.broadcast(ids), "_id")
    few = rows.where(F.octet_length("_t").between(1, SAMPLE_BYTES // SAMPLE)).groupBy("_id").agg(F.min("_t").alias("_t")).collect()
    return [bytes(r["_t"]) for r in sorted(few, key=lambda r: str(r["_id"]))]


def write(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    lists = ws.save(rows.mapInArrow(_lists, f"doc_id {id_type(docs, id_col)}, n_bytes long, media binary, chunks array<binary>"))
    one = lists.select("media", "chunks").dropDuplicates(["media"])
    refs = one.select("media", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "chunk"))
    total = lists.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).first()[0]
    share = max(1000, total // HOT_SHARE)
    hot = refs.groupBy("chunk").count().where(F.col("count") > share).select("chunk", F.ceil(F.col("count") / share).cast("int").alias("parts"))
    hot = F.broadcast(hot.limit(HOT_SHARE))  # no more can exist
    parts = F.coalesce("parts", F.lit(1))
    words = dictionary(sample(docs, id_col, text_col))
    found = rows.mapInArrow(partial(_frames, words=words), "chunk binary, frame binary").join(hot, "chunk", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    distinct = found.groupBy("chunk", "part").agg(F.first("frame").alias("frame"))
    dealt = refs.join(hot, "chunk", "left").withColumn("part", F.pmod(F.xxhash64("media"), parts).cast("int"))
    both = dealt.join(distinct, ["chunk", "part"]).select("chunk", "media", "seq", "n", "frame", "part").sortWithinPartitions("chunk", "part")
    packs = ws.save(both.drop("part").mapInArrow(_pack, "frames array<binary>, media array<binary>, seq array<int>, n array<int>, frame array<int>"))
    return Store(lists, packs, words)


def columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each row."""
    with Workspace(docs.sparkSession) as ws:
        store = write(ws, docs, id_col, text_col)
        made = ws.save(store.features())
        ws.drop(store.packs)
        out = store.lists.select("doc_id", "n_bytes", "media").join(made, "media")
        return ws.result(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
