"""Contents: hashing, splitting, putting together with checks, erasure coding, recoverability."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_hashes(contents: DataFrame) -> DataFrame:
    """contents: (id, content)."""
    return contents.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def split(contents: DataFrame, size: int) -> DataFrame:
    """(id, sequence, data, size_bytes, sha256) of slices of ``size`` bytes; the last may be shorter, an empty content has none."""
    b = contents.select("id", F.col("content").cast("binary").alias("b")).where(F.octet_length("b") > 0)
    at = b.select("id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / size).cast("int"))).alias("sequence"))
    data = F.substring("b", F.col("sequence") * size + 1, F.lit(size))
    return at.select("id", F.col("sequence").cast("long").alias("sequence"), data.alias("data")).select("id", "sequence", "data", F.octet_length("data").cast("long").alias("size_bytes"), F.sha2("data", 256).alias("sha256"))


def split_scheduled(contents: DataFrame, tiers: Column) -> DataFrame:
    """split by tiers (count, size); count 0 means: for all that is left."""
    from .placement import estimate_chunks, size_for_seq

    b = contents.select("id", F.col("content").cast("binary").alias("b")).where(F.octet_length("b") > 0).withColumn("tiers", tiers)
    n = F.sequence(F.lit(0).cast("long"), estimate_chunks("tiers", F.octet_length("b")) - 1)
    sizes = F.transform(n, lambda k: size_for_seq("tiers", k))
    ends = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    at = b.select("id", "b", F.posexplode(F.arrays_zip(ends.alias("from"), sizes.alias("size"))).alias("sequence", "c")).where("c.size is not null")
    cut = at.select("id", F.col("sequence").cast("long").alias("sequence"), F.substring("b", (F.col("c.from") + 1).cast("int"), F.col("c.size").cast("int")).alias("data"))
    return cut.select("id", "sequence", "data", F.octet_length("data").cast("long").alias("size_bytes"), F.sha2("data", 256).alias("sha256"))


STATUS = "id {kind}, status string, n long, size_bytes long"


def _read(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Parts (id, sequence, data, sha256, whole) sorted by id and sequence: one row for each id. A file's hash
    is fed part by part; its bytes are held only if they are wanted."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[dict] = []
    for i, parts in itertools.groupby(rows(), key=lambda r: r[0]):
        sha, n, size, gap, good, data, whole = hashlib.sha256(), 0, 0, False, True, [], None
        for _, seq, part, own, whole in parts:  # noqa: B020
            gap |= seq != n
            good &= hashlib.sha256(part).hexdigest() == own
            sha.update(part)
            n, size = n + 1, size + len(part)
            if keep:
                data.append(part)
        status = "gap" if gap else "chunk_mismatch" if not good else "file_mismatch" if sha.hexdigest() != whole else "ok"
        out.append({"id": i, "status": status, "n": n, "size_bytes": size} | ({"content": b"".join(data) if status == "ok" else None} if keep else {}))
        if keep or len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _assembled(parts: DataFrame, whole: DataFrame, keep: bool) -> DataFrame:
    kind = parts.schema["id"].dataType.simpleString()
    both = parts.select("id", "sequence", "data", "sha256").join(whole.select("id", F.col("sha256").alias("whole")), "id")
    schema = STATUS.format(kind=kind) + (", content binary" if keep else "")
    return both.repartition("id").sortWithinPartitions("id", "sequence").mapInArrow(partial(_read, keep=keep), schema)


def assemble(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, status, n, size_bytes): if the parts of each id follow each other from 0, have their own
    hashes, and together the hash in whole (id, sha256)."""
    return _assembled(parts, whole, False)


def read_files(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, status, n, size_bytes, content): assemble, with the bytes of files that are whole."""
    return _assembled(parts, whole, True)


def integrity(files: DataFrame, chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, status) of each file by the catalog alone: in_progress, gap, no_location, ok; a file without chunks is ok if it is empty, else a gap."""
    has = locations.groupBy(F.col("chunk_id").alias("id")).agg(F.lit(1).alias("there"))
    c = chunks.join(has, "id", "left").groupBy("file_id").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("d"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count_if(F.col("there").isNull()).alias("lost"))
    f = files.select("id", "size_bytes", "upload_state").join(c.withColumnRenamed("file_id", "id"), "id", "left")
    gap = F.coalesce((F.col("lo") != 0) | (F.col("hi") + 1 != F.col("n")) | (F.col("d") != F.col("n")), F.col("size_bytes") > 0)
    status = F.when(F.col("upload_state") != "complete", "in_progress").when(gap, "gap").when(F.col("lost") > 0, "no_location").otherwise("ok")
    return f.select("id", status.alias("status"))


def integrity_of_path(files: DataFrame, chunks: DataFrame, locations: DataFrame, path: str) -> DataFrame:
    """The status of one path, not_found where no file has it."""
    own = files.where(F.col("virtual_path") == path)
    found = integrity(own, chunks.join(own.select(F.col("id").alias("file_id")), "file_id", "left_semi"), locations).select("status")
    one = files.sparkSession.range(1).select(F.lit("not_found").alias("other"))
    return one.join(found, how="left", on=F.lit(True)).select(F.coalesce("status", "other").alias("status"))


def undedupable(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Complete files whose content can't be cloned, as they have no chunk."""
    return files.where("upload_state = 'complete'").join(chunks.select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "sha256_full")


def shard_size(size: Column | str, data: Column | str) -> Column:
    s, d = (F.col(x) if isinstance(x, str) else x for x in (size, data))
    return F.when(s <= 0, F.lit(0)).otherwise(F.ceil(s / d)).cast("long")


def shard_sizes(chunks: DataFrame) -> DataFrame:
    each = shard_size("size_bytes", "data_shards")
    return chunks.select("id", each.alias("shard_bytes"), (each * (F.col("data_shards") + F.col("parity_shards"))).alias("stored_bytes"))


def recoverability(chunks: DataFrame, locations: DataFrame, lost: list[str]) -> DataFrame:
    """(file_id, chunks, readable_chunks, readable) when the providers in lost are gone: a chunk needs
    as many reachable shards, of numbers that it has, as it has data shards."""
    here = locations.where(~F.col("provider_id").isin(*lost))
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id", "data_shards", "parity_shards")
    n = c.join(here.select("chunk_id", "shard_index"), "chunk_id", "left").groupBy("chunk_id", "file_id", "data_shards").agg(F.count_if(F.col("shard_index") < F.col("data_shards") + F.col("parity_shards")).alias("n"))
    ok = F.col("n") >= F.col("data_shards")
    return n.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(ok).alias("readable_chunks"), F.bool_and(ok).alias("readable"))


# Reed-Solomon over the field of 256 elements with the polynomial x^8 + x^4 + x^3 + x^2 + 1.


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    return exp, log


EXP, LOG = _field()


def _times(a: int, v: np.ndarray) -> np.ndarray:
    return np.zeros_like(v) if not a else np.where(v == 0, 0, EXP[LOG[a] + LOG[v]]).astype(np.uint8)


def _apply(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), rows.shape[1]), np.uint8)
    for i, r in enumerate(m.tolist()):
        for a, v in zip(r, rows):
            out[i] ^= _times(a, v)
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        k = next(r for r in range(i, n) if a[r, i])
        a[[i, k]] = a[[k, i]]
        a[i] = _times(int(EXP[255 - LOG[a[i, i]]]), a[i])
        for r in range(n):
            if r != i and a[r, i]:
                a[r] ^= _times(int(a[r, i]), a[i])
    return a[:, n:]


def generator(data: int, parity: int) -> np.ndarray:
    """data unit rows, then Cauchy rows: any ``data`` of all rows are independent."""
    cauchy = [[int(EXP[255 - LOG[(data + i) ^ j]]) for j in range(data)] for i in range(parity)]
    return np.concatenate([np.eye(data, dtype=np.uint8), np.array(cauchy, np.uint8).reshape(parity, data)])


def encode(content: bytes, data: int, parity: int) -> list[bytes]:
    if data < 1 or parity < 1 or data + parity > 255:
        raise ValueError("at least one data and one parity shard, 255 in all at most")
    size = -(-len(content) // data)
    rows = np.frombuffer(content.ljust(size * data, b"\0"), np.uint8).reshape(data, size)
    return [bytes(r) for r in _apply(generator(data, parity), rows)]


def reconstruct(shards: list[bytes | None], data: int, parity: int) -> list[bytes]:
    """All shards, from any ``data`` of them."""
    there = [i for i, s in enumerate(shards) if s is not None][:data]
    if len(there) < data:
        raise ValueError(f"{data} shards are needed, {len(there)} are there")
    g = generator(data, parity)
    rows = np.stack([np.frombuffer(shards[i], np.uint8) for i in there])
    return [bytes(r) for r in _apply(g, _apply(_inverse(g[there]), rows))]


def joined(shards: list[bytes], data: int, size: int) -> bytes:
    return b"".join(shards[:data])[:size]


def verify(shards: list[bytes], data: int, parity: int) -> bool:
    rows = np.stack([np.frombuffer(s, np.uint8) for s in shards[:data]])
    return [bytes(r) for r in _apply(generator(data, parity)[data:], rows)] == list(shards[data:])


def erasure_roundtrip(contents: DataFrame, data: int, parity: int) -> DataFrame:
    """(id, shard_bytes, same): each content encoded, the first ``parity`` shards lost, and put together again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, c in zip(b.id, b.content):
                shards = encode(bytes(c), data, parity)
                back = reconstruct([None] * parity + shards[parity:], data, parity)
                rows.append((i, len(shards[0]), joined(back, data, len(c)) == bytes(c) and verify(back, data, parity)))
            yield pd.DataFrame(rows, columns=["id", "shard_bytes", "same"])

    kind = contents.schema["id"].dataType.simpleString()
    return contents.select("id", F.col("content").cast("binary").alias("content")).mapInPandas(run, f"id {kind}, shard_bytes long, same boolean")
