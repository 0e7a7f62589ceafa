"""Token counts of documents in flat token files, by a separator scan.

A token file is nothing but identifiers, one after another, with an end-of-document identifier after
each document and no index. It is looked at in blocks of fixed size that know nothing of documents.
In each block numpy finds all separators at once; a block's summary is its number of tokens, its
number of separators and the end of its last one. A prefix scan over a file's blocks (running sums
and a running maximum) gives each block the documents and the open document's tokens before it, so
that the document which a block ends can have begun in any earlier block.

Only summaries (one row a block) are ordered by file; separator positions stay in their blocks, tokens
are never shuffled. Tokens behind a file's last separator are a last, open document (``closed`` false).
Files without tokens have no rows.

``flat_files`` reads byte ranges of files of any size, several tasks a file. ``pack`` writes documents
as such files (little-endian unsigned, 16 bits where the identifiers fit), each task one of its own
name, with a side table of doc_ids by file and position; what a lost task has written is named by no
row of it. Both open files by pyarrow.fs (file, hdfs, s3, gs, abfs); other stores are refused. Null and
empty texts are documents of 0 tokens; null ids and repeated rows stay; a text is encoded whole by one
task. Other columns are not looked at. An empty table gives no file and no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bpe
from .common import Workspace, id_type, local_rows, prepare

BLOCK_TOKENS = 1 << 18
RANGE_BYTES = 1 << 26


def _open(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def pack(ws: Workspace, docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame, int, int]:
    """(folder, places, separator, bytes of an identifier): flat files in the folder, places (file, ordinal, doc_id)."""
    spark = prepare(docs.sparkSession)
    ranks = bpe.read_ranks(rank_path)
    separator = sum(1 for x in ranks.splitlines() if x)  # the first free identifier
    width = 2 if separator < 1 << 16 else 4
    shared, folder = spark.sparkContext.broadcast(ranks), ws.path()
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, ordinal, out = bpe.codec(shared.value), 0, None
        name, end = f"{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}.tokens", np.array([separator], kind).tobytes()
        try:
            for batch in batches:
                for a, b in bpe.groups(bpe.lengths(batch.column(1))):
                    if out is None:
                        store, base = _open(folder)
                        store.create_dir(base)
                        out = store.open_output_stream(f"{base}/{name}")
                    for ids in c.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]):
                        out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), pa.array(range(ordinal, ordinal + b - a), pa.int64()), batch.column(0).slice(a, b - a)], ["file", "ordinal", "doc_id"])
                    ordinal += b - a
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    places = ws.save(rows.mapInArrow(run, f"file string, ordinal long, doc_id {id_type(docs, id_col)}"))
    return folder, places, separator, width


def flat_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, block, data) of the flat files in a folder; a task reads a range of range_bytes block by block."""
    prepare(spark)
    size = block_tokens * width
    step = max(1, range_bytes // size) * size
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [(s.getPath().toString(), s.getLen()) for s in (store.listStatus(at) if store.exists(at) else []) if s.isFile()]
    for name, n in files:
        if n % width:
            raise ValueError(f"{name} isn't a whole number of identifiers")
    ranges = local_rows(spark, [(name, k, min(step, n - k)) for name, n in files for k in range(0, n, step)], "file string, first long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                known, inside = _open(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with known.open_input_file(inside) as f:
                    for k in range(first, first + n, size):
                        data = f.read_at(min(size, first + n - k), k)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // size], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return ranges.mapInArrow(run, "file string, block long, data binary")


def separators(data: bytes, separator: int, width: int) -> tuple[int, np.ndarray]:
    """The number of tokens, and the positions of separators."""
    ids = np.frombuffer(data, f"<u{width}")
    return len(ids), np.flatnonzero(ids == separator)


def count(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """(file, ordinal, n_tokens, first_token, closed), one row for each document of each file."""
    spark = prepare(blocks.sparkSession)
    file = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [separators(d.as_py(), separator, width) for d in batch.column(2)]
            ends = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(e) for _, e in found])].astype(np.int32)), pa.array(np.concatenate([e for _, e in found]) if found else np.empty(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), ends], ["file", "block", "n", "ends"])

    found = blocks.select("file", "block", "data").mapInArrow(run, f"file {file}, block long, n long, ends array<long>").checkpoint(eager=True)
    in_file = W.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    s = found.select("file", "block", "n", F.size("ends").cast("long").alias("k"), F.element_at("ends", F.when(F.size("ends") > 0, F.lit(-1))).alias("last"))
    s = s.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("k").over(before), F.lit(0)))
    s = s.withColumn("stop", F.col("start") + F.col("last") + 1).withColumn("open", F.coalesce(F.max("stop").over(before), F.lit(0))).withColumn("tail", F.lead("block").over(in_file).isNull())
    joined = found.select("file", "block", "ends").join(s.where("k > 0").select("file", "block", "docs", "start", "open").hint("merge"), ["file", "block"])
    closed = joined.select("file", "docs", "start", "open", "ends", F.posexplode("ends").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1) + 1)
    one = closed.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), (F.col("start") + F.col("end") - first).alias("n_tokens"), first.alias("first_token"), F.lit(True).alias("closed"))
    rest = F.coalesce("stop", "open")
    tail = s.where("tail").select("file", (F.col("docs") + F.col("k")).alias("ordinal"), (F.col("start") + F.col("n") - rest).alias("n_tokens"), rest.alias("first_token"), F.lit(False).alias("closed"))
    return one.unionByName(tail.where("n_tokens > 0"))


def of_documents(docs: DataFrame, rank_path: str | None = None, block_tokens: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens, first_token) for each row: packed into flat files, these scanned, and
    joined to doc_ids by position."""
    with Workspace(docs.sparkSession) as ws:
        folder, places, separator, width = pack(ws, docs, rank_path)
        counts = count(flat_files(docs.sparkSession, folder, width, block_tokens, range_bytes), separator, width).where("closed")
        counts = counts.withColumn("file", F.substring_index("file", "/", -1)).hint("merge")
        return ws.result(places.join(counts, ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens", "first_token"))
