"""Helpers that the training-data operators share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors), never to a machine-local folder of a cluster; a local default is set only where the
session has none and its master is local, as in tests. Checkpoints go when nothing refers to them
any more, unless the session says otherwise.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = r"[^\x20\x09-\x0D]+"
#: What one Arrow batch holds, so that a Python worker's memory is bounded; settings of the session's start win.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Python workers live through several operators: freed memory goes back to the system at once.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
CHECKPOINT_CLEANUP = "spark.cleaner.referenceTracking.cleanCheckpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master is local, a local one is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "stratapool-checkpoints"))
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers and checkpoint() usable."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)
    for key, most in BATCH_LIMITS.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, most)
    if not spark.sparkContext.getConf().contains(CHECKPOINT_CLEANUP):
        spark.sparkContext._jsc.sc().conf().set(CHECKPOINT_CLEANUP, "true")
    shared_dir(spark)
    return spark


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the SQL execution that made them has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


_owner: str | None = None


def enter(owner: str) -> None:
    """Called by a task of an operator in its Python worker: what other operators have kept there goes."""
    global _owner
    if _owner not in (None, owner):
        for name in ("bpe", "langid", "toxicity"):
            if name != owner and (module := sys.modules.get(f"{__package__}.{name}")) is not None:
                module.release()
        gc.collect()
    _owner = owner


class Workspace:
    """Tables in the shared folder that live while one operator runs.

    with Workspace(spark) as ws:
        t = ws.save(df)          # written as Parquet, read again: lineage is cut
        return ws.result(out)    # checkpointed, as the tables go at the end
    """

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark)}/stratapool-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Workspace:
        return self

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/t{self.n}"

    def save(self, df: DataFrame, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
        path, schema = self.path(), df.schema
        with shuffle_cleanup(self.spark):
            w = df.write.option("compression", codec)
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.stratapool_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.stratapool_path)

    def result(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def __exit__(self, *exc) -> None:
        self._delete(self.base)
        gc.collect()


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. Through Arrow: a list would start Python workers that only pass it on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame(spark.sparkContext.emptyRDD(), schema).schema)
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


def deal(rows: DataFrame, key: str, by: str, block_rows: int) -> DataFrame:
    """rows with the key's place taken by ``part``, dealt and sorted by it: for each pair of rows of
    one key there is a part with both. Keys of more than block_rows rows are split into blocks by a
    hash of ``by``, and each pair of blocks is a part, so no part is larger than about twice that.
    Keys whose parts collide are in one part: they are compared as well."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != key]
    hot = rows.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > block_rows).checkpoint(eager=True)
    if hot.isEmpty():
        parts = rows.select(F.col(key).alias("part"), *others)
    else:
        n = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / block_rows).cast("int")
        own = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n")))
        pairs = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        part = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("_b", "_o"), F.greatest("_b", "_o")))
        parts = pairs.select(part.alias("part"), *others)
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group ends; rows are sorted by the first column, whole numbers."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if not cut and (not held or held[-1].column(0)[-1].as_py() == keys[0]):
                held.append(batch)
                continue
            held, rest = [*held, batch.slice(0, cut)], [batch.slice(cut)]
        else:
            rest = []
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = rest


def id_type(df: DataFrame, col: str = "doc_id") -> str:
    return df.schema[col].dataType.simpleString()


def n_words(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offset(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int = 1024) -> DataFrame:
    """Adds ``out``: within each group, the sum of ``value`` over the rows before this one.

    The order is (bucket, order columns), where bucket is a hash of the first order column, so it
    depends on the rows only. No task holds a group: a task sums one bucket of a group, and the
    buckets' totals (groups times ``buckets`` rows) are summed apart.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(F.col(order[0])), F.lit(buckets)).cast("int")).withColumn("_v", value.cast("long"))
    keys = [F.col(g) for g in group]
    totals = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    on = (F.col("_b") == F.col("_gb"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = b.withColumn("_l", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return (
        local.join(starts, on, "left")
        .withColumn(out, (F.col("_l") + F.col("_s")).cast("long"))
        .drop("_b", "_v", "_l", "_s", "_gb", *[f"_g{i}" for i in range(len(group))])
    )


SIEVE_BITS = 1 << 26


class Sieve:
    """Parts rows whose key may be in a table from those whose key surely isn't, without moving any.

    The keys' hashes are bits of a map that is broadcast: about eight bits a key, SIEVE_BITS (8 MB) at
    most. Some rows without a partner pass (one in eight or fewer below SIEVE_BITS / 8 keys, more
    above); none with one is lost. So a join that follows shuffles few rows, not the whole table.
    """

    def __init__(self, ws: Workspace, keys: DataFrame):
        self.bits = 1 << max(15, min(SIEVE_BITS.bit_length() - 1, (8 * keys.count()).bit_length()))
        at = keys.select(self._at(*keys.columns).alias("_x"))
        self.maps = ws.result(at.groupBy(F.bitmap_bucket_number("_x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits")))

    def _at(self, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits)) + 1

    def part(self, rows: DataFrame, *key: Column | str) -> tuple[DataFrame, DataFrame]:
        """(rows that may have a partner, rows that have none)"""
        at = rows.withColumn("_x", self._at(*key))
        both = at.join(F.broadcast(self.maps), F.bitmap_bucket_number("_x") == F.col("_bucket"), "left")
        place = F.bitmap_bit_position("_x")
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1), F.lit(0)) == 1
        return both.where(bit).select(*rows.columns), both.where(~bit).select(*rows.columns)


HOT_SHARE = 2000


def join_sums(rows: DataFrame, sums: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with what was aggregated from them by keys (column n: the rows of each key).

    Keys with more than one in HOT_SHARE of all rows are at most HOT_SHARE, so their sums are
    broadcast and their rows stay where they are; the others meet by a shuffle, in which no key is
    larger than that share (or 1000 rows).
    """
    least = max(1000, total // HOT_SHARE)
    hot = F.broadcast(sums.where(F.col(n) > least))
    few = sums.where(F.col(n) <= least)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(few, keys))


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris and others, 2014), each cut by
    checkpoint(). A hub is summed map-side by min(), and joined back by a join that Spark can
    split. No edges: an empty table.
    """
    a, b = F.greatest(u, v).alias("u"), F.least(u, v).alias("v")
    e = edges.where(F.col(u) != F.col(v)).select(a, b).distinct().checkpoint(eager=True)

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = sign(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint(eager=True)
        now = sign(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
