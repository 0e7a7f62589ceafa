"""Schemas of the catalog and of the relations beside it; opening, snapshots and JSON sources."""

from __future__ import annotations

import dataclasses
import json
import tomllib
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(spec: str) -> T.StructType:
    """Fields of simple types; needs no session, unlike StructType.fromDDL."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in spec.split(", "))])


TABLES: dict[str, T.StructType] = {
    "providers": _schema("id string, type string, display_name string, rclone_remote string, account_identity string, quota_total_bytes long, quota_free_bytes long, quota_polled_at long, rate_limited_until long"),
    "files": _schema("id string, virtual_path string, size_bytes long, created_at long, modified_at long, sha256_full string, upload_state string, tmp_path string"),
    "chunks": _schema("id string, file_id string, sequence long, size_bytes long, sha256 string, cloud_size long, data_shards int, parity_shards int"),
    "chunk_locations": _schema("chunk_id string, shard_index int, provider_id string, remote_path string, upload_confirmed_at long"),
    "directories": _schema("path string, created_at long"),
    "failed_deletions": _schema("id long, provider_id string, remote_path string, failed_at long, retry_count int, last_error string"),
    "activity_log": _schema("id long, action string, path string, detail string, created_at long"),
    "counters": _schema("key string, value long"),
}
LISTING = _schema("Path string, Name string, Size long, IsDir boolean, ModTime string")
TRANSFERS = T.StructType([T.StructField("speed", T.DoubleType()), T.StructField("transferring", T.ArrayType(_schema("name string, bytes long")))])
QUOTA = _schema("total long, used long, free long")
FS_EVENT = _schema("path string, op string, ts timestamp")
MAGIC = b"stratadb"  # first eight bytes of our backups; those of other makers are given by the caller


@dataclasses.dataclass(frozen=True)
class Catalog:
    """The eight tables, and what a reconciliation needs beside them."""

    providers: DataFrame
    files: DataFrame
    chunks: DataFrame
    chunk_locations: DataFrame
    directories: DataFrame
    failed_deletions: DataFrame
    activity_log: DataFrame
    counters: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}

    def replace(self, **tables: DataFrame) -> Catalog:
        return dataclasses.replace(self, **tables)

    def views(self) -> Catalog:
        for n, df in self.tables().items():
            df.createOrReplaceTempView(n)
        return self


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stamps of a target's whole snapshots, oldest first."""
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def open_catalog(spark: SparkSession, path: str, stamp: int | None = None) -> Catalog:
    """A snapshot's tables, the newest one's unless a stamp is given; schemas are given, never inferred.
    A table that is missing is empty."""
    known = versions(spark, path)
    own = stamp if stamp is not None else known[-1] if known else None
    out = {}
    for n, schema in TABLES.items():
        fs, at = _fs(spark, f"{path}/v={own}/{n}")
        out[n] = spark.read.schema(schema).parquet(f"{path}/v={own}/{n}") if own is not None and fs.exists(at) else spark.createDataFrame([], schema)
    return Catalog(**out)


def save_catalog(catalog: Catalog, targets: list[str], stamp: int, keep: int = 2) -> None:
    """The same snapshot at every target, as version ``stamp``: locations laid out by chunk, files by folded path.

    A version is written aside and gets its name at once when it is whole, so a crash leaves the
    versions before it as they are. The newest ``keep`` versions stay.
    """
    from ..functions.paths import fold

    spark = catalog.files.sparkSession
    for target in targets:
        aside = f"{target}/.v={stamp}-{uuid.uuid4().hex}"
        for n, df in catalog.tables().items():
            if n == "files":
                df = df.sortWithinPartitions(fold(F.col("virtual_path")))
            elif n == "chunk_locations":
                df = df.sortWithinPartitions("chunk_id", "shard_index")
            df.write.mode("overwrite").parquet(f"{aside}/{n}")
        fs, made = _fs(spark, aside)
        _, place = _fs(spark, f"{target}/v={stamp}")
        if fs.exists(place) or not fs.rename(made, place):
            fs.delete(made, True)
            raise FileExistsError(f"{target} has a snapshot of stamp {stamp}")
        for old in versions(spark, target)[:-keep]:
            fs.delete(_fs(spark, f"{target}/v={old}")[1], True)


def backup_blobs(rows: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """(…, data) from (…, stamp, content): eight magic bytes, big-endian nanoseconds, content."""
    stamp = F.unhex(F.lpad(F.hex("stamp"), 16, "0"))
    return rows.withColumn("data", F.concat(F.lit(magic), stamp, F.col("content").cast("binary"))).drop("stamp", "content")


def backup_payloads(blobs: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """(…, stamp, content) of backup blobs (column data): eight magic bytes, big-endian nanoseconds, content."""
    head = F.substring("data", 1, 8) == F.lit(magic)
    stamp = F.conv(F.hex(F.substring("data", 9, 8)), 16, 10).cast("decimal(20,0)").cast("long")
    ok = head & (F.octet_length("data") >= 16)
    return blobs.withColumn("stamp", F.when(ok, stamp)).withColumn("content", F.when(ok, F.expr("substring(data, 17)")))


def newest_backup(blobs: DataFrame, source_col: str = "source", magic: bytes = MAGIC) -> DataFrame:
    """The backup of the largest positive stamp; of equal ones the first source. No row if there is none."""
    return backup_payloads(blobs, magic).where("stamp > 0").agg(F.min_by(F.struct(source_col, "stamp", "content"), F.struct(-F.col("stamp"), F.col(source_col))).alias("b")).where("b is not null").select("b.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Object listings captured as JSON: {"list": [{Path, Name, ...}]}, one document a file."""
    doc = T.StructType([T.StructField("list", T.ArrayType(LISTING))])
    return spark.read.schema(doc).option("multiLine", True).json(path).select(F.inline("list"))


def listed_rows(listing: DataFrame, provider_id: str) -> DataFrame:
    """A provider's listing as reconciliation takes it: (provider_id, path, name, size, is_dir, mtime)."""
    from ..functions.text import rfc3339

    return listing.select(F.lit(provider_id).alias("provider_id"), F.col("Path").alias("path"), F.col("Name").alias("name"), F.col("Size").alias("size"), F.col("IsDir").alias("is_dir"), rfc3339("ModTime").alias("mtime"))


def quotas(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Quota answers; a missing number is 0."""
    q = F.from_json(json_col, QUOTA)
    return rows.select("*", *[F.coalesce(q[c], F.lit(0)).cast("long").alias(c) for c in QUOTA.names])


def fresh_quotas(cache: DataFrame, now: int, ttl: int = 900) -> DataFrame:
    """Cached quotas younger than their time to live."""
    return cache.where(F.lit(now) - F.col("fetched_at") < ttl)


def remote_types(configs: DataFrame, json_col: str = "json") -> DataFrame:
    """(…, type) of remotes' settings; unknown where it isn't said."""
    cfg = F.from_json(json_col, T.MapType(T.StringType(), T.StringType()))
    return configs.withColumn("type", F.coalesce(cfg["type"], F.lit("unknown")))


def remotes(spark: SparkSession, path: str) -> DataFrame:
    """(remote) of captured answers {"remotes": [name, ...]}, one document a file."""
    doc = T.StructType([T.StructField("remotes", T.ArrayType(T.StringType()))])
    return spark.read.schema(doc).option("multiLine", True).json(path).select(F.explode("remotes").alias("remote"))


def remote_config(configs: DataFrame, json_col: str = "json") -> DataFrame:
    """(…, key, value) of remotes' settings."""
    return configs.select("*", F.explode(F.from_json(json_col, T.MapType(T.StringType(), T.StringType()))))


def without_quota(cache: DataFrame, remotes: list[str] | None = None) -> DataFrame:
    """The quota cache without the entries of the remotes, or without any."""
    return cache.where(F.lit(False)) if remotes is None else cache.where(~F.col("remote").isin(*remotes))


def local_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of every file below a directory; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of objects, read whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def file_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of file-system events from Parquet files that arrive in a directory."""
    return spark.readStream.schema(FS_EVENT).parquet(path)


def load_config(path: str) -> dict:
    """Settings from TOML; a file that is missing has none."""
    p = Path(path)
    return tomllib.loads(p.read_text()) if p.exists() else {}


def load_selection(path: str) -> list[str] | None:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else None


def save_selection(path: str, remotes: list[str] | None) -> None:
    Path(path).write_text(json.dumps(remotes))
