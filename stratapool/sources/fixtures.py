"""The catalog as mapped from the driver's star-schema tables, for tests, queries and the benchmark.

Every rule is deterministic and has the same meaning in the SQL of plans/sql.py. Tables that take
more than a projection are written once a session, as a catalog would be, and read as Parquet by
every query: to the folder of spark.checkpoint.dir, or to a temporary one on a local master.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import Catalog

NOW = 1_706_745_600
ACTIONS = {"click": "download", "error": "delete", "purchase": "upload", "signup": "mkdir", "view": "verify"}
FS_OPS = {"click": "Create", "view": "Write", "purchase": "Write", "error": "Remove", "signup": "Rename"}
STATES = {"click": "queued", "view": "preparing", "purchase": "uploading", "error": "failed", "signup": "complete"}
EXTENSIONS = [".txt", ".pdf", ".jpg", ".mp4", ".zip", ".ts", ".mp3", ".docx"]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

_folders: dict[str, str] = {}
_written: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        base = sc.getConf().get("spark.checkpoint.dir")
        if base:
            _folders[app] = f"{base}/stratapool-fixtures-{app}"
        elif sc.master == "local" or sc.master.startswith("local["):
            _folders[app] = tempfile.mkdtemp(prefix="stratapool-fixtures-")
            atexit.register(shutil.rmtree, _folders[app], True)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _folders[app]


def stored(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    @functools.wraps(build)
    def read(self: Fixtures) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, build.__name__)
        if key not in _written:
            path = f"{folder(self.spark)}/{hashlib.sha256(self.sf_dir.encode()).hexdigest()[:16]}/{build.__name__}"
            rows = build(self)
            rows.repartition(self.spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(path)
            _written[key] = path, rows.schema
        path, schema = _written[key]
        return self.spark.read.schema(schema).parquet(path)

    return read


def _of(col: str, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(col))


def _id(prefix: str, col: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def _cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def _epoch(col: str) -> Column:
    return F.unix_timestamp(F.col(col).cast("timestamp"))


@dataclass(frozen=True)
class Fixtures:
    """Tables of one directory, each built when asked for."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _suppliers(self) -> DataFrame:
        """One row: the number of suppliers."""
        return self.table("supplier").agg(F.count("*").alias("n_suppliers"))

    def _modulo(self, rows: DataFrame, key: Column, name: str, more: int = 0) -> DataFrame:
        return rows.join(F.broadcast(self._suppliers()), on=F.lit(True)).withColumn(name, key % (F.col("n_suppliers") + more)).drop("n_suppliers")

    @stored
    def providers(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            _id("p", k).alias("id"),
            F.element_at(F.array(*map(F.lit, ("drive", "dropbox", "onedrive", "box"))), (k % 4 + 1).cast("int")).alias("type"),
            F.col("s_name").alias("display_name"),
            _id("r", k).alias("rclone_remote"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))).alias("account_identity"),
            F.lit(2_000_000).cast("long").alias("quota_total_bytes"),
            F.when(k % 11 != 0, _cents("s_acctbal")).alias("quota_free_bytes"),
            F.lit(NOW).cast("long").alias("quota_polled_at"),
            F.when(k % 5 == 0, F.lit(NOW + 3600)).when(k % 5 == 1, F.lit(NOW - 3600)).cast("long").alias("rate_limited_until"),
        )

    @stored
    def files(self) -> DataFrame:
        k = F.col("o_orderkey")
        slug = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
        top = F.concat(F.lit("/"), F.when(k % 89 == 0, F.upper(slug)).otherwise(slug))
        mark = F.when(k % 97 == 0, F.lit("._")).when(k % 53 == 0, F.lit("[")).otherwise(F.lit(""))
        name = F.concat(mark, F.lit("order_"), k.cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (k % 8 + 1).cast("int")))
        place = F.when(k % 211 == 0, F.lit("")).when(k % 50 == 0, top).otherwise(F.concat(top, F.date_format("o_orderdate", "/yyyy/MM")))
        pending = F.col("o_orderstatus") == "P"
        return self.table("orders").select(
            _id("f", k).alias("id"),
            F.concat(place, F.lit("/"), name).alias("virtual_path"),
            _cents("o_totalprice").alias("size_bytes"),
            _epoch("o_orderdate").alias("created_at"),
            (_epoch("o_orderdate") + k % 86400).alias("modified_at"),
            F.sha2(_id("c", "o_custkey"), 256).alias("sha256_full"),
            F.when(pending, F.lit("pending")).otherwise(F.lit("complete")).alias("upload_state"),
            F.when(pending & (k % 3 != 0), _id("/spool/", k)).alias("tmp_path"),
        )

    @stored
    def _lines(self) -> DataFrame:
        seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
        k = F.col("l_orderkey")
        rows = self.table("lineitem").withColumn("sequence", seq.cast("long")).where(~((k % 173 == 0) & (F.col("sequence") == 1)))
        coded = k % 10 == 0
        return rows.select(
            F.concat(F.lit("c"), k.cast("string"), F.lit("-"), F.col("sequence").cast("string")).alias("id"),
            _id("f", k).alias("file_id"),
            "sequence",
            _cents("l_extendedprice").alias("size_bytes"),
            F.sha2(_id("p", "l_partkey"), 256).alias("sha256"),
            _cents("l_extendedprice").alias("cloud_size"),
            F.when(coded, 3).otherwise(1).alias("data_shards"),
            F.when(coded, 1).otherwise(0).alias("parity_shards"),
            "l_partkey",
            "l_suppkey",
        )

    def chunks(self) -> DataFrame:
        return self._lines().drop("l_partkey", "l_suppkey")

    @stored
    def _locations(self) -> DataFrame:
        n = F.col("data_shards") + F.col("parity_shards")
        rows = self._lines().select(F.col("id").alias("chunk_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("shard_index"), n.alias("n"), "l_partkey", "l_suppkey")
        path = F.concat(F.lit("chunks/"), (F.col("l_partkey") % 500).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
        rows = self._modulo(rows, F.col("l_suppkey") + F.col("shard_index"), "pk")
        return rows.select(
            "chunk_id",
            "shard_index",
            "pk",
            F.when(F.col("n") > 1, F.concat(path, F.lit(".s"), F.col("shard_index").cast("string"))).otherwise(path).alias("remote_path"),
            "l_partkey",
            _id("p", "pk").alias("provider_id"),
            F.lit(NOW).cast("long").alias("upload_confirmed_at"),
        )

    def chunk_locations(self) -> DataFrame:
        return self._locations().select("chunk_id", "shard_index", "provider_id", "remote_path", "upload_confirmed_at")

    @stored
    def directories(self) -> DataFrame:
        r = self.table("region").select("r_regionkey", F.concat(F.lit("/"), F.lower("r_name")).alias("path"))
        n = self.table("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("path", F.lit("/"), F.lower("n_name")).alias("path"))
        return r.select("path").unionByName(n).select("path", F.lit(NOW).cast("long").alias("created_at"))

    @stored
    def listing(self) -> DataFrame:
        """(provider_id, path, name, size, is_dir, mtime): objects as the providers list them. Every tenth
        provider lists bare names, the one after it paths of another directory, and each a directory of its own."""
        lost = (F.col("l_partkey") % 50 == 7) & (F.col("pk") % 4 != 1)
        there = self._locations().where(~lost).select("pk", F.col("remote_path").alias("path"), F.lit(NOW - 86_400).cast("long").alias("mtime"), F.lit(False).alias("is_dir")).distinct()
        k = F.col("p_partkey")
        extra = self._modulo(self.table("part"), k, "pk").select("pk", _id("chunks/orphan-", k).alias("path"), (F.lit(NOW) - k % 12 * 100).cast("long").alias("mtime"), F.lit(False).alias("is_dir"))
        dirs = self.table("supplier").select(F.col("s_suppkey").alias("pk"), F.lit("chunks/old").alias("path"), F.lit(NOW).cast("long").alias("mtime"), F.lit(True).alias("is_dir"))
        rows = there.unionByName(extra).unionByName(dirs).where(~F.col("pk").isin(7, 9)).withColumn("name", F.substring_index("path", "/", -1))
        path = F.when(F.col("pk") % 10 == 3, F.col("name")).when(F.col("pk") % 10 == 4, F.concat(F.lit("moved/"), "name")).otherwise(F.col("path"))
        return rows.select(_id("p", "pk").alias("provider_id"), path.alias("path"), "name", F.lit(100).cast("long").alias("size"), "is_dir", "mtime")

    def scanned(self) -> DataFrame:
        """Providers whose listing could be read: provider 7's is empty, provider 9's is missing."""
        return self.providers().where("id <> 'p9'").select(F.col("id").alias("provider_id"))

    @stored
    def activity_log(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), _of("event_type", ACTIONS).alias("action"), _id("/u", "user_id").alias("path"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("detail"), _epoch("ts").alias("created_at"))

    @stored
    def failed_deletions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        rows = self._modulo(self.table("events").where("event_type = 'error'"), F.col("user_id"), "pk", 2)
        return rows.select(F.col("event_id").alias("id"), _id("p", F.col("pk")).alias("provider_id"), _id("chunks/gone-", "event_id").alias("remote_path"), _epoch("ts").alias("failed_at"), (k % 13).cast("int").alias("retry_count"), F.when(F.col("event_id") % 2 == 0, F.lit("error 429: rate limit")).otherwise(F.lit("quota exceeded")).alias("last_error"))

    def counters(self) -> DataFrame:
        key = F.when(F.col("event_type") == "click", "files_downloaded").when(F.col("event_type") == "error", "files_deleted").when(F.col("event_type") == "purchase", "files_uploaded").when(F.col("event_type") == "view", "dedup_hits").otherwise("other")
        return self.table("events").groupBy(key.alias("key")).agg(F.count("*").alias("value"))

    @stored
    def fs_events(self) -> DataFrame:
        """(path, op, t_ms, content, state): about one event in 1.4 s for each of 200 paths."""
        return self.table("events").select(_id("/u", F.col("user_id") % 200).alias("path"), _of("event_type", FS_OPS).alias("op"), (F.col("event_id") * 7).alias("t_ms"), _id("h", F.col("event_id") % 40).alias("content"), _of("event_type", STATES).alias("state"))

    def contents(self) -> DataFrame:
        return self.table("documents").select(_id("d", "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))

    def catalog(self) -> Catalog:
        return Catalog(self.providers(), self.files(), self.chunks(), self.chunk_locations(), self.directories(), self.failed_deletions(), self.activity_log(), self.counters())
