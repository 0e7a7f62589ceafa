"""Read queries over the catalog: functions of DataFrames.

A pending file is hidden from listings, search, sizes and reading, and seen by look-ups, existence
tests and renames. Prefixes compare A-Z without case (functions.paths.fold). Where any one row would
do, the one of the smallest id is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def complete(files: DataFrame) -> DataFrame:
    return files.where(F.col("upload_state") == "complete")


def provider_chunk_bytes(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bytes of chunks by provider, a chunk counted once for each of its shards."""
    c = chunks.select(F.col("id").alias("chunk_id"), "cloud_size")
    return locations.select("chunk_id", "provider_id").join(c, "chunk_id").groupBy("provider_id").agg(F.coalesce(F.sum("cloud_size"), F.lit(0)).alias("bytes"))


def provider_physical_bytes(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bytes that providers really hold: each stored object once, at its shard's size."""
    c = chunks.select(F.col("id").alias("chunk_id"), "cloud_size", "data_shards")
    shard = F.ceil(F.col("cloud_size") / F.col("data_shards")).cast("long")
    objects = locations.join(c, "chunk_id").groupBy("provider_id", "remote_path").agg(F.max(shard).alias("size"))
    return objects.groupBy("provider_id").agg(F.sum("size").alias("bytes"))


def pending_uploads(files: DataFrame) -> DataFrame:
    return files.where(F.col("upload_state") == "pending")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("virtual_path") == path)


def complete_file_by_path(files: DataFrame, path: str) -> DataFrame:
    return complete(file_by_path(files, path))


def complete_file_by_hash(files: DataFrame, sha: str) -> DataFrame:
    found = complete(files).where(F.col("sha256_full") == sha)
    return found.agg(F.min_by(F.struct(*files.columns), "id").alias("f")).where("f is not null").select("f.*")


def chunks_for_file(chunks: DataFrame, file_id: str) -> DataFrame:
    return chunks.where(F.col("file_id") == file_id).orderBy("sequence")


def locations_of_chunk(locations: DataFrame, chunk_id: str) -> DataFrame:
    return locations.where(F.col("chunk_id") == chunk_id).orderBy("shard_index")


def locations_of_file(locations: DataFrame, chunks: DataFrame, file_id: str) -> DataFrame:
    c = chunks.where(F.col("file_id") == file_id).select(F.col("id").alias("chunk_id"), "sequence")
    return locations.join(c, "chunk_id").orderBy("sequence", "shard_index").select(*locations.columns)


def locations_of_provider(locations: DataFrame, provider_id: str) -> DataFrame:
    return locations.where(F.col("provider_id") == provider_id)


def list_files(files: DataFrame, directory: str) -> DataFrame:
    """Direct children that are complete."""
    tail = paths.rest("virtual_path", directory)
    return complete(files).where(paths.under("virtual_path", directory) & (F.instr(tail, "/") == 0))


def list_subdirectories(files: DataFrame, directories: DataFrame, directory: str) -> DataFrame:
    """Names of child directories, explicit ones and those that files of any state lie in."""
    def first(df: DataFrame, col: str, more: bool) -> DataFrame:
        tail = paths.rest(col, directory)
        found = df.where(paths.under(col, directory))
        return (found.where(F.instr(tail, "/") > 0) if more else found).select(F.split_part(tail, F.lit("/"), F.lit(1)).alias("name"))

    return first(directories, "path", False).unionByName(first(files, "virtual_path", True)).where("name <> ''").distinct()


def providers_sorted(providers: DataFrame) -> DataFrame:
    return providers.orderBy("display_name")


def provider_by_id(providers: DataFrame, provider_id: str) -> DataFrame:
    return providers.where(F.col("id") == provider_id)


def provider_by_remote(providers: DataFrame, remote: str) -> DataFrame:
    found = providers.where(F.col("rclone_remote") == remote)
    return found.agg(F.min_by(F.struct(*providers.columns), "id").alias("p")).where("p is not null").select("p.*")


def remote_path_refcount(locations: DataFrame) -> DataFrame:
    return locations.groupBy("remote_path").agg(F.count("*").alias("refs"))


def file_chunk_credits(locations: DataFrame, chunks: DataFrame, file_id: str) -> DataFrame:
    """Bytes that go free at each provider when a file goes: of objects that nothing else refers to."""
    c = chunks.where(F.col("file_id") == file_id).select(F.col("id").alias("chunk_id"), "cloud_size")
    own = locations.join(c, "chunk_id")
    wanted = own.select("remote_path").distinct()
    single = remote_path_refcount(locations.join(wanted, "remote_path", "left_semi")).where("refs = 1")
    return own.join(single, "remote_path", "left_semi").groupBy("provider_id").agg(F.sum("cloud_size").alias("bytes"))


def all_credits(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_chunk_credits of every file at once."""
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id", "cloud_size")
    single = locations.groupBy("remote_path").agg(F.count("*").alias("n"), F.first("chunk_id").alias("chunk_id"), F.first("provider_id").alias("provider_id")).where("n = 1")
    return single.join(c, "chunk_id").groupBy("file_id", "provider_id").agg(F.sum("cloud_size").alias("bytes"))


def file_exists(files: DataFrame, path: str) -> DataFrame:
    return file_by_path(files, path).agg((F.count("*") > 0).alias("found"))


def path_is_dir(files: DataFrame, directories: DataFrame, path: str) -> DataFrame:
    """The root, an explicit directory, or what a file of any state lies below."""
    if paths.norm_dir(path) == "/":
        return files.sparkSession.range(1).select(F.lit(True).alias("found"))
    own = paths.norm_dir(path).rstrip("/")
    hits = directories.where(F.col("path") == own).select(F.lit(1).alias("x")).unionByName(files.where(paths.under("virtual_path", path)).select(F.lit(1).alias("x")))
    return hits.limit(1).agg((F.count("*") > 0).alias("found"))


def directory_exists(directories: DataFrame, path: str) -> DataFrame:
    own = paths.norm_dir(path).rstrip("/")
    return directories.agg((F.lit(own == "") | (F.count_if(F.col("path") == own) > 0)).alias("found"))


def files_under_dir(files: DataFrame, directory: str) -> DataFrame:
    return files.where(paths.under("virtual_path", directory))


def failed_deletions(queue: DataFrame, limit: int) -> DataFrame:
    return queue.orderBy("failed_at", "id").limit(limit)


def search_files(files: DataFrame, root: str, pattern: str) -> DataFrame:
    """Complete files below root whose base name the glob matches."""
    return complete(files).where(paths.under("virtual_path", root) & paths.glob_matches(paths.base("virtual_path"), pattern))


def list_all_files(files: DataFrame, root: str) -> DataFrame:
    return complete(files).where(paths.under("virtual_path", root)).orderBy("virtual_path")


def disk_usage(files: DataFrame, root: str, case_sensitive: bool = False) -> DataFrame:
    return complete(files).where(paths.under("virtual_path", root, case_sensitive)).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def recent_activity(log: DataFrame, limit: int = 50) -> DataFrame:
    n = limit if limit > 0 else 50
    return log.select("id", "action", "path", F.coalesce("detail", F.lit("")).alias("detail"), "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def storage_totals(files: DataFrame) -> DataFrame:
    return complete(files).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def restore_sample(locations: DataFrame, providers: DataFrame, n: int = 3) -> DataFrame:
    """A few stored objects with their remotes, by which a restored catalog is tried."""
    p = providers.select(F.col("id").alias("provider_id"), "rclone_remote")
    return locations.join(p, "provider_id").orderBy("chunk_id", "shard_index").limit(n).select("rclone_remote", "remote_path", F.regexp_replace("remote_path", "/[^/]*$", "").alias("directory"))


def restore_valid(sample: DataFrame, listing: DataFrame) -> DataFrame:
    """If nothing is stored, or each sampled object's directory lists something."""
    dirs = sample.select("rclone_remote", "directory").distinct()
    there = listing.select("rclone_remote", F.regexp_replace("path", "/[^/]*$", "").alias("directory")).distinct()
    return dirs.join(there, ["rclone_remote", "directory"], "left_anti").agg((F.count("*") == 0).alias("valid"))
