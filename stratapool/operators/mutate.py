"""Changes of the catalog: an old snapshot and a change make a new snapshot.

Tables in Parquet have no update in place, so every change is a function from DataFrames to a
DataFrame. Rows that a change names are anti-joined away and united with their new versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.schema import Catalog


def _set(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def insert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace: rows of an equal id and rows of an equal path go. An empty state means complete.
    Of new rows that share an id, and then of those that share a path, the last one stays: that of the
    latest change, of equal ones that of the largest row."""
    for key in ("id", "virtual_path"):
        row = F.struct(*[F.col(c) for c in files.columns])
        new = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct("modified_at", row)).alias("_row")).select("_row.*")
    new = new.withColumn("upload_state", F.when(F.col("upload_state") == "", "complete").otherwise(F.col("upload_state")))
    left = files.join(new.select("id"), "id", "left_anti").join(new.select("virtual_path"), "virtual_path", "left_anti")
    return left.select(*files.columns).unionByName(new.select(*files.columns))


def replaced_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that insert_files drops."""
    by_id = files.join(new.select("id"), "id", "left_semi").select(*files.columns)
    by_path = files.join(new.select("virtual_path"), "virtual_path", "left_semi").select(*files.columns)
    return by_id.unionByName(by_path).distinct()


def set_upload_complete(files: DataFrame, file_id: str) -> DataFrame:
    return _set(files, F.col("id") == file_id, upload_state=F.lit("complete"), tmp_path=F.lit(None))


def append(table: DataFrame, new: DataFrame) -> DataFrame:
    """New rows of chunks, locations, activity or failed deletions."""
    return table.unionByName(new.select(*table.columns))


def insert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Like append; 0 data shards mean 1."""
    return append(chunks, new.withColumn("data_shards", F.when(F.col("data_shards") == 0, 1).otherwise(F.col("data_shards"))))


def insert_file_with_chunks(catalog: Catalog, files: DataFrame, chunks: DataFrame, locations: DataFrame) -> Catalog:
    return catalog.replace(files=insert_files(catalog.files, files), chunks=insert_chunks(catalog.chunks, chunks), chunk_locations=append(catalog.chunk_locations, locations))


def confirm_upload(locations: DataFrame, chunk_id: str, shard: int, now: int) -> DataFrame:
    return _set(locations, (F.col("chunk_id") == chunk_id) & (F.col("shard_index") == shard), upload_confirmed_at=F.lit(now))


def affected(df: DataFrame, where: Column) -> DataFrame:
    return df.agg(F.count_if(where).alias("rows"))


def delete_files(catalog: Catalog, gone: DataFrame) -> Catalog:
    """Without the files whose id is in gone, their chunks, and those chunks' locations."""
    ids = gone.select(F.col("id").alias("file_id"))
    dead = catalog.chunks.join(ids, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return catalog.replace(
        files=catalog.files.join(gone.select("id"), "id", "left_anti"),
        chunks=catalog.chunks.join(ids, "file_id", "left_anti").select(*catalog.chunks.columns),
        chunk_locations=catalog.chunk_locations.join(dead, "chunk_id", "left_anti").select(*catalog.chunk_locations.columns),
    )


def delete_file_by_path(catalog: Catalog, path: str) -> Catalog:
    return delete_files(catalog, catalog.files.where(F.col("virtual_path") == path))


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def deduct_free(providers: DataFrame, provider_id: str, delta: int) -> DataFrame:
    known = (F.col("id") == provider_id) & F.col("quota_free_bytes").isNotNull()
    return _set(providers, known, quota_free_bytes=F.greatest(F.col("quota_free_bytes") - delta, F.lit(0)))


def credit_free(providers: DataFrame, provider_id: str, delta: int) -> DataFrame:
    known = (F.col("id") == provider_id) & F.col("quota_free_bytes").isNotNull()
    return _set(providers, known, quota_free_bytes=F.col("quota_free_bytes") + delta)


def credit_all(providers: DataFrame, credits: DataFrame) -> DataFrame:
    """Free space after credits (provider_id, bytes), as after failed or deleted uploads."""
    c = credits.groupBy(F.col("provider_id").alias("id")).agg(F.sum("bytes").alias("_credit"))
    return providers.join(c, "id", "left").withColumn("quota_free_bytes", F.col("quota_free_bytes") + F.coalesce("_credit", F.lit(0))).select(*providers.columns)


def create_directory(directories: DataFrame, path: str, now: int) -> DataFrame:
    own = path.removesuffix("/")
    if own in ("", "/"):
        return directories
    new = directories.sparkSession.range(1).select(F.lit(own).alias("path"), F.lit(now).cast("long").alias("created_at"))
    return directories.unionByName(new.join(directories.select("path"), "path", "left_anti"))


def delete_directories_under(directories: DataFrame, path: str) -> DataFrame:
    own = paths.norm_dir(path).rstrip("/")
    return directories.where(~((F.col("path") == own) | paths.under("path", path)))


def rename_file(files: DataFrame, old: str, new: str, now: int) -> DataFrame:
    hit = F.col("virtual_path") == old
    return _set(files, hit, virtual_path=F.lit(new), modified_at=F.lit(now))


def _moved(path: Column, old: str, new: str) -> Column:
    return F.concat(F.lit(paths.norm_dir(new)), paths.rest(path, old))


def rename_files_under(files: DataFrame, old: str, new: str) -> DataFrame:
    """Paths are cut by characters, so names of any script keep theirs; times stay."""
    return _set(files, paths.under("virtual_path", old), virtual_path=_moved(F.col("virtual_path"), old, new))


def rename_directories_under(directories: DataFrame, old: str, new: str) -> DataFrame:
    a, b = (paths.norm_dir(x).rstrip("/") for x in (old, new))
    out = F.when(F.col("path") == a, F.lit(b)).when(paths.under("path", old), _moved(F.col("path"), old, new)).otherwise(F.col("path"))
    return directories.withColumn("path", out)


def rename_conflicts(files: DataFrame, old: str, new: str) -> DataFrame:
    """Paths that two files would share after rename_files_under: such a rename must not be done."""
    return rename_files_under(files, old, new).groupBy("virtual_path").count().where("count > 1").select("virtual_path")


def move_file(catalog: Catalog, old: str, new: str, now: int) -> Catalog:
    """A rename that first deletes what is at its target."""
    out = delete_file_by_path(catalog, new)
    return out.replace(files=rename_file(out.files, old, new, now))


def queue_failed(queue: DataFrame, new: DataFrame) -> DataFrame:
    return append(queue, new)


def unqueue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("id"), "id", "left_anti")


def retry_failed(queue: DataFrame, again: DataFrame) -> DataFrame:
    """again: (id, last_error)."""
    a = again.select("id", F.col("last_error").alias("_error"), F.lit(1).alias("_n"))
    j = queue.join(a, "id", "left")
    return j.withColumn("retry_count", (F.col("retry_count") + F.coalesce("_n", F.lit(0))).cast("int")).withColumn("last_error", F.when(F.col("_n").isNotNull(), F.col("_error")).otherwise(F.col("last_error"))).select(*queue.columns)


def increment_counters(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    return counters.unionByName(deltas.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def clone_from_donor(catalog: Catalog, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, locations) of new files whose content is stored already.

    new: rows of files. The donor is the complete file of the smallest id with equal content that
    has chunks. Clones have ids derived from their file and sequence, and the donor's remote paths.
    """
    wanted = new.select("sha256_full").distinct()
    has = catalog.chunks.select(F.col("file_id").alias("id")).distinct()
    donors = catalog.files.where("upload_state = 'complete'").join(wanted, "sha256_full", "left_semi").join(has, "id", "left_semi").groupBy("sha256_full").agg(F.min("id").alias("donor"))
    pairs = new.join(donors, "sha256_full")
    old = catalog.chunks.select(F.col("id").alias("old_chunk"), F.col("file_id").alias("donor"), *[c for c in catalog.chunks.columns if c not in ("id", "file_id")])
    clone_id = F.concat(F.col("file_id"), F.lit("/"), F.col("sequence").cast("string"))
    made = pairs.select(F.col("id").alias("file_id"), "donor").join(old, "donor").withColumn("id", clone_id)
    at = catalog.chunk_locations.withColumnRenamed("chunk_id", "old_chunk").join(made.select("old_chunk", F.col("id").alias("chunk_id")), "old_chunk")
    return pairs.select(*catalog.files.columns), made.select(*catalog.chunks.columns), at.select(*catalog.chunk_locations.columns)


def clone_and_replace(catalog: Catalog, new: DataFrame) -> Catalog:
    """The catalog with clones of what is stored already, in one step: what was at their paths goes with its
    chunks and locations, unless it is the donor itself (then only its row's path is taken over)."""
    files, chunks, locations = clone_from_donor(catalog, new)
    gone = replaced_files(catalog.files, files)
    left = delete_files(catalog, gone.select("id"))
    complete = files.withColumn("upload_state", F.lit("complete")).withColumn("tmp_path", F.lit(None).cast("string"))
    return left.replace(files=left.files.unionByName(complete), chunks=left.chunks.unionByName(chunks), chunk_locations=left.chunk_locations.unionByName(locations))


def overwrite_swap(catalog: Catalog, files: DataFrame, chunks: DataFrame, locations: DataFrame) -> tuple[Catalog, DataFrame]:
    """(catalog, objects): an overwrite whose upload has ended. The rows that were at the new files' paths go
    with their chunks and locations, the new ones come. objects: (provider_id, remote_path) of the old chunks
    that nothing refers to any more; they are to be deleted last."""
    old = replaced_files(catalog.files, files)
    ids = old.select(F.col("id").alias("file_id"))
    dead = catalog.chunks.join(ids, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    were = catalog.chunk_locations.join(dead, "chunk_id", "left_semi").select("provider_id", "remote_path").distinct()
    out = insert_file_with_chunks(delete_files(catalog, old.select("id")), files, chunks, locations)
    return out, were.join(out.chunk_locations.select("remote_path"), "remote_path", "left_anti").select("provider_id", "remote_path")


def broken_files(catalog: Catalog, missing: DataFrame) -> DataFrame:
    """(file_id) of one file, that of the smallest id, for each missing object (provider_id, remote_path)."""
    c = catalog.chunks.select(F.col("id").alias("chunk_id"), "file_id")
    hit = catalog.chunk_locations.join(missing.select("provider_id", "remote_path").distinct(), ["provider_id", "remote_path"], "left_semi").join(c, "chunk_id")
    return hit.groupBy("provider_id", "remote_path").agg(F.min("file_id").alias("file_id")).select("file_id").distinct()


def purge_files(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Without the files in ids (file_id), their chunks and locations, also where the file's row has gone
    already; then without chunks of no file."""
    return sweep_orphan_records(delete_files(catalog, ids.select(F.col("file_id").alias("id"))))


def sweep_orphan_records(catalog: Catalog) -> Catalog:
    """Without chunks of no file, and locations of such chunks."""
    dead = catalog.chunks.join(catalog.files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    lost = catalog.chunk_locations.join(dead.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    return catalog.replace(chunk_locations=lost.select(*catalog.chunk_locations.columns), chunks=catalog.chunks.join(dead.select("id"), "id", "left_anti").select(*catalog.chunks.columns))
