"""The registered queries: each a DataFrame over the fixtures' catalog, most with DuckDB's SQL for the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import analytics as an
from ..operators import catalog as q
from ..operators import content as co
from ..operators import mutate as mu
from ..operators import placement as pl
from ..sources import schema as sc
from ..sources.fixtures import NOW, Fixtures, folder
from ..streaming import events as ev
from .sql import base, fold, under, with_tables

DIR, DEEP, FILE, PATH = "/1-urgent", "/2-high", "f10", "/order_844.zip"
FILES = "id, virtual_path, size_bytes, created_at, modified_at, sha256_full, upload_state, tmp_path"
GONE = ["p1", "p2", "p3"]

BUILD: dict[str, Callable[[Fixtures], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Fixtures], DataFrame], sql: str | None = None, **ctes: str) -> None:
    BUILD[name] = build
    if sql is not None:
        SQL[name] = with_tables(sql, **ctes)


def _k():
    return F.regexp_extract("id", r"\d+", 0).cast("long")


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def tenth(x: str) -> str:
    return f"printf('%.1f', {x})"


# Look-ups and scans.

query("provider_chunk_bytes", lambda f: q.provider_chunk_bytes(f.chunk_locations(), f.chunks()), f"SELECT provider_id, {big('sum(cloud_size)')} AS bytes FROM chunk_locations JOIN chunks ON chunk_id = id GROUP BY 1")
query("provider_physical_bytes", lambda f: q.provider_physical_bytes(f.chunk_locations(), f.chunks()), f"SELECT provider_id, {big('sum(size)')} AS bytes FROM (SELECT provider_id, remote_path, max({big('ceil(cloud_size / data_shards)')}) AS size FROM chunk_locations JOIN chunks ON chunk_id = id GROUP BY 1, 2) GROUP BY 1")
query("pending_uploads", lambda f: q.pending_uploads(f.files()), f"SELECT {FILES} FROM files WHERE upload_state = 'pending'")
query("file_by_path", lambda f: q.file_by_path(f.files(), PATH), f"SELECT {FILES} FROM files WHERE virtual_path = '{PATH}'")
query("complete_file_by_path", lambda f: q.complete_file_by_path(f.files(), PATH), f"SELECT {FILES} FROM files WHERE virtual_path = '{PATH}' AND upload_state = 'complete'")
_sha = "sha256('c7')"
query("complete_file_by_hash", lambda f: q.complete_file_by_hash(f.files(), hashlib.sha256(b"c7").hexdigest()), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND sha256_full = {_sha} ORDER BY id LIMIT 1")
query("chunks_for_file", lambda f: q.chunks_for_file(f.chunks(), FILE), f"SELECT * FROM chunks WHERE file_id = '{FILE}'")
query("chunk_locations", lambda f: q.locations_of_chunk(f.chunk_locations(), "c10-0"), "SELECT * FROM chunk_locations WHERE chunk_id = 'c10-0'")
query("locations_for_file", lambda f: q.locations_of_file(f.chunk_locations(), f.chunks(), FILE), f"SELECT l.* FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id WHERE file_id = '{FILE}'")
query("locations_by_provider", lambda f: q.locations_of_provider(f.chunk_locations(), "p3"), "SELECT * FROM chunk_locations WHERE provider_id = 'p3'")
query("all_locations", lambda f: f.chunk_locations(), "SELECT * FROM chunk_locations")
_tail = lambda d: f"substr(virtual_path, {len(d) + 2})"
query("list_files", lambda f: q.list_files(f.files(), DIR), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') = 0")
query("list_files_root", lambda f: q.list_files(f.files(), "/"), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND instr(substr(virtual_path, 2), '/') = 0")
query("list_subdirectories", lambda f: q.list_subdirectories(f.files(), f.directories(), DIR + "/"), f"SELECT DISTINCT split_part({_tail(DIR)}, '/', 1) AS name FROM files WHERE {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') > 0")
query("list_subdirectories_root", lambda f: q.list_subdirectories(f.files(), f.directories(), "/"), "SELECT DISTINCT name FROM (SELECT split_part(substr(virtual_path, 2), '/', 1) AS name FROM files WHERE instr(substr(virtual_path, 2), '/') > 0 UNION ALL SELECT split_part(substr(path, 2), '/', 1) FROM directories)")
query("providers_sorted", lambda f: q.providers_sorted(f.providers()), "SELECT * FROM providers")
query("provider_by_id", lambda f: q.provider_by_id(f.providers(), "p4"), "SELECT * FROM providers WHERE id = 'p4'")
query("provider_by_remote", lambda f: q.provider_by_remote(f.providers(), "r5"), "SELECT * FROM providers WHERE rclone_remote = 'r5'")
query("remote_path_refcount", lambda f: q.remote_path_refcount(f.chunk_locations()), "SELECT remote_path, count(*) AS refs FROM chunk_locations GROUP BY 1")
query("file_chunk_credits", lambda f: q.file_chunk_credits(f.chunk_locations(), f.chunks(), FILE), f"SELECT provider_id, {big('sum(cloud_size)')} AS bytes FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id WHERE file_id = '{FILE}' AND (SELECT count(*) FROM chunk_locations o WHERE o.remote_path = l.remote_path) = 1 GROUP BY 1")
query("all_credits", lambda f: q.all_credits(f.chunk_locations(), f.chunks()), f"SELECT file_id, provider_id, {big('sum(cloud_size)')} AS bytes FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id JOIN (SELECT remote_path FROM chunk_locations GROUP BY 1 HAVING count(*) = 1) USING (remote_path) GROUP BY 1, 2")
query("file_exists", lambda f: q.file_exists(f.files(), PATH), f"SELECT count(*) > 0 AS found FROM files WHERE virtual_path = '{PATH}'")
query("path_is_dir", lambda f: q.path_is_dir(f.files(), f.directories(), DEEP), f"SELECT (SELECT count(*) FROM files WHERE {under('virtual_path', DEEP + '/')}) + (SELECT count(*) FROM directories WHERE path = '{DEEP}') > 0 AS found")
query("directory_exists", lambda f: q.directory_exists(f.directories(), "/asia/"), "SELECT count(*) > 0 AS found FROM directories WHERE path = '/asia'")
query("files_under_dir", lambda f: q.files_under_dir(f.files(), DEEP), f"SELECT {FILES} FROM files WHERE {under('virtual_path', DEEP + '/')}")
query("list_all_files", lambda f: q.list_all_files(f.files(), DEEP), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND {under('virtual_path', DEEP + '/')}")
query("failed_deletions_oldest", lambda f: q.failed_deletions(f.failed_deletions(), 50), "SELECT * FROM failed_deletions ORDER BY failed_at, id LIMIT 50")
for _name, _glob in (("star", "order_1*.pdf"), ("question", "order_1?.*"), ("class", "order_[1-3]*[^t]"), ("escape", "order\\_[0-9]*")):
    query(f"search_glob_{_name}", lambda f, g=_glob: q.search_files(f.files(), "/", g), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND regexp_matches({base('virtual_path')}, '{paths.glob_regex(_glob)}')")
query("search_glob_empty", lambda f: q.search_files(f.files(), DIR, ""), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND {under('virtual_path', DIR + '/')}")
query("search_glob_malformed", lambda f: q.search_files(f.files(), "/", "[order_1"), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND contains({base('virtual_path')}, '[order_1')")
_du = lambda w: f"SELECT count(*) AS files, {big('coalesce(sum(size_bytes), 0)')} AS bytes FROM files WHERE upload_state = 'complete' AND {w}"
query("disk_usage", lambda f: q.disk_usage(f.files(), DIR, case_sensitive=True), _du(f"starts_with(virtual_path, '{DIR}/')"))
query("disk_usage_folded", lambda f: q.disk_usage(f.files(), "/1-URGENT"), _du(under("virtual_path", DIR + "/")))
query("disk_usage_of_file", lambda f: q.disk_usage(f.files(), PATH), _du(under("virtual_path", PATH + "/")))
query("recent_activity", lambda f: q.recent_activity(f.activity_log(), 100), "SELECT id, action, path, coalesce(detail, '') AS detail, created_at FROM activity_log ORDER BY created_at DESC, id DESC LIMIT 100")
query("counters", lambda f: f.counters(), "SELECT * FROM counters")
query("storage_totals", lambda f: q.storage_totals(f.files()), _du("true"))
query("emptiness", lambda f: f.files().agg((F.count("*") == 0).alias("no_files")).join(f.providers().agg((F.count("*") == 0).alias("no_providers")), on=F.lit(True)), "SELECT (SELECT count(*) = 0 FROM files) AS no_files, (SELECT count(*) = 0 FROM providers) AS no_providers")
query("restore_sample_check", lambda f: q.restore_sample(f.chunk_locations(), f.providers()), "SELECT rclone_remote, remote_path, regexp_replace(remote_path, '/[^/]*$', '') AS directory FROM chunk_locations l JOIN providers p ON p.id = l.provider_id ORDER BY chunk_id, shard_index LIMIT 3")


# Changes: the new snapshot's rows.


def _new_files(f: Fixtures) -> DataFrame:
    """Two of equal id, two of equal path, one new."""
    k = F.regexp_extract("id", r"\d+", 0).cast("int")
    own = f.files().where(k.isin(1, 2, 3, 4))
    changed = F.when(k <= 2, F.concat("virtual_path", F.lit(".new"))).otherwise(F.col("virtual_path"))
    again = own.withColumn("virtual_path", changed).withColumn("id", F.when(k <= 2, F.col("id")).otherwise(F.concat("id", F.lit("x"))))
    return again.withColumn("upload_state", F.lit(""))


_new_sql = f"""SELECT CASE WHEN id IN ('f1', 'f2') THEN id ELSE id || 'x' END AS id, CASE WHEN id IN ('f1', 'f2') THEN virtual_path || '.new' ELSE virtual_path END AS virtual_path,
    size_bytes, created_at, modified_at, sha256_full, 'complete' AS upload_state, tmp_path FROM files WHERE id IN ('f1', 'f2', 'f3', 'f4')"""
query("insert_file_replace", lambda f: mu.insert_files(f.files(), _new_files(f)), f"SELECT {FILES} FROM files WHERE id NOT IN (SELECT id FROM fresh) AND virtual_path NOT IN (SELECT virtual_path FROM fresh) UNION ALL SELECT {FILES} FROM fresh", fresh=_new_sql)
query("set_upload_complete", lambda f: mu.set_upload_complete(f.files(), FILE), f"SELECT id, virtual_path, size_bytes, created_at, modified_at, sha256_full, CASE WHEN id = '{FILE}' THEN 'complete' ELSE upload_state END AS upload_state, CASE WHEN id <> '{FILE}' THEN tmp_path END AS tmp_path FROM files")
query("confirm_upload", lambda f: mu.confirm_upload(f.chunk_locations(), "c10-0", 1, NOW + 5), f"SELECT chunk_id, shard_index, provider_id, remote_path, {big(f'CASE WHEN chunk_id = {chr(39)}c10-0{chr(39)} AND shard_index = 1 THEN {NOW + 5} ELSE upload_confirmed_at END')} AS upload_confirmed_at FROM chunk_locations")


def _cascade(f: Fixtures) -> DataFrame:
    c = mu.delete_files(f.catalog(), f.files().where(paths.under("virtual_path", DIR)).select("id"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
    return n(c.files, "files").unionByName(n(c.chunks, "chunks")).unionByName(n(c.chunk_locations, "chunk_locations"))


query("delete_file_cascade", _cascade, "SELECT 'files' AS \"table\", count(*) AS n FROM files WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunk_locations', count(*) FROM chunk_locations WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE file_id IN (SELECT id FROM gone))", gone=f"SELECT id FROM files WHERE {under('virtual_path', DIR + '/')}")
_prov = "id, type, display_name, rclone_remote, account_identity, quota_total_bytes, quota_free_bytes, quota_polled_at, rate_limited_until"
query("upsert_provider", lambda f: mu.upsert(f.providers(), f.providers().where("id = 'p1'").withColumn("type", F.lit("s3")).unionByName(f.providers().where("id = 'p2'").withColumn("id", F.lit("new")))), f"SELECT * FROM providers WHERE id <> 'p1' UNION ALL SELECT * REPLACE ('s3' AS type) FROM providers WHERE id = 'p1' UNION ALL SELECT * REPLACE ('new' AS id) FROM providers WHERE id = 'p2'")
_free = lambda e: f"SELECT * REPLACE ({big(e)} AS quota_free_bytes) FROM providers"
query("deduct_free", lambda f: mu.deduct_free(f.providers(), "p3", 10_000_000), _free("CASE WHEN id = 'p3' AND quota_free_bytes IS NOT NULL THEN greatest(quota_free_bytes - 10000000, 0) ELSE quota_free_bytes END"))
query("credit_free", lambda f: mu.credit_free(f.providers(), "p3", 77), _free("CASE WHEN id = 'p3' THEN quota_free_bytes + 77 ELSE quota_free_bytes END"))
query("create_directory", lambda f: mu.create_directory(mu.create_directory(f.directories(), "/new/", NOW), "/asia", NOW + 1), f"SELECT * FROM directories UNION ALL SELECT '/new', {NOW}")
query("delete_dirs_under", lambda f: mu.delete_directories_under(f.directories(), "/asia"), f"SELECT * FROM directories WHERE path <> '/asia' AND NOT {under('path', '/asia/')}")
query("rename_file", lambda f: mu.rename_file(f.files(), PATH, "/moved.mp4", NOW), f"SELECT * REPLACE (CASE WHEN virtual_path = '{PATH}' THEN '/moved.mp4' ELSE virtual_path END AS virtual_path, {big(f'CASE WHEN virtual_path = {chr(39)}{PATH}{chr(39)} THEN {NOW} ELSE modified_at END')} AS modified_at) FROM files")
query("rename_dir_files", lambda f: mu.rename_files_under(f.files(), DIR, "/é/new"), f"SELECT * REPLACE (CASE WHEN {under('virtual_path', DIR + '/')} THEN '/é/new/' || {_tail(DIR)} ELSE virtual_path END AS virtual_path) FROM files")
query("rename_dir_dirs", lambda f: mu.rename_directories_under(f.directories(), "/asia", "/orient"), f"SELECT CASE WHEN path = '/asia' THEN '/orient' WHEN {under('path', '/asia/')} THEN '/orient/' || substr(path, 7) ELSE path END AS path, created_at FROM directories")
query("rename_conflicts", lambda f: mu.rename_conflicts(f.files().unionByName(mu.rename_files_under(f.files().where(paths.under("virtual_path", DIR) & (_k() % 3 == 0)), DIR, DEEP).withColumn("id", F.concat("id", F.lit("x")))), DIR, DEEP), f"SELECT '{DEEP}/' || {_tail(DIR)} AS virtual_path FROM files WHERE {under('virtual_path', DIR + '/')} AND CAST(substr(id, 2) AS BIGINT) % 3 = 0")
query("retry_failed", lambda f: mu.retry_failed(f.failed_deletions(), f.failed_deletions().where("id % 3 = 0").select("id", F.lit("again").alias("last_error"))), "SELECT * REPLACE (CAST(CASE WHEN id % 3 = 0 THEN retry_count + 1 ELSE retry_count END AS INTEGER) AS retry_count, CASE WHEN id % 3 = 0 THEN 'again' ELSE last_error END AS last_error) FROM failed_deletions")
query("unqueue", lambda f: mu.unqueue(f.failed_deletions(), f.failed_deletions().where("id % 2 = 0")), "SELECT * FROM failed_deletions WHERE id % 2 <> 0")
query("increment_counter", lambda f: mu.increment_counters(f.counters(), f.spark.createDataFrame([("dedup_hits", 3), ("new", 1), ("new", 2)], "key string, value long")), f"SELECT key, {big('sum(value)')} AS value FROM (SELECT * FROM counters UNION ALL VALUES ('dedup_hits', 3), ('new', 1), ('new', 2)) GROUP BY 1")


def _clones(f: Fixtures) -> DataFrame:
    new = q.pending_uploads(f.files()).withColumn("id", F.concat(F.lit("n"), "id"))
    _, chunks, at = mu.clone_from_donor(f.catalog(), new)
    return chunks.select(F.col("id").alias("chunk_id"), "file_id", "sequence", "cloud_size").join(at, "chunk_id").select("chunk_id", "file_id", "sequence", "cloud_size", "shard_index", "provider_id", "remote_path")


query("clone_from_donor", _clones, """SELECT n.id || '/' || sequence AS chunk_id, n.id AS file_id, sequence, cloud_size, shard_index, provider_id, remote_path FROM (SELECT 'n' || id AS id, sha256_full FROM files WHERE upload_state = 'pending') n
    JOIN (SELECT sha256_full, min(id) AS donor FROM files WHERE upload_state = 'complete' AND id IN (SELECT file_id FROM chunks) GROUP BY 1) d USING (sha256_full) JOIN chunks c ON c.file_id = d.donor JOIN chunk_locations l ON l.chunk_id = c.id""")


def _swept(f: Fixtures) -> DataFrame:
    c = f.catalog()
    out = mu.sweep_orphan_records(c.replace(files=c.files.where("size_bytes % 5 <> 0")))
    return out.chunk_locations


query("orphan_record_sweep", _swept, "SELECT l.* FROM chunk_locations l WHERE chunk_id IN (SELECT c.id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.size_bytes % 5 <> 0)")
_not_listed = lambda key: f"NOT EXISTS (SELECT 1 FROM listing s WHERE NOT is_dir AND s.provider_id = k.provider_id AND {key})"
_lost_sql = f"SELECT provider_id, remote_path FROM (SELECT DISTINCT provider_id, remote_path, regexp_extract(remote_path, '[^/]*$') AS base FROM chunk_locations WHERE provider_id IN (SELECT provider_id FROM scanned)) k WHERE {_not_listed('s.path = k.remote_path')} AND {_not_listed("'chunks/' || s.name = k.remote_path")} AND {_not_listed('s.path = k.base')}"
_ratio = "SELECT s.provider_id, coalesce(k, 0) AS known, coalesce(m, 0) AS missing, coalesce(m, 0) > 10 AND m > 0.5 * k AS stopped FROM scanned s LEFT JOIN (SELECT provider_id, count(DISTINCT remote_path) AS k FROM chunk_locations GROUP BY 1) USING (provider_id) LEFT JOIN (SELECT provider_id, count(*) AS m FROM lost GROUP BY 1) USING (provider_id)"
_broken = "SELECT DISTINCT file_id FROM (SELECT provider_id, remote_path, min(file_id) AS file_id FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id JOIN lost USING (provider_id, remote_path) JOIN ratio USING (provider_id) WHERE NOT stopped GROUP BY 1, 2)"


def _purged(f: Fixtures):
    return mu.purge_files(f.catalog(), an.gc_broken_files(f.chunk_locations(), f.chunks(), f.listing(), f.scanned()))


query("broken_file_purge", lambda f: _purged(f).chunks, "SELECT * FROM chunks WHERE file_id NOT IN (SELECT file_id FROM broken)", broken=_broken, ratio=_ratio, lost=_lost_sql)
query("broken_file_purge_files", lambda f: _purged(f).files.select("id", "virtual_path"), "SELECT id, virtual_path FROM files WHERE id NOT IN (SELECT file_id FROM broken)", broken=_broken, ratio=_ratio, lost=_lost_sql)
query("broken_files_of_missing", lambda f: mu.broken_files(f.catalog(), an.gc_missing(f.chunk_locations(), f.listing(), f.scanned())), "SELECT DISTINCT file_id FROM (SELECT min(file_id) AS file_id FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id JOIN lost USING (provider_id, remote_path) GROUP BY provider_id, remote_path)", lost=_lost_sql)


def _inserted(f: Fixtures) -> DataFrame:
    """One new file with its only chunk and its location, rows of each table behind the insert."""
    new = f.files().where("id = 'f1'").withColumn("id", F.lit("new")).withColumn("virtual_path", F.lit("/new.bin"))
    chunk = f.chunks().where("id = 'c1-0'").withColumn("id", F.lit("new/0")).withColumn("file_id", F.lit("new")).withColumn("data_shards", F.lit(0))
    at = f.chunk_locations().where("chunk_id = 'c1-0'").withColumn("chunk_id", F.lit("new/0"))
    c = mu.insert_file_with_chunks(f.catalog(), new, chunk, at)
    return c.chunks.join(c.chunk_locations, F.col("id") == F.col("chunk_id")).select("file_id", "sequence", "data_shards", "remote_path", "shard_index").join(c.files.select(F.col("id").alias("file_id"), "virtual_path"), "file_id")


query("insert_file_with_chunks", _inserted, "SELECT file_id, sequence, data_shards, remote_path, shard_index, virtual_path FROM chunks c JOIN chunk_locations l ON l.chunk_id = c.id JOIN files f ON f.id = c.file_id UNION ALL SELECT 'new', sequence, 1, remote_path, shard_index, '/new.bin' FROM chunks c JOIN chunk_locations l ON l.chunk_id = c.id WHERE c.id = 'c1-0'")
query("insert_chunk", lambda f: mu.insert_chunks(f.chunks(), f.chunks().where("data_shards = 3").withColumn("id", F.concat("id", F.lit("+"))).withColumn("data_shards", F.lit(0))).where("id like '%+'"), "SELECT * REPLACE (id || '+' AS id, 1 AS data_shards) FROM chunks WHERE data_shards = 3")
query("insert_location", lambda f: mu.append(f.chunk_locations(), f.spark.createDataFrame([("c0-0", 9, "p1", "chunks/more", NOW)], f.chunk_locations().schema)), f"SELECT * FROM chunk_locations UNION ALL SELECT 'c0-0', 9, 'p1', 'chunks/more', {NOW}")
query("insert_activity", lambda f: mu.append(f.activity_log(), f.spark.createDataFrame([(10**9, "upload", "/x", None, NOW)], f.activity_log().schema)), f"SELECT * FROM activity_log UNION ALL SELECT 1000000000, 'upload', '/x', NULL, {NOW}")


def _replaced(f: Fixtures) -> DataFrame:
    return mu.clone_and_replace(f.catalog(), q.pending_uploads(f.files()).withColumn("id", F.concat(F.lit("n"), "id"))).files.select("id", "virtual_path", "upload_state")


query("clone_and_replace", _replaced, "SELECT CASE WHEN upload_state = 'pending' AND known THEN 'n' || id ELSE id END AS id, virtual_path, CASE WHEN known THEN 'complete' ELSE upload_state END AS upload_state FROM (SELECT *, sha256_full IN (SELECT sha256_full FROM files WHERE upload_state = 'complete' AND id IN (SELECT file_id FROM chunks)) AS known FROM files)")


def _swapped(f: Fixtures) -> DataFrame:
    old = f.files().where(_k() % 7 == 0)
    files = old.withColumn("id", F.concat("id", F.lit("x"))).withColumn("upload_state", F.lit("complete"))
    chunks = files.select(F.concat("id", F.lit("/0")).alias("id"), F.col("id").alias("file_id"), F.lit(0).cast("long").alias("sequence"), "size_bytes", F.col("sha256_full").alias("sha256"), F.col("size_bytes").alias("cloud_size"), F.lit(1).alias("data_shards"), F.lit(0).alias("parity_shards"))
    at = chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("shard_index"), F.lit("p1").alias("provider_id"), F.concat(F.lit("chunks/"), "id").alias("remote_path"), F.lit(NOW).cast("long").alias("upload_confirmed_at"))
    return mu.overwrite_swap(f.catalog(), files, chunks, at)[1]


query("overwrite_swap", _swapped, "SELECT DISTINCT provider_id, remote_path FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id WHERE CAST(substr(file_id, 2) AS BIGINT) % 7 = 0 AND remote_path NOT IN (SELECT remote_path FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id WHERE CAST(substr(file_id, 2) AS BIGINT) % 7 <> 0)")


# Placement.

_open = f"coalesce(rate_limited_until, 0) <= {NOW} AND quota_free_bytes IS NOT NULL"
query("eligible_providers", lambda f: pl.eligible(f.providers(), NOW, 100_000, 5_000), f"SELECT * FROM providers WHERE {_open} AND quota_free_bytes >= 100000")
query("eligible_free_spaces", lambda f: pl.eligible_free_spaces(f.providers(), NOW, 5_000), f"SELECT id, display_name, quota_free_bytes AS free FROM providers WHERE {_open} AND quota_free_bytes > 5000")
query("total_free_space", lambda f: pl.total_free_space(f.providers(), NOW), f"SELECT {big('coalesce(sum(quota_free_bytes), 0)')} AS free FROM providers WHERE {_open} AND quota_free_bytes > 0")
_sizes = lambda f: f.files().select("id", F.col("size_bytes").alias("size"))
query("check_space", lambda f: pl.check_space(f.files().select("id", (F.col("size_bytes") * 20).alias("size")), f.providers(), NOW), f"SELECT id, size_bytes * 20 AS size, size_bytes * 20 <= (SELECT coalesce(sum(quota_free_bytes), 0) FROM providers WHERE {_open} AND quota_free_bytes > 0) AS fits FROM files")
query("assign_chunk_mfs", lambda f: pl.assign_chunk_mfs(f.files().select("id", F.floor(F.col("size_bytes") / 20).alias("size")), f.providers(), NOW), f"SELECT id, {big('floor(size_bytes / 20)')} AS size, (SELECT p.id FROM providers p WHERE {_open} AND quota_free_bytes >= floor(f.size_bytes / 20) ORDER BY quota_free_bytes DESC, display_name LIMIT 1) AS provider_id FROM files f")
query("assign_shards_mfs", lambda f: pl.assign_shards_mfs(f.providers(), NOW, 12, 400_000), f"""SELECT CAST(i AS INTEGER) AS shard_index, CASE WHEN i < m THEN a.id ELSE b.id END AS provider_id FROM (SELECT unnest(range(12)) AS i) r
    JOIN (SELECT count(*) AS m FROM c) ON true LEFT JOIN c a ON a.by_free = i + 1 LEFT JOIN c b ON i >= m AND b.by_name = (i - m) % m + 1""", c=f"SELECT id, row_number() OVER (ORDER BY quota_free_bytes DESC, display_name) AS by_free, row_number() OVER (ORDER BY display_name) AS by_name FROM providers WHERE {_open} AND quota_free_bytes >= 400000")
_unit = lambda c: F.pmod(F.regexp_extract(c, r"\d+", 0).cast("long") * 7919, F.lit(10_000)) / 10_000
query("assign_chunk_pfrd", lambda f: pl.assign_chunk_pfrd(f.files().select("id", _unit("id").alias("uniform")), f.providers(), NOW, 1000), f"""SELECT d.id, s.id AS provider_id FROM (SELECT id, {big("floor((CAST(substr(id, 2) AS BIGINT) * 7919 % 10000) / 10000.0::DOUBLE * (SELECT max(high) FROM spans))")} AS r FROM files) d JOIN spans s ON r >= low AND r < high""", spans=f"SELECT id, sum(quota_free_bytes) OVER (ORDER BY display_name, id ROWS UNBOUNDED PRECEDING) - quota_free_bytes AS low, sum(quota_free_bytes) OVER (ORDER BY display_name, id ROWS UNBOUNDED PRECEDING) AS high FROM providers WHERE {_open} AND quota_free_bytes >= 1000")
_spans = f"SELECT id, row_number() OVER (ORDER BY display_name, id) AS place, quota_free_bytes AS free FROM providers WHERE {_open} AND quota_free_bytes >= 1000"
_draws = {"draw0": "SELECT id, CAST(substr(id, 2) AS BIGINT) * 7919 % 10000 / 10000.0::DOUBLE AS u, []::BIGINT[] AS taken FROM files"}
for _i in range(4):
    _draws[f"draw{_i + 1}"] = f"SELECT id, u, list_append(taken, min(place)) AS taken FROM (SELECT d.id, u, taken, place, sum(free) OVER (PARTITION BY d.id ORDER BY place) AS up, floor(u * sum(free) OVER (PARTITION BY d.id)) AS r FROM draw{_i} d JOIN spans s ON NOT list_contains(taken, place)) WHERE up > r GROUP BY id, u, taken"
query("assign_shards_pfrd", lambda f: pl.assign_shards_pfrd(f.files().select("id", F.lit(4).alias("n"), F.array(*[_unit("id") for _ in range(4)]).alias("uniforms")), f.providers(), NOW, 1000), "SELECT d.id, CAST(i AS INTEGER) AS shard_index, s.id AS provider_id FROM (SELECT id, unnest(range(4)) AS i, unnest(taken) AS place FROM draw4) d JOIN spans s USING (place)", spans=_spans, **_draws)
query("assign_chunk_policy", lambda f: pl.assign_chunk(f.files().select("id", _unit("id").alias("uniform")), f.providers(), NOW, 1000, policy="mfs"), f"SELECT id, (SELECT id FROM providers WHERE {_open} AND quota_free_bytes >= 1000 ORDER BY quota_free_bytes DESC, display_name LIMIT 1) AS provider_id FROM files")
_gib = 1 << 30
_steps = f"""SELECT id, size_bytes * 1000 AS size, size_bytes * 1000 AS rest, [{6 * _gib}, {3 * _gib}, {2 * _gib}]::BIGINT[] AS space, []::BIGINT[] AS sizes, false AS ended FROM files
    UNION ALL SELECT id, size, CASE WHEN list_max(space) <= 0 THEN 0 ELSE rest - take END, list_transform(space, lambda x, i: CASE WHEN i = list_position(space, list_max(space)) THEN x - take ELSE x END), CASE WHEN list_max(space) <= 0 THEN sizes ELSE list_append(sizes, take) END, list_max(space) <= 0
    FROM (SELECT *, least(list_max(space), {4 * _gib}, rest) AS take FROM steps WHERE rest > 0)"""
query("plan_chunks", lambda f: pl.plan_for_files(f.files().select("id", (F.col("size_bytes") * 1000).alias("size_bytes")), [6 * pl.GIB, 3 * pl.GIB, 2 * pl.GIB]).select("id", "n_chunks", "max_chunk"), f"""SELECT id, {big(f'CASE WHEN size <= {6 * _gib} THEN ceil(size / least(size, {4 * _gib})) WHEN ended THEN len(sizes) + ceil((size - list_sum(sizes)) / 33554432) ELSE len(sizes) END')} AS n_chunks,
    {big(f'CASE WHEN size <= {6 * _gib} THEN least(size, {4 * _gib}) WHEN ended THEN greatest(list_max(sizes), 33554432) ELSE list_max(sizes) END')} AS max_chunk FROM steps WHERE rest <= 0""", steps=_steps)
query("chunk_schedule", lambda f: f.files().select("id", F.to_json(pl.chunk_schedule("size_bytes", [])).alias("unknown"), F.to_json(pl.chunk_schedule("size_bytes", [5], 4096)).alias("fixed"), F.to_json(pl.chunk_schedule("size_bytes", [1 << 40])).alias("planned"), pl.size_for_seq(pl.chunk_schedule("size_bytes", [1 << 20, 1 << 19]), F.lit(1)).alias("second")), """SELECT id, '[{"count":0,"size":33554432}]' AS unknown, '[{"count":0,"size":4096}]' AS fixed, '[{"count":0,"size":' || size_bytes || '}]' AS planned,
    CAST(CASE WHEN size_bytes <= 1048576 THEN size_bytes WHEN size_bytes - 1048576 < 524288 THEN size_bytes - 1048576 WHEN size_bytes = 1572864 THEN 524288 ELSE 524288 END AS BIGINT) AS second FROM files""")
query("estimate_chunks", lambda f: pl.plan_for_files(f.files(), [], 1 << 20).select("id", "n_chunks"), f"SELECT id, {big('ceil(size_bytes / 1048576)')} AS n_chunks FROM files")
_space = f"SELECT list(quota_free_bytes ORDER BY display_name, id) AS free, list(id ORDER BY display_name, id) AS ids FROM providers WHERE {_open} AND quota_free_bytes >= 0"
_chain = "SELECT 0 AS j, free FROM space UNION ALL SELECT j + 1, CASE WHEN list_max(free) >= 500000 THEN list_transform(free, lambda x, i: CASE WHEN i = list_position(free, list_max(free)) THEN x - 500000 ELSE x END) ELSE free END FROM chain WHERE j < (SELECT max(ceil(size_bytes / 500000)) FROM files)"
_placed = "SELECT p.id, upload_state, sequence, size, CASE WHEN list_max(chain.free) >= size THEN ids[list_position(chain.free, list_max(chain.free))] END AS provider_id FROM (SELECT id, upload_state, sequence, least(500000, size_bytes - sequence * 500000) AS size FROM (SELECT *, unnest(range(CAST(ceil(size_bytes / 500000) AS BIGINT))) AS sequence FROM files)) p JOIN chain ON j = sequence JOIN space ON true"
_chains = {"space": _space, "chain": _chain, "plan": _placed}
query("upload_placement", lambda f: pl.upload_placement(f.files(), f.providers(), NOW, 500_000), "SELECT id, sequence, size, provider_id FROM plan", **_chains)
query("upload_rollback_credits", lambda f: pl.rollback_credits(pl.upload_placement(f.files(), f.providers(), NOW, 500_000), f.files().where("upload_state = 'pending'")), f"SELECT provider_id, {big('sum(size)')} AS bytes FROM plan WHERE provider_id IS NOT NULL AND upload_state = 'pending' GROUP BY 1", **_chains)
query("reserve_uploads", lambda f: pl.reserve_uploads(f.files().withColumn("size_bytes", F.floor(F.col("size_bytes") / 1000)), f.providers(), NOW, 5_000))
_shards = lambda f: f.chunk_locations().join(f.chunks().select(F.col("id").alias("chunk_id"), F.col("file_id").alias("id"), "data_shards", "cloud_size"), "chunk_id").select("id", "shard_index", "provider_id", co.shard_size("cloud_size", "data_shards").alias("size"), (F.col("shard_index") % 2 == 0).alias("uploaded"))
query("shard_credits", lambda f: pl.shard_credits(_shards(f), f.files().where("upload_state = 'pending'")), f"SELECT provider_id, {big('sum(ceil(cloud_size / data_shards))')} AS bytes, shard_index % 2 = 0 AS uploaded FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id JOIN files f ON f.id = c.file_id WHERE upload_state = 'pending' GROUP BY 1, 3")


# Status and reconciliation.

query("file_info", lambda f: an.file_info(f.files(), f.chunks(), f.chunk_locations(), f.providers().where("id <> 'p0'")).select("id", F.col("chunks.sequence").alias("sequences"), F.array_join(F.flatten("chunks.providers"), ",").alias("names")).where("sequences is not null").select("id", F.size("sequences").alias("n"), "names"), """SELECT file_id AS id, CAST(count(DISTINCT c.id) AS INTEGER) AS n, string_agg(coalesce(display_name, provider_id), ',' ORDER BY sequence, shard_index) AS names
    FROM chunks c JOIN chunk_locations l ON l.chunk_id = c.id LEFT JOIN (SELECT * FROM providers WHERE id <> 'p0') p ON p.id = provider_id GROUP BY 1""")
_bytes = f"SELECT provider_id, {big('sum(cloud_size)')} AS bytes FROM chunk_locations JOIN chunks ON chunk_id = id GROUP BY 1"
_status = f"SELECT id, display_name, quota_total_bytes, quota_free_bytes, {big('coalesce(bytes, 0) + 4096 + 16')} AS stored_bytes FROM providers LEFT JOIN held ON provider_id = id"
query("storage_status", lambda f: an.storage_status(f.providers(), f.chunk_locations(), f.chunks(), 4096), _status, held=_bytes)
query("remotes_active", lambda f: an.remotes_active(f.providers(), f.providers().where("type = 'box'").select(F.col("rclone_remote").alias("remote"))), "SELECT rclone_remote, type, type = 'box' AS active FROM providers")
_some = lambda f: f.providers().where("quota_free_bytes % 3 <> 0").select(F.col("rclone_remote").alias("remote"))
query("missing_providers", lambda f: an.missing_providers(f.providers(), _some(f)), "SELECT id, rclone_remote || ' (' || CASE WHEN account_identity <> '' THEN account_identity || ', ' ELSE '' END || type || ')' AS label FROM providers WHERE quota_free_bytes IS NULL OR quota_free_bytes % 3 = 0")
query("provider_sync_merge", lambda f: an.provider_sync(f.providers().where("type <> 'box'"), f.providers().select(F.col("rclone_remote").alias("remote"), F.when(F.col("type") != "drive", F.col("type")).alias("type"), F.lit("seen@example.com").alias("identity"), F.lit(None).cast("long").alias("total"), F.when(F.col("type") == "onedrive", F.lit(5)).cast("long").alias("free")), None, NOW + 60), f"""SELECT CASE WHEN type = 'box' THEN sha256(rclone_remote) ELSE id END AS id, CASE WHEN type = 'drive' THEN 'unknown' ELSE type END AS type, rclone_remote AS display_name, rclone_remote,
    CASE WHEN type = 'box' OR account_identity = '' THEN 'seen@example.com' ELSE account_identity END AS account_identity, CASE WHEN type <> 'box' THEN quota_total_bytes END AS quota_total_bytes,
    {big("CASE WHEN type = 'onedrive' THEN 5 WHEN type <> 'box' THEN quota_free_bytes END")} AS quota_free_bytes, {big(f"CASE WHEN type = 'onedrive' THEN {NOW + 60} WHEN type <> 'box' THEN quota_polled_at END")} AS quota_polled_at, CASE WHEN type <> 'box' THEN rate_limited_until END AS rate_limited_until FROM providers""")
_stray = f"SELECT provider_id, remote_path, {NOW} - mtime >= 600 AS old FROM (SELECT *, CASE WHEN starts_with(path, 'chunks/') THEN path ELSE 'chunks/' || path END AS remote_path FROM listing WHERE NOT is_dir) s WHERE NOT EXISTS (SELECT 1 FROM chunk_locations l WHERE l.provider_id = s.provider_id AND l.remote_path = s.remote_path)"
query("gc_orphans", lambda f: an.gc_orphans(f.chunk_locations(), f.listing(), NOW).where("old"), "SELECT * FROM stray WHERE old", stray=_stray)
query("gc_recent_skipped", lambda f: an.gc_orphans(f.chunk_locations(), f.listing(), NOW).where("not old"), "SELECT * FROM stray WHERE NOT old", stray=_stray)
query("gc_missing", lambda f: an.gc_missing(f.chunk_locations(), f.listing(), f.scanned()), "SELECT * FROM lost", lost=_lost_sql)
query("gc_missing_ratio", lambda f: an.gc_missing_ratio(f.chunk_locations(), f.listing(), f.scanned()), "SELECT * FROM ratio", ratio=_ratio, lost=_lost_sql)
query("gc_broken_files", lambda f: an.gc_broken_files(f.chunk_locations(), f.chunks(), f.listing(), f.scanned()), "SELECT * FROM broken", broken=_broken, ratio=_ratio, lost=_lost_sql)
query("gc_classification", lambda f: an.gc_classification(f.chunk_locations(), f.listing(), f.scanned(), NOW), f"SELECT r.provider_id, known, missing, {big('coalesce(o, 0)')} AS orphans_old, {big('coalesce(n, 0)')} AS orphans_recent, CASE WHEN stopped THEN 'stopped' WHEN missing > 0 THEN 'lossy' ELSE 'clean' END AS verdict FROM ratio r LEFT JOIN (SELECT provider_id, count(*) FILTER (old) AS o, count(*) FILTER (NOT old) AS n FROM stray GROUP BY 1) s USING (provider_id)", ratio=_ratio, lost=_lost_sql, stray=_stray)
_inside = f"SELECT l.*, cloud_size FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id JOIN files f ON f.id = c.file_id WHERE {under('virtual_path', DIR + '/')}"
query("dir_delete_credits", lambda f: an.dir_delete_credits(f.files(), f.chunks(), f.chunk_locations(), DIR), f"SELECT provider_id, {big('sum(cloud_size)')} AS bytes FROM (SELECT remote_path, count(*) AS n, first(provider_id ORDER BY chunk_id, shard_index) AS provider_id, first(cloud_size ORDER BY chunk_id, shard_index) AS cloud_size FROM inside GROUP BY 1) i JOIN (SELECT remote_path, count(*) AS m FROM chunk_locations GROUP BY 1) USING (remote_path) WHERE n = m GROUP BY 1", inside=_inside)
query("delete_plan", lambda f: an.delete_plan(f.files(), f.chunks(), f.chunk_locations(), DIR), "SELECT DISTINCT provider_id, remote_path, CASE WHEN remote_path IN (SELECT remote_path FROM chunk_locations WHERE chunk_id NOT IN (SELECT chunk_id FROM inside)) THEN 'keep' ELSE 'delete' END AS action FROM inside", inside=_inside)
query("dedup_groups", lambda f: an.dedup_groups(f.files()), f"SELECT sha256_full, count(*) AS copies, min(id) AS donor, {big('sum(size_bytes) - max(size_bytes)')} AS saved FROM files WHERE upload_state = 'complete' GROUP BY 1 HAVING count(*) > 1")


def _transfers(f: Fixtures) -> DataFrame:
    mk = lambda m, s: f.providers().groupBy().agg(F.lit(s).alias("speed"), F.collect_list(F.when(F.regexp_extract("id", r"\d+", 0).cast("int") % m == 0, F.struct(F.col("display_name").alias("name"), F.coalesce(F.col("quota_free_bytes"), F.lit(0)).alias("bytes")))).alias("transferring"))
    return an.merge_transfers(mk(2, 1.5), mk(3, 2.5).withColumn("transferring", F.transform("transferring", lambda t: F.struct(t["name"].alias("name"), (t["bytes"] - 7).alias("bytes")))))


query("transfer_stats_merge", _transfers, f"SELECT name, {big('max(b)')} AS bytes, 2.5::DOUBLE AS speed FROM (SELECT display_name AS name, coalesce(quota_free_bytes, 0) AS b FROM providers WHERE CAST(substr(id, 2) AS INTEGER) % 2 = 0 UNION ALL SELECT display_name, coalesce(quota_free_bytes, 0) - 7 FROM providers WHERE CAST(substr(id, 2) AS INTEGER) % 3 = 0) GROUP BY 1")
_up = lambda f: q.pending_uploads(f.files()).select(F.col("virtual_path").alias("path"), F.col("size_bytes").alias("total_bytes"), F.when(_k() % 4 == 0, 10).otherwise(0).cast("long").alias("done_bytes"), (_k() % 5 == 0).alias("preparing"), F.lit(NOW - 100).cast("long").alias("started_at"), F.lit(12_345.0).alias("speed"), _k().alias("k"))
_tr = lambda f: _up(f).where("k % 3 = 0").select(F.when(F.col("k") % 2 == 0, F.col("path")).otherwise(paths.base("path")).alias("name"), (F.col("k") % 1000).alias("bytes"))
query("upload_progress", lambda f: an.upload_progress(_up(f), _tr(f), NOW), f"SELECT path, total_bytes, {big('CASE WHEN done = 0 AND k % 5 <> 0 AND total_bytes > 0 THEN least(1234500, floor(total_bytes * 95 / 100)) ELSE done END')} AS bytes_done FROM (SELECT virtual_path AS path, size_bytes AS total_bytes, k, CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 3 = 0 THEN k % 1000 ELSE 0 END AS done FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM files WHERE upload_state = 'pending'))")
_split = "SELECT virtual_path, size_bytes, string_split(substr(virtual_path, 2), '/') AS p FROM files WHERE upload_state = 'complete'"
_dirs = "SELECT '/' || array_to_string(p[1:i], '/') AS directory, size_bytes, virtual_path FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pieces)"
query("du_by_directory", lambda f: an.du_by_directory(f.files()), f"SELECT directory, count(*) AS files, {big('sum(size_bytes)')} AS bytes FROM dirs GROUP BY 1", pieces=_split, dirs=_dirs)
query("tree_summary", lambda f: an.tree_summary(f.files(), "/"), f"SELECT (SELECT count(*) FROM pieces) AS files, (SELECT {big('sum(size_bytes)')} FROM pieces) AS bytes, (SELECT count(DISTINCT directory) FROM dirs) AS directories", pieces=_split, dirs=_dirs)
query("ls_with_state", lambda f: an.ls(f.files(), f.directories(), f.files().where("size_bytes % 2 = 0"), DIR), f"SELECT 1 AS is_file, {base('virtual_path')} AS name, size_bytes AS size, CASE WHEN size_bytes % 2 = 0 THEN 'stub' ELSE 'local' END AS local_state FROM files WHERE upload_state = 'complete' AND {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') = 0 AND NOT starts_with({base('virtual_path')}, '._') UNION ALL SELECT DISTINCT 0, split_part({_tail(DIR)}, '/', 1), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM files WHERE {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') > 0")
_children = f"SELECT 1 AS is_file, {base('virtual_path')} AS name FROM files WHERE upload_state = 'complete' AND {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') = 0 UNION ALL SELECT DISTINCT 0, split_part({_tail(DIR)}, '/', 1) FROM files WHERE {under('virtual_path', DIR + '/')} AND instr({_tail(DIR)}, '/') > 0"
query("readdir_bounded", lambda f: an.readdir(f.files(), f.directories(), DIR, 10), "SELECT * FROM children ORDER BY 1, 2 LIMIT 10", children=_children)
query("browse_items", lambda f: an.browse_items(f.files(), f.directories(), DIR), f"SELECT CASE is_file WHEN 1 THEN 'file' ELSE 'dir' END AS kind, name, CASE is_file WHEN 1 THEN (SELECT size_bytes FROM files WHERE virtual_path = '{DIR}/' || name) END AS size FROM children", children=_children)
query("sort_listing", lambda f: an.sort_listing(an.ls(f.files(), f.directories(), f.files().where("size_bytes % 2 = 0"), "/").withColumn("modified", F.lit(0)), "size", True).where("is_file = 1").limit(5).select("name", "size"), f"SELECT {base('virtual_path')} AS name, size_bytes AS size FROM files WHERE upload_state = 'complete' AND instr(substr(virtual_path, 2), '/') = 0 AND NOT starts_with({base('virtual_path')}, '._') ORDER BY size_bytes DESC LIMIT 5")
query("ring_last_n", lambda f: ev.ring(f.activity_log(), 1000), "SELECT * FROM activity_log ORDER BY id DESC LIMIT 1000")
query("quota_totals", lambda f: an.quota_totals(f.providers()), f"SELECT {big('sum(quota_free_bytes)')} AS free_bytes, {big('sum(quota_total_bytes)')} AS total_bytes FROM providers")
query("dashboard_ratios", lambda f: an.dashboard(an.storage_status(f.providers(), f.chunk_locations(), f.chunks(), 4096)).select("id", "used_bytes", F.round("own_pct", 6).alias("own_pct"), F.round("other_pct", 6).alias("other_pct")), f"SELECT id, {big('used')} AS used_bytes, round(coalesce(CASE WHEN quota_free_bytes IS NOT NULL THEN least(100, stored_bytes * 100.0::DOUBLE / quota_total_bytes) END, 0), 6) AS own_pct, round(coalesce(CASE WHEN quota_free_bytes IS NOT NULL THEN least(100, greatest(used - stored_bytes, 0) * 100.0::DOUBLE / quota_total_bytes) END, 0), 6) AS other_pct FROM (SELECT *, coalesce(quota_total_bytes - quota_free_bytes, 0) AS used FROM ({_status}))", held=_bytes)
query("dashboard_total", lambda f: an.dashboard_total(f.providers()).select("used_bytes", "total_bytes", "pct", F.round("bar_pct", 6).alias("bar_pct")), f"SELECT {big('u')} AS used_bytes, {big('t')} AS total_bytes, {big('floor(u * 100.0::DOUBLE / t + 0.5)')} AS pct, round(least(100, u * 100.0::DOUBLE / t), 6) AS bar_pct FROM (SELECT sum(quota_total_bytes - quota_free_bytes) AS u, sum(quota_total_bytes) FILTER (quota_free_bytes IS NOT NULL) AS t FROM providers)")
query("upload_eta", lambda f: an.upload_eta(f.files().select(F.col("virtual_path").alias("path"), F.when(_k() % 7 != 0, F.col("size_bytes")).otherwise(0).alias("total_bytes"), F.floor(F.col("size_bytes") * (_k() % 100) / 100).alias("bytes_done"), F.lit(8).cast("long").alias("chunks_total"), (_k() % 9).alias("chunks_done"), (_k() % 13 == 0).alias("failed"), F.lit(1000.0).alias("speed"))), """SELECT virtual_path AS path, CAST(least(100, floor(CASE WHEN k % 7 <> 0 THEN floor(size_bytes * (k % 100) / 100) * 100.0::DOUBLE / size_bytes ELSE (k % 9) * 100.0::DOUBLE / 8 END + 0.5)) AS INTEGER) AS pct,
    CAST(floor((k % 9) * 100 / 8) AS INTEGER) AS chunk_pct, CAST(ceil((CASE WHEN k % 7 <> 0 THEN size_bytes ELSE 0 END - floor(size_bytes * (k % 100) / 100)) / 1000.0::DOUBLE) AS BIGINT) AS eta_s, CASE WHEN k % 13 = 0 THEN 'FAILED' WHEN k % 9 >= 8 THEN 'finalizing' ELSE 'uploading' END AS state FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM files)""")
query("junk_files", lambda f: an.junk_files(f.files()), f"SELECT {FILES} FROM files WHERE upload_state = 'complete' AND (starts_with({base('virtual_path')}, '._') OR {base('virtual_path')} IN ('.DS_Store', 'Thumbs.db', 'desktop.ini'))")
query("selection_add_remove", lambda f: f.providers().select("id", F.array_join(an.selection_add(F.array("id", F.lit("x")), F.array(F.lit("x"), F.lit("y"))), ",").alias("added"), F.array_join(an.selection_remove(F.array("id", F.lit("p1"), F.lit("q")), F.array("id")), ",").alias("removed"), an.selection_remove(F.array("id"), F.array("id")).isNull().alias("refused")), "SELECT id, id || ',x,y' AS added, CASE WHEN id = 'p1' THEN 'q' ELSE 'p1,q' END AS removed, true AS refused FROM providers")
query("retry_classification", lambda f: an.retry_plan(f.failed_deletions(), f.providers()), "SELECT id, provider_id, remote_path, retry_count, CASE WHEN retry_count >= 10 OR provider_id NOT IN (SELECT id FROM providers) THEN 'abandon' ELSE 'retry' END AS action FROM (SELECT * FROM failed_deletions ORDER BY failed_at, id LIMIT 50)")
query("resume_classification", lambda f: an.resume_plan(f.files(), f.files().where("tmp_path is not null and size_bytes % 3 = 0")), "SELECT id, virtual_path, CASE WHEN tmp_path IS NOT NULL AND size_bytes % 3 = 0 THEN 'requeue' ELSE 'drop' END AS action FROM files WHERE upload_state = 'pending'")
query("type_directed", lambda f: an.type_directed(f.files(), f.directories(), DIR).unionByName(an.type_directed(f.files(), f.directories(), PATH)).unionByName(an.type_directed(f.files(), f.directories(), "/no")), "SELECT 'dir' AS kind UNION ALL SELECT 'file' UNION ALL SELECT 'missing'")
query("ancestors", lambda f: f.files().select("id", F.array_join(paths.ancestors("virtual_path"), "|").alias("up"), paths.parent("virtual_path").alias("parent"), paths.base("virtual_path").alias("name")), f"SELECT id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: '/' || array_to_string(p[1:i], '/')), '|') AS up, CASE WHEN len(p) = 1 THEN '/' ELSE regexp_replace(virtual_path, '/[^/]*$', '') END AS parent, {base('virtual_path')} AS name FROM (SELECT *, string_split(substr(virtual_path, 2), '/') AS p FROM files)")
query("stale_temp", lambda f: an.stale_temp(f.listing().where("mtime is not null").select("name", "is_dir", "mtime"), NOW, "orphan-1"), f"SELECT name, is_dir, mtime FROM listing WHERE starts_with(name, 'orphan-1') AND mtime < {NOW} - 600")
query("download_missing", lambda f: an.download_missing(f.files(), f.files().where("size_bytes % 3 = 0")), f"SELECT virtual_path, size_bytes FROM files WHERE upload_state = 'complete' AND size_bytes % 3 <> 0 AND NOT starts_with({base('virtual_path')}, '._')")
_local = lambda f: f.files().select(F.when(_k() % 3 == 0, F.concat("virtual_path", F.lit(".local"))).otherwise(F.col("virtual_path")).alias("virtual_path"), (_k() % 6 == 0).alias("is_stub"))
query("upload_missing", lambda f: an.upload_missing(_local(f), f.files()), f"SELECT virtual_path || '.local' AS virtual_path FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM files) WHERE k % 3 = 0 AND k % 6 <> 0 AND NOT starts_with({base('virtual_path')}, '._')")
_items = lambda f: f.table("events").select(F.concat(F.lit("/u"), (F.col("event_id") % 500).cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "submitted").when(F.col("event_type") == "signup", "uploading").alias("status"), "event_id")
query("upload_status_counts", lambda f: an.upload_status_counts(_items(f)), f"SELECT done, fail, uploading, submitted, queued, {big('floor((done + fail) * 100.0::DOUBLE / n + 0.5)')} AS pct FROM (SELECT count(*) FILTER (event_type = 'click') AS done, count(*) FILTER (event_type = 'error') AS fail, count(*) FILTER (event_type = 'signup') AS uploading, count(*) FILTER (event_type = 'view') AS submitted, count(*) FILTER (event_type = 'purchase') AS queued, count(*) AS n FROM events)")
query("settle_submitted", lambda f: an.settle_submitted(_items(f), _items(f).where("event_id % 2 = 0")), "SELECT '/u' || (event_id % 500) || '/' || event_id AS path, CASE WHEN event_type = 'click' THEN 'done' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'submitted' ELSE 'done' END WHEN event_type = 'signup' THEN 'uploading' END AS status FROM events")
query("dropped_files", lambda f: an.dropped_files(f.files().select(F.substring("virtual_path", 2, 1 << 30).alias("path"))), f"SELECT {base('virtual_path')} AS name, regexp_replace(substr(virtual_path, 2), '/?[^/]*$', '') AS directory FROM files")
query("metrics_snapshot", lambda f: an.metrics_snapshot(f.counters()), "SELECT " + ", ".join(f"{big(f'coalesce(sum(value) FILTER (key = {chr(39)}{m}{chr(39)}), 0)')} AS {m}" for m in an.METRICS) + " FROM counters")
query("health", lambda f: an.health(f.files().limit(1).select(F.lit(True).alias("ok")), q.pending_uploads(f.files())), "SELECT 'ok' AS status, count(*) AS in_flight FROM files WHERE upload_state = 'pending'")
query("log_level", lambda f: an.log_level(f.activity_log().withColumn("level", F.when(F.col("action") == "delete", "ERROR").otherwise("INFO")), "ERROR").select("id", "level"), "SELECT id, 'ERROR' AS level FROM activity_log WHERE action = 'delete'")
query("set_changes", lambda f: an.set_changes(f.fs_events().select(F.floor(F.col("t_ms") * (F.col("t_ms") % 13) / 500).alias("at"), "path")).withColumnRenamed("at", "poll"), "SELECT poll FROM (SELECT poll, now, lag(now) OVER (ORDER BY poll) AS before FROM (SELECT CAST(floor(t_ms * (t_ms % 13) / 500) AS BIGINT) AS poll, list_sort(list(DISTINCT path)) AS now FROM fs_events GROUP BY 1)) WHERE before <> now AND len(now) < len(before)")


# Contents.

query("chunk_size_for_file", lambda f: f.files().select("id", pl.chunk_size_for_file(F.col("size_bytes") * 50_000 - 1_000_000_000).alias("chunk")), f"SELECT id, {big('CASE WHEN s <= 0 THEN 33554432 ELSE least(greatest(floor(s / 25), 33554432), 4294967296) END')} AS chunk FROM (SELECT id, size_bytes * 50000 - 1000000000 AS s FROM files)")
query("upload_workers", lambda f: f.files().select("id", pl.upload_workers((F.col("size_bytes") - 1_000_000) * 100).alias("workers")), "SELECT id, CAST(CASE WHEN c <= 0 THEN 12 ELSE least(greatest(floor(6442450944 / c), 2), 12) END AS INTEGER) AS workers FROM (SELECT id, (size_bytes - 1000000) * 100 AS c FROM files)")
query("file_hashes", lambda f: co.file_hashes(f.contents()), "SELECT id, sha256(content) AS sha256 FROM contents")
query("split_chunks", lambda f: co.split(f.contents(), 1000).groupBy("id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest")), f"SELECT id, {big('ceil(n / 1000)')} AS n, {big('n')} AS bytes, {big('least(n, 1000)')} AS largest FROM (SELECT id, strlen(content) AS n FROM contents) WHERE n > 0")
query("chunk_hashes", lambda f: co.split(f.contents().select("id", F.sha2("content", 256).alias("content")), 24).select("id", "sequence", "size_bytes", "sha256"), f"SELECT id, {big('i')} AS sequence, {big('least(24, 64 - i * 24)')} AS size_bytes, sha256(substr(h, CAST(i * 24 + 1 AS BIGINT), 24)) AS sha256 FROM (SELECT id, sha256(content) AS h FROM contents) JOIN (SELECT unnest(range(3)) AS i) ON true")


def _assembled(f: Fixtures) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long")
    parts = co.split(f.contents(), 2000).where(~((k % 5 == 0) & (F.col("sequence") == 1)))
    parts = parts.withColumn("data", F.when((k % 7 == 0) & (F.col("sequence") == 0), F.lit(b"x")).otherwise(F.col("data")))
    return co.assemble(parts, co.file_hashes(f.contents()).withColumn("sha256", F.when(k % 11 == 0, F.lit("no")).otherwise(F.col("sha256")))).select("id", "status")


query("assemble_check", _assembled, "SELECT id, CASE WHEN k % 5 = 0 AND n > 4000 THEN 'gap' WHEN k % 7 = 0 THEN 'chunk_mismatch' WHEN k % 11 = 0 OR (k % 5 = 0 AND n > 2000) THEN 'file_mismatch' ELSE 'ok' END AS status FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS k, strlen(content) AS n FROM contents) WHERE n > 0")
query("integrity_classification", lambda f: co.integrity(f.files(), f.chunks(), f.chunk_locations().where("remote_path not like 'chunks/1%'")), """SELECT f.id, CASE WHEN upload_state <> 'complete' THEN 'in_progress' WHEN n IS NULL AND size_bytes > 0 OR lo <> 0 OR hi + 1 <> n THEN 'gap' WHEN lost > 0 THEN 'no_location' ELSE 'ok' END AS status FROM files f
    LEFT JOIN (SELECT file_id, count(*) AS n, min(sequence) AS lo, max(sequence) AS hi, count(*) FILTER (id NOT IN (SELECT chunk_id FROM chunk_locations WHERE remote_path NOT LIKE 'chunks/1%')) AS lost FROM chunks GROUP BY 1) c ON c.file_id = f.id""")
query("integrity_of_path", lambda f: co.integrity_of_path(f.files(), f.chunks(), f.chunk_locations(), "/none").unionByName(co.integrity_of_path(f.files(), f.chunks(), f.chunk_locations(), PATH)), f"SELECT 'not_found' AS status UNION ALL SELECT CASE WHEN upload_state <> 'complete' THEN 'in_progress' WHEN n IS NULL AND size_bytes > 0 OR lo <> 0 OR hi + 1 <> n THEN 'gap' ELSE 'ok' END FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, min(sequence) AS lo, max(sequence) AS hi FROM chunks GROUP BY 1) c ON c.file_id = f.id WHERE virtual_path = '{PATH}'")
query("split_scheduled", lambda f: co.split_scheduled(f.contents(), F.from_json(F.lit('[{"count":1,"size":1000},{"count":2,"size":300},{"count":0,"size":700}]'), pl.TIERS)).select("id", "sequence", "size_bytes"), f"SELECT id, sequence, {big('least(size, n - pos)')} AS size_bytes FROM (SELECT id, n, sequence, CASE WHEN sequence < 1 THEN 0 WHEN sequence < 3 THEN 1000 + (sequence - 1) * 300 ELSE 1600 + (sequence - 3) * 700 END AS pos, CASE WHEN sequence < 1 THEN 1000 WHEN sequence < 3 THEN 300 ELSE 700 END AS size FROM (SELECT id, strlen(content) AS n, unnest(range(strlen(content) // 300 + 1)) AS sequence FROM contents)) WHERE pos < n")
query("read_files", lambda f: co.read_files(co.split(f.contents(), 2000), co.file_hashes(f.contents())).select("id", "status", F.sha2("content", 256).alias("sha256")), "SELECT id, 'ok' AS status, sha256(content) AS sha256 FROM contents WHERE strlen(content) > 0")
query("read_plan", lambda f: an.read_plan(f.files(), f.chunks(), f.chunk_locations(), f.providers()), "SELECT f.id, sequence, rclone_remote || ':' AS remote, remote_path, shard_index FROM files f JOIN chunks c ON c.file_id = f.id JOIN chunk_locations l ON l.chunk_id = c.id JOIN providers p ON p.id = l.provider_id WHERE upload_state = 'complete' AND (data_shards > 1 OR parity_shards > 0 OR shard_index = 0)")
query("write_plan", lambda f: an.write_plan(f.chunk_locations().select("provider_id", "remote_path", F.lit(1).cast("long").alias("size")).distinct(), f.providers()), "SELECT DISTINCT rclone_remote || ':' AS remote, 'chunks' AS remote_path, 'mkdir' AS action, CAST(NULL AS BIGINT) AS size FROM chunk_locations JOIN providers ON id = provider_id UNION ALL SELECT DISTINCT rclone_remote || ':', remote_path, 'put', 1 FROM chunk_locations JOIN providers ON id = provider_id")
query("job_polls", lambda f: an.job_polls(f.files().select("id", (F.col("size_bytes") % 4_500_000).alias("took_ms"))), f"SELECT id, {big('coalesce(n, 720)')} AS polls, {big('coalesce(pos, (SELECT max(pos) FROM polls))')} AS seen_ms, n IS NULL AS timed_out FROM (SELECT id, size_bytes % 4500000 AS took FROM files) j ASOF LEFT JOIN polls ON took <= pos", polls="SELECT n, sum(least(100 * pow(2, n - 1), 5000)) OVER (ORDER BY n) AS pos FROM (SELECT unnest(range(1, 721)) AS n)")
query("stub_marks", lambda f: an.stub_marks(f.files(), f.files().where("size_bytes % 3 = 0"), f.files().where("size_bytes % 2 = 0")), "SELECT virtual_path, CASE WHEN known AND NOT here AND NOT stub THEN 'create' ELSE 'clear' END AS action, CASE WHEN known THEN size_bytes END AS size FROM (SELECT *, upload_state = 'complete' AS known, size_bytes % 3 = 0 AS here, size_bytes % 2 = 0 AS stub FROM files) WHERE (known AND NOT here AND NOT stub) OR (stub AND (here OR NOT known))")
query("backup_blobs", lambda f: f.providers().select("id").withColumn("stamp", F.lit(NOW).cast("long") * 1_000_000_000).withColumn("content", F.encode("id", "utf-8")).transform(sc.backup_blobs).transform(lambda d: sc.backup_payloads(d)).select("id", "stamp", F.decode("content", "utf-8").alias("content"), F.octet_length("data").alias("n")), f"SELECT id, CAST({NOW} AS BIGINT) * 1000000000 AS stamp, id AS content, CAST(16 + length(id) AS INTEGER) AS n FROM providers")
query("quotas", lambda f: sc.quotas(f.providers().select("id", F.to_json(F.struct(F.col("quota_total_bytes").alias("total"), F.col("quota_free_bytes").alias("free"))).alias("json"))).select("id", "total", "used", "free"), "SELECT id, quota_total_bytes AS total, CAST(0 AS BIGINT) AS used, coalesce(quota_free_bytes, 0) AS free FROM providers")
query("undedupable", lambda f: co.undedupable(f.files(), f.chunks()), "SELECT id, sha256_full FROM files WHERE upload_state = 'complete' AND id NOT IN (SELECT file_id FROM chunks)")
query("shard_sizes", lambda f: co.shard_sizes(f.chunks()), f"SELECT id, {big('ceil(size_bytes / data_shards)')} AS shard_bytes, {big('ceil(size_bytes / data_shards) * (data_shards + parity_shards)')} AS stored_bytes FROM chunks")
query("recoverability_without_provider", lambda f: co.recoverability(f.chunks(), f.chunk_locations(), GONE), f"SELECT file_id, count(*) AS chunks, {big('count(*) FILTER (ok)')} AS readable_chunks, bool_and(ok) AS readable FROM (SELECT c.id, file_id, count(l.chunk_id) >= data_shards AS ok FROM chunks c LEFT JOIN (SELECT chunk_id FROM chunk_locations WHERE provider_id NOT IN ('p1', 'p2', 'p3')) l ON l.chunk_id = c.id GROUP BY 1, 2, data_shards) GROUP BY 1")
query("erasure_roundtrip", lambda f: co.erasure_roundtrip(f.contents(), 3, 2), f"SELECT id, {big('ceil(strlen(content) / 3)')} AS shard_bytes, true AS same FROM contents")


# Labels and classes.

_n = "size_bytes * size_bytes // 1000"
_sz = lambda f, fn: f.files().select("id", fn(F.expr("size_bytes * size_bytes div 1000")).alias("label"))


def _unit_sql(units: list[str]) -> str:
    out = "CASE WHEN s < 1024 THEN s || ' B'"
    for i, u in enumerate(units, 1):
        out += (f" WHEN s < {1024 ** (i + 1)} THEN " if i < len(units) else " ELSE ") + tenth(f"s / {1024.0 ** i:.1f}::DOUBLE") + f" || ' {u}'"
    return f"SELECT id, {out} END AS label FROM (SELECT id, {_n} AS s FROM files)"


query("fmt_size", lambda f: _sz(f, text.size_text), _unit_sql(["KB", "MB", "GB"]))
query("fmt_bytes", lambda f: _sz(f, text.size_text_binary), _unit_sql(["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]))
query("fmt_duration", lambda f: f.files().select("id", text.duration_text(F.col("size_bytes") / 100).alias("label")), "SELECT id, CASE WHEN d > 0 THEN d || 'd ' || h || 'h ' || m || 'm' WHEN h > 0 THEN h || 'h ' || m || 'm' WHEN m > 0 THEN m || 'm ' || s % 60 || 's' ELSE s || 's' END AS label FROM (SELECT id, s, s // 86400 AS d, s // 3600 % 24 AS h, s // 60 % 60 AS m FROM (SELECT id, size_bytes // 100 AS s FROM files))")
query("fmt_uptime", lambda f: f.files().select("id", text.uptime_text(F.col("size_bytes") / 5000).alias("label")), "SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm' END AS label FROM (SELECT id, size_bytes // 5000 AS s FROM files)")
query("fmt_age", lambda f: f.files().select("id", text.age_text(F.when(_k() % 50 == 0, F.lit(0)).otherwise(NOW - F.col("size_bytes") % 4_000_000), NOW).alias("label")), f"SELECT id, CASE WHEN k % 50 = 0 THEN '-' WHEN d < 60 THEN 'just now' WHEN d < 3600 THEN d // 60 || 'm ago' WHEN d < 86400 THEN d // 3600 || 'h ago' WHEN d < 2592000 THEN d // 86400 || 'd ago' ELSE strftime(make_timestamp(({NOW} - d) * 1000000), '%b %d, %Y') END AS label FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS k, size_bytes % 4000000 AS d FROM files)")
query("state_label", lambda f: f.files().select("id", text.state_label(F.when(_k() % 3 == 0, "stub").when(_k() % 3 == 1, "uploading").otherwise("local")).alias("label")), "SELECT id, CASE CAST(substr(id, 2) AS BIGINT) % 3 WHEN 0 THEN 'cloud' WHEN 1 THEN 'uploading…' ELSE 'local' END AS label FROM files")
query("file_class", lambda f: f.files().select("id", text.file_class(paths.base("virtual_path")).alias("class"), text.is_previewed(paths.base("virtual_path")).alias("previewed")), "SELECT id, CASE lower(regexp_extract(virtual_path, '[^.]*$')) WHEN 'pdf' THEN 'pdf' WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'zip' THEN 'archive' WHEN 'ts' THEN 'video' WHEN 'mp3' THEN 'audio' WHEN 'docx' THEN 'office' ELSE 'other' END AS class, virtual_path LIKE '%.jpg' AS previewed FROM files")
_SAID = ["x: file does not exist", "file already exists", "permission denied (1)", "dir not empty", "it is a directory", "not a directory", "no space left", "read-only volume", "invalid argument", "name too long", "boom", None]
query("error_class", lambda f: f.failed_deletions().select("id", text.is_rate_limited("last_error").alias("limited"), text.is_quota_exceeded("last_error").alias("full"), text.errno(F.get(F.array(*[F.lit(m) for m in _SAID]), (F.col("id") % len(_SAID)).cast("int"))).alias("errno")), "SELECT id, last_error LIKE '%429%' AS limited, last_error LIKE '%quota%' AS \"full\", ['ENOENT', 'EEXIST', 'EACCES', 'ENOTEMPTY', 'EISDIR', 'ENOTDIR', 'ENOSPC', 'EROFS', 'EINVAL', 'ENAMETOOLONG', 'EIO', 'OK'][CAST(id % 12 + 1 AS INTEGER)] AS errno FROM failed_deletions")
query("mask_key", lambda f: f.providers().select("id", text.mask_key("display_name").alias("name"), text.mask_key("id").alias("short")), "SELECT id, CASE WHEN length(display_name) <= 8 THEN display_name ELSE left(display_name, 4) || '...' || right(display_name, 4) END AS name, id AS short FROM providers")
query("json_identity", lambda f: f.providers().select("id", text.identity_from_json("type", F.when(F.col("type") == "drive", F.to_json(F.struct(F.struct(F.col("id").alias("emailAddress")).alias("user")))).when(F.col("type") == "onedrive", F.concat(F.lit('{"mail":"","userPrincipalName":"'), "id", F.lit('"}'))).otherwise(F.concat(F.lit('{"email":"'), "id", F.lit('"}')))).alias("identity")), "SELECT id, CASE WHEN type = 'box' THEN '' ELSE id END AS identity FROM providers")
query("backoff_schedule", lambda f: f.failed_deletions().select("id", text.backoff_seconds("retry_count", text.is_rate_limited("last_error"), (F.col("id") % 4) / 4).alias("seconds")), "SELECT id, b + (id % 4) / 4.0::DOUBLE * b / 2 AS seconds FROM (SELECT id, least(pow(2, retry_count) * CASE WHEN last_error LIKE '%429%' THEN 3 ELSE 1 END, 30.0::DOUBLE) AS b FROM failed_deletions)")
query("provider_detail", lambda f: f.providers().select("id", text.provider_detail("account_identity", "type").alias("detail"), text.ensure_colon("rclone_remote").alias("remote"), F.array_join(text.parse_remotes(F.concat("id", F.lit(" ,, b"))), "+").alias("parsed")), "SELECT id, '(' || CASE WHEN account_identity <> '' THEN account_identity || ', ' ELSE '' END || type || ')' AS detail, rclone_remote || ':' AS remote, id || '+b' AS parsed FROM providers")
query("html_escape", lambda f: f.contents().select("id", text.html_escape(F.substring("content", 1, 1 << 30)).alias("html")).select("id", F.sha2("html", 256).alias("sha256")), "SELECT id, sha256(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS sha256 FROM contents")
query("remote_paths", lambda f: f.chunk_locations().join(f.chunks().select(F.col("id").alias("chunk_id"), "data_shards", "parity_shards", "sha256", "size_bytes"), "chunk_id").select("chunk_id", "shard_index", text.remote_path("chunks", "chunk_id", "shard_index", F.col("data_shards") + F.col("parity_shards")).alias("path"), text.rename_key("sha256", "size_bytes").alias("key")), "SELECT chunk_id, shard_index, 'chunks/' || chunk_id || CASE WHEN data_shards + parity_shards > 1 THEN '.s' || shard_index ELSE '' END AS path, sha256 || ':' || size_bytes AS key FROM chunk_locations l JOIN chunks c ON c.id = l.chunk_id")


query("fmt_size_web", lambda f: _sz(f, text.size_text_web), f"SELECT id, CASE WHEN s >= 1099511627776 THEN {tenth('floor(s / 1099511627776.0::DOUBLE * 10 + 0.5) / 10')} || ' TB' WHEN s >= 1073741824 THEN {tenth('floor(s / 1073741824.0::DOUBLE * 10 + 0.5) / 10')} || ' GB' WHEN s >= 1048576 THEN {tenth('floor(s / 1048576.0::DOUBLE * 10 + 0.5) / 10')} || ' MB' WHEN s >= 1024 THEN {tenth('floor(s / 1024.0::DOUBLE * 10 + 0.5) / 10')} || ' KB' ELSE s || ' B' END AS label FROM (SELECT id, {_n} AS s FROM files)")
query("clean_paths", lambda f: f.files().select("id", paths.clean_path(F.concat(F.lit("x/../"), "virtual_path", F.lit("/./..//y"))).alias("cleaned"), paths.clean_mount_path(F.concat(F.lit("../"), "virtual_path")).alias("mounted"), paths.join_paths(F.lit("/root/"), "virtual_path", F.lit("/")).alias("joined"), paths.virtual_path(F.concat(F.lit("/home/me/sync"), "virtual_path"), "/home/me/sync").alias("rooted")), "SELECT id, regexp_replace(virtual_path, '/[^/]*$', '') || '/y' AS cleaned, '/..' || virtual_path AS mounted, '/root' || virtual_path AS joined, virtual_path AS rooted FROM files")
query("data_and_parity", lambda f: f.chunks().select("id", text.data_and_parity(F.concat(F.col("data_shards").cast("string"), F.lit("+"), F.col("parity_shards").cast("string"))).alias("s")).select("id", "s.*"), "SELECT id, data_shards AS data, parity_shards AS parity FROM chunks")
query("listing_times", lambda f: f.listing().select("provider_id", "path", text.rfc3339(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("mtime"), text.rfc3339(F.lit("not a time")).alias("odd")), "SELECT provider_id, path, mtime, CAST(NULL AS BIGINT) AS odd FROM listing")
query("object_plan", lambda f: an.object_plan(an.delete_plan(f.files(), f.chunks(), f.chunk_locations(), DIR), f.providers()), "SELECT DISTINCT rclone_remote || ':' AS remote, remote_path, 'delete' AS action FROM inside i JOIN providers p ON p.id = i.provider_id WHERE remote_path NOT IN (SELECT remote_path FROM chunk_locations WHERE chunk_id NOT IN (SELECT chunk_id FROM inside))", inside=_inside)
query("cleanup_plan", lambda f: an.cleanup_plan(f.providers(), f.failed_deletions()), "SELECT rclone_remote || ':' AS remote, 'empty_trash' AS action FROM providers WHERE id IN (SELECT provider_id FROM failed_deletions)")
query("restore_valid", lambda f: q.restore_valid(q.restore_sample(f.chunk_locations(), f.providers()), f.listing().join(f.providers().select(F.col("id").alias("provider_id"), "rclone_remote"), "provider_id")), "SELECT count(*) = 0 AS valid FROM (SELECT provider_id FROM chunk_locations ORDER BY chunk_id, shard_index LIMIT 3) WHERE provider_id NOT IN (SELECT provider_id FROM listing WHERE regexp_replace(path, '/[^/]*$', '') = 'chunks')")
query("frame_headers", lambda f: f.files().select("id", text.frame_header(F.col("size_bytes") % 200_000).alias("header")), "SELECT id, '81' || CASE WHEN n < 126 THEN printf('%02X', n) WHEN n < 65536 THEN '7E' || printf('%04X', n) ELSE '7F' || printf('%016X', n) END AS header FROM (SELECT id, size_bytes % 200000 AS n FROM files)")


# Events.

_burst = """SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY t_ms, op) AS burst, lead(t_ms) OVER w AS n_at, lead(touch) OVER w AS n_touch FROM
    (SELECT *, CASE WHEN NOT touch OR coalesce(NOT b_touch OR t_ms - b_at > 2000, true) THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(t_ms) OVER v AS b_at, lag(touch) OVER v AS b_touch FROM (SELECT *, op IN ('Create', 'Write') AS touch FROM fs_events) WINDOW v AS (PARTITION BY path ORDER BY t_ms, op))) WINDOW w AS (PARTITION BY path ORDER BY t_ms, op)"""
query("debounce_sessions", lambda f: ev.debounce(f.fs_events()), f"SELECT path, {big('max(t_ms) + 2000')} AS fires_ms, count(*) AS events FROM bursts WHERE touch GROUP BY path, burst HAVING NOT coalesce(arg_max(NOT n_touch AND n_at - t_ms <= 2000, t_ms), false)", bursts=_burst)
query("rename_matches", lambda f: ev.rename_matches(f.fs_events()), "SELECT b_path AS old_path, path AS new_path, b_at AS removed_ms, t_ms AS created_ms FROM (SELECT *, lag(op) OVER w AS b_op, lag(path) OVER w AS b_path, lag(t_ms) OVER w AS b_at FROM fs_events WHERE op IN ('Create', 'Remove', 'Rename') WINDOW w AS (PARTITION BY content ORDER BY t_ms, op = 'Create', path)) WHERE op = 'Create' AND b_op <> 'Create' AND t_ms - b_at <= 500 AND b_path <> path")
query("deferred_deletes", lambda f: ev.deferred_deletes(f.fs_events(), f.spark.range(5).select(F.concat(F.lit("/u"), F.col("id").cast("string")).alias("path"))), "SELECT path, t_ms + 500 AS deletes_ms FROM (SELECT *, lead(op) OVER w AS n_op, lead(t_ms) OVER w AS n_at FROM fs_events WHERE op = 'Create' OR op IN ('Remove', 'Rename') AND CAST(substr(path, 3) AS INTEGER) >= 5 WINDOW w AS (PARTITION BY content ORDER BY t_ms, op = 'Create', path)) WHERE op <> 'Create' AND NOT coalesce(n_op = 'Create' AND n_at - t_ms <= 500, false)")
query("scan_after_create", lambda f: ev.scan_after_create(f.fs_events(), f.spark.range(50).select(F.concat(F.lit("/u"), F.col("id").cast("string")).alias("path")), f.table("events").select(F.concat(F.lit("/u"), (F.col("user_id") % 200).cast("string"), F.lit("/f"), F.col("event_id").cast("string")).alias("path"))), "SELECT '/u' || (user_id % 200) || '/f' || event_id AS path, 'Create' AS op, pos AS t_ms FROM events JOIN (SELECT path AS dir, min(t_ms) AS pos FROM fs_events WHERE op = 'Create' AND CAST(substr(path, 3) AS INTEGER) < 50 GROUP BY 1) ON dir = '/u' || (user_id % 200)")
query("upload_runs", lambda f: ev.upload_runs(f.fs_events().select("path", "t_ms", "state")), """SELECT path, CAST(run AS BIGINT) AS run, arg_max(state, t_ms) AS state, min(t_ms) AS started_ms, count(*) AS steps, bool_and(ok) AS valid FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY t_ms) AS run,
    CASE WHEN fresh = 1 THEN state IN ('queued', 'preparing') WHEN b = 'queued' THEN state IN ('preparing', 'failed', 'cancelled') WHEN b = 'preparing' THEN state IN ('uploading', 'failed', 'cancelled') ELSE state IN ('complete', 'failed', 'cancelled') END AS ok
    FROM (SELECT *, CASE WHEN b IS NULL OR b IN ('complete', 'failed', 'cancelled') THEN 1 ELSE 0 END AS fresh FROM (SELECT path, t_ms, state, lag(state) OVER (PARTITION BY path ORDER BY t_ms) AS b FROM fs_events))) GROUP BY 1, 2""")
_until = 30 * 3_600_000
query("trigger_times", lambda f: ev.trigger_times(f.providers().select(F.col("id").alias("run"), F.lit(0).cast("long").alias("from_ms"), F.lit(_until).cast("long").alias("to_ms")), f.failed_deletions().select(F.col("provider_id").alias("run"), (F.col("id") * 7_919_000 % _until).alias("t_ms"))), f"""SELECT run, job, {big('pos')} AS at_ms FROM (SELECT id AS run, 'sync' AS job, unnest(range(60000, {_until} + 1, 60000)) AS pos FROM providers UNION ALL SELECT id, 'retry', unnest(range(3600000, {_until} + 1, 3600000)) FROM providers
    UNION ALL SELECT run, 'gc', unnest(range(pos, until + 1, 86400000)) FROM (SELECT run, pos, coalesce(lead(pos) OVER (PARTITION BY run ORDER BY pos) - 1, {_until}) AS until FROM (SELECT id AS run, 60000 AS pos FROM providers UNION SELECT provider_id, t + 120000 FROM (SELECT provider_id, id * 7919000 % {_until} AS t FROM failed_deletions WHERE provider_id IN (SELECT id FROM providers)) WHERE t >= 60000) WHERE pos <= {_until}))""")
query("echo_suppressed", lambda f: ev.without_echo(f.fs_events(), f.fs_events().where("t_ms % 11 = 0").select("path", (F.col("t_ms") - 900).alias("at_ms"))), "SELECT path, op, t_ms FROM fs_events e WHERE op NOT IN ('Create', 'Write') OR NOT EXISTS (SELECT 1 FROM fs_events o WHERE o.path = e.path AND o.t_ms % 11 = 0 AND o.t_ms - 900 <= e.t_ms AND e.t_ms < o.t_ms - 900 + 2000)")
query("event_counters", lambda f: ev.event_counters(f.fs_events()), "SELECT op, count(*) AS n FROM fs_events GROUP BY 1")
query("changed_only", lambda f: ev.changed_only(f.fs_events().where("op = 'Write'").select("path", "t_ms", (F.col("t_ms") % 3).alias("content"))), "SELECT path, t_ms, content FROM (SELECT path, t_ms, t_ms % 3 AS content, lag(t_ms % 3) OVER (PARTITION BY path ORDER BY t_ms) AS b FROM fs_events WHERE op = 'Write') WHERE b IS DISTINCT FROM content")
query("directory_removals", lambda f: ev.directory_removals(f.fs_events(), f.spark.range(50).select(F.concat(F.lit("/u"), F.col("id").cast("string")).alias("path"))), "SELECT path, t_ms, CASE WHEN CAST(substr(path, 3) AS INTEGER) < 50 THEN 'delete_tree' ELSE 'wait' END AS action FROM fs_events WHERE op IN ('Remove', 'Rename')")
query("progress_reports", lambda f: ev.progress_reports(f.fs_events().select("path", "t_ms", (F.col("t_ms") * 1000).alias("bytes"), (F.col("op") == "Rename").alias("ended"))), "SELECT path, t_ms, bytes, ended FROM (SELECT *, lag(bytes, 1, 0) OVER (PARTITION BY path ORDER BY t_ms) AS b FROM (SELECT path, t_ms, t_ms * 1000 AS bytes, op = 'Rename' AS ended FROM fs_events)) WHERE ended OR bytes // 262144 > b // 262144")
query("lifecycle", lambda f: ev.lifecycle(f.fs_events().select("path", "t_ms", F.col("op").alias("state"))), "SELECT path, arg_max(op, t_ms) AS state, min(t_ms) AS started_ms, count(*) AS steps FROM fs_events GROUP BY 1")
query("backup_times", lambda f: ev.backup_times(f.activity_log().select((F.col("created_at") * 1000).alias("t_ms"))), "SELECT t_ms + 30000 AS fires_ms FROM (SELECT created_at * 1000 AS t_ms, lead(created_at * 1000) OVER (ORDER BY created_at) AS n FROM activity_log) WHERE n IS NULL OR n - t_ms > 30000")
query("token_bucket", lambda f: ev.token_bucket(f.fs_events().select(F.col("op").alias("key"), "t_ms"), width_ms=1000), "SELECT op AS key, t_ms, round(greatest(t_ms, max(t_ms - i * 1000.0::DOUBLE / 12) OVER (PARTITION BY op ORDER BY t_ms) + (i - 19) * 1000.0::DOUBLE / 12), 3) AS granted_ms FROM (SELECT op, t_ms, row_number() OVER (PARTITION BY op ORDER BY t_ms) - 1 AS i FROM fs_events)")


def _saved(f: Fixtures) -> DataFrame:
    """The newest of two snapshots, opened again: rows by table."""
    base = f"{folder(f.spark)}/saved-{uuid.uuid4().hex}"
    sc.save_catalog(f.catalog().replace(files=f.files().limit(0)), [base], 1)
    sc.save_catalog(f.catalog(), [base], 2)
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in sc.open_catalog(f.spark, base).tables().items()]
    return reduce(DataFrame.unionByName, counts)


query("saved_catalog", _saved, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in sc.TABLES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, b=b: b(Fixtures(spark, sf_dir))) for n, b in BUILD.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
