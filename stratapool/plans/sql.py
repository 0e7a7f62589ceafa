"""The fixtures' mapping as common table expressions in DuckDB's SQL, for comparing results."""

from __future__ import annotations

import re

NOW = 1706745600
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CTES: dict[str, str] = {
    "nsup": "SELECT count(*) AS n FROM supplier",
    "providers": f"""SELECT 'p' || s_suppkey AS id,
        CASE s_suppkey % 4 WHEN 0 THEN 'drive' WHEN 1 THEN 'dropbox' WHEN 2 THEN 'onedrive' ELSE 'box' END AS type,
        s_name AS display_name, 'r' || s_suppkey AS rclone_remote,
        CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'user' || s_suppkey || '@example.com' END AS account_identity,
        CAST(2000000 AS BIGINT) AS quota_total_bytes,
        CASE WHEN s_suppkey % 11 <> 0 THEN CAST(round(s_acctbal * 100) AS BIGINT) END AS quota_free_bytes,
        CAST({NOW} AS BIGINT) AS quota_polled_at,
        CAST(CASE s_suppkey % 5 WHEN 0 THEN {NOW} + 3600 WHEN 1 THEN {NOW} - 3600 END AS BIGINT) AS rate_limited_until
        FROM supplier""",
    "named": """SELECT *, '/' || CASE WHEN o_orderkey % 89 = 0 THEN upper(replace(o_orderpriority, ' ', '_')) ELSE lower(replace(o_orderpriority, ' ', '_')) END AS top,
        CASE WHEN o_orderkey % 97 = 0 THEN '._' WHEN o_orderkey % 53 = 0 THEN '[' ELSE '' END || 'order_' || o_orderkey || ['.txt', '.pdf', '.jpg', '.mp4', '.zip', '.ts', '.mp3', '.docx'][CAST(o_orderkey % 8 + 1 AS INTEGER)] AS name,
        CAST(floor(epoch(o_orderdate)) AS BIGINT) AS made_s FROM orders""",
    "files": """SELECT 'f' || o_orderkey AS id,
        CASE WHEN o_orderkey % 211 = 0 THEN '' WHEN o_orderkey % 50 = 0 THEN top ELSE top || strftime(o_orderdate, '/%Y/%m') END || '/' || name AS virtual_path,
        CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, made_s AS created_at, made_s + o_orderkey % 86400 AS modified_at,
        sha256('c' || o_custkey) AS sha256_full, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'complete' END AS upload_state,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN '/spool/' || o_orderkey END AS tmp_path FROM named""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq FROM lineitem""",
    "lines": """SELECT 'c' || l_orderkey || '-' || seq AS id, 'f' || l_orderkey AS file_id, CAST(seq AS BIGINT) AS sequence,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, sha256('p' || l_partkey) AS sha256, CAST(round(l_extendedprice * 100) AS BIGINT) AS cloud_size,
        CASE WHEN l_orderkey % 10 = 0 THEN 3 ELSE 1 END AS data_shards, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS parity_shards,
        l_partkey, l_suppkey FROM numbered WHERE NOT (l_orderkey % 173 = 0 AND seq = 1)""",
    "chunks": "SELECT id, file_id, sequence, size_bytes, sha256, cloud_size, data_shards, parity_shards FROM lines",
    "placed": """SELECT l.id AS chunk_id, s.shard AS shard_index, (l_suppkey + s.shard) % (SELECT n FROM nsup) AS pk, l_partkey,
        'chunks/' || (l_partkey % 500) || '-' || l_suppkey || CASE WHEN data_shards + parity_shards > 1 THEN '.s' || s.shard ELSE '' END AS remote_path
        FROM lines l JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS shard) s ON s.shard < l.data_shards + l.parity_shards""",
    "chunk_locations": f"SELECT chunk_id, shard_index, 'p' || pk AS provider_id, remote_path, CAST({NOW} AS BIGINT) AS upload_confirmed_at FROM placed",
    "directories": f"""SELECT path, CAST({NOW} AS BIGINT) AS created_at FROM (SELECT '/' || lower(r_name) AS path FROM region
        UNION ALL SELECT '/' || lower(r_name) || '/' || lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "listing": f"""SELECT 'p' || pk AS provider_id, CASE pk % 10 WHEN 3 THEN name WHEN 4 THEN 'moved/' || name ELSE path END AS path, name, CAST(100 AS BIGINT) AS size, is_dir, mtime FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM (
        SELECT DISTINCT pk, remote_path AS path, CAST({NOW} - 86400 AS BIGINT) AS mtime, false AS is_dir FROM placed WHERE NOT (l_partkey % 50 = 7 AND pk % 4 <> 1)
        UNION ALL SELECT p_partkey % (SELECT n FROM nsup), 'chunks/orphan-' || p_partkey, {NOW} - p_partkey % 12 * 100, false FROM part
        UNION ALL SELECT s_suppkey, 'chunks/old', {NOW}, true FROM supplier) WHERE pk NOT IN (7, 9))""",
    "scanned": "SELECT id AS provider_id FROM providers WHERE id <> 'p9'",
    "activity_log": """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'download' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'mkdir' WHEN 'view' THEN 'verify' END AS action,
        '/u' || user_id AS path, CASE WHEN event_id % 4 <> 0 THEN event_type END AS detail, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events""",
    "failed_deletions": """SELECT event_id AS id, 'p' || (user_id % ((SELECT n FROM nsup) + 2)) AS provider_id, 'chunks/gone-' || event_id AS remote_path,
        CAST(floor(epoch(ts)) AS BIGINT) AS failed_at, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 13 AS INTEGER) AS retry_count,
        CASE WHEN event_id % 2 = 0 THEN 'error 429: rate limit' ELSE 'quota exceeded' END AS last_error FROM events WHERE event_type = 'error'""",
    "counters": """SELECT CASE event_type WHEN 'click' THEN 'files_downloaded' WHEN 'error' THEN 'files_deleted' WHEN 'purchase' THEN 'files_uploaded' WHEN 'view' THEN 'dedup_hits' ELSE 'other' END AS key, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1""",
    "fs_events": """SELECT '/u' || (user_id % 200) AS path, CASE event_type WHEN 'click' THEN 'Create' WHEN 'view' THEN 'Write' WHEN 'purchase' THEN 'Write' WHEN 'error' THEN 'Remove' WHEN 'signup' THEN 'Rename' END AS op,
        event_id * 7 AS t_ms, 'h' || (event_id % 40) AS content, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'preparing' WHEN 'purchase' THEN 'uploading' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'complete' END AS state FROM events""",
    "contents": "SELECT 'd' || doc_id AS id, coalesce(text, '') AS content FROM documents",
}


def fold(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def under(x: str, root: str) -> str:
    return f"starts_with({fold(x)}, '{root.translate(str.maketrans(UP, LOW))}')"


def base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def with_tables(query: str, **own: str) -> str:
    """query behind the expressions of the tables that it, or they, name; own: further ones."""
    known = CTES | own
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text) and text is not known[name]:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(query)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + query
