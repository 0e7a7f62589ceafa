"""Literal catalogs: visibility, escaping, changes, reconciliation's edges, sources and snapshots."""

import struct

import pytest
from pyspark.sql import functions as F

from stratapool.operators import analytics as an
from stratapool.operators import catalog as q
from stratapool.operators import content as co
from stratapool.operators import mutate as mu
from stratapool.sources import schema as sc


def files(spark, *rows):
    full = [(f"f{i}", p, n, 1, 1, h, s, None) for i, (p, n, h, s) in enumerate(rows)]
    return spark.createDataFrame(full, sc.TABLES["files"])


def table(spark, name, rows):
    return spark.createDataFrame(rows, sc.TABLES[name])


def names(df, col="virtual_path"):
    return sorted(r[col] for r in df.collect())


def test_listing_and_visibility(spark):
    f = files(spark, ("/a.txt", 10, "h", "complete"), ("/sub/b.txt", 20, "h", "complete"), ("/sub/deep/c.txt", 30, "h", "complete"), ("/new/p.bin", 40, "h", "pending"))
    d = table(spark, "directories", [("/empty", 1)])
    assert names(q.list_files(f, "/")) == ["/a.txt"] and names(q.list_files(f, "/sub/")) == ["/sub/b.txt"] and names(q.list_files(f, "/new")) == []
    assert names(q.list_subdirectories(f, d, "/"), "name") == ["empty", "new", "sub"]
    assert q.path_is_dir(f, d, "/new").first().found and q.path_is_dir(f, d, "/empty/").first().found and q.path_is_dir(f, d, "/").first().found and not q.path_is_dir(f, d, "/su").first().found
    assert q.file_exists(f, "/new/p.bin").first().found and q.complete_file_by_path(f, "/new/p.bin").count() == 0
    assert tuple(q.disk_usage(f, "/").first()) == (3, 60) and tuple(q.disk_usage(f, "/a.txt").first()) == (0, 0) and tuple(q.disk_usage(f.limit(0), "/").first()) == (0, 0)
    assert tuple(an.tree_summary(f, "/sub").first()) == (2, 50, 1)


def test_metacharacters_are_literal(spark):
    f = files(spark, ("/data/100%_done.txt", 1, "h", "complete"), ("/data/regular.txt", 1, "h", "complete"), ("/da_a/x", 1, "h", "complete"), ("/data2/x", 1, "h", "complete"))
    assert names(q.search_files(f, "/data", "*100%*")) == names(q.search_files(f, "/data", "*_done*")) == ["/data/100%_done.txt"]
    assert names(q.files_under_dir(f, "/da_a")) == ["/da_a/x"] and q.disk_usage(f, "/data").first().files == 2


def test_activity_order_and_limits(spark):
    log = table(spark, "activity_log", [(i, "upload", f"/{i}", None, 7) for i in range(5)])
    got = q.recent_activity(log, 3).collect()
    assert [r.id for r in got] == [4, 3, 2] and got[0].detail == "" and q.recent_activity(log, 0).count() == 5


def test_changes(spark):
    f = files(spark, ("/a/x", 1, "h", "pending"), ("/b", 1, "h", "complete"), ("/é/y", 1, "h", "complete"))
    new = spark.createDataFrame([("f1", "/c", 5, 2, 2, "k", "", None), ("f9", "/a/x", 6, 2, 2, "k", "pending", None)], sc.TABLES["files"])
    out = mu.insert_files(f, new)
    assert names(out) == ["/a/x", "/c", "/é/y"] and {r.id: r.upload_state for r in out.collect()} == {"f1": "complete", "f9": "pending", "f2": "complete"}
    assert names(mu.replaced_files(f, new), "id") == ["f0", "f1"]
    assert names(mu.rename_files_under(f, "/é", "/längst")) == ["/a/x", "/b", "/längst/y"]
    assert names(mu.rename_conflicts(files(spark, ("/a/x", 1, "", "complete"), ("/b/x", 1, "", "complete")), "/a", "/b")) == ["/b/x"]
    p = table(spark, "providers", [("p1", "t", "n", "r", "", 1000, 100, 1, None), ("p2", "t", "n", "r", "", None, None, 1, None)])
    assert mu.deduct_free(p, "p1", 500).where("id='p1'").first().quota_free_bytes == 0 and mu.deduct_free(p, "p2", 5).where("id='p2'").first().quota_free_bytes is None
    assert mu.credit_free(p, "p1", 5000).where("id='p1'").first().quota_free_bytes == 5100
    d = table(spark, "directories", [("/a", 1), ("/a/b", 1), ("/ab", 1)])
    assert names(mu.delete_directories_under(d, "/a"), "path") == ["/ab"] and mu.create_directory(d, "/", 5).count() == 3 and mu.create_directory(d, "/a/", 5).count() == 3


def test_cascade_and_sequential_credits(spark):
    f = files(spark, ("/d/a", 1, "h", "complete"), ("/d/b", 1, "h", "complete"), ("/o", 1, "h", "complete"))
    c = table(spark, "chunks", [(f"c{i}", f"f{i}", 0, 10 + i, "s", 10 + i, 1, 0) for i in range(3)])
    at = table(spark, "chunk_locations", [("c0", 0, "p", "shared-in", 1), ("c1", 0, "p", "shared-in", 1), ("c1", 1, "q", "shared-out", 1), ("c2", 0, "q", "shared-out", 1)])
    cat = sc.Catalog(table(spark, "providers", []), f, c, at, *(table(spark, n, []) for n in ("directories", "failed_deletions", "activity_log", "counters")))
    assert [tuple(r) for r in an.dir_delete_credits(f, c, at, "/d").collect()] == [("p", 10)]
    plan = {r.remote_path: r.action for r in an.delete_plan(f, c, at, "/d").collect()}
    assert plan == {"shared-in": "delete", "shared-out": "keep"}
    out = mu.delete_file_by_path(cat, "/d/b")
    assert names(out.files, "id") == ["f0", "f2"] and names(out.chunks, "id") == ["c0", "c2"] and names(out.chunk_locations, "chunk_id") == ["c0", "c2"]
    assert {tuple(r) for r in q.provider_chunk_bytes(at, c).collect()} == {("p", 21), ("q", 23)}


def listing(spark, rows):
    return spark.createDataFrame(rows, "provider_id string, path string, name string, size long, is_dir boolean, mtime long")


def test_reconciliation_edges(spark):
    at = table(spark, "chunk_locations", [(f"c{i}", 0, p, f"chunks/{i}", 1) for p in ("full", "none", "gone", "base", "name") for i in range(15)])
    lst = listing(spark, [("full", f"chunks/{i}", f"{i}", 1, False, 0) for i in range(15)] + [("full", "chunks/x", "x", 1, False, None), ("full", "chunks/y", "y", 1, False, 950), ("full", "dir", "dir", 1, True, 0)] + [("base", f"{i}", f"{i}", 1, False, 0) for i in range(15)] + [("name", f"else/{i}", f"{i}", 1, False, 0) for i in range(14)] + [("name", "chunks/14", "14", 1, True, 0)])
    scanned = spark.createDataFrame([("full",), ("none",), ("base",), ("name",)], "provider_id string")
    got = {r.provider_id: (r.known, r.missing, r.stopped) for r in an.gc_missing_ratio(at, lst, scanned).collect()}
    assert got == {"full": (15, 0, False), "none": (15, 15, True), "base": (15, 0, False), "name": (15, 1, False)}  # a directory is no object
    assert {(r.provider_id, r.remote_path, r.old) for r in an.gc_orphans(at, lst, 1000).where("provider_id <> 'name'").collect()} == {("full", "chunks/x", True), ("full", "chunks/y", False)}
    assert an.gc_orphans(at, lst, 1000).where("provider_id = 'name'").count() == 14  # of another directory: vouched for, and strange
    verdicts = {r.provider_id: (r.missing, r.verdict) for r in an.gc_classification(at, lst, scanned, 1000).collect()}
    assert verdicts == {"full": (0, "clean"), "none": (15, "stopped"), "base": (0, "clean"), "name": (1, "lossy")}
    c = table(spark, "chunks", [(f"c{i}", f"f{i}", 0, 1, "s", 1, 1, 0) for i in range(15)])
    assert [r.file_id for r in an.gc_broken_files(at, c, lst, scanned).collect()] == ["f14"]


def test_bare_names_are_not_missing(spark):
    at = table(spark, "chunk_locations", [("c", 0, "p", "old/abc", 1)])
    one = spark.createDataFrame([("p",)], "provider_id string")
    bare = listing(spark, [("p", "abc", "abc", 1, False, 0)])
    assert an.gc_classification(at, bare, one, 1000).first().verdict == "clean" and an.gc_missing(at, bare, one).count() == 0
    assert an.gc_missing(at, listing(spark, [("p", "sub/abc", "abc", 1, False, 0)]), one).count() == 1  # neither path nor bare name


def test_safety_stop_keeps_files_and_purge_cascades(spark):
    f = files(spark, *[(f"/{i}", 4, "h", "complete") for i in range(15)])
    c = table(spark, "chunks", [(f"c{i}", f"f{i}", 0, 4, "s", 4, 1, 0) for i in range(15)] + [("lost", "nofile", 0, 4, "s", 4, 1, 0)])
    at = table(spark, "chunk_locations", [(f"c{i}", 0, "p", f"chunks/{i}", 1) for i in range(15)])
    cat = sc.Catalog(table(spark, "providers", []), f, c, at, *(table(spark, n, []) for n in ("directories", "failed_deletions", "activity_log", "counters")))
    one = spark.createDataFrame([("p",)], "provider_id string")

    def after(there):
        lst = listing(spark, [("p", f"chunks/{i}", f"{i}", 1, False, 0) for i in there])
        return mu.purge_files(cat, an.gc_broken_files(at, c, lst, one))

    out = after([])
    assert out.files.count() == 15 and out.chunks.count() == 15 and out.chunk_locations.count() == 15  # stopped; the orphan record goes
    out = after(range(2, 15))
    assert names(out.files, "id") == sorted(f"f{i}" for i in range(2, 15)) and out.chunks.count() == 13 and out.chunk_locations.count() == 13


def test_replace_and_swap(spark):
    f = files(spark, ("/donor", 1, "h", "complete"), ("/old", 1, "k", "complete"), ("/wait", 1, "h", "pending"))
    c = table(spark, "chunks", [("a", "f0", 0, 1, "s", 1, 1, 0), ("b", "f1", 0, 1, "s", 1, 1, 0)])
    at = table(spark, "chunk_locations", [("a", 0, "p", "x", 1), ("b", 0, "p", "y", 1), ("b", 1, "q", "x", 1)])
    cat = sc.Catalog(table(spark, "providers", []), f, c, at, *(table(spark, n, []) for n in ("directories", "failed_deletions", "activity_log", "counters")))
    new = spark.createDataFrame([("n", "/old", 1, 2, 2, "h", "pending", "/t")], sc.TABLES["files"])
    out = mu.clone_and_replace(cat, new)
    assert {(r.id, r.virtual_path, r.upload_state) for r in out.files.collect()} == {("f0", "/donor", "complete"), ("n", "/old", "complete"), ("f2", "/wait", "pending")}
    assert names(out.chunks, "id") == ["a", "n/0"] and {tuple(r)[:4] for r in out.chunk_locations.collect()} == {("a", 0, "p", "x"), ("n/0", 0, "p", "x")}
    chunk, place = table(spark, "chunks", [("z", "n", 0, 1, "s", 1, 1, 0)]), table(spark, "chunk_locations", [("z", 0, "p", "z", 1)])
    out, objects = mu.overwrite_swap(cat, new, chunk, place)
    assert names(out.files, "id") == ["f0", "f2", "n"] and names(out.chunks, "id") == ["a", "z"]
    assert [tuple(r) for r in objects.collect()] == [("p", "y")]  # x is the donor's as well
    both = spark.createDataFrame([("n", "/c", 1, 1, 1, "h", "", None), ("n", "/d", 1, 1, 2, "h", "", None), ("m", "/d", 1, 1, 1, "h", "", None)], sc.TABLES["files"])
    assert {(r.id, r.virtual_path) for r in mu.insert_files(f.limit(0), both).collect()} == {("n", "/d")}


def test_integrity_cases(spark):
    f = files(spark, ("/ok", 1, "", "complete"), ("/gap", 1, "", "complete"), ("/lost", 1, "", "complete"), ("/wait", 1, "", "pending"), ("/empty", 0, "", "complete"), ("/none", 5, "", "complete"))
    c = table(spark, "chunks", [("a", "f0", 0, 1, "", 1, 1, 0), ("b", "f1", 1, 1, "", 1, 1, 0), ("c", "f2", 0, 1, "", 1, 1, 0)])
    at = table(spark, "chunk_locations", [("a", 0, "p", "x", 1), ("b", 0, "p", "y", 1)])
    assert {r.id: r.status for r in co.integrity(f, c, at).collect()} == {"f0": "ok", "f1": "gap", "f2": "no_location", "f3": "in_progress", "f4": "ok", "f5": "gap"}
    assert co.integrity_of_path(f, c, at, "/lost").first().status == "no_location" and co.integrity_of_path(f, c, at, "/zzz").first().status == "not_found"


def test_sources_and_snapshots(spark, tmp_path):
    f = files(spark, ("/a", 1, "h", "complete"))
    cat = sc.Catalog(table(spark, "providers", []), f, *(table(spark, n, []) for n in ("chunks", "chunk_locations", "directories", "failed_deletions", "activity_log", "counters")))
    targets = [str(tmp_path / "s1"), str(tmp_path / "s2")]
    for stamp in (5, 7, 9):
        sc.save_catalog(cat if stamp == 9 else cat.replace(files=f.limit(0)), targets, stamp)
    assert sc.versions(spark, targets[1]) == [7, 9] and sc.open_catalog(spark, targets[0], 7).files.count() == 0
    (tmp_path / "s1" / ".v=11-crashed" / "files").mkdir(parents=True)  # written aside and never named
    assert sc.open_catalog(spark, targets[0]).files.count() == 1
    with pytest.raises(FileExistsError):
        sc.save_catalog(cat, targets[:1], 9)
    again = sc.open_catalog(spark, str(tmp_path / "s2")).views()
    assert names(again.files) == ["/a"] and again.files.schema == sc.TABLES["files"] and spark.sql("SELECT count(*) n FROM files").first().n == 1
    assert sc.open_catalog(spark, str(tmp_path / "nothing")).counters.count() == 0
    blob = lambda t, b: sc.MAGIC + struct.pack(">Q", t) + b
    made = sc.backup_blobs(spark.createDataFrame([(5, "old")], "stamp long, content string")).first().data
    assert bytes(made) == blob(5, b"old")
    blobs = spark.createDataFrame([("a", bytearray(blob(5, b"old"))), ("b", bytearray(blob(9, b"new"))), ("c", bytearray(blob(9, b"tie"))), ("d", bytearray(b"junk")), ("e", bytearray(blob(0, b"zero")))], "source string, data binary")
    best = sc.newest_backup(blobs).first()
    assert (best.source, best.stamp, bytes(best.content)) == ("b", 9, b"new") and sc.newest_backup(blobs.where("source > 'c'")).count() == 0
    assert sc.newest_backup(blobs, magic=b"12345678").count() == 0
    (tmp_path / "l.json").write_text('{"list": [{"Path": "d/x", "Name": "x", "Size": 3, "IsDir": false, "ModTime": "2024-01-01T00:00:00Z"}]}')
    assert sc.listing(spark, str(tmp_path / "l.json")).first().Path == "d/x"
    rows = spark.createDataFrame([('{"total": 5}',), ("{}",)], "json string")
    assert [(r.total, r.used, r.free) for r in sc.quotas(rows).collect()] == [(5, 0, 0), (0, 0, 0)] and {r.type for r in sc.remote_types(rows).collect()} == {"unknown"}
    (tmp_path / "c.toml").write_text("rate = 3\n")
    assert sc.load_config(str(tmp_path / "c.toml")) == {"rate": 3} and sc.load_config(str(tmp_path / "no.toml")) == {}
    sc.save_selection(str(tmp_path / "sel.json"), ["a"])
    assert sc.load_selection(str(tmp_path / "sel.json")) == ["a"] and sc.load_selection(str(tmp_path / "nosel")) is None
    assert sc.local_tree(spark, str(tmp_path)).count() >= 3 and sc.objects(spark, str(tmp_path), "*.toml").first().length == 9
    assert sc.fresh_quotas(spark.createDataFrame([(100,), (2000,)], "fetched_at long"), 2100).count() == 1


def test_retry_and_selection(spark):
    x = table(spark, "failed_deletions", [(1, "p", "a", 5, 10, None), (2, "p", "b", 4, 0, None), (3, "z", "c", 6, 0, None)])
    p = table(spark, "providers", [("p", "", "", "", "", None, None, None, None)])
    assert {r.id: r.action for r in an.retry_plan(x, p).collect()} == {1: "abandon", 2: "retry", 3: "abandon"}
    r = spark.range(1).select(an.selection_remove(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("ok"), an.selection_remove(F.array(F.lit("a")), F.array(F.lit("c"))).alias("unknown"), an.selection_add(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b"))).alias("more")).first()
    assert r.ok == ["b"] and r.unknown is None and r.more == ["b", "a"]
