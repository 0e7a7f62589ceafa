"""Streams against their batch twins, and literal event sequences."""

import datetime as dt

from pyspark.sql import functions as F

from stratapool.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(p, o, t, c) for p, o, t, c in rows], "path string, op string, t_ms long, content string")


def stream(spark, df, path, schema_df=None):
    df.withColumn("ts", F.timestamp_millis("t_ms")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.withColumn("ts", F.timestamp_millis("t_ms")).schema).parquet(path)


def drain(df, name, mode="append"):
    s = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    s.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_debounce(spark):
    e = events(spark, ("/a", "Create", 0, ""), ("/a", "Write", 2000, ""), ("/a", "Write", 4001, ""), ("/b", "Write", 0, ""), ("/b", "Remove", 1500, ""), ("/c", "Write", 0, ""), ("/c", "Remove", 2500, ""))
    assert sorted(tuple(r) for r in ev.debounce(e).collect()) == [("/a", 4000, 2), ("/a", 6001, 1), ("/c", 2000, 1)]


def test_debounce_stream_matches_batch(spark, tmp_path):
    rows = [(f"/{i % 3}", "Write", i * 1700 + (i % 5) * 900, "") for i in range(40)] + [("/z", "Write", 10_000_000, "")]
    e = events(spark, *rows)
    got = drain(ev.debounce_stream(stream(spark, e, str(tmp_path / "d"))), "debounced")
    want = ev.debounce(e).where("path <> '/z'").collect()
    assert sorted((r.path, round((r.fires - dt.datetime(1970, 1, 1)).total_seconds() * 1000), r.events) for r in got) == sorted((r.path, r.fires_ms, r.events) for r in want)


def test_rename_and_stream(spark, tmp_path):
    e = events(spark, ("/old", "Remove", 1000, "h"), ("/new", "Create", 1500, "h"), ("/late", "Remove", 5000, "k"), ("/x", "Create", 5501, "k"), ("/same", "Remove", 9000, "m"), ("/same", "Create", 9100, "m"), ("/two", "Create", 1600, "h"))
    assert [(r.old_path, r.new_path) for r in ev.rename_matches(e).collect()] == [("/old", "/new")]
    assert sorted((r.path, r.deletes_ms) for r in ev.deferred_deletes(e).collect()) == [("/late", 5500)]
    moved = events(spark, ("/a", "Rename", 0, "h"), ("/b", "Create", 10, "h"), ("/d", "Rename", 0, "x"))
    assert [(r.old_path, r.new_path) for r in ev.rename_matches(moved).collect()] == [("/a", "/b")]
    assert [r.path for r in ev.deferred_deletes(moved, spark.createDataFrame([("/d",)], "path string")).collect()] == []
    assert {(r.path, r.action) for r in ev.directory_removals(moved, spark.createDataFrame([("/d",)], "path string")).collect()} == {("/a", "wait"), ("/d", "delete_tree")}
    last = events(spark, ("/end", "Create", 10_000_000, "end"))  # the watermark passes all before it
    got = drain(ev.renames_stream(stream(spark, e.unionByName(last), str(tmp_path / "r"))), "renamed")
    assert sorted((r.kind, r.old_path, r.new_path, r.at_ms) for r in got) == [("delete", "/late", None, 5500), ("rename", "/old", "/new", 1500)]
    got = drain(ev.rename_matches_stream(stream(spark, e.unionByName(last), str(tmp_path / "r"))), "renamed_only")
    assert sorted(map(tuple, got))[:1] == sorted(map(tuple, ev.rename_matches(e).collect()))


def test_long_orders_in_stretches(spark):
    import random

    rng = random.Random(8)
    times = sorted(rng.sample(range(5_000_000), 300))
    c = spark.createDataFrame([(t,) for t in times], "t_ms long")
    ups = [(t, t + 90_000) for t in times[::40]]
    want = [a + 30_000 for a, b in zip(times, times[1:]) if b - a > 30_000] + [times[-1] + 30_000]
    assert sorted(r.fires_ms for r in ev.backup_times(c).collect()) == sorted(want)
    busy = [max([f, *(b for a, b in ups if a <= f)]) for f in want]
    assert sorted(r.fires_ms for r in ev.backup_times(c, spark.createDataFrame(ups, "from_ms long, to_ms long")).collect()) == sorted(busy)
    tokens, at, grants = 3.0, None, []
    for t in times:
        now = t if at is None else max(t, at)
        tokens = min(3.0, tokens + (0 if at is None else now - at) * 0.05 / 1000)
        at = now
        if tokens < 1:
            at += (1 - tokens) * 1000 / 0.05
            tokens = 1.0
        tokens -= 1
        grants.append(at)
    r = c.withColumn("key", F.lit(None).cast("string"))
    got = sorted(x.granted_ms for x in ev.token_bucket(r, 3, 0.05, width_ms=100_000).collect())
    assert max(abs(a - b) for a, b in zip(got, sorted(grants))) < 0.1
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (9, "a"), (9, "c"), (1 << 20, "c")], "at long, path string")
    from stratapool.operators import analytics as an

    assert sorted(r["at"] for r in an.set_changes(s).collect()) == [2, 1 << 20]


def test_triggers_and_runs(spark):
    runs = spark.createDataFrame([("r", 0, 2 * ev.DAY_MS)], "run string, from_ms long, to_ms long")
    nudges = spark.createDataFrame([("r", 3_600_000), ("r", 10)], "run string, t_ms long")
    got = {}
    for r in ev.trigger_times(runs, nudges).collect():
        got.setdefault(r.job, []).append(r.at_ms)
    assert len(got["sync"]) == 2880 and len(got["retry"]) == 48 and sorted(got["gc"]) == [60_000, 3_720_000, 3_720_000 + ev.DAY_MS]
    rows = [("/a", 0, "queued"), ("/a", 1, "preparing"), ("/a", 2, "uploading"), ("/a", 3, "complete"), ("/a", 9, "queued"), ("/a", 10, "complete")]
    out = ev.upload_runs(spark.createDataFrame(rows, "path string, t_ms long, state string")).orderBy("run").collect()
    assert [(r.run, r.state, r.started_ms, r.steps, r.valid) for r in out] == [(1, "complete", 0, 4, True), (2, "complete", 9, 2, False)]


def test_echo_counters_progress_bucket(spark, tmp_path):
    e = events(spark, ("/a", "Write", 100, ""), ("/a", "Remove", 150, ""), ("/a", "Write", 2100, ""), ("/b", "Write", 100, ""))
    own = spark.createDataFrame([("/a", 100)], "path string, at_ms long")
    assert sorted((r.path, r.op, r.t_ms) for r in ev.without_echo(e, own).collect()) == [("/a", "Remove", 150), ("/a", "Write", 2100), ("/b", "Write", 100)]
    got = drain(ev.event_counters(stream(spark, e, str(tmp_path / "c"))), "counted", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, ev.event_counters(e).collect()))
    s = spark.createDataFrame([("/a", 1, 1000, False), ("/a", 2, 300_000, False), ("/a", 3, 300_001, False), ("/a", 4, 300_002, True)], "path string, t_ms long, bytes long, ended boolean")
    assert sorted(r.t_ms for r in ev.progress_reports(s).collect()) == [2, 4]
    r = spark.createDataFrame([("k", 0)] * 5, "key string, t_ms long")
    assert sorted(x.granted_ms for x in ev.token_bucket(r, burst=3, per_second=10).collect()) == [0, 0, 0, 100, 200]


def test_lifecycle_stream(spark, tmp_path):
    rows = [("/a", T0, "queued"), ("/a", T0 + dt.timedelta(seconds=1), "uploading"), ("/b", T0, "queued"), ("/a", T0 + dt.timedelta(seconds=2), "complete")]
    df = spark.createDataFrame(rows, "path string, ts timestamp, state string")
    df.coalesce(1).write.parquet(str(tmp_path / "l"))
    got = drain(ev.lifecycle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l"))), "lived")
    assert [(r.path, r.state, r.started, r.steps) for r in got] == [("/a", "complete", T0, 3)]


def test_ring_and_subscriber(spark, tmp_path):
    log = spark.createDataFrame([(i, f"t{i:03}") for i in range(100)], "id long, time string")
    assert [r.id for r in ev.ring(log, 3).collect()] == [97, 98, 99]
    log.coalesce(1).write.parquet(str(tmp_path / "g"))
    seen = []
    s = ev.to_subscriber(spark.readStream.schema(log.schema).parquet(str(tmp_path / "g")), seen.extend, queue=64)
    s.processAllAvailable()
    s.stop()
    assert [r.id for r in seen] == list(range(36, 100))
