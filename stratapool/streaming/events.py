"""File-system event logic, as batch functions and as Structured Streaming.

Events: (path, op, t_ms, ...), op one of Create, Write, Remove, Rename. A path that is moved away
sends Rename, so Remove and Rename are both departures. Batch functions take times in milliseconds;
streaming twins take a timestamp column ``ts`` and use watermarks.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import with_previous, with_running_max

DEBOUNCE_MS, RENAME_MS, ECHO_MS = 2000, 500, 2000
BACKUP_MS = 30_000
REPORT_BYTES = 256 * 1024
DEPARTURES = ("Remove", "Rename")
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
SYNC_MS, FIRST_GC_MS, NUDGE_MS = 60_000, 60_000, 120_000


def debounce(events: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(path, fires_ms, events): when each burst of Create and Write has been quiet for long enough.

    An event within the quiet time, its end included, goes on with the burst. Remove and Rename
    cancel a burst that hasn't fired.
    """
    w = W.partitionBy("path").orderBy("t_ms", "op")
    touch = F.col("op").isin("Create", "Write")
    before = F.lag(F.struct("t_ms", touch.alias("touch"))).over(w)
    new = F.coalesce(~before["touch"] | (F.col("t_ms") - before["t_ms"] > quiet_ms), F.lit(True))
    s = events.withColumn("touch", touch).withColumn("new", F.when(touch, new.cast("int")).otherwise(1))
    s = s.withColumn("burst", F.sum("new").over(w)).withColumn("next", F.lead(F.struct("t_ms", "touch")).over(w))
    ends = s.where("touch").groupBy("path", "burst").agg(F.max("t_ms").alias("last"), F.count("*").alias("events"), F.max_by("next", F.struct("t_ms", "op")).alias("next"))
    cancelled = F.coalesce(~F.col("next.touch") & (F.col("next.t_ms") - F.col("last") <= quiet_ms), F.lit(False))
    return ends.where(~cancelled).select("path", (F.col("last") + quiet_ms).alias("fires_ms"), "events")


def debounce_stream(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of Create and Write by session windows; a burst comes out when the watermark has passed it."""
    touched = events.where(F.col("op").isin("Create", "Write")).withWatermark("ts", late)
    return touched.groupBy("path", F.session_window("ts", quiet)).agg(F.count("*").alias("events")).select("path", F.col("session_window.end").alias("fires"), "events")


def departed() -> Column:
    return F.col("op").isin(*DEPARTURES)


def _by_content(events: DataFrame) -> tuple[DataFrame, W]:
    """Departures (o = 0) and Creates (o = 1), and their order under each content."""
    rows = events.where(departed() | (F.col("op") == "Create")).withColumn("o", F.when(departed(), 0).otherwise(1))
    return rows, W.partitionBy("content").orderBy("t_ms", "o", "path")


def rename_matches(events: DataFrame, window_ms: int = RENAME_MS) -> DataFrame:
    """(old_path, new_path, removed_ms, created_ms): a Create of the content of a departure within the window.

    Events are keyed by content. Within a key, a Create is paired with the last departure before it
    that isn't taken by an earlier Create; both sides are one sorted run, no pairs are formed.
    """
    rows, w = _by_content(events)
    p = F.lag(F.struct("o", "path", "t_ms")).over(w)
    hit = (F.col("o") == 1) & (p["o"] == 0) & (F.col("t_ms") - p["t_ms"] <= window_ms) & (p["path"] != F.col("path"))
    return rows.withColumn("p", p).withColumn("hit", hit).where("hit").select(F.col("p.path").alias("old_path"), F.col("path").alias("new_path"), F.col("p.t_ms").alias("removed_ms"), F.col("t_ms").alias("created_ms"))


def deferred_deletes(events: DataFrame, directories: DataFrame | None = None, window_ms: int = RENAME_MS) -> DataFrame:
    """(path, deletes_ms): departures that no Create of their content takes up within the window.
    directories: (path), whose departures are done at once and don't wait."""
    if directories is not None:
        gone = directories.select("path").distinct().withColumn("_dir", F.lit(True))
        events = events.join(gone, "path", "left").where(~(departed() & F.coalesce("_dir", F.lit(False)))).drop("_dir")
    rows, w = _by_content(events)
    n = F.lead(F.struct("o", "t_ms")).over(w)
    taken = F.coalesce((n["o"] == 1) & (n["t_ms"] - F.col("t_ms") <= window_ms), F.lit(False))
    return rows.withColumn("taken", taken).where("o = 0 and not taken").select("path", (F.col("t_ms") + window_ms).alias("deletes_ms"))


RENAMES_OUT = "kind string, old_path string, new_path string, removed_ms long, at_ms long"


def renames_stream(events: DataFrame, window_ms: int = RENAME_MS, late: str = "5 seconds") -> DataFrame:
    """rename_matches (kind rename) and deferred_deletes (kind delete) as one stream.

    Events of a content wait in its state until the watermark has passed them, so they are taken in
    the order of their times, whatever the order in which they come.
    """

    def step(key, batches, state):
        held, gone = json.loads(state.get[0]) if state.exists else ([], None)
        for b in batches:
            held += [[int(t), int(o), p] for t, o, p in zip(b.t_ms, b.o, b.path)]
        held.sort()
        now, out, done = state.getCurrentWatermarkMs(), [], 0

        def delete():
            out.append(("delete", gone[1], None, gone[0], gone[0] + window_ms))

        for t, o, path in held:
            if t > now:
                break
            done += 1
            if gone and (not o or t - gone[0] > window_ms):
                delete()
                gone = None
            if not o:
                gone = [t, path]
            elif gone:
                if gone[1] != path:
                    out.append(("rename", gone[1], path, gone[0], t))
                gone = None
        held = held[done:]
        if gone and gone[0] + window_ms <= now:
            delete()
            gone = None
        if held or gone:
            state.update((json.dumps([held, gone]),))
            due = [h[0] for h in held[:1]] + ([gone[0] + window_ms] if gone else [])
            state.setTimeoutTimestamp(max(now, min(due)) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["kind", "old_path", "new_path", "removed_ms", "at_ms"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.withWatermark("ts", late).where(departed() | (F.col("op") == "Create"))
    rows = rows.select("content", "path", "ts", F.unix_millis("ts").alias("t_ms"), F.when(departed(), 0).otherwise(1).alias("o"))
    return rows.groupBy("content").applyInPandasWithState(step, RENAMES_OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def rename_matches_stream(events: DataFrame, window_ms: int = RENAME_MS, late: str = "5 seconds") -> DataFrame:
    """rename_matches as a stream."""
    return renames_stream(events, window_ms, late).where("kind = 'rename'").select("old_path", "new_path", "removed_ms", F.col("at_ms").alias("created_ms"))


def directory_removals(events: DataFrame, directories: DataFrame) -> DataFrame:
    """Departures of directories, which are done at once; others wait for a rename."""
    d = directories.select("path").distinct().withColumn("is_dir", F.lit(True))
    return events.where(departed()).join(d, "path", "left").select("path", "t_ms", F.when(F.col("is_dir"), "delete_tree").otherwise("wait").alias("action"))


def scan_after_create(events: DataFrame, directories: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, op, t_ms) of Creates for what already lies below a directory when it is created.

    Files that land before the watch begins send no event of their own. tree: (path) of local files;
    directories: (path). Each file meets the directories above it by its ancestors, no pairs are formed.
    """
    from ..functions import paths, text

    made = events.where("op = 'Create'").join(directories.select("path").distinct(), "path", "left_semi").groupBy(F.col("path").alias("_dir")).agg(F.min("t_ms").alias("t_ms"))
    up = paths.ancestors("path")
    below = tree.where(~text.is_skipped(paths.base("path"))).select("path", F.explode(F.slice(up, F.lit(1), F.size(up) - 1)).alias("_dir"))
    return below.join(made, "_dir").groupBy("path").agg(F.min("t_ms").alias("t_ms")).select("path", F.lit("Create").alias("op"), "t_ms")


def without_echo(events: DataFrame, own_writes: DataFrame, quiet_ms: int = ECHO_MS) -> DataFrame:
    """Events without Create and Write of a path within the time after our own write. own_writes: (path, at_ms)."""
    both = events.select("path", "op", "t_ms", F.lit(1).alias("kind")).unionByName(own_writes.select("path", F.lit(None).cast("string").alias("op"), F.col("at_ms").alias("t_ms"), F.lit(0).alias("kind")))
    w = W.partitionBy("path").orderBy("t_ms", "kind").rowsBetween(W.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") == 0, F.col("t_ms"))).over(w)
    echo = F.col("op").isin("Create", "Write") & (F.col("t_ms") < F.col("last") + quiet_ms)
    return both.withColumn("last", last).where("kind = 1").where(~F.coalesce(echo, F.lit(False))).select("path", "op", "t_ms")


def changed_only(writes: DataFrame) -> DataFrame:
    """Writes (path, t_ms, content) whose content differs from the path's write before."""
    before = F.lag("content").over(W.partitionBy("path").orderBy("t_ms"))
    return writes.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("content"))).select("path", "t_ms", "content")


def event_counters(events: DataFrame, key: str = "op") -> DataFrame:
    """Running counts: the same in a batch and in a stream (complete or update mode)."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def token_bucket(requests: DataFrame, burst: int = 20, per_second: int = 12, width_ms: int = HOUR_MS) -> DataFrame:
    """requests: (key, t_ms). (key, t_ms, granted_ms): when each request gets its token, first come first served.

    With g milliseconds a token, request i of a key gets its token at the later of t_i and
    (i + 1 - burst) g + max(t_j - j g) over j up to i. The running maximum and the numbers are taken
    within stretches of time and carried over by one row a stretch, so no task holds a whole key.
    """
    gap = 1000.0 / per_second
    b = requests.select("key", "t_ms").withColumn("_b", F.floor(F.col("t_ms") / width_ms))
    w = W.partitionBy("key", "_b").orderBy("t_ms")
    rows = b.withColumn("_i", F.row_number().over(w) - 1).withColumn("_x", F.col("t_ms") - F.col("_i") * gap)
    up = W.partitionBy("key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("key", "_b").agg(F.count("*").alias("_n"), F.max("_x").alias("_m")).withColumn("_o", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    sums = sums.withColumn("_top", F.max(F.col("_m") - F.col("_o") * gap).over(up)).select(F.col("key").alias("_k"), F.col("_b").alias("_s"), "_o", "_top")
    own = rows.withColumn("_x", F.max("_x").over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = own.join(sums, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_s")))
    top = F.greatest(F.col("_x") - F.col("_o") * gap, F.col("_top"))
    granted = F.greatest(F.col("t_ms").cast("double"), top + (F.col("_o") + F.col("_i") + 1 - burst) * gap)
    return both.select("key", "t_ms", F.round(granted, 3).alias("granted_ms"))


def progress_reports(samples: DataFrame, step: int = REPORT_BYTES) -> DataFrame:
    """samples: (path, t_ms, bytes, ended). Those that pass another step of bytes, and ends."""
    w = W.partitionBy("path").orderBy("t_ms")
    before = F.floor(F.coalesce(F.lag("bytes").over(w), F.lit(0)) / step)
    return samples.withColumn("_due", F.col("ended") | (F.floor(F.col("bytes") / step) > before)).where("_due").drop("_due")


def lifecycle(events: DataFrame) -> DataFrame:
    """events: (path, t_ms, state). The last state of each path, with the first time it was queued."""
    return events.groupBy("path").agg(F.max_by("state", "t_ms").alias("state"), F.min("t_ms").alias("started_ms"), F.count("*").alias("steps"))


ENDS = ("complete", "failed", "cancelled")
#: From each state, the states that may follow it; what has ended may begin again.
FOLLOWS = {"queued": ("preparing", "failed", "cancelled"), "preparing": ("uploading", "failed", "cancelled"), "uploading": ENDS}
BEGINS = ("queued", "preparing")


def upload_runs(events: DataFrame) -> DataFrame:
    """(path, run, state, started_ms, steps, valid): one row for each upload of a path.

    events: (path, t_ms, state). A run begins behind an end, or with a path's first event; an upload
    that was queued takes its queue entry's start over. valid: if every step was allowed.
    """
    w = W.partitionBy("path").orderBy("t_ms", "state")
    before = F.lag("state").over(w)
    new = before.isNull() | before.isin(*ENDS)
    ok = F.when(new, F.col("state").isin(*BEGINS))
    for state, following in FOLLOWS.items():
        ok = ok.when(before == state, F.col("state").isin(*following))
    s = events.withColumn("ok", ok.otherwise(False)).withColumn("new", new.cast("long"))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("path", "run").agg(F.max_by("state", F.struct("t_ms", "state")).alias("state"), F.min("t_ms").alias("started_ms"), F.count("*").alias("steps"), F.bool_and("ok").alias("valid"))


LIFECYCLE_OUT = "path string, state string, started timestamp, steps long"


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: one row for each path that has ended. events: (path, ts, state)."""

    def step(key, batches, state):
        started, n, last = state.get if state.exists else (None, 0, None)
        for b in batches:
            b = b.sort_values("ts")
            first = b.ts.iloc[0]
            started = first if started is None else min(started, first)
            n, last = n + len(b), b.state.iloc[-1]
        if last in ENDS:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "state": [last], "started": [started], "steps": [n]})
        else:
            state.update((started, n, last))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("path").applyInPandasWithState(step, LIFECYCLE_OUT, "started timestamp, n long, last string", "append", GroupStateTimeout.NoTimeout)


def ring(log: DataFrame, capacity: int = 1000, order: str = "id") -> DataFrame:
    """What a ring of so many entries holds, oldest first."""
    return log.orderBy(F.desc(order)).limit(capacity).orderBy(order)


def to_subscriber(stream: DataFrame, sink, queue: int = 64):
    """Starts a broadcast: each batch's newest ``queue`` rows go to sink(list of rows), older ones are dropped."""

    def send(df: DataFrame, _: int) -> None:
        sink(df.orderBy(F.desc("time")).limit(queue).collect()[::-1])

    return stream.writeStream.foreachBatch(send).start()


def backup_times(changes: DataFrame, uploads: DataFrame | None = None, quiet_ms: int = BACKUP_MS) -> DataFrame:
    """(fires_ms): when the catalog is backed up: after changes (t_ms) have been quiet, and no earlier
    than the end of an upload (from_ms, to_ms) that is running then."""
    times = changes.select("t_ms").distinct()
    gaps = with_previous(times, "t_ms", ["t_ms"], DAY_MS).where(F.col("t_ms") - F.col("before.t_ms") > quiet_ms).select((F.col("before.t_ms") + quiet_ms).alias("fires_ms"))
    fires = gaps.unionByName(times.agg((F.max("t_ms") + quiet_ms).alias("fires_ms")).where("fires_ms is not null"))
    if uploads is None:
        return fires
    both = fires.select("fires_ms", F.lit(None).cast("long").alias("to_ms"), F.col("fires_ms").alias("at")).unionByName(uploads.select(F.lit(None).cast("long").alias("fires_ms"), "to_ms", F.col("from_ms").alias("at")))
    known = with_running_max(both, "at", F.col("fires_ms").isNotNull(), "to_ms", DAY_MS, "busy")
    return known.where("fires_ms is not null").select(F.greatest("fires_ms", "busy").alias("fires_ms"))


def trigger_times(runs: DataFrame, nudges: DataFrame) -> DataFrame:
    """(run, job, at_ms) of the periodic jobs of each run (run, from_ms, to_ms) of the daemon.

    sync: every minute. retry: every hour. gc: a minute after the start, two minutes behind each
    nudge (run, t_ms), and a day behind the gc before where nothing nudged.
    """
    every = lambda job, ms: runs.select("run", F.lit(job).alias("job"), F.explode(F.when(F.col("from_ms") + ms <= F.col("to_ms"), F.sequence(F.col("from_ms") + ms, "to_ms", F.lit(ms).cast("long")))).alias("at_ms"))
    first = runs.select("run", (F.col("from_ms") + FIRST_GC_MS).alias("at_ms"), "to_ms")
    called = nudges.join(runs, "run").where(F.col("t_ms") >= F.col("from_ms") + FIRST_GC_MS).select("run", (F.col("t_ms") + NUDGE_MS).alias("at_ms"), "to_ms")
    known = first.unionByName(called).distinct().where("at_ms <= to_ms")
    until = F.coalesce(F.lead("at_ms").over(W.partitionBy("run").orderBy("at_ms")) - 1, F.col("to_ms"))
    gc = known.withColumn("until", until).select("run", F.lit("gc").alias("job"), F.explode(F.sequence("at_ms", "until", F.lit(DAY_MS).cast("long"))).alias("at_ms"))
    return every("sync", SYNC_MS).unionByName(every("retry", HOUR_MS)).unionByName(gc)
