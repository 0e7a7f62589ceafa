"""Where new bytes go: eligible providers, choice by most free space or by weighted draw, chunk plans.

Randomness is always passed in as a column of numbers from 0 up to 1. Providers are few (one row an
account): what all rows need of them is one row of arrays that is joined to each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIB, GIB = 1 << 20, 1 << 30
DEFAULT_CHUNK, MAX_CHUNK = 32 * MIB, 4 * GIB
CHUNKS_AIM = 25
BUDGET, MIN_WORKERS, MAX_WORKERS = 6 * GIB, 2, 12
TIERS = "array<struct<count: bigint, size: bigint>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows, each with the columns of the only row of one."""
    return rows.join(F.broadcast(one), on=F.lit(True), how="left")


def _open(now: int) -> Column:
    return ~(F.coalesce("rate_limited_until", F.lit(0)) > now) & F.col("quota_free_bytes").isNotNull()


def eligible(providers: DataFrame, now: int, size: int, min_free: int = 0) -> DataFrame:
    return providers.where(_open(now) & (F.col("quota_free_bytes") >= max(size, min_free))).orderBy("display_name")


def eligible_free_spaces(providers: DataFrame, now: int, min_free: int = 0) -> DataFrame:
    """Strictly above min_free, whatever the size."""
    return providers.where(_open(now) & (F.col("quota_free_bytes") > min_free)).select("id", "display_name", F.col("quota_free_bytes").alias("free"))


def total_free_space(providers: DataFrame, now: int, min_free: int = 0) -> DataFrame:
    return eligible_free_spaces(providers, now, min_free).agg(F.coalesce(F.sum("free"), F.lit(0)).alias("free"))


def check_space(sizes: DataFrame, providers: DataFrame, now: int, min_free: int = 0) -> DataFrame:
    """sizes: (size). If all that is free holds it."""
    total = total_free_space(providers, now, min_free).withColumnRenamed("free", "_free")
    return _with_row(sizes, total).withColumn("fits", F.col("size") <= F.col("_free")).drop("_free")


def assign_chunk_mfs(sizes: DataFrame, providers: DataFrame, now: int, min_free: int = 0) -> DataFrame:
    """sizes: (size). The provider of the most free space for each size; of equal ones the first by name.

    The best provider is the best for every size that it holds, so one row is enough.
    """
    best = providers.where(_open(now)).agg(F.min_by(F.struct("id", "quota_free_bytes"), F.struct(-F.col("quota_free_bytes"), F.col("display_name"))).alias("_best"))
    fits = F.col("_best.quota_free_bytes") >= F.greatest(F.col("size"), F.lit(min_free))
    return _with_row(sizes, best).withColumn("provider_id", F.when(fits, F.col("_best.id"))).drop("_best")


def weighted(providers: DataFrame) -> DataFrame:
    """providers' id with the interval [low, high) of their free space, in order of names, and the total.

    One row a provider, so a window over all of them is small.
    """
    w = W.partitionBy(F.lit(0)).orderBy("display_name", "id")
    up = F.sum("quota_free_bytes").over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("quota_free_bytes").over(W.partitionBy(F.lit(0)))
    return providers.select("id", (up - F.col("quota_free_bytes")).alias("low"), up.alias("high"), total.alias("total"), F.row_number().over(w).alias("rank"))


def _spans(providers: DataFrame, now: int, size: int, min_free: int) -> DataFrame:
    """One row: the eligible providers in order of names as arrays (_low, _high, _ids), and their _total."""
    every = weighted(eligible(providers, now, size, min_free)).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high", "id"))).alias("s"), F.max("total").alias("_total"))
    return every.select(F.col("s.low").alias("_low"), F.col("s.high").alias("_high"), F.col("s.id").alias("_ids"), "_total")


def _place(x: Column) -> Column:
    """The index of the first span whose end is above x: a binary search in 32 steps at most."""

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get("_high", mid) > x
        return F.struct(F.when(below, s["lo"]).otherwise(F.least(mid + 1, s["hi"])).alias("lo"), F.when(below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_high") + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (F.size("_high") - 1).alias("hi")), step, lambda s: s["hi"])


def _draw(uniform: Column, taken: Column | None = None) -> Column:
    """The index of a weighted draw, none of the indexes in taken: their spans are stepped over."""
    if taken is None:
        return F.when(F.col("_total") <= 0, F.lit(0)).otherwise(_place(F.floor(uniform * F.col("_total")).cast("long")))
    order = F.array_sort(taken)
    width = lambda i: F.get("_high", i) - F.get("_low", i)
    total = F.aggregate(order, F.col("_total"), lambda t, i: t - width(i))
    x = F.aggregate(order, F.floor(uniform * total).cast("long"), lambda r, i: F.when(r >= F.get("_low", i), r + width(i)).otherwise(r))
    first = F.aggregate(order, F.lit(0), lambda k, i: F.when(i == k, k + 1).otherwise(k))  # the first that isn't taken
    return F.when(total <= 0, first).otherwise(_place(x))


def assign_chunk_pfrd(draws: DataFrame, providers: DataFrame, now: int, size: int, min_free: int = 0) -> DataFrame:
    """draws: (id, uniform). A provider for each, with odds in proportion to free space; null without any.

    The spans are one sorted array, so a draw costs a binary search in it, and no join.
    """
    both = _with_row(draws.select("id", "uniform"), _spans(providers, now, size, min_free))
    return both.select("id", F.when(F.size("_ids") > 0, F.get("_ids", _draw(F.col("uniform")))).alias("provider_id"))


def assign_chunk(requests: DataFrame, providers: DataFrame, now: int, size: int, min_free: int = 0, policy: str = "") -> DataFrame:
    """requests: (id, uniform). (id, provider_id) by the policy: mfs, or weighted draws by default."""
    if policy == "mfs":
        return assign_chunk_mfs(requests.select("id", F.lit(size).cast("long").alias("size")), providers, now, min_free).select("id", "provider_id")
    return assign_chunk_pfrd(requests, providers, now, size, min_free)


def assign_shards_mfs(providers: DataFrame, now: int, n: int, size: int, min_free: int = 0) -> DataFrame:
    """(shard_index, provider_id): distinct providers by free space first, then round by name."""
    c = eligible(providers, now, size, min_free)
    every = W.partitionBy(F.lit(0))
    ranked = c.select("id", F.row_number().over(every.orderBy(F.desc("quota_free_bytes"), "display_name")).alias("by_free"), F.row_number().over(every.orderBy("display_name")).alias("by_name"), F.count("*").over(every).alias("m"))
    first = ranked.where(F.col("by_free") <= n).select((F.col("by_free") - 1).alias("shard_index"), F.col("id").alias("provider_id"))
    more = F.sequence(F.lit(0), F.lit(n - 1))
    later = ranked.where(F.col("m") < n).select("id", "m", "by_name", F.explode(more).alias("i")).where((F.col("i") < F.lit(n) - F.col("m")) & (F.col("i") % F.col("m") == F.col("by_name") - 1))
    return first.unionByName(later.select((F.col("m") + F.col("i")).cast("int").alias("shard_index"), F.col("id").alias("provider_id"))).orderBy("shard_index")


def assign_shards_pfrd(requests: DataFrame, providers: DataFrame, now: int, size: int, min_free: int = 0) -> DataFrame:
    """requests: (id, n, uniforms). (id, shard_index, provider_id): distinct weighted draws first, then round by name."""
    both = _with_row(requests.select("id", F.col("n").cast("int").alias("n"), "uniforms"), _spans(providers, now, size, min_free)).where("n > 0 and size(_ids) > 0")
    m = F.size("_ids")
    drawn = F.aggregate(F.sequence(F.lit(0), F.least("n", m) - 1), F.array().cast("array<int>"), lambda taken, k: F.concat(taken, F.array(_draw(F.get("uniforms", k), taken))))
    round_ = F.when(F.col("n") > m, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - m, F.lit(1)) - 1), lambda i: i % m)).otherwise(F.array().cast("array<int>"))
    at = both.select("id", "_ids", F.posexplode(F.concat(drawn, round_)).alias("shard_index", "_at"))
    return at.select("id", "shard_index", F.get("_ids", F.col("_at")).alias("provider_id"))


def chunk_size_for_file(size: Column | str) -> Column:
    s = _col(size)
    aim = F.floor(s / CHUNKS_AIM).cast("long")
    return F.when(s <= 0, F.lit(DEFAULT_CHUNK)).otherwise(F.least(F.greatest(aim, F.lit(DEFAULT_CHUNK)), F.lit(MAX_CHUNK))).cast("long")


def upload_workers(max_chunk: Column | str) -> Column:
    c = _col(max_chunk)
    return F.when(c <= 0, F.lit(MAX_WORKERS)).otherwise(F.least(F.greatest(F.floor(F.lit(BUDGET) / c).cast("int"), F.lit(MIN_WORKERS)), F.lit(MAX_WORKERS))).cast("int")


def _tier(count: int, size: Column | int) -> Column:
    s = F.lit(size) if isinstance(size, int) else size
    return F.struct(F.lit(count).cast("long").alias("count"), s.cast("long").alias("size"))


def default_schedule() -> Column:
    """Chunks of the default size without end."""
    return F.array(_tier(0, DEFAULT_CHUNK)).cast(TIERS)


def plan_chunks(size: Column | str, spaces: list[int]) -> Column:
    """Tiers (count, size) for a file; count 0 means: for all that is left.

    A file that the largest space holds is cut as little as possible. Else each chunk is as much as
    the largest space that is left takes, until the file is covered or no space is left.
    """
    size = _col(size).cast("long")
    usable = sorted((s for s in spaces if s > 0), reverse=True)
    if not usable:
        return default_schedule()

    def step(s: Column, _: Column) -> Column:
        top = F.array_max(s["space"])
        at, take = F.array_position(s["space"], top), F.least(top, F.lit(MAX_CHUNK).cast("long"), s["left"])
        less = F.transform(s["space"], lambda x, i: F.when(i + 1 == at, x - take).otherwise(x))
        on = F.struct((s["left"] - take).alias("left"), less.alias("space"), F.concat(s["tiers"], F.array(_tier(1, take))).alias("tiers"))
        out = F.struct(F.lit(0).cast("long").alias("left"), s["space"].alias("space"), F.concat(s["tiers"], default_schedule()).alias("tiers"))
        return F.when(s["left"] <= 0, s).when(take <= 0, out).otherwise(on)

    steps = F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(size, F.lit(0)) / MAX_CHUNK).cast("long") + len(usable))
    zero = F.struct(size.alias("left"), F.array(*[F.lit(s).cast("long") for s in usable]).alias("space"), F.array().cast(TIERS).alias("tiers"))
    tiers = F.aggregate(steps, zero, step, lambda s: s["tiers"])
    even = F.size(F.array_distinct(F.transform(tiers, lambda t: t["size"]))) == 1
    cut = F.when(even, F.array(_tier(0, F.get(tiers, F.lit(0))["size"]))).otherwise(tiers)
    whole = F.array(_tier(0, F.least(size, F.lit(MAX_CHUNK).cast("long"))))
    return F.when(size <= 0, default_schedule()).when(size <= usable[0], whole).otherwise(cut)


def chunk_schedule(size: Column | str, spaces: list[int], override: int = 0) -> Column:
    """A fixed size if one is set; the default where no space is known; else the plan."""
    if override > 0:
        return F.array(_tier(0, override)).cast(TIERS)
    return plan_chunks(size, spaces) if spaces else default_schedule()


def size_for_seq(tiers: Column | str, seq: Column | str) -> Column:
    """The size of chunk number seq; behind the last tier, that tier's size."""
    t, n = _col(tiers), _col(seq).cast("long")
    found = F.aggregate(
        t,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("size")),
        lambda s, x: F.struct((s["at"] + x["count"]).alias("at"), F.coalesce(s["size"], F.when((x["count"] == 0) | (n < s["at"] + x["count"]), x["size"])).alias("size")),
        lambda s: s["size"],
    )
    return F.coalesce(found, F.element_at(t, -1)["size"], F.lit(DEFAULT_CHUNK).cast("long"))


def estimate_chunks(tiers: Column | str, size: Column | str) -> Column:
    """How many chunks the tiers make of a file."""
    t, size = _col(tiers), _col(size).cast("long")

    def step(s: Column, x: Column) -> Column:
        k = F.ceil(s["left"] / x["size"]).cast("long")
        k = F.when(x["count"] > 0, F.least(k, x["count"])).otherwise(k)
        k = F.when(s["left"] > 0, k).otherwise(F.lit(0).cast("long"))
        return F.struct((s["n"] + k).alias("n"), (s["left"] - k * x["size"]).alias("left"))

    more = F.concat(t, F.array(_tier(0, F.element_at(t, -1)["size"])))
    return F.aggregate(more, F.struct(F.lit(0).cast("long").alias("n"), size.alias("left")), step, lambda s: s["n"])


def plan_for_files(files: DataFrame, spaces: list[int], override: int = 0) -> DataFrame:
    """(id, size_bytes, tiers, max_chunk, n_chunks) of each file, each as if it came alone."""
    f = files.select("id", "size_bytes", chunk_schedule("size_bytes", spaces, override).alias("tiers"))
    return f.select("id", "size_bytes", "tiers", F.array_max(F.transform("tiers", lambda t: t["size"])).alias("max_chunk"), estimate_chunks("tiers", "size_bytes").alias("n_chunks"))


def upload_placement(files: DataFrame, providers: DataFrame, now: int, chunk: int, min_free: int = 0) -> DataFrame:
    """(id, sequence, size, provider_id): a plan for each file, as if it came alone, each chunk on the
    provider with the most free space after the chunks before. No provider fits: null.

    Every file sees the same spaces, so chunk number j always goes to the same provider: the j-th of all
    values free - k * chunk that still hold a chunk, from the largest down, of equal ones by name. Behind
    these, only a last, smaller chunk can fit: in the largest rest.
    """
    least = max(chunk, min_free)
    free = eligible(providers, now, 0, min_free).select("id", "quota_free_bytes", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("display_name", "id")).alias("rank"))
    fits = F.greatest(F.floor((F.col("quota_free_bytes") - least) / chunk) + 1, F.lit(0)).cast("long")
    held = free.withColumn("k", fits)
    each = held.where("k > 0").select("id", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"), "quota_free_bytes")
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.col("quota_free_bytes") - F.col("i") * chunk), "rank")
    picks = each.select((F.row_number().over(order) - 1).cast("long").alias("sequence"), F.col("id").alias("_full"))
    rest = held.withColumn("rest", F.col("quota_free_bytes") - F.col("k") * chunk).agg(F.min_by(F.struct("id", "rest"), F.struct(-F.col("rest"), F.col("rank"))).alias("_rest"))
    n = F.ceil(F.col("size_bytes") / chunk).cast("long")
    parts = files.where("size_bytes > 0").select("id", "size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("sequence"))
    parts = parts.select("id", "sequence", F.least(F.lit(chunk).cast("long"), F.col("size_bytes") - F.col("sequence") * chunk).alias("size"))
    last = F.when(F.col("_rest.rest") >= F.greatest(F.col("size"), F.lit(min_free)), F.col("_rest.id"))
    return _with_row(parts.join(picks, "sequence", "left"), rest).select("id", "sequence", "size", F.coalesce("_full", last).alias("provider_id"))


class Queue:
    """Free space of providers, one number each. A file fits if its whole chunks are no more than the slots, of a
    chunk each, that are left, and its last part fits behind them: most files after the last slot need no look.
    The heap may name a provider with a space that it no longer has; such entries are passed over."""

    def __init__(self, chunk: int, min_free: int):
        self.chunk, self.min_free, self.slots = chunk, min_free, 0
        self.names: list[str] = []
        self.free: list[int] = []
        self.heap: list[tuple[int, int]] = []

    def held(self, free: int) -> int:
        return max(0, (free - max(self.chunk, self.min_free)) // self.chunk + 1)

    def add(self, provider: str, free: int) -> None:
        heapq.heappush(self.heap, (-free, len(self.free)))
        self.names.append(provider)
        self.free.append(free)
        self.slots += self.held(free)

    def place(self, size: int) -> list[str] | None:
        """The provider of each chunk, which takes its space; None, and nothing taken, if one doesn't fit."""
        whole, last = divmod(size, self.chunk)
        if whole > self.slots or not self.heap:
            return None
        heap, free, slots, taken = self.heap, self.free, self.slots, []
        for n in [self.chunk] * whole + [last] * (last > 0):
            while free[heap[0][1]] != -heap[0][0]:
                heapq.heappop(heap)
            k = heap[0][1]
            left = free[k] - n
            if free[k] < max(n, self.min_free):
                for j, before in dict(reversed(taken)).items():
                    free[j] = before
                    heapq.heappush(heap, (-before, j))
                if len(heap) > 2 * len(free) + 64:
                    self.heap = [(-f, j) for j, f in enumerate(free)]
                    heapq.heapify(self.heap)
                self.slots = slots
                return None
            self.slots += self.held(left) - self.held(free[k])
            taken.append((k, free[k]))
            free[k] = left
            heapq.heapreplace(heap, (-left, k))
        return [self.names[k] for k, _ in taken]


def reserve_uploads(files: DataFrame, providers: DataFrame, now: int, chunk: int, min_free: int = 0) -> DataFrame:
    """(id, sequence, size, provider_id) of a queue of uploads, where each chunk takes its space at once, so
    later files see what is left. A file of which a chunk doesn't fit gives all its space back: null.

    Files come by (created_at, id). Each choice depends on all before it, as uploads do that run one at
    a time: one task streams the queue in order, behind the providers by name, and holds one number a provider.
    Only ids and sizes go through it; the chunks' rows are made behind it, in parallel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Queue(chunk, min_free)
        for b in batches:
            own = b.filter(b.column(2).is_valid())
            for provider, free in zip(own.column(2).to_pylist(), own.column(1).to_pylist()):
                queue.add(provider, free)
            b = b.filter(pc.and_(b.column(2).is_null(), pc.greater(b.column(1), 0)))
            size = b.column(1).to_numpy()
            plans: list[list[str] | None] = [None] * len(size)
            for i in np.flatnonzero(size // chunk <= queue.slots).tolist():  # slots never grow
                plans[i] = queue.place(int(size[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(-(-size // chunk)), pa.array(plans, pa.list_(pa.string()))], ["id", "size_bytes", "n", "plan"])

    kind = files.schema["id"].dataType.simpleString()
    spaces = eligible(providers, now, 0, min_free).select(F.lit(None).cast(kind).alias("id"), F.col("quota_free_bytes").cast("long").alias("n"), F.col("id").cast("string").alias("provider"), "display_name", F.lit(None).cast(files.schema["created_at"].dataType).alias("created_at"))
    uploads = files.select("id", F.col("size_bytes").cast("long").alias("n"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("display_name"), "created_at")
    order = (F.col("provider").isNull(), "display_name", "provider", "created_at", "id")
    queue = spaces.unionByName(uploads).repartition(1).sortWithinPartitions(*order).select("id", "n", "provider")
    placed = queue.mapInArrow(run, f"id {kind}, size_bytes long, n long, plan array<string>").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    each = placed.select("id", "size_bytes", F.posexplode(F.coalesce("plan", F.array_repeat(F.lit(None).cast("string"), F.col("n").cast("int")))).alias("sequence", "provider_id"))
    return each.select("id", F.col("sequence").cast("long").alias("sequence"), F.least(F.lit(chunk).cast("long"), F.col("size_bytes") - F.col("sequence").cast("long") * chunk).alias("size"), "provider_id")


def rollback_credits(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """(provider_id, bytes) to give back for the files in failed (id)."""
    return plan.where("provider_id is not null").join(failed.select("id"), "id", "left_semi").groupBy("provider_id").agg(F.sum("size").alias("bytes"))


def shard_credits(shards: DataFrame, failed: DataFrame) -> DataFrame:
    """(provider_id, bytes, uploaded): space to give back after failed uploads, shard by shard: of shards
    that were reserved and not sent, and of those sent, whose objects are to be deleted as well.
    shards: (id, shard_index, provider_id, size, uploaded); failed: (id)."""
    own = shards.where("provider_id is not null").join(failed.select("id"), "id", "left_semi")
    return own.groupBy("provider_id", "uploaded").agg(F.sum("size").alias("bytes")).select("provider_id", "bytes", "uploaded")
