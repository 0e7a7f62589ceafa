import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratapool.operators import content as co
from stratapool.operators import placement as pl
from stratapool.sources.schema import TABLES

GIB, MIB = pl.GIB, pl.MIB


def providers(spark, *free):
    return spark.createDataFrame([(f"p{i}", "t", f"n{i}", f"r{i}", "", 1, f, 1, None) for i, f in enumerate(free)], TABLES["providers"])


def plan(spark, *cases):
    """(tiers, number of chunks) for each (size, spaces)."""
    out = []
    for size, spaces in cases:
        r = spark.createDataFrame([(size,)], "size long").select(pl.plan_chunks("size", list(spaces)).alias("t"), "size").select("t", pl.estimate_chunks("t", "size").alias("n")).first()
        out.append(([tuple(x) for x in r.t], r.n))
    return out


def test_plan_examples(spark):
    a, b, c, d, e, f, g, h = plan(spark, (100 * MIB, [GIB]), (8 * GIB, [20 * GIB]), (5 * GIB, [3 * GIB, 3 * GIB]), (10 * GIB, [6 * GIB, 3 * GIB, 2 * GIB]), (20 * GIB, [50 * GIB, 30 * GIB]), (MIB, [0, 10]), (0, [5]), (5, []))
    assert a == ([(0, 100 * MIB)], 1) and b == ([(0, 4 * GIB)], 2) and c[1] == 2 and 3 <= d[1] <= 4 and e == ([(0, 4 * GIB)], 5)
    assert max(s for _, s in f[0]) == 32 * MIB and g[0] == h[0] == [(0, 32 * MIB)]


def brute_plan(size, spaces):
    usable = sorted((s for s in spaces if s > 0), reverse=True)
    if size <= 0 or not usable:
        return [(0, 32 * MIB)]
    if usable[0] >= size:
        return [(0, min(size, 4 * GIB))]
    tiers = []
    while size > 0:
        k = usable.index(max(usable))
        take = min(usable[k], 4 * GIB, size)
        if take <= 0:
            tiers.append((0, 32 * MIB))
            break
        tiers.append((1, take))
        usable[k], size = usable[k] - take, size - take
    return [(0, tiers[0][1])] if len({t for _, t in tiers}) == 1 else tiers


def test_plans_against_a_plain_loop_cover_the_file(spark):
    rng = random.Random(6)
    cases = [(rng.randint(1, 1 << 36), [rng.randint(-5, 1 << 34) for _ in range(rng.randint(0, 6))]) for _ in range(12)]
    for (size, spaces), (tiers, n) in zip(cases, plan(spark, *cases)):
        assert tiers == brute_plan(size, spaces)
        flat = [s for k, s in tiers for _ in range(k)] + [tiers[-1][1]] * n
        left, used = size, 0
        while left > 0:
            left, used = left - flat[used], used + 1
        assert used == n
    row = spark.createDataFrame([([(1, 10), (2, 7), (0, 3)],)], "t array<struct<count: long, size: long>>")
    assert [row.select(pl.size_for_seq("t", F.lit(k)).alias("s")).first().s for k in range(6)] == [10, 7, 7, 3, 3, 3]


def test_weighted_draws(spark):
    p = providers(spark, 10_000_000_000, 90_000_000_000)
    rng = random.Random(1)
    draws = spark.createDataFrame([(i, rng.random()) for i in range(10_000)], "id int, uniform double")
    got = pl.assign_chunk_pfrd(draws, p, 0, 1).groupBy("provider_id").count().collect()
    share = {r.provider_id: r["count"] / 10_000 for r in got}
    assert 0.87 < share["p1"] < 0.93
    assert pl.assign_chunk_pfrd(draws, p, 0, 1 << 60).where("provider_id is not null").count() == 0


def test_limits_and_shards(spark):
    p = providers(spark, 5, None, 100, 100)
    assert [r.id for r in pl.eligible(p, 0, 100).collect()] == ["p2", "p3"] and {r.id for r in pl.eligible_free_spaces(p, 0, 5).collect()} == {"p2", "p3"}
    assert [r.provider_id for r in pl.assign_shards_mfs(p, 0, 5, 1).collect()] == ["p2", "p3", "p0", "p0", "p2"]
    req = spark.createDataFrame([(1, 5, [0.0, 0.99, 0.5, 0.1, 0.1])], "id int, n int, uniforms array<double>")
    got = [r.provider_id for r in pl.assign_shards_pfrd(req, p, 0, 1).orderBy("shard_index").collect()]
    assert sorted(got[:3]) == ["p0", "p2", "p3"] and got[3:] == ["p0", "p2"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 6), st.integers(1, 4), st.randoms())
def test_erasure_survives_any_losses(content, data, parity, rng):
    shards = co.encode(content, data, parity)
    lost = set(rng.sample(range(data + parity), parity))
    back = co.reconstruct([None if i in lost else s for i, s in enumerate(shards)], data, parity)
    assert back == shards and co.joined(back, data, len(content)) == content and co.verify(back, data, parity)


def test_erasure_refuses():
    import pytest

    with pytest.raises(ValueError):
        co.reconstruct([None, None, b"x"], 2, 1)
    with pytest.raises(ValueError):
        co.encode(b"x", 0, 1)
    assert co.encode(b"", 2, 1) == [b"", b"", b""]
