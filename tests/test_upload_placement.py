import random

from stratapool.operators import placement as pl
from stratapool.plans import queries as plans

from .test_placement import providers


def brute_place(size, free, chunk, min_free=0):
    left, out = [f for _, f in free], []
    while size > 0:
        n = min(chunk, size)
        fit = [i for i, f in enumerate(left) if f >= max(n, min_free)]
        best = max(fit, key=lambda i: (left[i], -i)) if fit else None
        if fit:
            left[best] -= n
        out.append((len(out), n, None if best is None else free[best][0]))
        size -= n
    return out


def test_placement_and_credits_against_brute_force(spark):
    rng = random.Random(4)
    space = [rng.choice([0, 30, 30, 55, 80, 200]) for _ in range(9)]
    files = [(f"f{i}", rng.randint(0, 400)) for i in range(80)]
    df = spark.createDataFrame(files, "id string, size_bytes long")
    failed = spark.createDataFrame([(f"f{i}",) for i in range(0, 80, 3)], "id string")
    for min_free in (0, 25):
        free = [(f"p{i}", f) for i, f in enumerate(space) if f >= min_free]
        want = [(i, *r) for i, s in files for r in brute_place(s, free, 20, min_free)]
        plan = pl.upload_placement(df, providers(spark, *space), 0, 20, min_free)
        assert sorted(map(tuple, plan.collect()), key=str) == sorted(want, key=str) and any(r[3] is None for r in want)
        credits = {}
        for i, _, n, p in want:
            if p is not None and int(i[1:]) % 3 == 0:
                credits[p] = credits.get(p, 0) + n
        assert dict(map(tuple, pl.rollback_credits(plan, failed).collect())) == credits


def test_registered_queries_plan_every_file(spark, sf_dir):
    files = {r.id for r in plans.queries()["plan_chunks"](spark, sf_dir).select("id").collect()}
    for name in ("upload_placement", "assign_shards_pfrd"):
        assert {r.id for r in plans.queries()[name](spark, sf_dir).select("id").distinct().collect()} == files


def test_queue_of_uploads_reserves_space(spark):
    rng = random.Random(5)
    space = [90, 70, 70, 15]
    files = [(f"f{i:02}", rng.randint(0, 60), i) for i in range(20)]
    df = spark.createDataFrame(files, "id string, size_bytes long, created_at long").repartition(3)
    left, want = list(space), []
    for i, size, _ in files:
        before, rows = list(left), []
        while size > 0:
            n = min(20, size)
            k = max(range(len(left)), key=lambda j: (left[j], -j))
            rows.append((i, len(rows), n, f"p{k}" if left[k] >= n else None))
            if rows[-1][3]:
                left[k] -= n
            size -= n
        if any(p is None for *_, p in rows):
            left, rows = before, [(*r[:3], None) for r in rows]
        want += rows
    got = [tuple(r) for r in pl.reserve_uploads(df, providers(spark, *space), 0, 20).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[3] is None for r in want) and any(r[3] for r in want)
    shards = spark.createDataFrame([("a", 0, "p", 5, True), ("a", 1, "q", 5, False), ("b", 0, "p", 9, True)], "id string, shard_index int, provider_id string, size long, uploaded boolean")
    assert {tuple(r) for r in pl.shard_credits(shards, spark.createDataFrame([("a",)], "id string")).collect()} == {("p", 5, True), ("q", 5, False)}
