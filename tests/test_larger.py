"""Queries on more rows or odder ones than sf0.001 has."""

import random
import time

from stratapool.operators import analytics as an
from stratapool.operators import placement as pl
from stratapool.plans import queries as plans

from .oracle import compare, connect
from .test_placement import providers


def test_browse_items_against_sql(spark):
    sf = "/root/testdata/sf0.01"  # has a file in a directory of another case, which sf0.001 hasn't
    assert compare(plans.queries()["browse_items"](spark, sf), connect(sf), plans.SQL["browse_items"]) is None


def test_browse_items_looks_sizes_up_by_exact_path(spark):
    files = [("/a/x", 1, "complete"), ("/A/y", 2, "complete"), ("/A/z", 3, "complete"), ("/a/z", 4, "pending"), ("/a/d/w", 5, "complete"), ("/ab", 6, "complete")]
    f = spark.createDataFrame(files, "virtual_path string, size_bytes long, upload_state string")
    d = spark.createDataFrame([], "path string")
    want = {("file", "x", 1), ("file", "y", None), ("file", "z", 4), ("dir", "d", None)}
    for root in ("/a", "/a/"):
        assert {tuple(r) for r in an.browse_items(f, d, root).collect()} == want
    assert {tuple(r) for r in an.browse_items(f, d, "/").collect()} == {("file", "ab", 6), ("dir", "a", None), ("dir", "A", None)}


def test_queue_takes_and_gives_back_as_plain_loops():
    rng = random.Random(8)
    for case in range(300):
        chunk, min_free = rng.choice([5, 20]), rng.choice([0, 0, 3, 30])
        left = [rng.randint(min_free, rng.choice([30, 120])) for _ in range(rng.randint(0, 6))]
        queue = pl.Queue(chunk, min_free)
        for k, f in enumerate(left):
            queue.add(k, f)
        for _ in range(60):
            size, now, want = rng.randint(1, rng.choice([8, 60, 400])), list(left), []
            for at in range(0, size, chunk):
                n = min(chunk, size - at)
                k = max(range(len(now)), key=lambda j: (now[j], -j), default=None)
                if k is None or now[k] < max(n, min_free):
                    want = None
                    break
                now[k] -= n
                want.append(k)
            left = left if want is None else now
            assert queue.place(size) == want and queue.free == left and len(queue.heap) <= 2 * len(left) + 64
            assert queue.slots == sum(map(queue.held, left))


def test_reserve_uploads_of_many_providers(spark):
    """Each row of the queue used to carry all providers, and the join that brought them lost the queue's order."""
    n = 20_000
    files = spark.range(4 * n).selectExpr("concat('f', lpad(id, 6, '0')) AS id", "3 + id % 8 AS size_bytes", "-id AS created_at")
    many = providers(spark, 10).drop("id", "display_name", "quota_free_bytes").crossJoin(spark.range(n).selectExpr("concat('p', id) AS id", "lpad(id, 6, '0') AS display_name", "10L AS quota_free_bytes"))
    start = time.monotonic()
    got = pl.reserve_uploads(files, many, 0, 10).collect()
    assert time.monotonic() - start < 60
    assert len(got) == 4 * n and all(r.sequence == 0 and r.size == 3 + int(r.id[1:]) % 8 for r in got)
    placed = {r.id: r.provider_id for r in got if r.provider_id is not None}
    assert [placed[f"f{4 * n - 1 - i:06}"] for i in range(n)] == [f"p{i}" for i in range(n)]  # in order of created_at, ties by name
    spaces = {}
    for r in got:
        if r.provider_id is not None:
            spaces[r.provider_id] = spaces.get(r.provider_id, 0) + r.size
    assert max(spaces.values()) <= 10
