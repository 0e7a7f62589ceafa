import __spark_entry__ as e


def test_registry():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
    if e.llm is not None:
        assert "pipeline" in q and {int(n[2:].split("_")[0]) for n in q if n.startswith("op")} == set(range(1, 11))


def test_entry(spark):
    assert e.entry(spark).count() > 0
