import pytest

from stratapool.plans import queries as plans

from .oracle import compare, connect

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.BUILD))
def test_query(spark, sf_dir, con, name):
    df = plans.queries()[name](spark, sf_dir)
    if name in plans.SQL:
        assert compare(df, con, plans.SQL[name]) is None
        assert con.execute(plans.SQL[name]).fetchone() is not None
    else:
        assert df.count() > 0
