"""Every registered core query against its SQL twin on the smallest tables."""

import pytest

from aerolith import plans
from conftest import rows

Q, S = plans.registered()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, sf, duck):
    got = Q[name](spark, sf).toPandas()
    if name in S:
        want = duck.sql(S[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
