"""Every registered query of the subpackage against its SQL twin on the smallest tables."""

import pytest

from aerolith.llm import entries
from conftest import rows


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_query(name, spark, sf, duck):
    got = entries.QUERIES[name](spark, sf).toPandas()
    if name in entries.SQL:
        want = duck.sql(entries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
