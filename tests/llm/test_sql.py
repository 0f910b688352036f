"""The registered queries against their SQL, with every column they return."""

import pytest

from oracle import same
from timberline.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_registered_query(spark, name):
    same(queries.QUERIES[name](spark, D), queries.SQL[name], D)
