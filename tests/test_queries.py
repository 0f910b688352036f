import pytest

from oracle import same
from timberline.queries import QUERIES, SQL

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in SQL:
        same(df, SQL[name], D)
    else:
        assert df.count() > 0
