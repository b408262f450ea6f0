import pytest

from docloom import catalog, notices
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == notices.__name__))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, SF, name)
