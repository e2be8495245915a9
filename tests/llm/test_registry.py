import pytest

from airlattice.llm import registry
from oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, sf, name, registry.queries()[name], registry.oracle_sql()[name]) > 0


def test_all_ten_and_the_pipeline():
    names = list(registry.queries())
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
