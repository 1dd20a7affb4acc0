import parity
import pytest

from tramloom.llm import queries as llm


@pytest.fixture(scope="module")
def con(small):
    return parity.connect(small)


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql_twin(spark, con, small, name):
    parity.compare(spark, con, small, llm.QUERIES[name], llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_runs(spark, small, name):
    assert llm.QUERIES[name](spark, small).columns
