import parity
import pytest

from tramloom.plans import queries as core


@pytest.fixture(scope="module")
def con(small):
    return parity.connect(small)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql_twin(spark, con, small, name):
    parity.compare(spark, con, small, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, small, name):
    assert core.QUERIES[name](spark, small).count() > 0


def test_link_best_compares_the_whole_pool(spark, small):
    want = {r.key: r.n for r in core.QUERIES["retrieve_topk"](spark, small).groupBy("key").count().withColumnRenamed("count", "n").collect()}
    got = {r.key: r.pool for r in core.QUERIES["link_best"](spark, small).collect()}
    assert got == want and 10 < max(got.values()) <= 80


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_without_the_corpus_operators():
    import pathlib

    root = pathlib.Path(core.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tramloom.llm" not in p.read_text(), p
