"""Every query of the library proper against its SQL, or at least that it runs."""

import pytest

import __spark_entry__
from loomquery.plans import catalog
from tests.conftest import DATA
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert differences(spark, DATA, name) is None


#: The given turns have no quoted phrase, number or call; tests/test_round.py has some.
EMPTY = {"exact_term_extraction"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    assert frame.columns and (frame.count() > 0) != (name in EMPTY)


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["query_id", "rank", "doc_id", "score"] and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
