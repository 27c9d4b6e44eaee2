import pytest

import __spark_entry__ as entry
from folioquery import catalog

from conftest import oracle_over

ORACLES = catalog.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(catalog.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    assert rows_of(catalog.queries()[name](spark, sf_dir).toPandas()) == duck(ORACLES[name])


@pytest.mark.parametrize("name", ["rewrite_query", "topic_state", "answers", "until_exit", "document_change"])
def test_query_equals_its_oracle_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert rows_of(catalog.queries()[name](spark, larger).toPandas()) == oracle_over(larger)(ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(ORACLES)
