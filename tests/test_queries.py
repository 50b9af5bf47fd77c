"""Every named query against its SQL counterpart on the smallest data set."""

import pytest

from __spark_entry__ import entry, queries
from bastionlog.plans.oracles import oracles
from bastionlog.plans.queries import REGISTRY
from tests.compare import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = {"anomaly_scores", "rf_threat_class"}


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_registry():
    assert set(REGISTRY) - set(oracles()) == WITHOUT_SQL
    assert set(oracles()) <= set(REGISTRY) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    result = duck.execute(oracles()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, SF_DIR).count() == 1000


def test_threat_class_has_every_line(spark):
    got = [r.line_index for r in queries()["rf_threat_class"](spark, SF_DIR).collect()]
    want = [r.line_index for r in queries()["raw_lines"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(want)


def test_entry(spark):
    assert entry(spark).count() > 0
