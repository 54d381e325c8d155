"""Every query with a SQL twin, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences

SQLS = entry.oracle_sql()
# may have no rows on the smallest tables
SPARSE = {"campaign_clusters", "top_campaigns", "stream_campaign", "ring_report", "ring_flags"}


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, sf, name):
    found = [p for p in differences(spark, sf, entry.queries()[name], SQLS[name]) if p != "no rows" or name not in SPARSE]
    assert not found


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 44 and df.count() == 150
