"""Driver contract: entry() runs, every oracle has a query, schemas are stable."""

import __spark_entry__ as E


def test_registry_consistent():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 40


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "review_id"
    assert {"labels", "relevancy", "user_burst_24h"} <= set(df.columns)
