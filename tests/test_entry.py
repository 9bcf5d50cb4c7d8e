import __spark_entry__ as entry


def test_entry_and_keys(spark, sf_dir):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert entry.entry(spark).count() > 0
