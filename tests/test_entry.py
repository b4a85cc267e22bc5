import __spark_entry__ as entry


def test_entry_and_names(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 60
    df = entry.entry(spark)
    assert df.count() > 0 and {"run_key", "k", "cl", "n", "mean_value"} <= set(df.columns)
