import __spark_entry__ as entry


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 60
    out = entry.entry(spark)
    assert out.columns == ["l_returnflag", "l_linestatus", "count_0", "sum_1", "avg_2", "min_3", "max_4"]
    assert out.count() == 6
