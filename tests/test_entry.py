import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).limit(1).columns[0] == "file_id"
    assert set(e.oracle_sql()) <= set(e.queries()) and all(callable(f) for f in e.queries().values())
