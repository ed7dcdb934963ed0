import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
