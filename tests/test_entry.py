import __spark_entry__ as entry


def test_registry():
    names = entry.queries()
    assert len(names) > 80 and set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {"example_id", "metric", "value"} <= set(rows[0].asDict()) and all(0 <= r.value <= 1 for r in rows)
