import __spark_entry__ as entry


def test_entry_gives_rows(spark, duck):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_do_not_share_names():
    from ethoframe.plans import catalog

    assert len(catalog.QUERIES) == sum(len(p.QUERIES) for p in catalog._PARTS)
