"""Streamed queries on events that lie at the edges of windows and of time."""

from datetime import datetime

import duckdb
import pytest

from compare import assert_same
from ethoframe.plans import catalog

TIMES = [
    datetime(2024, 1, 1, 5, 59, 59, 499999), datetime(2024, 1, 1, 5, 59, 59, 500000), datetime(2024, 1, 1, 5, 59, 59, 700000), datetime(2024, 1, 1, 6, 0, 0, 500000),
    datetime(2031, 5, 1, 11, 59, 59, 900000), datetime(2031, 5, 1, 12), datetime(1970, 1, 1, 0, 0, 0, 700000),
]


@pytest.mark.parametrize("name, times", [("stream_tumbling", [*TIMES, None]), ("stream_session", TIMES)])
def test_edges_of_windows(spark, tmp_path, name, times):
    con = duckdb.connect()
    con.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, ?, '{\"k\": 1}')", [(i, t, i % 2, "view", i + 0.25) for i, t in enumerate(times)])
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.SQL[name]))
