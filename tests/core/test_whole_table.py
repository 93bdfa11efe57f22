"""Reads as of a moment of the table take in every event, at a size beyond the moments of decayed_counts and snapshot_read."""

import duckdb
import pytest

from tidewater.plans import queries as Q

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["decayed_counts_last", "snapshot_read_last"])
def test_whole_table_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLES[name]})").fetchall()
    a, b = sorted(map(tuple, got.collect())), sorted(want)
    assert len(a) == con.execute("SELECT count(DISTINCT user_id) FROM events").fetchone()[0]
    assert len(a) == len(b) and all(x == pytest.approx(y, abs=2e-6) for x, y in zip(a, b))


def test_snapshot_holds_each_keys_newest_event(spark):
    newest = duckdb.sql(f"SELECT user_id, max(event_id) FROM '{SF}/events.parquet' GROUP BY 1").fetchall()
    got = {r.key: r.bid for r in Q.QUERIES["snapshot_read_last"](spark, SF).collect()}
    assert got == dict(newest) and max(got.values()) >= 5000
