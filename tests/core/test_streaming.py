"""Streams equal the same jobs over whole tables, also when they are stopped and started again."""

import pandas as pd
from pyspark.sql import functions as F

from test_ledger import frames, made, serial_transfers
from tidewater.operators import ledger
from tidewater.sources import events as E
from tidewater.streaming import jobs as S


def test_ledger_over_epochs_and_a_restart(spark, tmp_path):
    events, balance = made(11, n=60)
    want, end = serial_transfers(events, balance)
    _, accounts = frames(spark, [], balance) if False else (None, spark.createDataFrame(list(balance.items()), "key long, balance long"))
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"

    def feed(part):
        spark.createDataFrame(part, "bid long, src long, dest long, amount long").coalesce(1).write.mode("append").parquet(source)

    def drain():
        q = S.transfer_ledger(S.tables(spark, source, "bid long, src long, dest long, amount long"), accounts, out, check)
        q.processAllAvailable()
        q.stop()

    feed(events[:20])
    drain()
    feed(events[20:45])
    drain()
    feed(events[45:])
    drain()
    got = {r.bid: r.result for r in spark.read.parquet(f"{out}/results").collect()}
    assert got == {b: f"{s},{d}" if ok else "aborted" for b, (ok, s, d) in want.items()}
    assert {r.key: r.balance for r in S.state_of(spark, out, 2).collect()} == {k: end[k] for k in balance}


def test_text_lines(spark, tmp_path):
    line = "accounts:12:87,bookEntries:12:87;transferAmount:350;transferAmount:int;transfer;false"
    (tmp_path / "a.txt").write_text(line + "\npause\n\ndeposits:1;;;deposit;TRUE\n")
    q = E.parse_text(S.lines(spark, str(tmp_path))).writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    rows = {r.flag: r for r in spark.table("parsed").collect()}
    assert set(rows) == {"transfer", "deposit"} and rows["deposit"].is_abort and rows["deposit"].vals == {}
    assert rows["transfer"]["keys"] == {"accounts": ["12", "87"], "bookEntries": ["12", "87"]} and rows["transfer"].types == {"transferAmount": "int"}
    assert spark.table("parsed").where("flag = 'transfer'").select(E.to_text(spark.table("parsed"))).first()[0] == line


def test_windows_drop_late_rows(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, "ts string, value double").select(F.to_timestamp("ts").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    feed([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:11:00", 2.0)])
    frame = S.tables(spark, f"{tmp_path}/in", "ts timestamp, value double")
    q = S.windowed(frame, "ts", "10 minutes", late="5 minutes").writeStream.outputMode("append").format("memory").queryName("late").start()
    q.processAllAvailable()
    feed([("2024-01-01 00:40:00", 4.0)])
    q.processAllAvailable()
    feed([("2024-01-01 00:02:00", 8.0), ("2024-01-01 01:30:00", 16.0)])
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.window_start)[11:16], r.total) for r in spark.table("late").collect())[:2] == [("00:00", 1.0), ("00:10", 2.0)]


def test_keyed_fold(spark, tmp_path):
    spark.createDataFrame([(b, b % 2, float(b)) for b in range(10)], "bid long, key long, v double").coalesce(1).write.parquet(f"{tmp_path}/in")

    def step(state: float, rows: pd.DataFrame):
        after = state + rows["v"].cumsum()
        return float(after.iloc[-1]), after.tolist()

    frame = S.tables(spark, f"{tmp_path}/in", "bid long, key long, v double")
    q = S.keyed_fold(frame, "key", ["v"], 100.0, step, "bid").writeStream.outputMode("append").format("memory").queryName("fold").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.bid): r.state for r in spark.table("fold").collect()}
    assert got[(0, 8)] == 120.0 and got[(1, 9)] == 125.0


def test_generator(spark):
    made_ = E.generate_ledger(spark, 4000, 50, skew=0.9, deposit_share=0.25, abort_share=0.1, seed=3)
    assert made_.exceptAll(E.generate_ledger(spark, 4000, 50, skew=0.9, deposit_share=0.25, abort_share=0.1, seed=3)).count() == 0
    r = made_.agg(F.avg((F.col("flag") == "deposit").cast("int")), F.avg(F.col("is_abort").cast("int")), F.min("src"), F.max("src"), F.count(F.when(F.col("src") == F.col("dest"), 1))).first()
    assert abs(r[0] - 0.25) < 0.03 and abs(r[1] - 0.1) < 0.03 and r[2] == 0 and r[3] <= 49 and r[4] == 0
    by = {x.src: x["count"] for x in made_.groupBy("src").count().collect()}
    assert by[0] > 3 * by.get(40, 0)
    assert ledger.RESERVE == 10_000
