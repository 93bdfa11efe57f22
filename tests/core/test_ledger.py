"""Transactions against a serial run."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ledger as L, versions as V, workloads as WL


def serial_transfers(events, balance):
    balance, out = dict(balance), {}
    for bid, s, d, v in sorted(events):
        a, b = balance.get(s, 0), balance.get(d, 0)
        ok = a > L.RESERVE and a > v
        if ok:
            balance[s], balance[d] = a - v, b + v
        out[bid] = (ok, balance.get(s, 0) if ok else None, balance.get(d, 0) if ok else None)
    return out, balance


def frames(spark, events, balance):
    return (spark.createDataFrame(events, "bid long, src long, dest long, amount long"), spark.createDataFrame(list(balance.items()), "key long, balance long"))


def run(spark, events, balance):
    e, a = frames(spark, events, balance)
    done = L.transfers(e, a)
    return {r.bid: (r.committed, r.src_balance, r.dest_balance) for r in done.collect()}, {r.key: r.balance for r in L.final_balances(done, a).collect()}


def made(seed, n=300, users=6, most=30_000):
    rng = random.Random(seed)
    events = [(b, *rng.sample(range(users), 2), rng.randrange(most)) for b in range(n)]
    return events, {u: rng.choice([0, L.RESERVE, 20_000, 90_000]) for u in range(users)}


@pytest.mark.parametrize("seed", range(3))
def test_transfers_equal_a_serial_run(spark, seed):
    events, balance = made(seed)
    want, end = serial_transfers(events, balance)
    got, got_end = run(spark, events, balance)
    assert got == want and got_end == end
    assert sum(end.values()) == sum(balance.values())
    assert len({ok for ok, _, _ in want.values()}) == 2


def test_input_order_and_epochs_dont_matter(spark):
    events, balance = made(7, n=90)
    want, end = serial_transfers(events, balance)
    assert run(spark, events[::-1], balance)[0] == want
    for size in (7, 90):
        state, got = dict(balance), {}
        for b in range(0, 90, size):
            part, state = run(spark, events[b : b + size], state)
            got |= part
        assert got == want and state == end


def test_edges_of_the_rule(spark):
    # A balance of exactly the reserve, and one that equals the amount, abort; then a chain in one batch.
    balance = {1: L.RESERVE, 2: 50_000, 3: 0, 4: 30_000}
    events = [(0, 1, 3, 1), (1, 2, 3, 50_000), (2, 4, 1, 29_999), (3, 1, 2, 35_000), (4, 2, 4, 80_000), (5, 9, 1, 5)]
    got, end = run(spark, events, balance)
    assert (got, end) == (serial_transfers(events, balance)[0], {k: v for k, v in serial_transfers(events, balance)[1].items() if k in balance})
    assert [got[b][0] for b in range(6)] == [False, False, True, True, True, False]
    e, a = frames(spark, events, balance)
    assert {r.bid: r.result for r in L.results(L.transfers(e, a)).collect()}[0] == "aborted"


def test_withdrawals(spark):
    rng = random.Random(3)
    rows = [(b, rng.randrange(4), rng.randrange(40_000), rng.choice(["withdraw", "deposit"])) for b in range(200)]
    balance, out = {0: 10_000, 1: 50_000, 2: -5}, {}
    now = dict(balance)
    for b, k, v, kind in rows:
        seen = now.get(k, 0)
        ok = kind == "deposit" or (seen > L.RESERVE and seen > v)
        now[k] = seen + (0 if not ok else v if kind == "deposit" else -v)
        out[b] = (seen, ok, now[k])
    got = L.withdrawals(spark.createDataFrame(rows, "bid long, key long, amount long, kind string"), spark.createDataFrame(list(balance.items()), "key long, balance long")).collect()
    assert {r.bid: (r.seen, r.committed, r.balance) for r in got} == out


def test_chained_writes(spark):
    rng = random.Random(5)
    rows = [(b, rng.randrange(5), rng.randrange(100)) for b in range(150)]
    now, out = {}, {}
    for b, k, v in rows:
        seen = now.get(k, 0)
        target = seen % 5 if seen > 150 else k
        now[target] = now.get(target, 0) + v
        out[b] = (seen, target, now[target])
    e = spark.createDataFrame(rows, "bid long, key long, amount long")
    got = L.chained_writes(e, spark.createDataFrame([(0, 0)], "key long, balance long"), F.when(F.col("seen") > 150, F.col("seen") % 5).otherwise(F.col("key"))).collect()
    assert {r.bid: (r.seen, r.target, r.balance) for r in got} == out


def test_prefix_sums_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit(1).alias("key"), F.col("id").alias("bid"), (F.col("id") % 7).alias("v"))
    got = V.prefix_sum(rows, ["key"], "v", "s", width=64).orderBy("bid").collect()
    total = 0
    for r in got:
        assert r.s == total
        total += r.v


def test_reads_of_shared_bids_and_first_events(spark):
    log = spark.createDataFrame([(1, -1, 5), (1, 0, 6), (1, 3, 7), (2, -1, 9)], "key long, bid long, value long")
    probes = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (1, 3, "c"), (2, 9, "d"), (3, 1, "e")], "key long, bid long, tag string")
    got = {r.tag: (r.read_bid, r.read_value) for r in V.read_latest(log, probes, ["key"]).collect()}
    assert got == {"a": (-1, 5), "b": (0, 6), "c": (0, 6), "d": (-1, 9), "e": (None, None)}


def test_grep_sum_repeats_keys(spark):
    log = spark.createDataFrame([(1, 0, 5), (2, 1, 7)], "key long, bid long, value long")
    reads = spark.createDataFrame([(2, [1, 1, 2, 3]), (0, [1])], "bid long, keys array<long>")
    assert sorted(map(tuple, WL.grep_sum(reads, log).collect())) == [(0, 0, 0), (2, 3, 17)]
