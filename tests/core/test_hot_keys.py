"""One key holds half of the rows: reads cut it into ranges, and the result is that of reading it whole."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidewater.operators import ledger as L, relational as R, versions as V


def hot_rows(seed, n=600):
    rng = random.Random(seed)
    return [("hot" if i % 2 else rng.choice([None, "a", "b"]), i, rng.randrange(100)) for i in range(n)]


def test_reads_in_ranges(spark):
    rows = hot_rows(1)
    log = spark.createDataFrame(rows, "key string, bid long, value long")
    probes = spark.createDataFrame([(k, b + 1) for k, b, _ in rows[::3]] + [("hot", 0), ("none", 9)], "key string, bid long")
    want = {}
    for k, b in [tuple(r) for r in probes.collect()]:
        own = [(x, v) for key, x, v in rows if key == k and x < b]
        want[k, b] = (max(own) if own else (None, None), len([1 for x, _ in own if x >= b - 40]), sum(v for x, v in own if x >= b - 40) if any(x >= b - 40 for x, _ in own) else None)
    got = {(r.key, r.bid): (r.read_bid, r.read_value) for r in V.read_latest(log, probes, ["key"], width=64).collect()}
    assert got == {k: x[0] for k, x in want.items()}
    got = {(r.key, r.bid): (r.n_versions, r.sum_versions) for r in V.read_window(log, probes, ["key"], 40, width=64).collect()}
    assert got == {k: x[1:] for k, x in want.items()}
    before = {(r.key, r.bid): r.before for r in V.previous(log, ["key"], ["bid"], "value", "before", width=64).collect()}
    last, wanted = {}, {}
    for k, b, v in rows:
        wanted[k, b] = last.get(k)
        last[k] = v
    assert before == wanted


def test_a_hot_key_shares_out(spark):
    """No task of a windowed read gets more of the hot key than a range."""
    log = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.col("id").alias("bid"), F.col("id").alias("value"))
    read = V.read_window(log, log.select("key", "bid"), ["key"], 8, width=128)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(Counter(r.p for r in read.where("key = 'hot'").select("n_versions", F.spark_partition_id().alias("p")).collect()).values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most <= 5 * 64


def serial(events, state):
    state, out = dict(state), {}
    for bid, flag, s, d, v, ab in sorted(events):
        ok = not ab and (flag == "deposit" or (flag == "transfer" and d is not None and s != d and all(state.get((t, s), 0) > max(L.RESERVE, v) for t in L.TABLES)))
        for t in L.TABLES if ok else ():
            state[t, s] = state.get((t, s), 0) + (v if flag == "deposit" else -v)
            if flag == "transfer":
                state[t, d] = state.get((t, d), 0) + v
        out[bid] = "aborted" if not ok else str(state["accounts", s]) if flag == "deposit" else f"{state['accounts', s]},{state['accounts', d]}"
    return out, state


def test_mixed_equals_a_serial_run(spark):
    """Two conditions, two tables, marked aborts, unknown flags, transfers to oneself and keys that the state lacks."""
    rng = random.Random(4)
    events = [(b, rng.choice(["deposit", "transfer", "transfer", "other"]), rng.randrange(6), rng.choice([None, *range(7)]), rng.randrange(30_000), rng.choice([True, False, False, None])) for b in range(120)]
    state = {(t, k): rng.choice([0, L.RESERVE, 60_000]) for t in L.TABLES for k in range(5)}
    e = spark.createDataFrame(events, "bid long, flag string, src long, dest long, amount long, is_abort boolean")
    s = spark.createDataFrame([(*k, v) for k, v in state.items()], "tbl string, key long, balance long")
    done = L.mixed(e, s)
    want, end = serial(events, state)
    assert {r.bid: r.result for r in L.mixed_results(done).collect()} == want
    assert {(r.tbl, r.key): r.balance for r in L.mixed_state(done, e, s).collect()} == end
    assert len(set(want.values())) > 10


def test_only_results_tables_stay(spark, tmp_path):
    """A round's table goes when the next is there; those that hold settled transactions are the result's."""
    import glob

    rounds = set(glob.glob(f"{L.shared_folder(spark)}/tidewater-ledger-*"))
    e = spark.createDataFrame([(b, b % 3, (b + 1) % 3, 9_000) for b in range(60)], "bid long, src long, dest long, amount long")
    a = spark.createDataFrame([(k, 20_000) for k in range(3)], "key long, balance long")
    done = L.transfers(e, a)
    new = set(glob.glob(f"{L.shared_folder(spark)}/tidewater-ledger-*")) - rounds
    assert len(new) == 1
    tables = glob.glob(f"{new.pop()}/*")
    assert all(any(t in f for f in done.inputFiles()) for t in tables) and done.count() == 60


def test_long_sides_arent_copied(spark, monkeypatch):
    left = spark.range(50).withColumnRenamed("id", "a")
    right = spark.range(40).withColumnRenamed("id", "b")
    plan = lambda algorithm: R.Query.table(left).join(right, "a", "b", algorithm=algorithm).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_replicate_nl" in plan("nested_loop") and "broadcast" in plan("broadcast")
    monkeypatch.setattr(R, "SMALL_SIDE", {"broadcast": 39, "nested_loop": 39})
    assert "shuffle_replicate_nl" not in plan("nested_loop") and "strategy=broadcast" not in plan("broadcast")
