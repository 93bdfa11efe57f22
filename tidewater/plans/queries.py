"""Queries over the driver's tables, and equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..operators import ledger, relational as R, stats, versions as V, workloads as L
from ..sources import events as E
from ..streaming import jobs as S
from . import pipeline as J

P = R.Predicate
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir); sql: the same in DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def k():
    return F.get_json_object("props", "$.k").cast("int")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INT)"

# --- Relational -----------------------------------------------------------------------------------------------------


@query("priority_revenue", """
SELECT o_orderpriority, count(*) AS "countAgg", round(sum(l_extendedprice), 2) AS "sumAgg", round(avg(l_extendedprice), 4) AS "averageAgg"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 10 AND l_discount < 0.08 GROUP BY o_orderpriority ORDER BY 1 LIMIT 5""")
def priority_revenue(spark, sf):
    """The flagship: scan, filter, equi-join, group, aggregate, order, limit."""
    q = R.Query.table(table(spark, sf, "lineitem")).join(table(spark, sf, "orders"), "l_orderkey", "o_orderkey")
    q = q.where("l_quantity", P.GREATER_THAN_EQUALS, 10.0).where("l_discount", P.LESS_THAN, 0.08).group_by("o_orderpriority")
    out = q.count().sum("l_extendedprice").average("l_extendedprice").order_by("o_orderpriority", limit=5).to_df()
    return out.withColumn("sumAgg", F.round("sumAgg", 2)).withColumn("averageAgg", F.round("averageAgg", 4))


query("seq_scan_project", "SELECT s_suppkey, s_name FROM supplier")(lambda s, d: R.Query.table(table(s, d, "supplier")).project("s_suppkey", "s_name").to_df())

for _name, _p, _sql in (("eq", P.EQUALS, "="), ("ne", P.NOT_EQUALS, "<>"), ("lt", P.LESS_THAN, "<"), ("le", P.LESS_THAN_EQUALS, "<="),
                        ("gt", P.GREATER_THAN, ">"), ("ge", P.GREATER_THAN_EQUALS, ">=")):
    query(f"select_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_sql} 25")(
        lambda s, d, p=_p: R.Query.table(table(s, d, "part")).where("p_size", p, 25).project("p_partkey", "p_size").to_df())
    query(f"select_string_{_name}", f"SELECT p_partkey, p_brand FROM part WHERE p_brand {_sql} 'Brand#23'")(
        lambda s, d, p=_p: R.Query.table(table(s, d, "part")).where("p_brand", p, "Brand#23").project("p_partkey", "p_brand").to_df())


@query("select_conjunction", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_returnflag = 'R'")
def select_conjunction(spark, sf):
    q = R.Query.table(table(spark, sf, "lineitem")).where("l_quantity", P.GREATER_THAN, 10.0).where("l_quantity", P.LESS_THAN_EQUALS, 20.0)
    return q.where("l_returnflag", P.EQUALS, "R").project("l_orderkey", "l_linenumber", "l_quantity").to_df()


@query("join_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi(spark, sf):
    return R.Query.table(table(spark, sf, "orders")).join(table(spark, sf, "customer"), "o_custkey", "c_custkey").project("o_orderkey", "c_name").to_df()


@query("join_chain_left_deep", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join_chain(spark, sf):
    q = R.Query.table(table(spark, sf, "customer")).join(table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    return q.join(table(spark, sf, "region"), "n_regionkey", "r_regionkey").project("c_custkey", "n_name", "r_name").to_df()


@query("join_self_alias", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self_alias(spark, sf):
    nation = table(spark, sf, "nation")
    out = R.Query.table(nation, "a").join(nation, "a.n_regionkey", "b.n_regionkey", alias="b").to_df()
    return out.select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


for _a in ("hash", "sort_merge", "broadcast", "nested_loop"):
    query(f"join_{_a}", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
        lambda s, d, a=_a: R.Query.table(table(s, d, "supplier")).join(table(s, d, "nation"), "s_nationkey", "n_nationkey", algorithm=a).project("s_suppkey", "n_name").to_df())

query("group_count", 'SELECT l_returnflag, count(*) AS "countAgg" FROM lineitem GROUP BY 1')(
    lambda s, d: R.Query.table(table(s, d, "lineitem")).group_by("l_returnflag").count().to_df())
query("group_sum_int", 'SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS "sumAgg" FROM part GROUP BY 1')(
    lambda s, d: R.Query.table(table(s, d, "part")).group_by("p_brand").sum("p_size").to_df())
query("group_sum_double", 'SELECT l_linestatus, round(sum(l_quantity), 2) AS "sumAgg" FROM lineitem GROUP BY 1')(
    lambda s, d: R.Query.table(table(s, d, "lineitem")).group_by("l_linestatus").sum("l_quantity").to_df().withColumn("sumAgg", F.round("sumAgg", 2)))
query("group_avg", 'SELECT p_brand, round(avg(p_size), 6) AS "averageAgg" FROM part GROUP BY 1')(
    lambda s, d: R.Query.table(table(s, d, "part")).group_by("p_brand").average("p_size").to_df().withColumn("averageAgg", F.round("averageAgg", 6)))
query("global_agg", 'SELECT count(*) AS "countAgg", CAST(sum(p_size) AS BIGINT) AS "sumAgg", round(avg(p_size), 6) AS "averageAgg" FROM part')(
    lambda s, d: R.Query.table(table(s, d, "part")).count().sum("p_size").average("p_size").to_df().withColumn("averageAgg", F.round("averageAgg", 6)))
query("global_agg_empty", 'SELECT count(*) AS "countAgg", coalesce(avg(p_size), 0.0) AS "averageAgg" FROM part WHERE p_size > 1000')(
    lambda s, d: R.Query.table(table(s, d, "part")).where("p_size", P.GREATER_THAN, 1000).count().average("p_size").to_df())
query("order_by_limit_asc", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")(
    lambda s, d: R.Query.table(table(s, d, "orders")).project("o_orderkey").order_by("o_orderkey", True, 20).to_df())
query("order_by_limit_desc", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")(
    lambda s, d: R.Query.table(table(s, d, "orders")).project("o_orderkey").order_by("o_orderkey", False, 20).to_df())


@query("insert_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def insert_rows(spark, sf):
    return R.insert(table(spark, sf, "region").select("r_regionkey", "r_name"), table(spark, sf, "nation").selectExpr("n_nationkey r_regionkey", "n_name r_name"))


@query("update_rows", "SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_acctbal ELSE n END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_rows(spark, sf):
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("c_acctbal"))
    return R.update(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, "c_custkey")


@query("delete_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def delete_rows(spark, sf):
    return R.delete(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("delete_rows_some", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def delete_rows_some(spark, sf):
    """Customers without a large finished order: some go, some stay."""
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return R.delete(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("temp_table_scan", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 1")
def temp_table_scan(spark, sf):
    return R.temp_table(table(spark, sf, "nation"), "tidewater_nation").where("n_regionkey > 1").select("n_name", "n_regionkey")


@query("upsert_rows", "SELECT s_suppkey AS k, 'supplier' AS origin FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_rows(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit("part").alias("origin"))
    return R.upsert(parts, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("origin")), "k")


# --- Statistics -----------------------------------------------------------------------------------------------------

_BUCKETS = """SELECT least(CAST(floor((l_quantity - lo) / ((hi - lo) / 10)) AS INT), 9) AS bucket, lo, hi, count(*) AS n
FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY ALL"""
query("equi_width_histogram", f"SELECT bucket, round(lo + bucket * ((hi - lo) / 10), 6) AS low, round(lo + (bucket + 1) * ((hi - lo) / 10), 6) AS high, n FROM ({_BUCKETS})")(
    lambda s, d: stats.histogram(table(s, d, "lineitem"), "l_quantity").select("bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"))
query("histogram_range", f"""SELECT round(sum(n * greatest(0, least(1, (least(lo + (bucket + 1) * w, 30.0) - greatest(lo + bucket * w, 12.0)) / w))), 4) AS estimate
FROM (SELECT *, (hi - lo) / 10 AS w FROM ({_BUCKETS}))""")(
    lambda s, d: stats.estimated_rows(stats.histogram(table(s, d, "lineitem"), "l_quantity"), 12.0, 30.0).select(F.round("estimate", 4).alias("estimate")))
query("table_stats_ndv", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS ndv, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM part"
    for c in ("p_partkey", "p_brand", "p_size")))(lambda s, d: stats.column_stats(table(s, d, "part"), ["p_partkey", "p_brand", "p_size"]))
query("pivot_counts", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS total FROM orders GROUP BY 1")(
    lambda s, d: stats.pivot_sums(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"]))
query("distinct_set_size", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1")(
    lambda s, d: stats.distinct_sets(table(s, d, "lineitem"), "l_suppkey", "l_partkey"))
query("set_members", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(
    lambda s, d: stats.members(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"))
query("decayed_counts", "SELECT user_id, round(sum(value * power(0.5, (20000 - event_id) / 1000.0)), 6) AS level FROM events WHERE event_id <= 20000 GROUP BY 1")(
    lambda s, d: stats.decayed_counts(table(s, d, "events"), "user_id", "value", "event_id", 1000.0, 20000.0).withColumn("level", F.round("level", 6)))


@query("decayed_counts_last", "SELECT user_id, round(sum(value * power(0.5, (m - event_id) / 1000.0)), 6) AS level FROM events, (SELECT max(event_id) AS m FROM events) GROUP BY 1")
def decayed_counts_last(spark, sf):
    """As of the last event, so that every event counts."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    return stats.decayed_counts(events, "user_id", "value", "event_id", 1000.0, float(last)).withColumn("level", F.round("level", 6))


# --- Versioned state ------------------------------------------------------------------------------------------------


def version_log(spark, sf):
    """Every event writes its value (in cents) to its user's key."""
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("bid"), cents("value").alias("value"))


_LOG = "(SELECT user_id AS key, event_id AS bid, CAST(round(value * 100) AS BIGINT) AS value FROM events)"
query("version_read_latest", f"SELECT key, bid, max(bid) OVER w AS read_bid, lag(value) OVER w2 AS read_value FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY key ORDER BY bid)")(
    lambda s, d: V.read_latest(version_log(s, d), version_log(s, d).select("key", "bid"), ["key"]))
query("version_read_bounded", f"SELECT key, bid, CASE WHEN b >= bid - 100 THEN b END AS read_bid, CASE WHEN b >= bid - 100 THEN v END AS read_value FROM (SELECT key, bid, lag(bid) OVER w AS b, lag(value) OVER w AS v FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY bid))")(
    lambda s, d: V.read_latest(version_log(s, d), version_log(s, d).select("key", "bid"), ["key"], least=F.col("bid") - 100))
query("asof_state_lookup", f"SELECT o_orderkey AS bid, o_custkey AS key, l.bid AS read_bid, l.value AS read_value FROM orders o ASOF LEFT JOIN {_LOG} l ON o.o_custkey = l.key AND o.o_orderkey > l.bid")(
    lambda s, d: V.read_latest(version_log(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("bid"), F.col("o_custkey").alias("key")), ["key"]))
query("snapshot_read", f"SELECT key, max(bid) AS bid, max_by(value, bid) AS value FROM {_LOG} WHERE bid < 5000 GROUP BY key")(
    lambda s, d: V.snapshot(version_log(s, d), ["key"], 5000))


@query("snapshot_read_last", f"SELECT key, max(bid) AS bid, max_by(value, bid) AS value FROM {_LOG} GROUP BY key")
def snapshot_read_last(spark, sf):
    """As of an event after the last one, so that every event counts."""
    log = version_log(spark, sf)
    last = log.agg(F.max("bid")).first()[0]
    return V.snapshot(log, ["key"], V.BASE if last is None else last + 1)


query("previous_version", f"SELECT key, bid, lag(value) OVER (PARTITION BY key ORDER BY bid) AS before FROM {_LOG}")(
    lambda s, d: V.previous(version_log(s, d), ["key"], ["bid"], "value", "before", width=1000).select("key", "bid", "before"))
query("compact_versions", f"SELECT key, CAST(-1 AS BIGINT) AS bid, max_by(value, bid) AS value FROM {_LOG} GROUP BY key")(lambda s, d: V.compact(version_log(s, d), ["key"]))
query("window_read_range", f"SELECT key, bid, count(*) OVER w AS n_versions, CAST(sum(value) OVER w AS BIGINT) AS sum_versions FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY bid RANGE BETWEEN 1024 PRECEDING AND 1 PRECEDING)")(
    lambda s, d: V.read_window(version_log(s, d), version_log(s, d).select("key", "bid"), ["key"], 1024))
query("running_count_sum_mean", f"SELECT key, bid, count(*) OVER w AS n, CAST(sum(value) OVER w AS BIGINT) AS total, round(avg(value) OVER w, 6) AS mean FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY bid)")(
    lambda s, d: V.prefix_sum(V.prefix_sum(version_log(s, d).withColumn("one", F.lit(1).cast("long")), ["key"], "value", "t"), ["key"], "one", "c").select(
        "key", "bid", (F.col("c") + 1).alias("n"), (F.col("t") + F.col("value")).alias("total"), F.round((F.col("t") + F.col("value")) / (F.col("c") + 1), 6).alias("mean")))

# --- Ledger ---------------------------------------------------------------------------------------------------------


def accounts(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), cents("c_acctbal").alias("balance"))


def keyed_events(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit")
    return table(spark, sf, "events").select(F.col("event_id").alias("bid"), F.col("user_id").alias("key"), cents("value").alias("amount"), kind.alias("kind"))


def transfer_events(spark, sf, *more):
    """Each event moves its value to another user: (user + k + 1) mod the number of users. more: other columns of events."""
    events = table(spark, sf, "events")
    n = events.agg(F.max("user_id") + 1).first()[0] or 1
    return events.select(F.col("event_id").alias("bid"), F.col("user_id").alias("src"), F.pmod(F.col("user_id") + k() + 1, F.lit(n)).alias("dest"), cents("value").alias("amount"), *more)


_ACCOUNTS = "(SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer)"
query("ledger_deposit", f"SELECT l.key, bid, value AS amount, CAST(coalesce(balance, 0) + sum(value) OVER (PARTITION BY l.key ORDER BY bid) AS BIGINT) AS balance FROM {_LOG} l LEFT JOIN {_ACCOUNTS} a ON a.key = l.key")(
    lambda s, d: ledger.deposits(keyed_events(s, d).select("key", "bid", "amount"), accounts(s, d)))
query("ledger_withdraw_conditional", f"""
SELECT e.key, list_reduce(list_prepend(any_value(coalesce(balance, 0)), list(CASE WHEN draw THEN -amount ELSE amount END ORDER BY bid)),
  lambda a, x: CASE WHEN x >= 0 THEN a + x WHEN a > 10000 AND a > -x THEN a + x ELSE a END) AS balance
FROM (SELECT user_id AS key, event_id AS bid, CAST(round(value * 100) AS BIGINT) AS amount, event_type = 'purchase' AS draw FROM events) e
LEFT JOIN {_ACCOUNTS} a ON a.key = e.key GROUP BY e.key""")(
    lambda s, d: ledger.withdrawals(keyed_events(s, d), accounts(s, d)).groupBy("key").agg(F.max_by("balance", "bid").alias("balance")))

#: A serial run of all transfers: state as a list of balances by user.
_SERIAL = f"""
WITH RECURSIVE n AS (SELECT max(user_id) + 1 AS n FROM events),
e AS (SELECT event_id AS bid, user_id AS s, (user_id + {SQL_K} + 1) % n AS d, CAST(round(value * 100) AS BIGINT) AS v FROM events, n),
o AS (SELECT *, row_number() OVER (ORDER BY bid) AS rn FROM e WHERE s <> d),
start AS (SELECT list(coalesce(balance, 0) ORDER BY u) AS st FROM (SELECT unnest(range(n)) AS u FROM n) LEFT JOIN {_ACCOUNTS} a ON a.key = u),
r(rn, bid, s, d, ok, st) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, st FROM start
  UNION ALL
  SELECT o.rn, o.bid, o.s, o.d, st[o.s + 1] > 10000 AND st[o.s + 1] > o.v,
    CASE WHEN st[o.s + 1] > 10000 AND st[o.s + 1] > o.v
      THEN list_transform(st, lambda x, i: CASE WHEN i = o.s + 1 THEN x - o.v WHEN i = o.d + 1 THEN x + o.v ELSE x END) ELSE st END
  FROM r JOIN o ON o.rn = r.rn + 1)
"""
query("ledger_transfer", _SERIAL + ", z AS (SELECT st FROM r ORDER BY rn DESC LIMIT 1) SELECT a.key, CASE WHEN a.key < len(st) THEN st[a.key + 1] ELSE balance END AS balance FROM " + _ACCOUNTS + " a, z")(
    lambda s, d: ledger.final_balances(ledger.transfers(transfer_events(s, d), accounts(s, d)), accounts(s, d)))
query("ledger_results", _SERIAL + "SELECT bid, CASE WHEN ok THEN st[s + 1] || ',' || st[d + 1] ELSE 'aborted' END AS result FROM r WHERE rn > 0")(
    lambda s, d: ledger.results(ledger.transfers(transfer_events(s, d), accounts(s, d))))


@query("ledger_new_accounts", f"SELECT l.key, bid, CAST(CASE WHEN l.key % 2 = 0 THEN coalesce(balance, 0) ELSE 0 END + sum(value) OVER (PARTITION BY l.key ORDER BY bid) AS BIGINT) AS balance FROM {_LOG} l LEFT JOIN {_ACCOUNTS} a ON a.key = l.key")
def ledger_new_accounts(spark, sf):
    """Deposits to accounts half of which don't exist yet."""
    return ledger.deposits(keyed_events(spark, sf).select("key", "bid", "amount"), accounts(spark, sf).where("key % 2 = 0")).select("key", "bid", "balance")


@query("guarded_inc_dec", f"""
SELECT e.key, list_reduce(list_prepend(any_value(coalesce(balance, 0)), list(CASE WHEN event_type = 'purchase' THEN -amount ELSE amount END ORDER BY bid)),
  lambda a, x: CASE WHEN a >= 0 AND a <= 500000 THEN a + x ELSE a END) AS balance
FROM (SELECT user_id AS key, event_id AS bid, CAST(round(value * 100) AS BIGINT) AS amount, event_type FROM events) e
LEFT JOIN {_ACCOUNTS} a ON a.key = e.key GROUP BY e.key""")
def guarded_inc_dec(spark, sf):
    """Increments and decrements that happen only while the balance lies between 0 and 5,000."""
    events = keyed_events(spark, sf).withColumn("delta", F.when(F.col("kind") == "withdraw", -F.col("amount")).otherwise(F.col("amount")))
    return ledger.guarded(events.select("bid", "key", "delta"), accounts(spark, sf), 0, 500_000).groupBy("key").agg(F.max_by("balance", "bid").alias("balance"))


def mixed_events(spark, sf):
    """Views and sign-ups are deposits, other events transfers, errors transfers that abort."""
    return transfer_events(spark, sf, "event_type").select("bid", F.when(F.col("event_type").isin("view", "signup"), "deposit").otherwise("transfer").alias("flag"), "src", "dest", "amount", (F.col("event_type") == "error").alias("is_abort"))


def mixed_tables(spark, sf):
    """Accounts from customers; book entries begin at 500 and one more for each key."""
    a = accounts(spark, sf)
    book = a.select(F.lit("bookEntries").alias("tbl"), "key", (F.col("key") * 100 + 50_000).alias("balance"))
    return a.select(F.lit("accounts").alias("tbl"), "key", "balance").unionByName(book)


def _mixed_serial(events: str, n: str, accounts: str, book: str) -> str:
    """A serial run of deposits and transfers over two tables, whose states are lists by key.

    events: (bid, f, s, d, v, ab); n: the number of keys; accounts and book: (key, balance)."""
    fine = "(NOT o.ab AND (o.f = 'deposit' OR (o.s <> o.d AND least(a[o.s + 1], b[o.s + 1]) > greatest(10000, o.v))))"

    def after(st: str) -> str:
        return (f"CASE WHEN {fine} THEN list_transform({st}, lambda x, i: CASE WHEN i = o.s + 1 THEN x + CASE WHEN o.f = 'deposit' THEN o.v ELSE -o.v END "
                f"WHEN o.f = 'transfer' AND i = o.d + 1 THEN x + o.v ELSE x END) ELSE {st} END")

    return f"""
WITH RECURSIVE n AS ({n}), e AS MATERIALIZED ({events}), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bid) AS rn FROM e),
start AS (SELECT list(coalesce(x.balance, 0) ORDER BY u) AS a, list(coalesce(y.balance, 0) ORDER BY u) AS b
  FROM (SELECT unnest(range(n)) AS u FROM n) LEFT JOIN ({accounts}) x ON x.key = u LEFT JOIN ({book}) y ON y.key = u),
r(rn, bid, f, s, d, ok, a, b) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, false, a, b FROM start
  UNION ALL SELECT o.rn, o.bid, o.f, o.s, o.d, {fine}, {after("a")}, {after("b")} FROM r JOIN o ON o.rn = r.rn + 1)
"""


_BOOK = "SELECT c_custkey AS key, CAST(c_custkey * 100 + 50000 AS BIGINT) AS balance FROM customer"
_MIXED = _mixed_serial(f"""SELECT event_id AS bid, CASE WHEN event_type IN ('view', 'signup') THEN 'deposit' ELSE 'transfer' END AS f, user_id AS s, (user_id + {SQL_K} + 1) % n AS d,
  CAST(round(value * 100) AS BIGINT) AS v, event_type = 'error' AS ab FROM events, n""", "SELECT max(user_id) + 1 AS n FROM events", f"SELECT * FROM {_ACCOUNTS}", _BOOK)
_MIXED_RESULT = "CASE WHEN NOT ok THEN 'aborted' WHEN f = 'deposit' THEN CAST(a[s + 1] AS VARCHAR) ELSE a[s + 1] || ',' || a[d + 1] END AS result"
_MIXED_STATE = _MIXED + f""", z AS (SELECT a, b FROM r ORDER BY rn DESC LIMIT 1)
SELECT 'accounts' AS tbl, key, CASE WHEN key < len(a) THEN a[key + 1] ELSE balance END AS balance FROM {_ACCOUNTS} x, z
UNION ALL SELECT 'bookEntries', key, CASE WHEN key < len(b) THEN b[key + 1] ELSE balance END FROM ({_BOOK}) y, z"""


@query("ledger_mixed", _MIXED_STATE)
def ledger_mixed(spark, sf):
    """Both tables after deposits and transfers in one serial order."""
    events, state = mixed_events(spark, sf), mixed_tables(spark, sf)
    return ledger.mixed_state(ledger.mixed(events, state), events, state)


query("ledger_mixed_results", _MIXED + f"SELECT bid, {_MIXED_RESULT} FROM r WHERE rn > 0")(
    lambda s, d: ledger.mixed_results(ledger.mixed(mixed_events(s, d), mixed_tables(s, d))))


@query("stream_mixed_ledger", _MIXED_STATE)
def stream_mixed_ledger(spark, sf, epochs: int = 3):
    """The same as a stream of files, an epoch each; the last state."""
    rounds = f"{ledger.shared_folder(spark)}/tidewater-stream-{uuid.uuid4().hex[:12]}"
    events = mixed_events(spark, sf)
    last = events.agg(F.max("bid")).first()[0] or 0
    size = -(-(last + 1) // epochs)
    for n in range(epochs):
        events.where(F.col("bid").between(n * size, (n + 1) * size - 1)).coalesce(1).write.mode("append").parquet(f"{rounds}/in")
    schema = "bid long, flag string, src long, dest long, amount long, is_abort boolean"
    q = S.mixed_ledger(S.tables(spark, f"{rounds}/in", schema), mixed_tables(spark, sf), f"{rounds}/out", f"{rounds}/check")
    q.processAllAvailable()
    done = q.lastProgress
    q.stop()
    return S.state_of(spark, f"{rounds}/out", max(epochs - 1, done.batchId if done and done.numInputRows else 0))


@query("non_deterministic_write", f"""
WITH RECURSIVE n AS (SELECT max(user_id) + 1 AS n FROM events),
o AS MATERIALIZED (SELECT key, bid, value AS v, row_number() OVER (ORDER BY bid) AS rn FROM {_LOG}),
r(rn, bid, key, seen, target, balance, n, st) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, n, list_transform(range(n), lambda x: 0::BIGINT) FROM n
  UNION ALL SELECT rn, bid, key, seen, target, st[target + 1] + v, n, list_transform(st, lambda y, i: CASE WHEN i = target + 1 THEN y + v ELSE y END)
  FROM (SELECT o.rn, o.bid, o.key, o.v, r.n, st, st[o.key + 1] AS seen, CASE WHEN st[o.key + 1] > 5000000 THEN st[o.key + 1] % r.n ELSE o.key END AS target FROM r JOIN o ON o.rn = r.rn + 1))
SELECT bid, key, seen, target, balance FROM r WHERE rn > 0""")
def non_deterministic_write(spark, sf):
    """An event adds its value to its own key, or, where it finds more than 50,000 there, to the key that the balance
    read names."""
    keys = keyed_events(spark, sf).select("bid", "key", "amount")
    n = keys.agg(F.max("key") + 1).first()[0] or 1
    base = keys.select("key").distinct().withColumn("balance", F.lit(0).cast("long"))
    return ledger.chained_writes(keys, base, F.when(F.col("seen") > 5_000_000, F.pmod(F.col("seen"), F.lit(n))).otherwise(F.col("key")))


# --- Workloads ------------------------------------------------------------------------------------------------------


def reads(spark, sf):
    """Each event reads its user's key and the next two."""
    return table(spark, sf, "events").select(F.col("event_id").alias("bid"), F.array(*(F.col("user_id") + i for i in range(3))).alias("keys"))


_READS = "(SELECT event_id AS bid, unnest([user_id, user_id + 1, user_id + 2]) AS key FROM events)"
query("grep_sum", f"SELECT r.bid, count(l.value) AS n_found, CAST(coalesce(sum(l.value), 0) AS BIGINT) AS total FROM {_READS} r ASOF LEFT JOIN {_LOG} l ON l.key = r.key AND r.bid > l.bid GROUP BY r.bid")(
    lambda s, d: L.grep_sum(reads(s, d), version_log(s, d)))
query("windowed_grep_sum", f"SELECT r.bid, count(l.value) AS n_found, CAST(coalesce(sum(l.value), 0) AS BIGINT) AS total FROM {_READS} r LEFT JOIN {_LOG} l ON l.key = r.key AND l.bid BETWEEN r.bid - 1024 AND r.bid - 1 GROUP BY r.bid")(
    lambda s, d: L.windowed_grep_sum(reads(s, d), version_log(s, d), 1024))


def reports(spark, sf):
    events = table(spark, sf, "events")
    begun = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
    seconds = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - begun) / 1_000_000).cast("long")
    return events.select(F.col("user_id").alias("vid"), seconds.alias("time"), k().alias("segment"), (F.floor("value") % 101).cast("int").alias("speed"))


_REPORTS = f"(SELECT user_id AS vid, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000) AS BIGINT) AS time, {SQL_K} AS segment, CAST(floor(value) AS INT) % 101 AS speed FROM events)"
_SEGMENTS = f"SELECT segment, time // 60 AS minute, count(DISTINCT vid) AS n_vehicles, avg(speed) AS avg_speed FROM {_REPORTS} GROUP BY ALL"
_TOLLS = f"""SELECT vid, e.segment, e.minute, CAST(CASE WHEN avg_speed < 60 AND n_vehicles > 1 THEN 2 * (n_vehicles - 1) * (n_vehicles - 1) ELSE 0 END AS BIGINT) AS toll
FROM (SELECT DISTINCT vid, segment, time // 60 AS minute FROM {_REPORTS}) e LEFT JOIN ({_SEGMENTS}) s ON s.segment = e.segment AND s.minute = e.minute - 1"""
query("toll_segment_stats", f"SELECT segment, minute, n_vehicles, round(avg_speed, 6) AS avg_speed FROM ({_SEGMENTS})")(
    lambda s, d: L.segment_stats(reports(s, d)).withColumn("avg_speed", F.round("avg_speed", 6)))
query("toll_charge", _TOLLS)(lambda s, d: L.tolls(reports(s, d), crowd=1, slow=60.0))
query("toll_daily_spending", f"SELECT vid, minute // 1440 AS day, CAST(sum(toll) AS BIGINT) AS spent FROM ({_TOLLS}) GROUP BY ALL")(lambda s, d: L.daily_spending(L.tolls(reports(s, d), crowd=1, slow=60.0)))
query("toll_accidents", f"SELECT segment, time // 60 AS time, count(DISTINCT vid) AS n_stopped FROM {_REPORTS} WHERE speed = 0 GROUP BY ALL HAVING n_stopped >= 2")(
    lambda s, d: L.accidents(reports(s, d).withColumn("time", F.floor(F.col("time") / 60).cast("long"))))


def rush_reports(spark, sf):
    """The same reports with 720 seconds as one, so that vehicles meet."""
    return reports(spark, sf).withColumn("time", F.floor(F.col("time") / 720).cast("long"))


_RUSH = f"(SELECT vid, time // 720 AS time, segment, speed FROM {_REPORTS})"
_RUSH_TOLLS = _TOLLS.replace(_REPORTS, _RUSH)
query("toll_rush_charge", _RUSH_TOLLS)(lambda s, d: L.tolls(rush_reports(s, d), crowd=1, slow=60.0))
query("toll_slow_places", f"SELECT segment, time // 60 AS time, count(DISTINCT vid) AS n_stopped FROM {_RUSH} WHERE speed <= 30 GROUP BY ALL HAVING n_stopped >= 2")(
    lambda s, d: L.accidents(rush_reports(s, d).withColumn("time", F.floor(F.col("time") / 60).cast("long")), slowest=30))


def toll_requests(spark, sf):
    """A third of the vehicles ask for their account in every minute in which they report."""
    asked = rush_reports(spark, sf).withColumn("minute", F.floor(F.col("time") / 60).cast("long")).select("vid", "minute").distinct()
    return asked.where("vid % 3 = 0").select((F.col("vid") * 1_000_000 + F.col("minute")).alias("qid"), "vid", "minute")


_REQUESTS = f"(SELECT DISTINCT vid * 1000000 + time // 60 AS qid, vid, time // 60 AS minute FROM {_RUSH} WHERE vid % 3 = 0)"
query("toll_account_balance", f"""SELECT qid, r.vid, r.minute, CAST(coalesce(sum(toll), 0) AS BIGINT) AS balance
FROM {_REQUESTS} r LEFT JOIN ({_RUSH_TOLLS}) t ON t.vid = r.vid AND t.minute < r.minute GROUP BY ALL""")(
    lambda s, d: L.account_balance(toll_requests(s, d), L.tolls(rush_reports(s, d), crowd=1, slow=60.0)))
query("toll_expenditure", f"""SELECT qid, r.vid, r.day, CAST(coalesce(sum(toll), 0) AS BIGINT) AS spent
FROM (SELECT DISTINCT vid * 10 AS qid, vid, minute // 20 AS day FROM {_REQUESTS}) r LEFT JOIN ({_RUSH_TOLLS}) t ON t.vid = r.vid AND t.minute // 20 = r.day GROUP BY ALL""")(
    lambda s, d: L.expenditure(toll_requests(s, d).select((F.col("vid") * 10).alias("qid"), "vid", F.floor(F.col("minute") / 20).cast("long").alias("day")).distinct(), L.tolls(rush_reports(s, d), crowd=1, slow=60.0), minutes=20))
query("toll_average_velocity", f"""SELECT m.segment, m.minute, round(avg(speed), 6) AS lav FROM (SELECT DISTINCT segment, time // 60 AS minute FROM {_RUSH}) m
JOIN {_RUSH} r ON r.segment = m.segment AND r.time // 60 BETWEEN m.minute - 5 AND m.minute - 1 GROUP BY ALL""")(
    lambda s, d: L.latest_average_velocity(rush_reports(s, d)).withColumn("lav", F.round("lav", 6)))
query("epoch_latency", """SELECT event_id // 1000 AS epoch, min(w) AS min_latency, max(w) AS max_latency, round(avg(w), 3) AS avg_latency, CAST(sum(w) AS BIGINT) AS total_latency
FROM (SELECT event_id, max(epoch_us(ts)) OVER (PARTITION BY event_id // 1000) - epoch_us(ts) AS w FROM events) GROUP BY 1""")(
    lambda s, d: L.epoch_latency(table(s, d, "events").withColumnRenamed("event_id", "bid"), 1000, "ts").withColumn("avg_latency", F.round("avg_latency", 3)))
query("epoch_batches", "SELECT event_id, event_id // 1000 AS epoch FROM events")(lambda s, d: L.epochs(table(s, d, "events").select("event_id"), 1000, "event_id"))
query("epoch_metrics", "SELECT event_id // 1000 AS epoch, count(*) AS n_events, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS per_second FROM events GROUP BY 1")(
    lambda s, d: L.epoch_metrics(table(s, d, "events").withColumnRenamed("event_id", "bid"), 1000, "ts").select("epoch", "n_events", F.round("per_second", 6).alias("per_second")))


def operations(spark, sf):
    """Two operations per transfer: write the source; read the source and write the destination."""
    t = transfer_events(spark, sf).where("src <> dest")
    none = F.expr("cast(array() as array<bigint>)")
    return t.select("bid", F.explode(F.array(F.struct(F.lit(0).alias("op"), F.col("src").alias("key"), none.alias("reads")),
                                             F.struct(F.lit(1).alias("op"), F.col("dest").alias("key"), F.array("src").alias("reads")))).alias("x")).select("bid", "x.*")


query("dependency_edges", f"""
WITH n AS (SELECT max(user_id) + 1 AS n FROM events),
t AS (SELECT event_id AS bid, user_id AS s, (user_id + {SQL_K} + 1) % n AS d FROM events, n),
ops AS (SELECT bid, 0 AS op, s AS key FROM t WHERE s <> d UNION ALL SELECT bid, 1, d FROM t WHERE s <> d),
temporal AS (SELECT lag(bid) OVER (PARTITION BY key ORDER BY bid, op) AS source, bid AS target FROM ops)
SELECT source, target, 'temporal' AS kind FROM temporal WHERE source IS NOT NULL
UNION ALL SELECT o.bid, t.bid, 'functional' FROM t ASOF JOIN ops o ON o.key = t.s AND t.bid > o.bid WHERE t.s <> t.d
UNION ALL SELECT bid, bid, 'logical' FROM t WHERE s <> d""")(lambda s, d: L.dependencies(operations(s, d)))

# --- Streams, windows and sources -----------------------------------------------------------------------------------


def stamped(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.withColumn("window_start", F.unix_micros("window_start")).withColumn("window_end", F.unix_micros("window_end")).withColumn("total", F.round("total", 2))


query("tumbling_window", "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_start, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")(
    lambda s, d: _plain(S.windowed(stamped(s, d), "ts", "1 hour", by=("event_type",))))
query("sliding_window", "SELECT w * 1800000000 AS window_start, (w + 2) * 1800000000 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, unnest([epoch_us(ts) // 1800000000 - 1, epoch_us(ts) // 1800000000]) AS w FROM events) GROUP BY w")(
    lambda s, d: _plain(S.windowed(stamped(s, d), "ts", "1 hour", "30 minutes")))
query("session_windows", """
SELECT user_id, min(epoch_us(ts)) AS session_start, max(epoch_us(ts)) + 1800000000 AS session_end, count(*) AS n
FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, g""")(lambda s, d: S.sessions(stamped(s, d), "ts", "30 minutes", "user_id").withColumn("session_start", F.unix_micros("session_start")).withColumn("session_end", F.unix_micros("session_end")))


@query("symmetric_join", """SELECT a.user_id, epoch_us(a.ts) AS left_ts, epoch_us(b.ts) AS right_ts FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def symmetric_join(spark, sf):
    e = stamped(spark, sf)
    out = S.symmetric_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "1 hour")
    return out.select("user_id", F.unix_micros("left_ts").alias("left_ts"), F.unix_micros("right_ts").alias("right_ts"))


@query("parse_event_string", f"""SELECT event_id AS bid, CAST(user_id AS VARCHAR) AS src, CAST(user_id + {SQL_K} + 1 AS VARCHAR) AS dest, 'transfer' AS flag,
CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount, event_type = 'error' AS is_abort FROM events""")
def parse_event_string(spark, sf):
    """Events written as text lines and read again."""
    e = table(spark, sf, "events")
    key = F.concat_ws(":", F.lit("accounts"), F.col("user_id"), F.col("user_id") + k() + 1)
    line = F.concat_ws(";", key, F.concat(F.lit("transferAmount:"), cents("value")), F.lit("transferAmount:int"), F.lit("transfer"), (F.col("event_type") == "error").cast("string"))
    read = E.parse_text(e.select(F.col("event_id").alias("bid"), line.alias("value")))
    return read.select("bid", F.col("keys")["accounts"][0].alias("src"), F.col("keys")["accounts"][1].alias("dest"), "flag", F.col("vals")["transferAmount"].alias("amount"), "is_abort")


@query("parse_event_json", "SELECT event_id AS bid, CAST(user_id AS VARCHAR) AS src, CAST(value AS VARCHAR) AS amount, event_type AS flag FROM events")
def parse_event_json(spark, sf):
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.create_map(F.lit("accounts"), F.array(F.col("user_id").cast("string"))).alias("subJson0"), F.create_map(F.lit("amount"), F.col("value").cast("string")).alias("subJson1"),
                              F.create_map(F.lit("amount"), F.lit("double")).alias("subJson2"), F.col("event_type").alias("subJson3"), F.lit("false").alias("subJson4")))
    read = E.parse_json(e.select(F.col("event_id").alias("bid"), line.alias("value")))
    return read.select("bid", F.col("keys")["accounts"][0].alias("src"), F.col("vals")["amount"].alias("amount"), "flag")


query("number_events", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS bid FROM orders")(
    lambda s, d: E.numbered(table(s, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "bid"))

query("partial_key_sums", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")(
    lambda s, d: J.partial_key_sums(table(s, d, "events").select("user_id", cents("value").alias("c")), "user_id", "c").select("user_id", "total"))
query("grouping_by_fields", "SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS tasks FROM events GROUP BY 1")(
    lambda s, d: J.by_fields(J.shuffled(table(s, d, "events").select("user_id"), 5), 7, "user_id").withColumn("p", F.spark_partition_id()).groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("p").alias("tasks")))

# --- Scalar functions -----------------------------------------------------------------------------------------------

query("scalar_minute_floor", "SELECT event_id, epoch_us(date_trunc('minute', ts)) AS minute FROM events")(
    lambda s, d: stamped(s, d).select("event_id", F.unix_micros(scalar.minute_floor(F.col("ts"))).alias("minute")))
query("scalar_working_days", """SELECT l_orderkey, l_linenumber, CAST((SELECT count(*) FROM range(least(a, b) + INTERVAL 1 DAY, greatest(a, b) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS INT) AS days
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS a, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", scalar.working_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("days")))
query("scalar_is_integer", "SELECT p_partkey, regexp_full_match(p_name, '-?[0-9]+') AS name_is, regexp_full_match(CAST(p_size AS VARCHAR), '-?[0-9]+') AS size_is FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.is_integer(F.col("p_name")).alias("name_is"), scalar.is_integer(scalar.as_text(F.col("p_size"))).alias("size_is")))
query("scalar_pad", "SELECT p_partkey, left(rpad(p_brand, 12, ' '), 12) AS padded, left(p_type, 4) AS cut FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.fixed_length(F.col("p_brand"), 12).alias("padded"), F.rtrim(scalar.fixed_length(F.col("p_type"), 4)).alias("cut")))
query("scalar_inc_dec", "SELECT p_partkey, p_partkey + 1 AS up, p_partkey - 5 AS down FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.increment(F.col("p_partkey")).alias("up"), scalar.decrement(F.col("p_partkey"), 5).alias("down")))
query("scalar_timestamp_parts", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) % 1000 AS us FROM events")(
    lambda s, d: stamped(s, d).select("event_id", scalar.millis(F.col("ts")).alias("ms"), scalar.micros_of_milli(F.col("ts")).alias("us")))
query("scalar_key_partition", "SELECT c_custkey, CAST(least(c_custkey // 188, 7) AS INT) AS p FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", scalar.key_partition(F.col("c_custkey"), 1500, 8).alias("p")))


def _uniform(on: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({on} AS VARCHAR) || ':{seed}'), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _zipf(u: str, n: int, skew: float) -> str:
    return f"CAST(least(floor(pow({u} * {(n + 1) ** (1 - skew) - 1!r} + 1, {1 / (1 - skew)!r})) - 1, {n - 1}) AS BIGINT)"


query("scalar_distributions", f"""SELECT p_partkey, round({_uniform('p_partkey', 1)}, 9) AS u, CAST(floor({_uniform('p_partkey', 1)} * 40) + 10 AS BIGINT) AS flat,
round(sqrt(-2 * ln(1 - {_uniform('p_partkey', 1)})) * cos(2 * pi() * {_uniform('p_partkey', 2)}), 6) AS gauss,
CAST({' + '.join(f"CAST({_uniform('p_partkey', k)} < 0.3 AS INT)" for k in range(3, 9))} AS INT) AS successes,
CASE WHEN {_uniform('p_partkey', 9)} < 0.7 THEN 'hot' WHEN {_uniform('p_partkey', 9)} < 0.9 THEN 'warm' ELSE 'cold' END AS share, {_zipf(_uniform('p_partkey', 10), 1000, 0.6)} AS zipf FROM part""")(
    lambda s, d: table(s, d, "part").select(
        "p_partkey", F.round(scalar.uniform(1, F.col("p_partkey")), 9).alias("u"), scalar.flat(scalar.uniform(1, F.col("p_partkey")), 10, 50).alias("flat"),
        F.round(scalar.gaussian(scalar.uniform(1, F.col("p_partkey")), scalar.uniform(2, F.col("p_partkey"))), 6).alias("gauss"),
        scalar.binomial([scalar.uniform(i, F.col("p_partkey")) for i in range(3, 9)], 0.3).alias("successes"),
        scalar.by_share(scalar.uniform(9, F.col("p_partkey")), {"hot": 7, "warm": 2, "cold": 1}).alias("share"), scalar.zipf(scalar.uniform(10, F.col("p_partkey")), 1000, 0.6).alias("zipf")))

JOB = J.JobConfig("generated", events=20_000, accounts=500, skew=0.6, abort_share=0.05, seed=1)
_BASE_ROWS = f"SELECT range AS key, range * 10000 AS balance FROM range({JOB.accounts})"
_MADE = f"""SELECT range AS bid, CASE WHEN {_uniform('range', 16)} < {JOB.deposit_share} THEN 'deposit' ELSE 'transfer' END AS f, {_zipf(_uniform('range', 17), JOB.accounts, JOB.skew)} AS s,
  ({_zipf(_uniform('range', 17), JOB.accounts, JOB.skew)} + 1 + CAST(floor({_uniform('range', 18)} * {JOB.accounts - 1}) AS BIGINT)) % {JOB.accounts} AS d,
  CAST(floor({_uniform('range', 19)} * 10000) AS BIGINT) AS v, {_uniform('range', 20)} < {JOB.abort_share} AS ab FROM range({JOB.events})"""


def generated_state(spark):
    return R.initial_state(spark, JOB.accounts, {"balance": "long"}).select(F.col("Key").cast("long").alias("key"), (F.col("balance") * 10_000).alias("balance"))


@query("generated_ledger", _mixed_serial(f"SELECT * FROM ({_MADE}) WHERE f = 'transfer' AND NOT ab", f"SELECT {JOB.accounts} AS n", _BASE_ROWS, _BASE_ROWS)
       + "SELECT bid, CASE WHEN ok THEN a[s + 1] || ',' || a[d + 1] ELSE 'aborted' END AS result FROM r WHERE rn > 0")
def generated_ledger(spark, sf):
    """The transfers of a generated job, by hash and Zipf keys, run as a ledger."""
    made = JOB.ledger(spark).where("flag = 'transfer' and not is_abort")
    return ledger.results(ledger.transfers(made.select("bid", "src", "dest", "amount"), generated_state(spark)))


@query("generated_mixed", _mixed_serial(_MADE, f"SELECT {JOB.accounts} AS n", _BASE_ROWS, _BASE_ROWS) + f"SELECT bid, {_MIXED_RESULT} FROM r WHERE rn > 0")
def generated_mixed(spark, sf):
    """All events of a generated job: deposits, transfers and those that are to abort, over two tables."""
    base = generated_state(spark)
    state = base.select(F.explode(F.array(*(F.lit(t) for t in ledger.TABLES))).alias("tbl"), "key", "balance")
    return ledger.mixed_results(ledger.mixed(JOB.ledger(spark), state))
