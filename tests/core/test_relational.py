import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import relational as R, stats
from tidewater.plans import pipeline as PL


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("a", 1), ("c", 2), ("zz", 3), (None, 4)], "w string, n int")


def test_strings_compare_by_order(words):
    got = R.Query.table(words).where("w", R.Predicate.LESS_THAN, "c").project("w").to_df().collect()
    assert [r.w for r in got] == ["a"]


def test_errors(spark, words):
    with pytest.raises(AnalysisException):
        R.Query.table(words).where("missing", R.Predicate.EQUALS, 1).to_df().collect()
    with pytest.raises(TypeError):
        R.Query.table(words).join(words.withColumnRenamed("w", "x").withColumnRenamed("n", "m"), "w", "m")
    with pytest.raises(ValueError):
        R.Query.table(words).group_by("w").count().project("n").to_df()
    with pytest.raises(ValueError):
        R.Query.table(words).project()


def test_empty_table(words):
    empty = words.limit(0)
    assert R.Query.table(empty).count().average("n").to_df().first().asDict() == {"countAgg": 0, "averageAgg": 0.0}
    assert stats.histogram(empty, "n").count() == 0
    assert stats.histogram(words.where("n = 2"), "n").first().n == 1


def test_initial_state(spark):
    rows = R.initial_state(spark, 3, {"balance": "double", "note": "string"}).collect()
    assert [(r.Key, r.balance, r.note) for r in rows] == [("0", 0.0, None), ("1", 1.0, None), ("2", 2.0, None)]


def test_maintenance(spark, words):
    changed = R.update(words, spark.createDataFrame([("c", None)], "w string, n int"), "w")
    assert {(r.w, r.n) for r in changed.collect()} == {("a", 1), ("c", None), ("zz", 3), (None, 4)}
    assert {r.w for r in R.delete(words, words.where("w = 'a'"), "w").collect()} == {"c", "zz", None}
    assert R.upsert(words, spark.createDataFrame([("a", 9), ("q", 8)], "w string, n int"), "w").count() == 5
    assert R.insert(words, words).count() == 8


def test_predicates_reach_the_scan(spark):
    df = R.Query.table(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).where("l_quantity", R.Predicate.GREATER_THAN, 10.0).project("l_orderkey").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan


def test_scalars(spark):
    r = spark.sql("select date'2024-01-05' a, date'2024-01-08' b, '-12' t, '1x' u, timestamp'2024-01-01 10:20:30.123456' ts").select(
        scalar.working_days(F.col("a"), F.col("b")), scalar.working_days(F.col("a"), F.col("a")), scalar.is_integer(F.col("t")), scalar.is_integer(F.col("u")),
        scalar.micros_of_milli(F.col("ts")), scalar.fixed_length(F.lit("abc"), 2)).first()
    assert tuple(r) == (1, 0, True, False, 456, "ab")
    u, v = scalar.uniform(1, F.col("id")), scalar.uniform(2, F.col("id"))
    m = spark.range(20_000).select(scalar.gaussian(u, v).alias("g"), scalar.binomial([u, v], 0.5).alias("b"), scalar.by_share(u, {"hot": 8, "cold": 2}).alias("s")).agg(
        F.avg("g"), F.stddev("g"), F.avg("b"), F.avg((F.col("s") == "hot").cast("int"))).first()
    assert abs(m[0]) < 0.05 and abs(m[1] - 1) < 0.05 and abs(m[2] - 1) < 0.05 and abs(m[3] - 0.8) < 0.02


def test_topology(spark, words):
    t = PL.Topology().source("in", words).stream("small", "in", F.col("n") < 3).operator("both", lambda a, b: a.unionByName(b), "in", "small").sink("n", lambda df: df.count(), "both")
    assert t.run() == {"n": 6}
    with pytest.raises(ValueError):
        t.source("in", words)
    with pytest.raises(ValueError):
        t.operator("x", lambda a: a, "nowhere")
    with pytest.raises(ValueError):
        PL.JobConfig("x", events=0)
    assert PL.partial_key_sums(words.withColumn("k", F.lit(1)), "k", "n").first().total == 10
