"""Working days without a list of days."""

import datetime as D
import random

from pyspark.sql import functions as F

from tidewater.functions import scalar


def test_working_days(spark):
    rng, start = random.Random(2), D.date(1969, 12, 20)
    pairs = [(start + D.timedelta(rng.randrange(40)), start + D.timedelta(rng.randrange(40))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a date, b date").withColumn("n", scalar.working_days(F.col("a"), F.col("b")))
    for r in rows.collect():
        low, high = sorted((r.a, r.b))
        assert r.n == sum((low + D.timedelta(i)).weekday() < 5 for i in range(1, (high - low).days + 1))
    assert not any(x in rows._jdf.queryExecution().optimizedPlan().toString() for x in ("sequence(", "filter("))


def test_missing_dates_have_no_days_between(spark):
    rows = spark.createDataFrame([(None, D.date(2024, 1, 3)), (D.date(2024, 1, 3), None), (None, None), (D.date(1, 1, 1), D.date(9999, 12, 31))], "a date, b date")
    got = [r[0] for r in rows.select(scalar.working_days(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0, 0, 0] and got[3] == 2_608_614
