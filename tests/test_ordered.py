"""Running values over ranges against one walk over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labeling, pit
from tidemark.operators.ordered import Ordered, positions


@pytest.fixture(autouse=True, scope="module")
def several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SCHEMA = "k string, at int, id int, v int"


def rows(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "a", None]), rnd.randint(0, n // 2), i, rnd.choice([None, rnd.randint(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("n", [0, 1, 400])
def test_running_values(spark, keys, n):
    df = spark.createDataFrame(rows(n), SCHEMA).repartition(3)
    w = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max(F.struct("v", "id")).over(w), "l": F.last("v", ignorenulls=True).over(w)})
    got = Ordered(df, ["at", "id"], keys).running(s=("sum", F.col("v")), m=("max", F.struct("v", "id")), l=("last", F.col("v")))
    lazy = Ordered(df, ["at", "id"], keys, ranges=F.floor(F.col("at") / 7)).running(s=("sum", F.col("v")), m=("max", F.struct("v", "id")), l=("last", F.col("v")))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) == key(lazy)
    if n > 1:
        assert got.select("s").count() == n and Ordered(df, ["at", "id"], keys).rows.select("_range").distinct().count() > 1


def test_positions_need_no_single_partition(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    got = positions(df, ["at", "id"])
    assert [r.pos for r in got.orderBy("at", "id").collect()] == list(range(300))


@pytest.mark.parametrize("equal, hot", [([], False), (["k"], True)])
def test_as_of_over_ranges(spark, equal, hot):
    day, rnd = datetime(2024, 1, 1), random.Random(3)
    facts = [(rnd.choice("ab"), day + timedelta(d), day + timedelta(d + rnd.randint(0, 5)), float(i)) for i, d in enumerate(rnd.choices(range(40), k=120))]
    asks = [(rnd.choice("abc"), i, day + timedelta(rnd.choice([7, 7, 7, rnd.randint(-2, 50)]))) for i in range(150)]  # many of one time
    got = pit.as_of(spark.createDataFrame(asks, "k string, id int, t timestamp"), spark.createDataFrame(facts, "k string, ts timestamp, as_of timestamp, value double"), ["id"], "t", "value", equal, hot)
    for r in got.collect():
        seen = [(f[1], f[2], f[3]) for f in facts if f[1] <= r.t and f[2] <= r.t and (not equal or f[0] == r.k)]
        assert r.value == (max(seen)[2] if seen else None)
    assert got.count() == 150


def test_uniqueness_without_keys_equals_one_key(spark):
    day, rnd = datetime(2024, 1, 1), random.Random(4)
    own = [(i, day + timedelta(a := rnd.randint(0, 30)), rnd.choice([None, day + timedelta(a + rnd.randint(-1, 9))]), 0) for i in range(200)]
    df = spark.createDataFrame(own, "id int, ts timestamp, t1 timestamp, all int")
    whole = {r.id: r.weight for r in labeling.uniqueness(df, ["all"]).collect()}
    assert {r.id: r.weight for r in labeling.uniqueness(df).collect()} == pytest.approx(whole)
