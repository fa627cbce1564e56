"""The keyed table: what a write touches, what a reader sees, and what compaction leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks

SCHEMA = "k int, v double, note string"


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return sinks.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_random_writes_match_a_dict(spark, table):
    rnd, want = random.Random(4), {}
    for step in range(14):
        new = {k: (rnd.choice([None, float(rnd.randint(1, 9))]), rnd.choice([None, f"n{step}"])) for k in rnd.sample(range(60), 12)}
        df = frame(spark, [(k, *v) for k, v in new.items()])
        kind = rnd.choice(["upsert", "fill", "insert", "delete", "compact"])
        if kind == "upsert":
            table.upsert(df)
            want |= new
        elif kind == "fill":
            table.fill(df)
            want |= {k: tuple(a if a is not None else b for a, b in zip(want.get(k, (None, None)), v, strict=True)) for k, v in new.items()}
        elif kind == "insert":
            table.insert(df)
            want = new | want
        elif kind == "delete":
            table.delete(F.col("k").isin(list(new)[:5]) | F.col("v").isNull())
            want = {k: v for k, v in want.items() if k not in list(new)[:5] and v[0] is not None}
        else:
            table.compact()
        assert rows(table) == sorted((k, *v) for k, v in want.items()), (step, kind)


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(frame(spark, [(k, 1.0, "a") for k in range(200)]))
    before = files(table.path)
    bucket = lambda k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k).cast("int")), F.lit(8))).first()[0]
    table.upsert(frame(spark, [(3, 2.0, "b")]))
    table.upsert(frame(spark, [(3, 3.0, "c")]))
    assert files(table.path).items() >= before.items() and len(files(table.path)) == len(before) + 2  # one file a write
    assert table.compact() == [bucket(3)]
    assert files(table.path).items() >= before.items()
    new_base = {p for p in files(table.path) if p not in before and p.parent.parent.name.startswith("v4-")}
    assert {p.parent.name for p in new_base} == {f"bucket={bucket(3)}"}
    assert table.layout().buckets[bucket(3)] == [next(iter(new_base)).parent.parent.relative_to(table.path).as_posix()]
    assert table.vacuum() == 3 and rows(table) == sorted((k, 3.0 if k == 3 else 1.0, "c" if k == 3 else "a") for k in range(200))


def test_old_versions_dead_writers_and_rivals(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, 1.0, None)]))
    seen = table.layout().version
    monkeypatch.setattr(table, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(frame(spark, [(1, 9.0, None), (2, 9.0, None)]))  # dies after its files are written
    monkeypatch.undo()
    assert rows(table) == [(1, 1.0, None)]
    table.upsert(frame(spark, [(1, 2.0, None)]))
    assert rows(table) == [(1, 2.0, None)] and rows(table, seen) == [(1, 1.0, None)]
    with pytest.raises(Exception, match="(?i)exists"):
        table._commit(table.layout().version, {"kind": "delta", "dir": "x", "touched": []})
    again = sinks.KeyedTable(spark, table.path, SCHEMA, ["k"], buckets=99)
    assert again.n_buckets == 8 and rows(again) == [(1, 2.0, None)]


def test_deltas_are_folded_by_themselves_and_the_log_stays_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SNAPSHOT", 4)
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=1, most_deltas=2)
    for i in range(9):
        table.upsert(frame(spark, [(1, float(i), None), (i + 2, 0.0, None)]))
    assert table.layout().deltas(0) <= 2 and rows(table)[0] == (1, 8.0, None) and len(rows(table)) == 10
    table.delete(F.lit(True))
    table.compact()
    assert rows(table) == [] and table.layout().buckets == {}
    table.upsert(frame(spark, [(5, 5.0, "x")]))
    assert rows(table) == [(5, 5.0, "x")]


def test_rows_are_dealt_to_as_many_tasks_as_their_number_asks_for(spark):
    rows = spark.range(10_000).selectExpr("id % 2500 AS k", "id AS at", "id AS v")
    dealt = sinks.spread(rows, ["k"], 500)
    found = sinks.newest(dealt, ["k"], ["at"])
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == 20
    assert found.groupBy(F.spark_partition_id().alias("p")).count().count() == 20  # and are not dealt again
    assert {(r.k, r.v) for r in found.collect()} == {(k, 7500 + k) for k in range(2500)}
    assert sinks.spread(rows.limit(0), ["k"]).count() == 0
