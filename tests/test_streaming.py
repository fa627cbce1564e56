"""Streams that keep state: vintages, questions and facts in any order of arrival, and the push feed."""

import random
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.streaming import feeds

DAY = datetime(2024, 1, 1)


def arriving(spark, path, schema, batches):
    """A stream of files, one micro-batch each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b={k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b=*")


def sent(stream, path):
    """All rows that a stream sends, in order of micro-batch."""
    out = []

    def write(batch, number):
        out.extend((number, r) for r in batch.collect())

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return out


def test_later_vintage_corrects(spark, tmp_path):
    schema = "series string, ts timestamp, as_of timestamp, value double"
    row = lambda s, d, known, v: (s, DAY + timedelta(d), DAY + timedelta(known), v)
    batches = [
        [row("cpi", 0, 10, 1.0), row("cpi", 1, 11, 2.0)],
        [row("cpi", 0, 40, 1.5)],  # a correction
        [row("cpi", 0, 40, 1.5), row("cpi", 1, 5, 9.0)],  # a retry, and an earlier vintage that comes late
        [row("cpi", 0, 20, 7.0), row("cpi", 0, 50, 1.6), row("cpi", 0, 45, 8.0), ("cpi", DAY, None, 3.0)],
    ]
    stream = feeds.latest_vintage(arriving(spark, str(tmp_path / "in"), schema, batches), ["series", "ts"], ["as_of", "value"])
    got = [(r.ts, r.value, r.revision) for _, r in sent(stream, str(tmp_path / "state"))]
    assert sorted(got[:2]) == [(DAY, 1.0, 0), (DAY + timedelta(1), 2.0, 0)]
    assert got[2:] == [(DAY, 1.5, 1), (DAY, 1.6, 2)]


def facts_and_asks(seed):
    rnd = random.Random(seed)
    facts = []
    for k in ("a", "b"):
        for d in rnd.sample(range(60), 25):
            for lag in rnd.sample(range(9), rnd.randint(1, 3)):
                facts.append((k, DAY + timedelta(d), DAY + timedelta(d + lag, hours=rnd.randint(0, 20)), float(rnd.randint(1, 99))))
    asks = [(k, i, DAY + timedelta(rnd.randint(-2, 70), hours=rnd.choice([0, 5]))) for i, k in enumerate("abc" * 40)]
    return facts, asks


FACTS, ASKS = "k string, ts timestamp, as_of timestamp, value double", "k string, id long, t timestamp"


@pytest.mark.parametrize("seed, salts", [(1, 1), (2, 3)])
def test_as_of_in_any_order_of_arrival(spark, tmp_path, seed, salts):
    facts, asks = facts_and_asks(seed)
    whole = pit.as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(facts, FACTS), ["k"], "t", "value", equal=["k"])
    want = {r.id: r.value for r in whole.collect()}
    rnd = random.Random(seed)
    rnd.shuffle(facts)
    rnd.shuffle(asks)
    cut = lambda rows, n: [rows[i::n] for i in range(n)]
    late = cut(facts, 4)
    stream = feeds.as_of(arriving(spark, str(tmp_path / "asks"), ASKS, [*cut(asks, 3), asks[:5]]), arriving(spark, str(tmp_path / "facts"), FACTS, [late[3], *late]), ["k"], salts=salts)
    got = sent(stream, str(tmp_path / "state"))
    last = {r.id: r.value for _, r in got}
    assert last == want
    told = [(r.id, r.value, r.known_at) for _, r in got]
    assert all(a != b for i in want for a, b in zip([t for t in told if t[0] == i], [t for t in told if t[0] == i][1:], strict=False))  # nothing is repeated


def test_watermark_settles_and_bounds_state(spark, tmp_path):
    # In order of time, in steps of ten days: with a watermark of five days the answers are those of the whole table.
    facts, asks = facts_and_asks(5)
    effective = lambda f: max(f[1], f[2])
    step = lambda t: (t - DAY).days // 10
    want = {r.id: r.value for r in pit.as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(facts, FACTS), ["k"], "t", "value", equal=["k"]).collect()}
    by = lambda rows, t: [[r for r in rows if step(t(r)) == s] or [] for s in range(-1, 9)]
    asked, told = by(asks, lambda a: a[2]), by(facts, effective)
    stream = feeds.as_of(arriving(spark, str(tmp_path / "asks"), ASKS, asked), arriving(spark, str(tmp_path / "facts"), FACTS, told), ["k"], late="5 days")
    assert {r.id: r.value for _, r in sent(stream, str(tmp_path / "state"))} == want


def test_only_a_lagging_subscriber_skips():
    hub = feeds.Hub(capacity=8, patience=0.5)
    fast, slow, got = hub.subscribe(), hub.subscribe(), []
    done = threading.Event()

    def follow():
        while not done.is_set() or hub._next > fast.at:
            got.extend(fast.read(0.05))

    reader = threading.Thread(target=follow)
    reader.start()
    for i in range(500):
        hub.publish(str(i))
    done.set()
    reader.join()
    assert got == [str(i) for i in range(500)] and fast.skipped == 0
    assert slow.read() == [str(i) for i in range(492, 500)] and slow.skipped == 492
    slow.close()
    hub.publish("x")
    assert fast.read() == ["x"] and slow.read() and hub.subscribe().read() == []


def test_push_publishes_every_frame_in_order(spark, tmp_path):
    schema = "at timestamp, note string"
    batches = [[(DAY + timedelta(minutes=1000 * b + i), f"n{b}-{i}") for i in range(300)] for b in range(3)]
    rows = arriving(spark, str(tmp_path / "in"), schema, batches)
    hub = feeds.Hub(capacity=64, patience=20)
    reader, got, done = hub.subscribe(), [], threading.Event()

    def follow():
        while not done.is_set() or hub._next > reader.at:
            got.extend(reader.read(0.1))

    thread = threading.Thread(target=follow)
    thread.start()
    framed = feeds.frames("note", rows).withColumn("at", F.get_json_object("data", "$.at"))
    feeds.push(framed, str(tmp_path / "state"), hub, order="at", available=True).awaitTermination()
    done.set()
    thread.join()
    assert len(got) == 900 and reader.skipped == 0
    assert [g.split('"note":"')[1][:-2] for g in got] == [f"n{b}-{i}" for b in range(3) for i in range(300)]


def test_vintages_of_many_keys_take_no_step_for_each(spark, tmp_path):
    # 40,000 keys, some null, over two micro-batches: Python is called for buckets, and large ids beside nulls stay whole.
    big = 2**60
    schema = "id long, day timestamp, n long, value double"
    first = [(None if i % 7 == 0 else big + i, DAY + timedelta(i % 5), 1, float(i)) for i in range(40_000)]
    newest = {(i, d): v for i, d, _, v in sorted(first, key=lambda r: r[3])}
    later = [(i, d, 2 if k % 2 else 0, -float(k)) for k, (i, d, _, _) in enumerate(first[:1000])]
    stream = feeds.latest_vintage(arriving(spark, str(tmp_path / "in"), schema, [first, later]), ["id", "day"], ["n", "value"], buckets=8)
    began = time.monotonic()
    got = sent(stream, str(tmp_path / "state"))
    assert time.monotonic() - began < 60
    assert {(r.id, r.day): r.value for b, r in got if b == 0} == newest and {r.revision for b, r in got if b == 0} == {0}
    want = {(i, d): v for i, d, n, v in sorted(later, key=lambda r: r[3]) if n == 2}
    assert {(r.id, r.day): (r.value, r.revision) for b, r in got if b == 1} == {k: (v, 1) for k, v in want.items()}


def test_only_facts_that_can_be_told_are_held():
    rng = np.random.default_rng(3)
    facts = np.zeros(200_000, feeds._FACT)
    facts["ts"] = rng.integers(0, 10_000, len(facts))
    facts["as_of"] = facts["ts"] + rng.integers(1, 500, len(facts))
    facts["at"], facts["value"] = facts["as_of"], rng.integers(0, 9, len(facts))
    asked = rng.integers(-5, 11_000, 5_000)
    whole = np.sort(facts, order=["at", "ts", "as_of", "value"])
    gathered = feeds._Gathered(np.zeros(0, feeds._FACT))
    most = 0
    for part in np.array_split(facts, 40):
        gathered.add(part)
        most = max(most, len(gathered.held))
    held = gathered.all()
    at, before = feeds._newest_by(held, asked), feeds._newest_by(whole, asked)
    assert ((at < 0) == (before < 0)).all() and (held[at][at >= 0] == whole[before][at >= 0]).all()
    assert len(held) <= 10_500 and most <= 10_500  # at most one for each instant, of 200,000
