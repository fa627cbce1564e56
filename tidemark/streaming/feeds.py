"""Structured Streaming: file-fed bars, sessions, vintages and the push feed.

Late facts are handled by the point-in-time rule: a fact counts from when it is known. Watermarks only bound state.
"""

from __future__ import annotations

import pickle
import threading
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampType

from tidemark.operators.sinks import newest, spread


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream; ``ts`` as an instant, as event time needs."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    single = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return single.parquet(f"{sf_dir}/{table}.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Bars of event values by type and window; state older than the watermark is dropped."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy("event_type", F.window("ts", width).alias("w"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
        .select("event_type", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_counts(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("ts"), "n")


def once_each(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event once within the watermark: repeats are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_vintage(stream: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 256) -> DataFrame:
    """The rows of ``stream`` that were the newest of their key when they came, by ``order`` (``as_of``, then what breaks ties), with ``revision``: 0 for a key's
    first, then 1, 2, ... for each correction.

    A later vintage corrects what was sent, an earlier one that comes late is no news, and one that comes again repeats nothing. State is the order and
    revision of a key's newest row. A row without an ``order`` was never known and is left out. Of the rows of one micro-batch only the newest is sent.
    Keys are met a bucket at a time, not one by one; each of ``buckets`` (fixed for the life of a checkpoint) has a table of its keys as its state.
    """
    keys, order = list(keys), list(order)
    schema = StructType([*stream.schema.fields, StructField("revision", LongType())])
    fields = [f.name for f in stream.schema.fields]
    # Instants as numbers: a local time may stand for two.
    instants = [f.name for f in stream.schema.fields if f.name in {*keys, *order} and f.dataType == TimestampType()]
    known = stream.dropna(subset=order).withColumns({c: F.unix_micros(c) for c in instants})
    # In a group each key column has a null in all rows or in none, so whole numbers stay whole.
    nulls = F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys])
    dealt = known.withColumns({"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)), "_nulls": nulls})
    inner = StructType([*known.schema.fields, StructField("revision", LongType())])

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, kind="stable").drop_duplicates(keys, keep="last")

    def walk(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, more, n = None, [], 0
        for pdf in parts:  # the newest of each key are kept, whatever the number of rows
            more.append(last(pdf[fields]))
            n += len(more[-1])
            if n > 50_000 and n > 2 * (len(fresh) if fresh is not None else 0):
                fresh, more, n = last(pd.concat([*([] if fresh is None else [fresh]), *more], ignore_index=True)), [], 0
        fresh = last(pd.concat([*([] if fresh is None else [fresh]), *more], ignore_index=True)).reset_index(drop=True)
        slim = fresh[[*dict.fromkeys([*keys, *order])]].assign(revision=np.int64(-1), _at=np.arange(len(fresh)))
        if state.exists:
            held = pickle.loads(state.get[0]).assign(_at=np.int64(-1))
            slim = pd.concat([slim, held], ignore_index=True)  # what is held comes after what is alike, and so stays
            slim["revision"] = slim.groupby(keys, dropna=False, sort=False)["revision"].transform("max")
        slim = last(slim)
        news = (slim["_at"] >= 0).to_numpy()
        slim["revision"] += news.astype(np.int64)
        state.update((pickle.dumps(slim.drop(columns="_at").reset_index(drop=True)),))
        at, revision = slim["_at"].to_numpy()[news], slim["revision"].to_numpy()[news]
        for k in range(0, len(at), 50_000):
            yield fresh.iloc[at[k : k + 50_000]].assign(revision=revision[k : k + 50_000])

    out = dealt.groupBy("_bucket", "_nulls").applyInPandasWithState(walk, inner, "held binary", "update", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in instants}).select(*[f.name for f in schema.fields])


#: What a stream's group remembers: facts by when they take effect, and the questions; what these were told follows from the facts.
_FACT = np.dtype([("at", "i8"), ("ts", "i8"), ("as_of", "i8"), ("value", "f8")])
_ASK = np.dtype([("at", "i8"), ("id", "i8")])


def _newest_by(facts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each time the place of the newest fact that has taken effect, -1 for none; ``facts`` in order of ``at``."""
    rank = np.empty(len(facts), np.int64)
    rank[np.lexsort((facts["value"], facts["as_of"], facts["ts"]))] = np.arange(len(facts))
    running = np.maximum.accumulate(rank)
    place = np.argsort(rank)
    found = np.searchsorted(facts["at"], at, side="right") - 1
    return np.where(found >= 0, place[running[np.maximum(found, 0)]] if len(facts) else 0, -1)


def _answers(facts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each time the newest fact that has taken effect (zeros for none), and whether there is none."""
    if not len(facts):
        return np.zeros(len(at), _FACT), np.ones(len(at), bool)
    found = _newest_by(facts, at)
    none = found < 0
    out = facts[found]
    out[none] = np.zeros(1, _FACT)[0]
    return out, none


def _front(facts: np.ndarray) -> np.ndarray:
    """Those of ``facts`` that are the newest at some time, in order of ``at``: the others can't be told, whatever is asked or comes later."""
    facts = facts[np.lexsort((facts["value"], facts["as_of"], facts["ts"], facts["at"]))]
    best = _newest_by(facts, facts["at"])
    return facts[np.unique(best)] if len(facts) else facts


class _Gathered:
    """Facts that arrive in parts; what can't be told any more is dropped on the way."""

    def __init__(self, held: np.ndarray):
        self.held, self.more, self.n = held, [], 0

    def add(self, facts: np.ndarray) -> None:
        self.more.append(facts)
        self.n += len(facts)
        if self.n > max(100_000, len(self.held)):
            self.all()

    def all(self) -> np.ndarray:
        if self.more:
            self.held, self.more, self.n = _front(np.concatenate([self.held, *self.more])), [], 0
        return self.held


#: Rows of answers that are made at once.
_TOLD = 100_000


def as_of(asks: DataFrame, facts: DataFrame, equal: Sequence[str], late: str | None = None, salts: int = 1) -> DataFrame:
    """``equal, id, t, value, known_at`` for the questions ``asks`` (``equal, id, t``): the newest of ``facts`` (``equal, ts, as_of, value``) that had happened and was
    known by ``t``, newest event first, then newest vintage; what ``pit.as_of`` gives for whole tables.

    Both are streams and may come in any order. A question is answered as soon as it is there; a fact that comes later but was known by its time
    corrects the answer, which is sent again (the last one sent counts). A question that comes again with the same id is not told again.
    Of the facts only those are held that are the newest at some time: no question, however late, is answered by another.
    With ``late`` both clocks have a watermark: facts behind it fold into the one newest, questions behind it are settled, and state is bounded; rows that come
    later still are dropped. Without it nothing is ever settled. Questions of one ``equal`` are spread over ``salts`` groups, each of which has its facts.
    """
    equal = list(equal)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("long")
    line = asks.select(*equal, F.col("t").cast("timestamp").alias("_at"), F.col("id").cast("long").alias("_id"), none.alias("_ts"), none.alias("_as_of"), F.lit(None).cast("double").alias("_value"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("_salt"))
    told = facts.where("ts IS NOT NULL AND as_of IS NOT NULL").select(
        *equal, F.greatest(F.col("ts").cast("timestamp"), F.col("as_of").cast("timestamp")).alias("_at"), none.alias("_id"), micros("ts").alias("_ts"), micros("as_of").alias("_as_of"),
        F.col("value").cast("double").alias("_value"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"),
    )
    both = line.unionByName(told).where("_at IS NOT NULL")
    timeout = GroupStateTimeout.NoTimeout
    if late:
        both, timeout = both.withWatermark("_at", late), GroupStateTimeout.EventTimeTimeout
    both = both.withColumn("_micros", F.unix_micros("_at"))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in equal), "id long, at long, value double, known long"])

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, open_asks = pickle.loads(state.get[0]) if state.exists else (np.zeros(0, _FACT), np.zeros(0, _ASK))
        if not state.hasTimedOut:
            fresh, asked = _Gathered(held), [open_asks]
            for pdf in parts:
                ask = pdf["_id"].notna()
                own = pdf[~ask]
                made = np.zeros(len(own), _FACT)
                made["at"], made["ts"], made["as_of"], made["value"] = own["_micros"], own["_ts"], own["_as_of"], own["_value"]
                fresh.add(made)
                own = pdf[ask]
                made = np.zeros(len(own), _ASK)
                made["at"], made["id"] = own["_micros"], own["_id"]
                asked.append(made)
            before, held, old = held, fresh.all(), len(open_asks)
            open_asks = np.concatenate(asked)
            del asked, fresh
            if len(open_asks) > old:  # the first of an id stands
                open_asks = open_asks[np.sort(np.unique(open_asks["id"], return_index=True)[1])]
            for k in range(0, len(open_asks), _TOLD):
                questions = open_asks[k : k + _TOLD]
                answer, none = _answers(held, questions["at"])
                told, untold = _answers(before, questions["at"])
                same = (none == untold) & (answer["ts"] == told["ts"]) & (answer["as_of"] == told["as_of"]) & ((answer["value"] == told["value"]) | np.isnan(answer["value"]) & np.isnan(told["value"]))
                moved = ~same | (np.arange(k, k + len(questions)) >= old)
                out, answer, gone = questions[moved], answer[moved], none[moved]
                if len(out):
                    rows = {k: v for k, v in zip(equal, key, strict=False)}
                    yield pd.DataFrame({**{k: [v] * len(out) for k, v in rows.items()}, "id": out["id"], "at": out["at"], "value": pd.array(np.where(gone, np.nan, answer["value"])), "known": pd.Series(answer["as_of"]).astype("Int64").where(~gone)})
        if late:
            passed = state.getCurrentWatermarkMs() * 1000
            old = held["at"] <= passed
            if old.sum() > 1:  # of those that no open question can tell apart, the newest
                front = held[old][_newest_by(held[old], np.array([passed]))[0]]
                held = np.concatenate([np.array([front], _FACT), held[~old]])
                held = held[np.argsort(held["at"], kind="stable")]
            open_asks = open_asks[open_asks["at"] > passed]
            if len(open_asks):
                state.setTimeoutTimestamp(int(max(passed, open_asks["at"].min()) // 1000 + 1))
        state.update((pickle.dumps((held, open_asks)),))

    out = both.groupBy(*equal, "_salt").applyInPandasWithState(walk, schema, "held binary", "update", timeout)
    return out.select(*equal, "id", F.timestamp_micros("at").alias("t"), F.nanvl("value", F.lit(None).cast("double")).alias("value"), F.timestamp_micros("known").alias("known_at"))


def frames(kind: str, rows: DataFrame) -> DataFrame:
    """``kind, data`` of a stream of rows: what subscribers get."""
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("data"))


def run_available(stream: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there, to its end, and gives the last state of each key.

    Every micro-batch appends its changes under ``path`` with its number; the checkpoint beside them is the high-water mark,
    so a second run takes up where the first ended and repeats nothing.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    found = spark.read.schema(StructType([*schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/out/batch=*")
    return newest(spread(found, keys), keys, ["_batch"]).drop("_batch")


class Hub:
    """A ring of the last ``capacity`` frames. Each subscriber reads at its own pace; only one that has fallen behind by more than the ring skips, and is told how many.

    ``publish`` lets subscribers catch up before it overwrites what they have not read, for at most ``patience`` seconds: the fast lose nothing, and
    the slow hold nobody up for longer. Without subscribers frames are forgotten.
    """

    def __init__(self, capacity: int = 256, patience: float = 1.0):
        self.capacity, self.patience = capacity, patience
        self._ring: deque[str] = deque(maxlen=capacity)
        self._next = 0  # the number of the next frame
        self._changed = threading.Condition()
        self._readers: set[Subscriber] = set()

    def subscribe(self) -> Subscriber:
        """Reads from the next frame on."""
        with self._changed:
            reader = Subscriber(self, self._next)
            self._readers.add(reader)
            return reader

    def publish(self, frame: str) -> None:
        with self._changed:
            oldest = self._next - self.capacity
            behind = lambda: any(r.at <= oldest and not r.lagging for r in self._readers)
            if not self._changed.wait_for(lambda: not behind(), self.patience):
                for r in self._readers:
                    r.lagging = r.lagging or r.at <= oldest  # not waited for again until it has caught up
            self._ring.append(frame)
            self._next += 1
            self._changed.notify_all()


class Subscriber:
    def __init__(self, hub: Hub, at: int):
        self.hub, self.at, self.lagging, self.skipped = hub, at, False, 0

    def read(self, timeout: float = 0.0) -> list[str]:
        """The frames since the last call, in order; waits for one up to ``timeout`` seconds. ``skipped`` counts those that were lost to lagging."""
        hub = self.hub
        with hub._changed:
            hub._changed.wait_for(lambda: hub._next > self.at, timeout)
            first = hub._next - len(hub._ring)
            if self.at < first:
                self.skipped += first - self.at
                self.at = first
            out = [hub._ring[i - first] for i in range(self.at, hub._next)]
            self.at, self.lagging = hub._next, False
            hub._changed.notify_all()
            return out

    def close(self) -> None:
        with self.hub._changed:
            self.hub._readers.discard(self)
            self.hub._changed.notify_all()


def push(stream: DataFrame, path: str, hub: Hub, order: str = "data", every: str = "2 seconds", available: bool = False):
    """Publishes every frame of each micro-batch (``kind, data`` and whatever ``order`` names), in ``order``; runs until stopped, with ``available`` to the end of what is there.

    Frames reach the driver one partition at a time, so neither a burst nor a backlog is held there whole. A micro-batch that is run again after a failure
    is published again: subscribers see each frame at least once.
    """

    def write(batch: DataFrame, number: int) -> None:
        for row in batch.orderBy(order).select("data").toLocalIterator():
            hub.publish(row.data)

    pace = {"availableNow": True} if available else {"processingTime": every}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(**pace).start()
