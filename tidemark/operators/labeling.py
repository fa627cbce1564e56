"""Labels from the path ahead: triple barrier, sizing, uniqueness; and the rule backtest with its cooldown."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Ordered


@dataclass(frozen=True)
class Profile:
    """The constants of a trading horizon."""

    name: str
    cadence: str
    min_hold: int
    max_hold: int
    target_atr: float
    stop_atr: float
    atr_lookback: int
    embargo: int
    slippage_bps: float = 1.0
    spread_bps: float = 1.0

    @property
    def purge(self) -> int:
        return self.max_hold

    @property
    def round_trip(self) -> float:
        """Cost of entry and exit as a fraction of the price."""
        return 2 * (self.slippage_bps + self.spread_bps) / 10_000


#: Horizons (fixed values): name, cadence, bars held at least and at most, target and stop in ATRs, ATR lookback, embargo.
PROFILES = {
    p.name: p
    for p in (
        Profile("swing", "daily", 2, 15, 2.0, 1.0, 14, 3),
        Profile("short_swing", "hourly", 2, 8, 1.5, 0.8, 14, 2),
        Profile("day", "min15", 2, 13, 1.2, 0.7, 14, 2),
        Profile("zero_dte", "min5", 1, 12, 1.0, 0.6, 14, 1),
        Profile("scalp", "min1", 1, 10, 0.8, 0.5, 14, 1),
    )
}
SWING = PROFILES["swing"]
#: Minutes of a bar of each cadence.
CADENCE_MINUTES = {"daily": 390, "hourly": 60, "min30": 30, "min15": 15, "min5": 5, "min1": 1}


def distance(kind: Column, value: Column, entry: Column, atr: Column, risk: Column | None = None) -> Column:
    """Of a stop or target in price: ``atr`` multiples, ``fixed`` amounts, ``pct`` of the entry, ``r`` multiples of the risk."""
    out = F.when(kind == "atr", value * atr).when(kind == "fixed", value).when(kind == "pct", entry * value / 100)
    return out if risk is None else out.when(kind == "r", value * risk)


def parse_spec(text: Column) -> Column:
    """``atr:1.0``, ``fixed:$5``, ``pct:2.5``, ``r:2`` as ``struct(kind, value)``; null if it is none of these, or not above 0."""
    kind = F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1))))
    value = F.regexp_replace(F.split_part(text, F.lit(":"), F.lit(2)), r"[$\s%]", "").try_cast("double")
    return F.when(kind.isin("atr", "fixed", "pct", "r") & (value > 0), F.struct(kind.alias("kind"), value.alias("value")))


def triple_barrier(entries: DataFrame, bars: DataFrame, max_hold: int = SWING.max_hold) -> DataFrame:
    """``entries`` (``ticker, idx, entry_px, side, target_dist, stop_dist``) with ``exit_idx, outcome, ret_r``.

    The first bar after the entry that reaches a barrier ends it; where one bar reaches both, the stop counts.
    Without either, the last bar of the holding time, or of the series, ends it at its close. An entry without a
    positive risk, or without a bar ahead, has no label and says why in ``reason``. One range join on the
    bar number, then one aggregate: no walk over bars.
    """
    keys = entries.columns
    own = entries.withColumn("target_px", F.col("entry_px") + F.col("side") * F.col("target_dist")).withColumn("stop_px", F.col("entry_px") - F.col("side") * F.col("stop_dist"))
    good = F.coalesce((F.col("stop_dist") > 0) & ~F.isnan("stop_dist") & (F.col("stop_dist") < float("inf")), F.lit(False))
    ahead = bars.select(F.col("ticker").alias("b_ticker"), F.col("idx").alias("b_idx"), "high", "low", "close")
    # Each entry meets its bars through an explode of at most max_hold numbers: an equi-join that can be split and spilled.
    steps = own.where(good).withColumn("b_idx", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + max_hold)))
    met = steps.join(ahead, (steps.ticker == ahead.b_ticker) & (steps.b_idx == ahead.b_idx)).drop(ahead.b_idx)
    long = F.col("side") > 0
    hit_target = F.when(long, F.col("high") >= F.col("target_px")).otherwise(F.col("low") <= F.col("target_px"))
    hit_stop = F.when(long, F.col("low") <= F.col("stop_px")).otherwise(F.col("high") >= F.col("stop_px"))
    hit = F.when(hit_stop, F.lit("stop")).when(hit_target, F.lit("target"))
    last = (
        met.withColumn("hit", hit)
        .groupBy(*keys, "target_px", "stop_px")
        .agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("b_idx", "hit"))).alias("first"), F.max(F.struct("b_idx", "close")).alias("end"))
    )
    outcome = F.coalesce("first.hit", F.lit("time"))
    ret = F.when(outcome == "stop", -1.0).when(outcome == "target", F.col("target_dist") / F.col("stop_dist")).otherwise(F.col("side") * (F.col("end.close") - F.col("entry_px")) / F.col("stop_dist"))
    done = last.select(*keys, "target_px", "stop_px", F.coalesce("first.b_idx", "end.b_idx").alias("exit_idx"), outcome.alias("outcome"), ret.alias("ret_r"), F.lit(None).cast("string").alias("reason"))
    rest = own.join(done.select("ticker", "idx"), ["ticker", "idx"], "left_anti")
    reason = F.when(~good, "no positive risk").otherwise("no bar ahead")
    return done.unionByName(rest.select(*keys, "target_px", "stop_px", F.lit(None).cast("int").alias("exit_idx"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("double").alias("ret_r"), reason.alias("reason")))


def greedy_cooldown(candidates: DataFrame, keys: Sequence[str], hold: int) -> DataFrame:
    """``keys, idx`` of the candidates taken in order, each barring the next ``hold`` bars.

    A fold over each group's sorted bar numbers (a few bytes a bar), then an explode.
    """
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, i: Column) -> Column:
        free = s["last"].isNull() | (i > s["last"] + hold)
        return F.when(free, F.struct(i.alias("last"), F.array_append(s["kept"], i).alias("kept"))).otherwise(s)

    kept = F.aggregate(F.array_sort(F.collect_list(F.col("idx").cast("int"))), start, step, lambda s: s["kept"])
    return candidates.groupBy(*keys).agg(kept.alias("kept")).select(*keys, F.explode("kept").alias("idx"))


def fires(predicates: Sequence[tuple[str, str, float]]) -> Column:
    """All of ``(column, op, threshold)`` hold; none at all, or a missing value, does not fire."""
    ops = {"gt": "__gt__", "lt": "__lt__", "gte": "__ge__", "lte": "__le__"}
    out = F.lit(bool(predicates))
    for name, op, threshold in predicates:
        out = out & F.coalesce(getattr(F.col(name), ops[op])(threshold), F.lit(False))
    return out


def fires_map(features: Column, predicates: Column) -> Column:
    """The same for predicates in data: an array of ``struct(feature_key, op, threshold)`` against a map."""

    def holds(p: Column) -> Column:
        v = F.try_element_at(features, p["feature_key"])
        return F.coalesce(
            F.when(p["op"] == "gt", v > p["threshold"]).when(p["op"] == "lt", v < p["threshold"]).when(p["op"] == "gte", v >= p["threshold"]).when(p["op"] == "lte", v <= p["threshold"]), F.lit(False)
        )

    return (F.size(predicates) > 0) & F.forall(predicates, holds)


def backtest(window: DataFrame, rule: Column, side: int = 1, profile: Profile = SWING, regime: str | None = None) -> DataFrame:
    """Labelled entries of a rule over a feature window (``ticker, idx, ts, close, atr`` and features).

    A bar is a candidate if the rule fires, its regime may be traded, and it can be labelled; the cooldown then takes
    candidates in order. All tickers in one job.
    """
    last = F.max("idx").over(Window.partitionBy("ticker"))
    ok = F.coalesce(rule, F.lit(False)) & (F.col("atr") > 0) & (F.col("idx") < last)
    if regime:
        ok = ok & (F.coalesce(F.col(regime), F.lit("")) != "out_of_distribution")
    candidates = window.withColumn("_ok", ok).where("_ok").select("ticker", "idx")
    taken = greedy_cooldown(candidates, ["ticker"], max(profile.min_hold, 1))
    entries = taken.join(window.select("ticker", "idx", "ts", F.col("close").alias("entry_px"), "atr"), ["ticker", "idx"]).select(
        "ticker", "idx", F.col("ts").alias("entry_ts"), "entry_px", F.lit(side).alias("side"), (F.col("atr") * profile.target_atr).alias("target_dist"), (F.col("atr") * profile.stop_atr).alias("stop_dist")
    )
    labelled = triple_barrier(entries, window, profile.max_hold)
    ends = window.select("ticker", F.col("idx").alias("exit_idx"), F.col("ts").alias("t1"))
    return labelled.join(ends, ["ticker", "exit_idx"], "left")


def meta_label(r: Column, threshold: float = 0.0) -> Column:
    return (r > threshold).cast("int")


def act_size(p: Column, tau: float, most: float = 1.0) -> Column:
    """0 under the threshold, then linear up to ``most`` at certainty."""
    return F.when(p >= tau, F.least(F.greatest((p - tau) / (1 - tau) * most, F.lit(0.0)), F.lit(most)) if tau < 1 else F.lit(most)).otherwise(0.0)


def uniqueness(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``spans`` (``id, ts, t1``) with the mean, over the distinct starts inside each, of one over the spans open there.

    The spans open at a point come from a running sum of +1 and -1; a span's mean from differences of running sums:
    sorts, where comparing spans with points would be quadratic. A span without an end, or that ends before it starts, is
    open at its start alone and weighs 1.
    """
    good = F.coalesce(F.col("t1") >= F.col("ts"), F.lit(False))
    end = F.when(good, F.col("t1")).otherwise(F.col("ts"))
    ends = [F.struct(F.col("ts").alias("p"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(end.alias("p"), F.lit(0).alias("up"), F.lit(1).alias("down"))]
    points = spans.select(*keys, F.explode(F.array(*ends)).alias("e")).select(*keys, "e.*")
    by_point = points.groupBy(*keys, "p").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    # A span is open at its own end, so ends count from the next point on; only starts are points.
    still = F.col("ups") - F.col("downs") + F.col("down")
    share = F.when(F.col("up") > 0, 1.0 / F.col("open")).otherwise(0.0).cast("decimal(28,18)")  # differences of running sums stay exact
    if keys:
        upto = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        opened = by_point.withColumns({"ups": F.sum("up").over(upto), "downs": F.sum("down").over(upto)}).withColumn("open", still)
        own = opened.withColumns({"own": share, "is_point": (F.col("up") > 0).cast("int")})
        run = own.withColumns({"share": F.sum("own").over(upto), "n": F.sum("is_point").over(upto)})
    else:  # one order of all points: ranges that start from the sums before them
        opened = Ordered(by_point, ["p"]).running(ups=("sum", F.col("up")), downs=("sum", F.col("down"))).withColumn("open", still)
        own = opened.withColumns({"own": share, "is_point": (F.col("up") > 0).cast("int")})
        run = Ordered(own, ["p"]).running(share=("sum", F.col("own")), n=("sum", F.col("is_point")))
    a = run.select(*keys, F.col("p").alias("ts"), (F.col("share") - F.col("own")).alias("s0"), F.col("n").alias("n0"))
    b = run.select(*keys, F.col("p").alias("t1"), F.col("share").alias("s1"), F.col("n").alias("n1"))
    out = spans.join(a, [*keys, "ts"], "left").join(b, [*keys, "t1"], "left")
    mean = (F.col("s1") - F.col("s0")).cast("double") / (F.col("n1") - F.col("n0") + 1)
    return out.select(*spans.columns, F.when(good, mean).otherwise(1.0).alias("weight"))


def effective_n(weight: Column) -> Column:
    """Kish's effective number of observations."""
    return F.pow(F.sum(weight), 2) / F.sum(weight * weight)
