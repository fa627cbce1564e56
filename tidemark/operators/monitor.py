"""Forward-adaptation monitor: detectors over closed trades, feeds and labels, each one grouped aggregate.

A detector gives a row where it fires: its key, ``detector, action, metric, threshold``. Trades are taken in order
of time wherever a path counts, and calibration looks at closed trades only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.pit import top_one

#: Thresholds (fixed values).
DIVERGENCE_MIN, SHRINK_R, SHRINK_Z, QUARANTINE_R, QUARANTINE_Z = 10, 0.25, 1.64, 0.50, 2.33
DECAY_MIN, DECAY_Z = 15, 1.64
DRAWDOWN_MIN, CVAR_FLOOR, MAX_DRAWDOWN = 10, -2.0, -6.0
CALIBRATION_MIN, CALIBRATION_GAP = 20, 0.15
STALE_HOURS = 48.0
OOD_COUNT, OOD_DAYS = 3, 5
TRADE_DAYS = 60

#: What an action does to a strategy's status; others leave it.
STATUS_AFTER = {"quarantine": "quarantined", "demote": "demoted", "disable": "disabled"}


def _row(detector: str, action: Column | str, metric: Column, threshold: Column | float) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [F.lit(detector).alias("detector"), lit(action).alias("action"), metric.alias("metric"), lit(threshold).cast("double").alias("threshold")]


def recent_trades(trades: DataFrame, signals: DataFrame, now: Column, days: int = TRADE_DAYS) -> DataFrame:
    """Trades of paper and live within ``days`` before ``now``, with their signals' conviction."""
    own = trades.where(F.col("mode").isin("paper", "live") & (F.col("entry_ts") > now - F.make_dt_interval(F.lit(days))) & (F.col("entry_ts") <= now))
    return own.join(signals.select("signal_id", "conviction"), "signal_id", "left")


def _stats(trades: DataFrame) -> DataFrame:
    r = F.col("pnl_r")
    return trades.where(r.isNotNull()).groupBy("strategy_id").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"))


def _z(gap: Column) -> Column:
    return F.when(F.col("sd") > 0, gap / (F.when(F.col("sd") > 0, F.col("sd")) / F.sqrt("n"))).when(gap > 0, float("inf")).otherwise(0.0)


def divergence(trades: DataFrame, expected: DataFrame) -> DataFrame:
    """Live results short of the out-of-sample expectancy, by size and by significance."""
    own = _stats(trades).join(expected.select("strategy_id", "expectancy"), "strategy_id").where(F.col("n") >= DIVERGENCE_MIN)
    gap = F.col("expectancy") - F.col("mean")
    own = own.withColumns({"gap": gap, "z": _z(gap)})
    hard, soft = (F.col("z") >= QUARANTINE_Z) & (F.col("gap") >= QUARANTINE_R), (F.col("z") >= SHRINK_Z) & (F.col("gap") >= SHRINK_R)
    return own.where(hard | soft).select("strategy_id", *_row("divergence", F.when(hard, "quarantine").otherwise("shrink_size"), F.col("gap"), F.when(hard, QUARANTINE_R).otherwise(SHRINK_R)))


def decay(trades: DataFrame) -> DataFrame:
    own = _stats(trades).where(F.col("n") >= DECAY_MIN)
    return own.where(_z(-F.col("mean")) >= DECAY_Z).select("strategy_id", *_row("decay", "demote", F.col("mean"), 0.0))


def drawdown(trades: DataFrame) -> DataFrame:
    """Judged at six places, as results are reported: a path that ends at -6 exactly may sum to a hair above it."""
    closed = trades.where("pnl_r IS NOT NULL")
    tail = metrics.tail_mean(closed, ["strategy_id"], "pnl_r", 0.05, up=True)
    path = metrics.drawdowns(closed, ["strategy_id"], "pnl_r", ["entry_ts", "trade_id", "pnl_r"])
    own = _stats(trades).where(F.col("n") >= DRAWDOWN_MIN).join(tail, "strategy_id").join(path, "strategy_id")
    deep = F.round("cvar", 6) <= CVAR_FLOOR
    return own.where(deep | (F.round("mdd_from_zero", 6) <= MAX_DRAWDOWN)).select(
        "strategy_id", *_row("drawdown", "disable", F.when(deep, F.col("cvar")).otherwise(F.col("mdd_from_zero")), F.when(deep, CVAR_FLOOR).otherwise(MAX_DRAWDOWN))
    )


def calibration(trades: DataFrame) -> DataFrame:
    own = trades.where("pnl_r IS NOT NULL AND conviction IS NOT NULL").groupBy("strategy_id").agg(F.count("*").alias("n"), F.abs(F.avg("conviction") - F.avg((F.col("pnl_r") > 0).cast("double"))).alias("gap"))
    return own.where((F.col("n") >= CALIBRATION_MIN) & (F.col("gap") >= CALIBRATION_GAP)).select("strategy_id", *_row("calibration", "recalibrate", F.col("gap"), CALIBRATION_GAP))


def freshness(*feeds: tuple[str, DataFrame]) -> DataFrame:
    """``source, latest`` over several tables."""
    out = None
    for name, df in feeds:
        own = df.groupBy().agg(F.lit(name).alias("source"), F.max("ts").alias("latest"))
        out = own if out is None else out.unionAll(own)
    return out


def staleness(latest: DataFrame, now: Column) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("latest"), now) / 3600
    return latest.withColumn("age", age).where(F.col("age") > STALE_HOURS).select("source", *_row("staleness", "skip_degraded", F.col("age"), STALE_HOURS))


def regime_ood(labels: DataFrame, now: Column) -> DataFrame:
    """One row if too many labels of the last days were out of distribution."""
    own = labels.where((F.col("label") == "out_of_distribution") & (F.col("ts") > now - F.make_dt_interval(F.lit(OOD_DAYS))) & (F.col("ts") <= now))
    return own.agg(F.count("*").alias("n")).where(F.col("n") >= OOD_COUNT).select(*_row("regime_ood", "suppress", F.col("n").cast("double"), float(OOD_COUNT)))


def regate(strategies: DataFrame, scores: DataFrame) -> DataFrame:
    """Promoted strategies whose latest score no longer passes."""
    last = metrics.gate(top_one(scores, ["strategy_id"], ["evaluated_at", "score_id"]))
    own = strategies.where("status = 'promoted'").join(last, "strategy_id").where("NOT passed")
    return own.select("strategy_id", *_row("regate", "demote", F.col("expectancy"), 0.0))


def alerts(events: DataFrame) -> DataFrame:
    """Events, with an alert beside each that disables or degrades."""
    pair = events.where(F.col("action").isin("disable", "skip_degraded")).withColumn("action", F.lit("alert"))
    return events.unionByName(pair)


def transitions(events: DataFrame) -> DataFrame:
    """The status each event gives its strategy, where it gives one."""
    names = F.create_map(*[F.lit(x) for kv in STATUS_AFTER.items() for x in kv])
    return events.withColumn("status", F.try_element_at(names, F.col("action"))).where("status IS NOT NULL")


def changelog(events: DataFrame) -> DataFrame:
    """By ISO week: strategies that decayed, were retired, or adapted."""
    kind = F.when(F.col("action").isin("demote", "shrink_size"), "decayed").when(F.col("action").isin("disable", "quarantine"), "retired").when(F.col("action").isin("recalibrate", "refit"), "adapted")
    own = events.withColumn("kind", kind).where("kind IS NOT NULL")
    each = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("strategy_id").cast("string")))).alias(k) for k in ("decayed", "retired", "adapted")]
    return own.groupBy("week").agg(*each)


#: Periods whose regime is known (fixed values): name, first and last day, labels of which enough days should have one, and the least share.
KNOWN_PERIODS = [
    ("COVID crash", "2020-02-20", "2020-03-23", ["risk_off", "vol_expansion"], 0.50),
    ("2022 bear market", "2022-01-01", "2022-06-30", ["risk_off", "vol_expansion"], 0.30),
    ("calm uptrend", "2024-05-01", "2024-07-31", ["risk_on", "vol_compression"], 0.50),
]


def regime_sanity(labels: DataFrame, periods: list[tuple[str, str, str, list[str], float]] = KNOWN_PERIODS) -> DataFrame:
    """``name, n, share, passed`` of each period over ``labels`` (``ts, label``): the share of labels that are as expected. A period without labels fails."""
    known = labels.sparkSession.createDataFrame(periods, "name string, first string, last string, expected array<string>, least double")
    day = F.col("ts").cast("date")
    one = [F.struct(F.lit(name).alias("name"), F.count_if(day.between(F.lit(a).cast("date"), F.lit(b).cast("date"))).alias("n"),
                    F.count_if(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) & F.col("label").isin(wanted)).alias("hits")) for name, a, b, wanted, _ in periods]
    counted = labels.agg(F.array(*one).alias("x")).select(F.inline("x"))  # one pass over the labels
    share = F.coalesce(F.col("hits") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
    return known.join(counted, "name").select("name", "n", share.alias("share"), ((F.col("n") > 0) & (share >= F.col("least"))).alias("passed"))


def report(events: DataFrame) -> DataFrame:
    return events.groupBy("detector").agg(F.count("*").alias("n"))


def nightly(trades: DataFrame, strategies: DataFrame, scores: DataFrame) -> DataFrame:
    """All detectors over strategies, as one table of events."""
    expected = top_one(scores, ["strategy_id"], ["evaluated_at", "score_id"])
    out = divergence(trades, expected)
    for more in (decay(trades), drawdown(trades), calibration(trades), regate(strategies, scores)):
        out = out.unionByName(more)
    return out


def ranked_by_week(events: DataFrame) -> DataFrame:
    """Each strategy's events of a week in order, newest first."""
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("strategy_id", "week").orderBy(F.col("metric").desc(), "detector")))
