"""Signals and the paper journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions.scalars import adverse_price, clamp01, wilson_lower_bound
from tidemark.operators import labeling
from tidemark.operators.labeling import SWING, Profile
from tidemark.operators.search import Genome, labelled
from tidemark.storage import Scratch

MIN_ACTED, LIVE_FLOOR = 8, 0.40


def conviction(precision: Column, n_acted: Column, expectancy: Column, rr: Column) -> Column:
    """The measured precision where enough was acted on, else what the cohort's expectancy and geometry imply."""
    b = F.when(rr > 0, rr).otherwise(1.0)
    return F.when(precision.isNotNull() & (n_acted >= MIN_ACTED), clamp01(precision)).otherwise(clamp01((expectancy + 1) / (b + 1)))


def blackout(bars: DataFrame, earnings: DataFrame, profile: Profile = SWING) -> DataFrame:
    """``bars`` (``ticker, d``) with the first earnings date inside the holding time after ``d``, if any: one sort, no range join."""
    days = -(-profile.max_hold * 7 // 5)
    asks = bars.select("ticker", "d", F.lit(None).cast("date").alias("e"))
    line = asks.unionByName(earnings.select("ticker", F.col("date").alias("d"), F.col("date").alias("e"))).withColumn("n", F.unix_date("d"))
    # The holding time starts the day after d, so a date on d itself does not count.
    after = Window.partitionBy("ticker").orderBy("n").rangeBetween(1, days)
    return line.withColumn("blackout", F.min("e").over(after)).where("e IS NULL").select("ticker", "d", "blackout")


def invalidation(side: Column, stop: Column) -> Column:
    return F.format_string("%s %.2f", F.when(side > 0, "close below").otherwise("close above"), stop)


def build(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``skip_reason`` (null: emitted), in a fixed order of reasons, and the signal's numbers.

    Columns: ``fires, regime, blackout, atr, scored, precision_oos, n_acted, expectancy, side, entry, stop_dist, target_dist``.
    """
    stop = F.col("entry") - F.col("side") * F.col("stop_dist")
    target = F.col("entry") + F.col("side") * F.col("target_dist")
    risk = F.abs(F.col("entry") - stop)
    rr = F.coalesce(F.abs(target - F.col("entry")) / F.when(risk > 0, risk), F.lit(0.0))
    low = F.coalesce((F.col("n_acted") >= MIN_ACTED) & (wilson_lower_bound(F.col("precision_oos"), F.col("n_acted")) < LIVE_FLOOR) & F.col("precision_oos").isNotNull(), F.lit(False))
    reason = (
        F.when(F.col("entry").isNull(), "no_bars")
        .when(~F.coalesce("fires", F.lit(False)), "not_firing")
        .when(F.col("regime") == "out_of_distribution", "regime")
        .when(F.col("blackout").isNotNull(), "earnings")
        .when(F.col("atr").isNull(), "no_atr")
        .when(~F.coalesce("scored", F.lit(False)), "no_score")
        .when(low, "low_precision")
        .when(~F.coalesce(risk > 0, F.lit(False)), "geometry")
    )
    return candidates.withColumns(
        {
            "skip_reason": reason, "stop": stop, "target1": target, "rr1": rr,
            "conviction": conviction(F.col("precision_oos"), F.col("n_acted"), F.col("expectancy"), rr),
            "invalidation": invalidation(F.col("side"), stop),
        }
    )


def drivers(predicates: Column, features: Column) -> Column:
    """Of an array of predicates: key, share of the signal with the sign of its comparison, observed value."""
    n = F.size(predicates)
    return F.transform(
        predicates,
        lambda p: F.struct(
            p["feature_key"].alias("key"),
            (F.when(p["op"].isin("gt", "gte"), 1.0).otherwise(-1.0) / n).alias("contribution"),
            F.try_element_at(features, p["feature_key"]).alias("observed"),
        ),
    )


def text(s: dict[str, Column] | None = None) -> Column:
    """A signal as people read it (the form is fixed). Columns: ``ticker, side, horizon, entry, stop, target1, target2, rr1, rr2, conviction, cohort_n, regime, why`` (an array
    of ``key, contribution``), ``invalidation, expectancy, cvar5, lead_time``; the second target and its ratio may be null."""
    c = {n: F.col(n) for n in "ticker side horizon entry stop target1 target2 rr1 rr2 conviction cohort_n regime why invalidation expectancy cvar5 lead_time".split()} | (s or {})
    num = lambda form, x: F.format_string(form, x)
    why = F.array_join(F.transform(c["why"], lambda d: F.concat(d["key"], F.lit(" ("), num("%+.2f", d["contribution"]), F.lit(")"))), "; ")
    second = F.when(c["target2"].isNotNull(), num("   Target 2: %.2f", c["target2"])).otherwise("")
    ratio2 = F.when(c["rr2"].isNotNull(), num(" / %.1f", c["rr2"])).otherwise("")
    lines = [
        F.concat(c["ticker"].cast("string"), F.lit(" — "), F.when(c["side"] > 0, "LONG").otherwise("SHORT"), F.lit(" ("), c["horizon"], F.lit(")")),
        F.format_string("Entry: %.2f   Stop: %.2f", c["entry"], c["stop"]),
        F.concat(num("Target 1: %.2f", c["target1"]), second, num("   Risk:Reward %.1f", c["rr1"]), ratio2),
        F.format_string("Conviction: %.2f (calibrated, regime-matched cohort n=%d)", c["conviction"], c["cohort_n"]),
        F.concat(F.lit("Regime: "), c["regime"]),
        F.concat(F.lit("Why: "), why),
        F.concat(F.lit("Invalidation: "), c["invalidation"]),
        F.concat(F.format_string("Expectancy(cohort): %+.2fR   CVaR(5%%): %.1fR   Lead-time: ", c["expectancy"], c["cvar5"]), c["lead_time"]),
    ]
    return F.concat_ws("\n", *lines)


def valid_geometry(entry: Column, stop: Column, target: Column, side: Column) -> Column:
    """Finite, with a risk, and both barriers on their side."""
    return F.coalesce((side * (entry - stop) > 0) & (side * (target - entry) > 0), F.lit(False))


def paper_trades(signals: DataFrame, bars: DataFrame, profile: Profile = SWING) -> DataFrame:
    """``signals`` (``signal_id, ticker, created_at, side``) filled at the next bar's open and resolved by the barrier from there.

    Fills are worse by half the cost on each leg, and the result is net of the cost in R. Fills are written on the way. ``bars``, best a table that is stored: ``ticker, ts, idx, open, high, low, close, atr``.
    """
    # From the last bar back, so that a running value has the next bar; a frame that reaches ahead would be read anew for every row.
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc(), F.col("_kind").desc())
    asks = signals.select("ticker", F.col("created_at").alias("ts"), F.lit(0).alias("_kind"), F.struct("signal_id", "side").alias("_s"), F.lit(None).cast("int").alias("idx"))
    line = asks.unionByName(bars.select("ticker", "ts", F.lit(1).alias("_kind"), F.lit(None).cast(asks.schema["_s"].dataType).alias("_s"), F.col("idx").cast("int").alias("idx")))
    # The first bar at or after the decision is the decision's; the fill is one later.
    first = F.last("idx", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = line.withColumn("fill_idx", first + 1).where("_kind = 0").select("ticker", "_s.signal_id", "_s.side", "fill_idx")
    fill = bars.select("ticker", F.col("idx").alias("fill_idx"), F.col("ts").alias("fill_ts"), "open", "close", "atr")
    tables = Scratch(bars.sparkSession)  # what the barrier and its results both read
    opened = tables.written(at.join(fill, ["ticker", "fill_idx"]).withColumn("fill_px", adverse_price(F.col("open"), F.col("side"), True, profile.round_trip)), "fills")
    ways = opened.select("ticker", F.col("fill_idx").alias("idx"), "side", F.col("close").alias("entry_px"), (F.col("atr") * profile.target_atr).alias("target_dist"), (F.col("atr") * profile.stop_atr).alias("stop_dist")).distinct()
    ways = tables.written(ways.where("stop_dist > 0"), "ways")
    done = labeling.triple_barrier(ways, bars, profile.max_hold).select("ticker", F.col("idx").alias("fill_idx"), "side", "exit_idx", "outcome", "ret_r", "target_px", "stop_px")
    ends = bars.select("ticker", F.col("idx").alias("exit_idx"), F.col("ts").alias("exit_ts"), F.col("close").alias("exit_close"))
    out = opened.join(done, ["ticker", "fill_idx", "side"], "left").join(ends, ["ticker", "exit_idx"], "left")
    raw_exit = F.when(F.col("outcome") == "target", F.col("target_px")).when(F.col("outcome") == "stop", F.col("stop_px")).when(F.col("outcome") == "time", F.col("exit_close"))
    cost = profile.round_trip * F.col("fill_px") / (profile.stop_atr * F.col("atr"))
    return out.select("signal_id", "ticker", "side", "fill_ts", "fill_px", "exit_ts", adverse_price(raw_exit, F.col("side"), False, profile.round_trip).alias("exit_px"), "outcome", (F.col("ret_r") - cost).alias("pnl_r"))


def replay(genomes: dict[str, Genome], window: DataFrame, scanner: str, profile: Profile = SWING) -> DataFrame:
    """The journal of a backtest: every labelled entry of the named strategies over all tickers, ``strategy, ticker, side, mode, scanner, entry_ts, fill_px, exit_ts, exit_px, pnl_r, cost, outcome``.

    One job for all strategies. Results are before costs, which stand beside them. ``sinks.replace_partitions`` by ``mode, scanner`` puts it in place of an earlier one.
    """
    own = list(genomes.items())
    pick = lambda f: F.element_at(F.array(*[F.lit(f(n, g)) for n, g in own]), F.col("genome") + 1)
    done = labelled([g for _, g in own], window, profile)
    ends = window.select("ticker", F.col("idx").alias("exit_idx"), F.col("ts").alias("exit_ts"))
    begun = window.select("ticker", "idx", F.col("ts").alias("entry_ts"))
    met = done.join(begun, ["ticker", "idx"]).join(ends, ["ticker", "exit_idx"], "left")
    px = F.when(F.col("outcome") == "target", F.col("target_px")).when(F.col("outcome") == "stop", F.col("stop_px")).otherwise(exit_price(F.col("entry_px"), F.col("stop_dist"), F.col("side"), F.col("ret_r")))
    return met.select(
        pick(lambda n, g: n).alias("strategy"), "ticker", "side", F.lit("backtest").alias("mode"), F.lit(scanner).alias("scanner"), "entry_ts", F.col("entry_px").alias("fill_px"),
        "exit_ts", px.alias("exit_px"), F.col("ret_r").alias("pnl_r"), F.lit(profile.round_trip).alias("cost"), "outcome",
    )


def against_out_of_sample(trades: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: the mean result of a replay, which saw what it was fitted on, beside the mean out-of-sample expectancy of its strategies' newest scores, and the gap."""
    last = scores.groupBy("strategy_id").agg(F.max_by("expectancy", F.struct("evaluated_at", "score_id")).alias("expectancy"))
    return trades.agg(F.avg("pnl_r").alias("in_sample")).join(last.agg(F.avg("expectancy").alias("out_of_sample"))).withColumn("gap", F.col("in_sample") - F.col("out_of_sample"))  # one row each


def exit_price(entry: Column, stop_dist: Column, side: Column, ret_r: Column) -> Column:
    """The exit that a result in R stands for."""
    return entry + side * ret_r * stop_dist


def tally(trades: DataFrame, *keys: str) -> DataFrame:
    """Wins and losses of closed trades; a breakeven is a loss."""
    r = F.col("pnl_r")
    loss = F.sum(F.when(r <= 0, -r).otherwise(0.0))
    return trades.where(r.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(r > 0).alias("wins"), F.count_if(r <= 0).alias("losses"), F.sum(r).alias("sum_r"), F.avg(r).alias("avg_r"),
        (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"), F.when(loss > 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / F.when(loss > 0, loss)).alias("profit_factor"),
    )


def with_atr(bars: DataFrame, n: int = SWING.atr_lookback) -> DataFrame:
    own = bars.withColumns({"tr": ind.true_range(F.col("high"), F.col("low"), F.col("close")), "idx": F.row_number().over(ind.by_bar())})
    return own.withColumn("atr", ind.atr(F.col("tr"), n))
