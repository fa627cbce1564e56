"""Feature layers: each takes bars (or days) and returns them with its features as columns, null where undefined.

All tickers and days are computed in one job. Columns are staged so that no window is nested; every window is by
ticker in time order, so a layer costs one shuffle and one sort however many features it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recursive
from tidemark.functions import scalars as sc
from tidemark.operators import pit
from tidemark.operators.ordered import Ordered

BENCHMARK = 0
LOCATION_LOOKBACK, TRIGGER_LOOKBACK, REGIME_LOOKBACK = 260, 80, 277
PIVOT_K = 3


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def staged(bars: DataFrame) -> DataFrame:
    """Per-bar quantities that the indicators' frames run over."""
    c = F.col("close")
    up, down = F.col("high") - ind.back(F.col("high")), ind.back(F.col("low")) - F.col("low")
    tr = ind.true_range(F.col("high"), F.col("low"), c)
    return bars.withColumns(
        {
            "prev_close": ind.back(c),
            "move": c - ind.back(c),
            "tr": tr,
            "log_ret": ind.log_return(c),
            "signed": ind.signed_volume(c, F.col("volume")),
            "i": F.row_number().over(ind.by_bar()).cast("double"),
            "dm": F.when(tr.isNotNull(), F.struct(tr.alias("tr"), F.when((up > down) & (up > 0), up).otherwise(0.0).alias("up"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("down"))),
            "typical": (F.col("high") + F.col("low") + c) / 3,
            "range": F.col("high") - F.col("low"),
        }
    )


def distance(level: Column, atr: Column) -> Column:
    """Of the close from a level, in ATRs."""
    return F.when(atr > 0, (F.col("close") - level) / atr)


def location(bars: DataFrame) -> DataFrame:
    """Layer 2: where the close is against averages, prior extremes, swings, VWAP and its range."""
    w = ind.trailing(LOCATION_LOOKBACK)
    c = F.col("close")
    first = staged(bars).withColumns(
        {
            "high_pivot": ind.pivot(F.col("high"), PIVOT_K, True),
            "low_pivot": ind.pivot(F.col("low"), PIVOT_K, False),
        }
    )
    second = first.withColumns(
        {
            "atr": ind.atr(F.col("tr"), 14),
            "hi20": F.max("high").over(ind.trailing(20)),
            "lo20": F.min("low").over(ind.trailing(20)),
            "hi_range": F.max("high").over(ind.trailing(20)),
            "lo_range": F.min("low").over(ind.trailing(20)),
            "week": F.count("*").over(ind.trailing(5, 1)),
            "wh": F.max("high").over(ind.trailing(5, 1)),
            "wl": F.min("low").over(ind.trailing(5, 1)),
            "swing_high": ind.last_pivot(F.col("high_pivot"), PIVOT_K, LOCATION_LOOKBACK),
            "swing_low": ind.last_pivot(F.col("low_pivot"), PIVOT_K, LOCATION_LOOKBACK),
            "vwap": F.sum(F.col("typical") * F.col("volume")).over(w) / F.when(F.sum("volume").over(w) > 0, F.sum("volume").over(w)),
            "prior_high": ind.back(F.col("high")),
            "prior_low": ind.back(F.col("low")),
            "ma50": ind.sma(c, 50),
            "ma200": ind.sma(c, 200),
        }
    )
    a = F.col("atr")
    week = lambda x: F.when(F.col("week") == 5, F.col(x))
    out = {
        "dist_50dma": distance(F.col("ma50"), a),
        "dist_200dma": distance(F.col("ma200"), a),
        "dist_prior_dh": distance(F.col("prior_high"), a),
        "dist_prior_dl": distance(F.col("prior_low"), a),
        "dist_prior_wh": distance(week("wh"), a),
        "dist_prior_wl": distance(week("wl"), a),
        "swing_high_dist": distance(F.col("swing_high"), a),
        "swing_low_dist": distance(F.col("swing_low"), a),
        "anchored_vwap_dist": distance(F.col("vwap"), a),
        "pct_range_position": F.when(F.col("hi_range") > F.col("lo_range"), sc.clamp01((c - F.col("lo_range")) / (F.col("hi_range") - F.col("lo_range")))),
        "dist_rolling_high": distance(F.col("hi20"), a),
        "dist_rolling_low": distance(F.col("lo20"), a),
    }
    return second.select("ticker", "ts", "close", *[finite(v).alias(k) for k, v in out.items()])


def trigger(bars: DataFrame) -> DataFrame:
    """Layer 3: momentum, contraction, oscillators, volume trend, strength against the benchmark, and breadth."""
    c = F.col("close")
    own = staged(bars).withColumns({"obv": ind.obv(F.col("signed")), "ma50": ind.sma(c, 50), "roc10": ind.roc(c, 10)})
    second = own.withColumns({"atr5": ind.atr(F.col("tr"), 5), "atr14": ind.atr(F.col("tr"), 14), "atr20": ind.atr(F.col("tr"), 20)})
    n = F.count("range").over(ind.trailing(7))
    out = second.select(
        "ticker", "ts", "i", "close", "ma50", "roc10",
        F.col("roc10").alias("momentum_roc"),
        ind.divergence(c, F.col("move")).alias("momentum_divergence"),
        F.when(F.col("atr20") > 0, F.col("atr5") / F.col("atr20")).alias("atr_contraction"),
        F.when(n == 7, (F.col("range") <= F.min("range").over(ind.trailing(7))).cast("double")).alias("nr7"),
        F.when(c > 0, F.col("atr14") / c).alias("atr_pct"),
        ind.slope_sign(F.col("obv"), F.col("i"), 20).alias("obv_trend"),
    )
    met = oscillators(out).withColumn("ema_stack_align", ema_stack()).drop("i", "e9", "e21", "e50")
    return breadth(relative_strength(met)).drop("ma50", "roc10", "close")


def oscillators(bars: DataFrame) -> DataFrame:
    """``bars`` (``ticker, i, close``) with ``rsi14, rsi_slope`` and the averages ``e9, e21, e50``."""

    def run(c: np.ndarray) -> list[np.ndarray]:
        n = TRIGGER_LOOKBACK
        return [recursive.rsi(c, 14, n), recursive.rsi_slope(c, 14, 5, n), *(recursive.ema(c, span, n) for span in (9, 21, 50))]

    return recursive.blocked(bars, ["close"], ["rsi14", "rsi_slope", "e9", "e21", "e50"], TRIGGER_LOOKBACK, run)


def ema_stack() -> Column:
    return (F.signum(F.col("e9") - F.col("e21")) + F.signum(F.col("e21") - F.col("e50"))) / 2


def relative_strength(own: DataFrame) -> DataFrame:
    """``rs_vs_spy``: momentum less the benchmark's latest at that time."""
    bench = own.where(F.col("ticker") == BENCHMARK).select("ts", F.coalesce("roc10", F.lit(float("nan"))).alias("bench_roc"))
    # Where a day lacks the benchmark, its last bar stands: a year's days in order, from what the year began with.
    days = Ordered(own.select("ts").distinct().join(bench, "ts", "left"), ["ts"], ranges=F.year("ts")).running(last_roc=("last", F.col("bench_roc")))
    days = days.select("ts", F.col("last_roc").alias("bench_roc"))
    met = own.join(days, "ts", "left")
    rs = F.col("roc10") - F.nanvl("bench_roc", F.lit(None).cast("double"))
    return met.withColumn("rs_vs_spy", F.when(F.col("ticker") == BENCHMARK, 0.0).otherwise(rs)).drop("bench_roc")


def breadth(own: DataFrame) -> DataFrame:
    """``breadth_thrust``: of the tickers with a 50-bar average on the day, the share above it."""
    have = F.col("ma50").isNotNull()
    days = own.groupBy("ts").agg((F.count_if(have & (F.col("close") > F.col("ma50"))) / F.when(F.count_if(have) > 0, F.count_if(have))).alias("breadth_thrust"))
    return own.join(days, "ts")


def volatility(bars: DataFrame) -> DataFrame:
    """The bar part of layer 1: realized volatility, its percentile, ADX."""
    own = staged(bars).withColumn("rv20", F.when(F.col("i") > 20, ind.realized_vol(F.col("log_ret"), 20)))
    flat = own.select("ticker", "ts", "i", "rv20", *[F.col(f"dm.{k}").alias(k) for k in ("tr", "up", "down")])

    def run(rv: np.ndarray, tr: np.ndarray, up: np.ndarray, down: np.ndarray) -> list[np.ndarray]:
        return [recursive.share_below(rv, REGIME_LOOKBACK - 20), recursive.adx(tr, up, down, 14, REGIME_LOOKBACK - 1)]

    met = recursive.blocked(flat, ["rv20", "tr", "up", "down"], ["rv_percentile", "adx"], REGIME_LOOKBACK, run)
    return met.select("ticker", "ts", finite(F.col("rv20")).alias("rv20"), "rv_percentile", F.when(F.col("i") > 20, finite(F.col("adx"))).alias("adx"))


#: Dates of a macro trend.
TREND_DATES = 21


def change(first: Column, last: Column) -> Column:
    """From the first to the last of a trend; undefined from 0."""
    return F.when(first != 0, last / first - 1)


def macro_regime(days: DataFrame, macro: DataFrame) -> DataFrame:
    """The macro part of layer 1, one row for each of ``days`` (``ts``): term structure of volatility, credit, liquidity, rates and cross-asset
    trends, from the newest vintages visible on the day (``macro``: ``series, ts, as_of, value``). A key whose legs are not all there is null."""
    seen = pit.trailing_dates(days, macro, TREND_DATES)
    names = ["vix9d", "vix", "vix3m", "vvix", "hy_oas", "ig_oas", "fed_balance_sheet", "tga", "reverse_repo", "dxy", "ust2y", "ust10y", "copper", "gold", "oil"]
    wide = seen.groupBy("ts").agg(*[F.max(F.when(F.col("series") == s, F.col("dates"))).alias(s) for s in names])  # one row a series and day
    now = lambda s: F.try_element_at(F.col(s), F.lit(-1))["value"]
    ratio = lambda a, b: F.when(b > 0, a / b)
    # Position by position, as far as both go; where gold is not above 0 there is no ratio.
    pairs = F.arrays_zip(F.transform(F.col("copper"), lambda x: x["value"]).alias("c"), F.transform(F.col("gold"), lambda x: x["value"]).alias("g"))
    both = F.transform(F.filter(pairs, lambda p: p["c"].isNotNull() & (p["g"] > 0)), lambda p: p["c"] / p["g"])
    trend = lambda xs: F.when(F.size(xs) >= 2, change(F.get(xs, 0), F.try_element_at(xs, F.lit(-1))))
    values = lambda s: F.transform(F.col(s), lambda x: x["value"])
    keys = {
        "vix9d_vix": ratio(now("vix9d"), now("vix")),
        "vix_vix3m": ratio(now("vix"), now("vix3m")),
        "vvix": now("vvix"),
        "hy_oas": now("hy_oas"),
        "ig_oas": now("ig_oas"),
        "hy_ig_ratio": ratio(now("hy_oas"), now("ig_oas")),
        "net_liquidity": now("fed_balance_sheet") - now("tga") - now("reverse_repo"),
        "dxy_trend": trend(values("dxy")),
        "twos_tens": now("ust10y") - now("ust2y"),
        "copper_gold": trend(both),
        "oil_trend": trend(values("oil")),
    }
    return wide.select("ts", now("vix").alias("vix"), *[finite(v).alias(k) for k, v in keys.items()])


def regime_layer(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Layer 1: all keys for each ticker and bar. ``vrp``: implied less realized volatility, in points."""
    days = macro_regime(bars.select("ts").distinct(), macro)
    met = volatility(bars).join(days, "ts", "left")
    return met.withColumn("vrp", finite(F.col("vix") - F.col("rv20") * 100)).select("ticker", "ts", *LAYERS["regime"])


def tradeability(funds: DataFrame) -> DataFrame:
    """Layer 0 of ``symbol, dollar_adv, aum``: components, score, gate and reasons. An unknown AUM fails."""
    floor_adv, good_adv, floor_aum, good_aum = 50e6, 1e9, 500e6, 10e9
    liq, flow = sc.log_scale(F.col("dollar_adv"), floor_adv, good_adv), sc.log_scale(F.coalesce("aum", F.lit(0.0)), floor_aum, good_aum)
    own = funds.withColumns({"liquidity": liq, "flow_capacity": flow}).withColumn("large_hand", F.least("liquidity", F.lit(0.5)))
    score = sc.clamp01(0.40 * F.col("liquidity") + 0.35 * F.col("flow_capacity") + 0.25 * F.col("large_hand"))
    thin, small, unknown = F.col("dollar_adv") < floor_adv, F.col("aum") < floor_aum, F.col("aum").isNull()
    reasons = F.array_compact(F.array(F.when(thin, "adv"), F.when(small, "aum"), F.when(unknown, "aum unavailable")))
    return own.select(
        "symbol", "dollar_adv", "liquidity", "flow_capacity", "large_hand", score.alias("score"),
        F.coalesce(~thin & ~small & ~unknown, F.lit(False)).alias("passed"), F.array_join(reasons, "; ").alias("reasons"),
    )


def calendar(days: DataFrame, column: str = "d") -> DataFrame:
    """Event overlay of dates: option expiries, month and quarter ends, rate decisions."""
    d = F.col(column)
    friday, month = sc.third_friday(d), F.month(d)
    end = d == sc.last_weekday_of_month(d)
    quarter = month.isin(3, 6, 9, 12)
    dates = F.array(*[F.lit(x).cast("date") for x in sc.FOMC_DATES])
    flag = lambda c: c.cast("double")
    return days.select(
        column,
        flag(d == friday).alias("is_opex"),
        sc.weekday_diff(d, friday).cast("double").alias("days_to_opex"),
        flag((d == friday) & quarter).alias("is_quad_witch"),
        flag(end).alias("is_month_end"),
        flag(end & quarter).alias("is_quarter_end"),
        flag(F.exists(dates, lambda x: sc.weekday_diff(d, x).between(1, 2))).alias("pre_fomc"),
        sc.fomc_days(d).cast("double").alias("days_to_fomc"),
    )


#: The feature keys of each layer: their public names.
LAYERS = {
    "location": ["dist_50dma", "dist_200dma", "dist_prior_dh", "dist_prior_dl", "dist_prior_wh", "dist_prior_wl", "swing_high_dist", "swing_low_dist", "anchored_vwap_dist", "pct_range_position", "dist_rolling_high", "dist_rolling_low"],
    "trigger": ["rs_vs_spy", "momentum_roc", "momentum_divergence", "atr_contraction", "nr7", "rsi14", "rsi_slope", "ema_stack_align", "atr_pct", "obv_trend", "breadth_thrust"],
    "regime": ["vix9d_vix", "vix_vix3m", "vvix", "rv20", "rv_percentile", "adx", "vrp", "hy_oas", "ig_oas", "hy_ig_ratio", "net_liquidity", "dxy_trend", "twos_tens", "copper_gold", "oil_trend"],
}


def window(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """One row a bar with the features of all layers (named ``layer__feature``) and the profile's ATR: what the search reads."""
    out = staged(bars).withColumn("atr", ind.atr(F.col("tr"), 14)).select("ticker", "ts", "open", "high", "low", "close", "volume", "atr", F.col("i").cast("int").alias("idx"))
    for layer, frame in (("location", location(bars)), ("trigger", trigger(bars)), ("regime", regime_layer(bars, macro))):
        out = out.join(frame.select("ticker", "ts", *[F.col(k).alias(f"{layer}__{k}") for k in LAYERS[layer]]), ["ticker", "ts"], "left")
    return out


def long_features(wide: DataFrame) -> DataFrame:
    """A window as rows ``ticker, ts, feature_key, value``; undefined features have no row."""
    names = [c for c in wide.columns if "__" in c]
    long = wide.unpivot(["ticker", "ts"], names, "column", "value").where("value IS NOT NULL")
    return long.select("ticker", "ts", F.replace("column", F.lit("__"), F.lit(".")).alias("feature_key"), "value")


def latest_map(wide: DataFrame) -> DataFrame:
    """Each ticker's features at its latest bar, as a map."""
    names = [c for c in wide.columns if "__" in c]
    last = pit.top_one(wide, ["ticker"], ["ts"])
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in names])
    return last.select("ticker", "ts", "close", "atr", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("features"))
