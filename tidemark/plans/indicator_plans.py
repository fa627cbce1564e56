"""Indicators and feature layers as queries."""

from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import scalars as sc
from tidemark.operators import features, regime
from tidemark.sources import tables
from tidemark.sources.tables import rounded, with_tables


def _bars(spark, sf):
    return features.staged(tables.bars(spark, sf))


def _per_bar(**columns):
    """A query of named columns over the staged bars."""
    return lambda spark, sf: rounded(_bars(spark, sf).select("ticker", "ts", *[c().alias(k) for k, c in columns.items()]))


def _oscillator(**columns):
    """A query of named columns over the oscillators."""
    return lambda spark, sf: rounded(features.oscillators(_bars(spark, sf).select("ticker", "ts", "i", "close")).select("ticker", "ts", *[c().alias(k) for k, c in columns.items()]))


close = lambda: F.col("close")


def sma_dist(spark, sf):
    """Flagship: the 50-bar average and the close's distance from it in ATRs, for every ticker and day."""
    own = _bars(spark, sf).withColumns({"sma50": ind.sma(close(), 50), "atr14": ind.atr(F.col("tr"), 14)})
    return rounded(own.select("ticker", "ts", "close", "sma50", "atr14", features.distance(F.col("sma50"), F.col("atr14")).alias("dist")))


def obv_trend(spark, sf):
    own = _bars(spark, sf).withColumn("obv", ind.obv(F.col("signed")))
    return rounded(own.select("ticker", "ts", "obv", ind.slope_sign(F.col("obv"), F.col("i"), 20).alias("obv_trend")))


def rv_percentile(spark, sf):
    return rounded(features.volatility(tables.bars(spark, sf)).select("ticker", "ts", "rv20", "rv_percentile"))


def adx(spark, sf):
    return rounded(features.volatility(tables.bars(spark, sf)).select("ticker", "ts", "adx"))


def swing_pivots(spark, sf):
    own = _bars(spark, sf).withColumns({"hp": ind.pivot(F.col("high"), 3, True), "lp": ind.pivot(F.col("low"), 3, False)})
    return rounded(own.select("ticker", "ts", ind.last_pivot(F.col("hp"), 3, 260).alias("swing_high"), ind.last_pivot(F.col("lp"), 3, 260).alias("swing_low")))


def location_features(spark, sf):
    return rounded(features.location(tables.bars(spark, sf)))


def trigger_features(spark, sf):
    return rounded(features.trigger(tables.bars(spark, sf)))


def rel_strength(spark, sf):
    own = tables.bars(spark, sf).withColumn("roc10", ind.roc(close(), 10)).select("ticker", "ts", "roc10")
    return rounded(features.relative_strength(own))


def breadth(spark, sf):
    own = tables.bars(spark, sf).withColumn("ma50", ind.sma(close(), 50))
    return rounded(features.breadth(own).select("ts", "breadth_thrust").distinct())


def event_calendar(spark, sf):
    days = tables.read(spark, sf, "lineitem").select(F.add_months(F.col("l_shipdate").cast("date"), 288).alias("d")).distinct()
    return rounded(features.calendar(days))


def tradeability(spark, sf):
    """Dollar ADV of each supplier as symbol, against its account as AUM."""
    return rounded(features.tradeability(tables.funds(spark, sf)))


def regime_features(spark, sf):
    """All keys of layer 1 for each ticker and bar."""
    return rounded(features.regime_layer(tables.bars(spark, sf), tables.regime_series(spark, sf)))


def regime_by_day(spark, sf):
    """Regime labels from the layer's own keys."""
    return rounded(regime.classify(features.regime_layer(tables.bars(spark, sf), tables.regime_series(spark, sf))).select("ticker", "ts", "label", "confidence", "observed_inputs"))


def feature_window(spark, sf):
    """How many features each bar has, over all layers."""
    w = features.window(tables.bars(spark, sf), tables.regime_series(spark, sf))
    names = [c for c in w.columns if "__" in c]
    return w.select("ticker", "ts", "idx", sum(F.col(c).isNotNull().cast("int") for c in names).alias("n_features"))


def latest_feature_map(spark, sf):
    m = features.latest_map(features.window(tables.bars(spark, sf), tables.regime_series(spark, sf)))
    return rounded(m.select("ticker", "ts", "close", F.size("features").alias("n"), F.element_at("features", "trigger__momentum_roc").alias("roc")))


def dataset_pivot(spark, sf):
    """Long features as one row a key, a column for each feature in order of name."""
    wide = tables.features_pit(spark, sf).groupBy("ticker").pivot("feature_key", ["click", "error", "purchase", "signup", "view"]).agg(F.max_by("value", F.struct("decision_ts", "seq")))
    return rounded(wide.select("ticker", *sorted(c for c in wide.columns if c != "ticker")))


QUERIES = {
    "sma_dist": sma_dist,
    "returns": _per_bar(ret=lambda: ind.simple_return(close()), log_ret=lambda: F.col("log_ret")),
    "bar_shape": _per_bar(typical=lambda: F.col("typical"), range=lambda: F.col("range"), tr=lambda: F.col("tr"), intrabar=lambda: F.when(F.col("open") != 0, F.col("close") / F.col("open") - 1), is_up=lambda: F.col("close") > F.col("open")),
    "realized_vol": _per_bar(rv20=lambda: ind.realized_vol(F.col("log_ret"), 20)),
    "atr": _per_bar(atr14=lambda: ind.atr(F.col("tr"), 14), atr5=lambda: ind.atr(F.col("tr"), 5)),
    "roc": _per_bar(roc3=lambda: ind.roc(close(), 3), roc10=lambda: ind.roc(close(), 10)),
    "dollar_adv": _per_bar(adv=lambda: F.avg(F.col("close") * F.col("volume")).over(ind.trailing(20))),
    "vwap_dist": _per_bar(vwap=lambda: F.sum(F.col("typical") * F.col("volume")).over(ind.trailing(260)) / F.sum("volume").over(ind.trailing(260))),
    "cumulative_vwap": _per_bar(vwap=lambda: ind.obv(F.col("typical") * F.col("volume")) / ind.obv(F.col("volume"))),
    "donchian": _per_bar(hi=lambda: F.max("high").over(ind.trailing(20)), lo=lambda: F.min("low").over(ind.trailing(20))),
    "range_position": _per_bar(pos=lambda: F.when(F.max("high").over(ind.trailing(20)) > F.min("low").over(ind.trailing(20)), sc.clamp01((close() - F.min("low").over(ind.trailing(20))) / (F.max("high").over(ind.trailing(20)) - F.min("low").over(ind.trailing(20)))))),
    "prior_day_week": _per_bar(pdh=lambda: ind.back(F.col("high")), pdl=lambda: ind.back(F.col("low")), pwh=lambda: F.max("high").over(ind.trailing(5, 1)), pwl=lambda: F.min("low").over(ind.trailing(5, 1))),
    "nr7": _per_bar(nr7=lambda: F.when(F.count("range").over(ind.trailing(7)) == 7, (F.col("range") <= F.min("range").over(ind.trailing(7))).cast("double"))),
    "divergence": _per_bar(div=lambda: ind.divergence(close(), F.col("move"))),
    "atr_contraction": _per_bar(ratio=lambda: F.when(ind.atr(F.col("tr"), 20) > 0, ind.atr(F.col("tr"), 5) / ind.atr(F.col("tr"), 20))),
    "ema": _oscillator(ema9=lambda: F.col("e9")),
    "ema_stack": _oscillator(align=features.ema_stack),
    "rsi": _oscillator(rsi14=lambda: F.col("rsi14")),
    "rsi_slope": _oscillator(slope=lambda: F.col("rsi_slope")),
} | {f.__name__: f for f in (obv_trend, rv_percentile, adx, swing_pivots, location_features, trigger_features, rel_strength, breadth, event_calendar, tradeability, regime_features, regime_by_day, feature_window, latest_feature_map, dataset_pivot)}

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY ts)"
_STAGED = """staged AS (SELECT *, close - lag(close) OVER w AS move, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS log_ret,
  CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, (high + low + close) / 3 AS typical, high - low AS rng,
  coalesce(sign(close - lag(close) OVER w) * volume, 0) AS signed, row_number() OVER w AS i, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""


def _f(n, before=0):
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1 + before} PRECEDING AND {f'{before} PRECEDING' if before else 'CURRENT ROW'})"


def _full(value, n, over):
    return f"CASE WHEN count({over}) OVER {_f(n)} = {n} THEN {value} OVER {_f(n)} END"


def _ema(span, xs="xs"):
    k = 2 / (span + 1)
    return f"list_reduce({xs}, lambda acc, x: x * {k!r}::DOUBLE + acc * {(1 - k)!r}::DOUBLE)"


def _rsi(xs="xs", n=14):
    """Moves of an array, seeded by the first n, then smoothed: a fold over structs."""
    mv = f"list_transform(range(2, len({xs}) + 1), lambda j: {xs}[j] - {xs}[j - 1])"
    g, l = (f"list_sum(list_transform(({mv})[1:{n}], lambda d: greatest({s}d, 0.0::DOUBLE))) / {n}" for s in ("", "-"))  # noqa: E741
    tail = f"list_transform(({mv})[{n + 1}:], lambda d: {{'g': greatest(d, 0.0::DOUBLE), 'l': greatest(-d, 0.0::DOUBLE)}})"
    st = f"list_reduce(list_prepend({{'g': {g}, 'l': {l}}}, {tail}), lambda a, d: {{'g': (a.g * {n - 1} + d.g) / {n}, 'l': (a.l * {n - 1} + d.l) / {n}}})"
    return f"(SELECT CASE WHEN len({xs}) > {n} THEN CASE WHEN s.l = 0 THEN 100.0 ELSE 100 - 100 / (1 + s.g / s.l) END END FROM (SELECT {st} AS s))"


def _q(select, doubles, ctes="", source="staged", more=""):
    return with_tables(f"WITH {_STAGED}{', ' + ctes if ctes else ''} SELECT {select} FROM {source} {more}", "bars", doubles=doubles)


def _xs(n=80):
    return f"arrays AS (SELECT ticker, ts, list(close) OVER {_f(n)} AS xs FROM staged)"


_ATR14, _ATR5, _ATR20 = (_full("avg(tr)", n, "tr") for n in (14, 5, 20))
_SMA50 = _full("avg(close)", 50, "close")
_PIVOTS = "pivots AS (SELECT *, CASE WHEN " + " AND ".join(f"high > lag(high, {d}) OVER w AND high > lead(high, {d}) OVER w" for d in (1, 2, 3)) + " THEN high END AS hp, CASE WHEN " + " AND ".join(f"low < lag(low, {d}) OVER w AND low < lead(low, {d}) OVER w" for d in (1, 2, 3)) + f" THEN low END AS lp FROM staged {_W})"
_SWING = "last_value({} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 256 PRECEDING AND 3 PRECEDING)"
_DIV = f"""CASE WHEN count(close) OVER {_f(10)} < 10 THEN 0.0
  WHEN max(close) OVER {_f(5)} > max(close) OVER {_f(5, 5)} AND max(move) OVER {_f(5)} < greatest(max(move) OVER {_f(4, 5)}, 0) THEN -1.0
  WHEN min(close) OVER {_f(5)} < min(close) OVER {_f(5, 5)} AND min(move) OVER {_f(5)} > least(min(move) OVER {_f(4, 5)}, 0) THEN 1.0 ELSE 0.0 END"""
_ADX = """adx_in AS (SELECT ticker, ts, i, list({'tr': tr, 'up': CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END, 'dn': CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END}) FILTER (tr IS NOT NULL) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 275 PRECEDING AND CURRENT ROW) AS m FROM staged),
seeded AS (SELECT ticker, ts, i, list_prepend({'tr': list_sum(list_transform(m[1:14], lambda x: x.tr)), 'up': list_sum(list_transform(m[1:14], lambda x: x.up)), 'dn': list_sum(list_transform(m[1:14], lambda x: x.dn)), 'dxs': 0.0::DOUBLE, 'k': 0},
  list_transform(m[15:], lambda x: {'tr': x.tr, 'up': x.up, 'dn': x.dn, 'dxs': 0.0::DOUBLE, 'k': 1})) AS s FROM adx_in WHERE len(m) >= 28),
smoothed AS (SELECT ticker, ts, list_reduce(list_prepend({'tr': s[1].tr, 'up': s[1].up, 'dn': s[1].dn, 'dxs': CASE WHEN s[1].up + s[1].dn > 0 THEN 100 * abs(s[1].up - s[1].dn) / (s[1].up + s[1].dn) ELSE 0 END, 'k': 1}, s[2:]), lambda a, x: {
  'tr': a.tr - a.tr / 14 + x.tr, 'up': a.up - a.up / 14 + x.up, 'dn': a.dn - a.dn / 14 + x.dn,
  'dxs': CASE WHEN a.k < 13 THEN a.dxs + CASE WHEN (a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn) > 0 THEN 100 * abs((a.up - a.up / 14 + x.up) - (a.dn - a.dn / 14 + x.dn)) / ((a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn)) ELSE 0 END
    WHEN a.k = 13 THEN (a.dxs + CASE WHEN (a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn) > 0 THEN 100 * abs((a.up - a.up / 14 + x.up) - (a.dn - a.dn / 14 + x.dn)) / ((a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn)) ELSE 0 END) / 14
    ELSE (a.dxs * 13 + CASE WHEN (a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn) > 0 THEN 100 * abs((a.up - a.up / 14 + x.up) - (a.dn - a.dn / 14 + x.dn)) / ((a.up - a.up / 14 + x.up) + (a.dn - a.dn / 14 + x.dn)) ELSE 0 END) / 14 END,
  'k': a.k + 1}) AS r FROM seeded)"""
_RV = f"rv AS (SELECT ticker, ts, CASE WHEN i > 20 THEN coalesce(CASE WHEN count(log_ret) OVER {_f(20)} < 2 THEN 0.0 ELSE stddev_pop(log_ret) OVER {_f(20)} * sqrt(252) END, 0) END AS rv20 FROM staged), rvh AS (SELECT ticker, ts, rv20, list(rv20) FILTER (rv20 IS NOT NULL) OVER {_f(257)} AS h FROM rv)"
_RS = f"rocs AS (SELECT ticker, ts, close / lag(close, 10) OVER w - 1 AS roc10 FROM staged {_W}), days AS (SELECT ts, last_value(b IGNORE NULLS) OVER (ORDER BY ts) AS b FROM (SELECT DISTINCT r.ts, coalesce(x.roc10, 'nan'::DOUBLE) AS b0, CASE WHEN x.ticker IS NOT NULL THEN coalesce(x.roc10, 'nan'::DOUBLE) END AS b FROM rocs r LEFT JOIN (SELECT * FROM rocs WHERE ticker = 0) x USING (ts)))"
_BREADTH = f"ma AS (SELECT ts, close, {_SMA50} AS ma50 FROM staged), br AS (SELECT ts, count(*) FILTER (ma50 IS NOT NULL AND close > ma50) / nullif(count(ma50), 0) AS breadth_thrust FROM ma GROUP BY ts)"
_RS_VALUE = "CASE WHEN r.ticker = 0 THEN 0.0 WHEN isnan(d.b) THEN NULL ELSE r.roc10 - d.b END"
_LAST = {s: f"{s}[len({s})]" for s in tables.REGIME_SERIES}
_TREND = lambda x: f"CASE WHEN len({x}) >= 2 AND {x}[1] <> 0 THEN {x}[len({x})] / {x}[1] - 1 END"
# A date is known within 7 days, so the last 21 that are known are among the last 29: no day has to meet all dates.
_MACRO = f"""dt AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) AS k FROM (SELECT DISTINCT series, ts FROM regime_series)),
asks AS (SELECT t, series FROM (SELECT DISTINCT ts AS t FROM bars), (SELECT DISTINCT series FROM regime_series)),
near AS (SELECT a.t, a.series, unnest(range(greatest(x.k - 28, 1), x.k + 1)) AS k FROM asks a ASOF JOIN dt x ON x.series = a.series AND a.t >= x.ts),
vis AS (SELECT n.t, n.series, m.ts, max_by(m.value, m.as_of) AS v FROM near n JOIN dt x ON x.series = n.series AND x.k = n.k JOIN regime_series m ON m.series = x.series AND m.ts = x.ts AND m.as_of <= n.t GROUP BY ALL),
tr AS (SELECT t, series, list(v ORDER BY ts) AS xs FROM (SELECT *, row_number() OVER (PARTITION BY t, series ORDER BY ts DESC) AS r FROM vis) WHERE r <= 21 GROUP BY t, series),
wide0 AS (SELECT t, {", ".join(f"any_value(xs) FILTER (series = '{s}') AS {s}" for s in tables.REGIME_SERIES)} FROM tr GROUP BY t),
wide AS (SELECT *, list_filter(list_transform(range(1, least(len(copper), len(gold)) + 1), lambda i: CASE WHEN gold[i] > 0 THEN copper[i] / gold[i] END), lambda x: x IS NOT NULL) AS cg FROM wide0)"""
_REGIME_KEYS = {
    "vix9d_vix": f"CASE WHEN {_LAST['vix']} > 0 THEN {_LAST['vix9d']} / {_LAST['vix']} END", "vix_vix3m": f"CASE WHEN {_LAST['vix3m']} > 0 THEN {_LAST['vix']} / {_LAST['vix3m']} END", "vvix": _LAST["vvix"],
    "rv20": "v.rv20", "rv_percentile": "CASE WHEN v.rv20 IS NOT NULL THEN len(list_filter(h, lambda x: x <= v.rv20)) / len(h) END", "adx": "CASE WHEN b.i > 20 THEN s.r.dxs END", "vrp": f"{_LAST['vix']} - v.rv20 * 100",
    "hy_oas": _LAST["hy_oas"], "ig_oas": _LAST["ig_oas"], "hy_ig_ratio": f"CASE WHEN {_LAST['ig_oas']} > 0 THEN {_LAST['hy_oas']} / {_LAST['ig_oas']} END",
    "net_liquidity": f"{_LAST['fed_balance_sheet']} - {_LAST['tga']} - {_LAST['reverse_repo']}", "dxy_trend": _TREND("dxy"), "twos_tens": f"{_LAST['ust10y']} - {_LAST['ust2y']}", "copper_gold": _TREND("cg"), "oil_trend": _TREND("oil"),
}
_LOC = {
    "dist_50dma": "ma50", "dist_200dma": "ma200", "dist_prior_dh": "pdh", "dist_prior_dl": "pdl", "dist_prior_wh": "wh", "dist_prior_wl": "wl", "swing_high_dist": "sh", "swing_low_dist": "sl",
    "anchored_vwap_dist": "vwap", "dist_rolling_high": "hi", "dist_rolling_low": "lo",
}
_LEVELS = f"""levels AS (SELECT ticker, ts, close, {_ATR14} AS atr, {_SMA50} AS ma50, {_full("avg(close)", 200, "close")} AS ma200, lag(high) OVER w AS pdh, lag(low) OVER w AS pdl,
  CASE WHEN count(*) OVER {_f(5, 1)} = 5 THEN max(high) OVER {_f(5, 1)} END AS wh, CASE WHEN count(*) OVER {_f(5, 1)} = 5 THEN min(low) OVER {_f(5, 1)} END AS wl, {_SWING.format("hp")} AS sh, {_SWING.format("lp")} AS sl,
  sum(typical * volume) OVER {_f(260)} / sum(volume) OVER {_f(260)} AS vwap, max(high) OVER {_f(20)} AS hi, min(low) OVER {_f(20)} AS lo FROM pivots {_W})"""
_DAYS_SQL = "wd AS (SELECT d, CAST(floor((d - DATE '1900-01-01' + 1) / 7) * 5 + least((d - DATE '1900-01-01' + 1) % 7, 5) AS INTEGER) AS k"
_FOMC_SQL = "fomc AS (SELECT i, x, CAST(floor((x - DATE '1900-01-01' + 1) / 7) * 5 + least((x - DATE '1900-01-01' + 1) % 7, 5) AS INTEGER) AS k FROM (SELECT unnest(range(1, " + str(len(sc.FOMC_DATES) + 1) + ")) AS i, CAST(unnest([" + ", ".join(f"'{x}'" for x in sc.FOMC_DATES) + "]) AS DATE) AS x))"

_REGIME_SQL = f"WITH {_STAGED}, {_RV}, {_ADX}, {_MACRO} SELECT b.ticker, b.ts, " + ", ".join(f"{v} AS {k}" for k, v in _REGIME_KEYS.items()) + " FROM staged b JOIN rvh v ON v.ticker = b.ticker AND v.ts = b.ts LEFT JOIN smoothed s ON s.ticker = b.ticker AND s.ts = b.ts LEFT JOIN wide w ON w.t = b.ts"
ORACLES = {
    "sma_dist": _q(f"ticker, ts, close, sma50, atr14, CASE WHEN atr14 > 0 THEN (close - sma50) / atr14 END AS dist", "close sma50 atr14 dist", f"x AS (SELECT ticker, ts, close, {_SMA50} AS sma50, {_ATR14} AS atr14 FROM staged)", "x"),
    "returns": _q("ticker, ts, CASE WHEN lag(close) OVER w = 0 THEN 0 ELSE close / lag(close) OVER w - 1 END AS ret, log_ret", "ret log_ret", more=_W),
    "bar_shape": _q("ticker, ts, typical, rng AS range, tr, close / nullif(open, 0) - 1 AS intrabar, close > open AS is_up", "typical range tr intrabar"),
    "realized_vol": _q(f"ticker, ts, CASE WHEN count(log_ret) OVER {_f(20)} < 2 THEN 0 ELSE stddev_pop(log_ret) OVER {_f(20)} * sqrt(252) END AS rv20", "rv20"),
    "atr": _q(f"ticker, ts, {_ATR14} AS atr14, {_ATR5} AS atr5", "atr14 atr5"),
    "roc": _q("ticker, ts, close / nullif(lag(close, 3) OVER w, 0) - 1 AS roc3, close / nullif(lag(close, 10) OVER w, 0) - 1 AS roc10", "roc3 roc10", more=_W),
    "dollar_adv": _q(f"ticker, ts, avg(close * volume) OVER {_f(20)} AS adv", "adv"),
    "vwap_dist": _q(f"ticker, ts, sum(typical * volume) OVER {_f(260)} / sum(volume) OVER {_f(260)} AS vwap", "vwap"),
    "cumulative_vwap": _q("ticker, ts, sum(typical * volume) OVER w / sum(volume) OVER w AS vwap", "vwap", more=_W),
    "donchian": _q(f"ticker, ts, max(high) OVER {_f(20)} AS hi, min(low) OVER {_f(20)} AS lo", "hi lo"),
    "range_position": _q(f"ticker, ts, CASE WHEN max(high) OVER {_f(20)} > min(low) OVER {_f(20)} THEN greatest(least((close - min(low) OVER {_f(20)}) / (max(high) OVER {_f(20)} - min(low) OVER {_f(20)}), 1), 0) END AS pos", "pos"),
    "prior_day_week": _q(f"ticker, ts, lag(high) OVER w AS pdh, lag(low) OVER w AS pdl, max(high) OVER {_f(5, 1)} AS pwh, min(low) OVER {_f(5, 1)} AS pwl", "pdh pdl pwh pwl", more=_W),
    "nr7": _q(f"ticker, ts, CASE WHEN count(*) OVER {_f(7)} = 7 THEN CASE WHEN rng <= min(rng) OVER {_f(7)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS nr7", "nr7"),
    "divergence": _q(f"ticker, ts, CAST({_DIV} AS DOUBLE) AS div", "div"),
    "atr_contraction": _q(f"ticker, ts, CASE WHEN {_ATR20} > 0 THEN ({_ATR5}) / ({_ATR20}) END AS ratio", "ratio"),
    "ema": _q(f"ticker, ts, {_ema(9)} AS ema9", "ema9", _xs(), "arrays"),
    "ema_stack": _q(f"ticker, ts, (sign({_ema(9)} - {_ema(21)}) + sign({_ema(21)} - {_ema(50)})) / 2 AS align", "align", _xs(), "arrays"),
    "rsi": _q(f"ticker, ts, {_rsi()} AS rsi14", "rsi14", _xs(), "arrays"),
    "rsi_slope": _q(f"ticker, ts, CASE WHEN len(xs) > 19 THEN {_rsi()} - {_rsi('ys')} END AS slope", "slope", _xs() + ", shorter AS (SELECT ticker, ts, xs, xs[1:len(xs) - 5] AS ys FROM arrays)", "shorter"),
    "obv_trend": _q(f"ticker, ts, obv, CASE WHEN count(obv) OVER {_f(20)} = 20 THEN sign(sum(i * obv) OVER {_f(20)} - sum(i) OVER {_f(20)} * sum(obv) OVER {_f(20)} / 20) END AS obv_trend", "obv", "o AS (SELECT ticker, ts, i, sum(signed) OVER w AS obv FROM staged WINDOW w AS (PARTITION BY ticker ORDER BY ts))", "o").replace("END AS obv_trend", "END::DOUBLE AS obv_trend"),
    "rv_percentile": _q("ticker, ts, rv20, CASE WHEN rv20 IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv20)) / len(h) END AS rv_percentile", "rv20 rv_percentile", _RV, "rvh"),
    "adx": _q("b.ticker, b.ts, CASE WHEN b.i > 20 THEN r.r.dxs END AS adx", "adx", _ADX, "staged b LEFT JOIN smoothed r ON b.ticker = r.ticker AND b.ts = r.ts"),
    "regime_features": with_tables(_REGIME_SQL, "bars", "regime_series", doubles=" ".join(_REGIME_KEYS)),
    "swing_pivots": _q(f"ticker, ts, {_SWING.format('hp')} AS swing_high, {_SWING.format('lp')} AS swing_low", "swing_high swing_low", _PIVOTS, "pivots"),
    "location_features": _q("ticker, ts, close, " + ", ".join(f"CASE WHEN atr > 0 THEN (close - {v}) / atr END AS {k}" for k, v in _LOC.items()) + ", CASE WHEN hi > lo THEN greatest(least((close - lo) / (hi - lo), 1), 0) END AS pct_range_position", "close pct_range_position " + " ".join(_LOC), _PIVOTS + ", " + _LEVELS, "levels"),
    "rel_strength": _q(f"r.ticker, r.ts, r.roc10, {_RS_VALUE} AS rs_vs_spy", "roc10 rs_vs_spy", _RS, "rocs r JOIN days d USING (ts)"),
    "breadth": _q("ts, breadth_thrust", "breadth_thrust", _BREADTH, "br"),
    "event_calendar": f"""WITH days AS (SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) + INTERVAL 288 MONTH AS DATE) AS d FROM lineitem),
base AS (SELECT d, last_day(d) AS e, CAST(date_trunc('month', d) AS DATE) AS f FROM days),
marks AS (SELECT d, e - greatest(isodow(e) - 5, 0)::INTEGER AS lw, f + ((5 - isodow(f) + 7) % 7 + 14)::INTEGER AS tf FROM base),
{_DAYS_SQL}, (CAST(floor((tf - DATE '1900-01-01' + 1) / 7) * 5 + least((tf - DATE '1900-01-01' + 1) % 7, 5) AS INTEGER)) AS kt, tf, lw FROM marks), {_FOMC_SQL},
near AS (SELECT wd.d, min({{'a': abs(fomc.k - wd.k), 'i': i, 'v': fomc.k - wd.k}}) AS m, max(CASE WHEN fomc.k - wd.k BETWEEN 1 AND 2 THEN 1 ELSE 0 END) AS pre FROM wd, fomc GROUP BY wd.d)
SELECT d, (d = tf)::INT::DOUBLE AS is_opex, (kt - k)::DOUBLE AS days_to_opex, (d = tf AND month(d) % 3 = 0)::INT::DOUBLE AS is_quad_witch, (d = lw)::INT::DOUBLE AS is_month_end,
  (d = lw AND month(d) % 3 = 0)::INT::DOUBLE AS is_quarter_end, pre::DOUBLE AS pre_fomc, m.v::DOUBLE AS days_to_fomc FROM wd JOIN near USING (d)""",
    "tradeability": """SELECT * REPLACE (round(dollar_adv, 6) AS dollar_adv, round(liquidity, 6) AS liquidity, round(flow_capacity, 6) AS flow_capacity, round(large_hand, 6) AS large_hand, round(score, 6) AS score) FROM (
WITH f AS (SELECT l_suppkey AS symbol, sum(l_extendedprice) * 10 AS dollar_adv FROM lineitem GROUP BY 1), a AS (SELECT s_suppkey AS symbol, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) * 1000000 END AS aum FROM supplier),
c AS (SELECT f.symbol, dollar_adv, aum, CASE WHEN dollar_adv > 0 THEN greatest(least((ln(dollar_adv) - ln(50e6)) / (ln(1e9) - ln(50e6)), 1), 0) ELSE 0 END AS liquidity,
  CASE WHEN coalesce(aum, 0) > 0 THEN greatest(least((ln(aum) - ln(500e6)) / (ln(10e9) - ln(500e6)), 1), 0) ELSE 0 END AS flow_capacity FROM f LEFT JOIN a USING (symbol))
SELECT symbol, dollar_adv, liquidity, flow_capacity, least(liquidity, 0.5) AS large_hand, greatest(least(0.40::DOUBLE * liquidity + 0.35::DOUBLE * flow_capacity + 0.25::DOUBLE * least(liquidity, 0.5), 1), 0) AS score,
  coalesce(dollar_adv >= 50e6 AND aum >= 500e6, false) AS passed,
  array_to_string(list_filter([CASE WHEN dollar_adv < 50e6 THEN 'adv' END, CASE WHEN aum < 500e6 THEN 'aum' END, CASE WHEN aum IS NULL THEN 'aum unavailable' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM c)""",
    "trigger_features": _q(
        "r.ticker, r.ts, momentum_roc, momentum_divergence, atr_contraction, nr7, rsi14, rsi_slope, ema_stack_align, atr_pct, obv_trend, " + _RS_VALUE + " AS rs_vs_spy, br.breadth_thrust",
        "momentum_roc momentum_divergence atr_contraction nr7 rsi14 rsi_slope ema_stack_align atr_pct obv_trend rs_vs_spy breadth_thrust",
        f"""{_RS}, {_BREADTH}, o AS (SELECT *, sum(signed) OVER (PARTITION BY ticker ORDER BY ts) AS obv, list(close) OVER {_f(80)} AS xs, close / lag(close, 10) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS momentum_roc FROM staged),
t AS (SELECT ticker, ts, momentum_roc, CAST({_DIV} AS DOUBLE) AS momentum_divergence, CASE WHEN {_ATR20} > 0 THEN ({_ATR5}) / ({_ATR20}) END AS atr_contraction,
  CASE WHEN count(*) OVER {_f(7)} = 7 THEN CASE WHEN rng <= min(rng) OVER {_f(7)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS nr7, xs, xs[1:len(xs) - 5] AS ys, {_ATR14} / close AS atr_pct,
  CASE WHEN count(obv) OVER {_f(20)} = 20 THEN sign(sum(i * obv) OVER {_f(20)} - sum(i) OVER {_f(20)} * sum(obv) OVER {_f(20)} / 20)::DOUBLE END AS obv_trend FROM o),
u AS (SELECT *, {_rsi()} AS rsi14, CASE WHEN len(xs) > 19 THEN {_rsi()} - {_rsi("ys")} END AS rsi_slope, (sign({_ema(9)} - {_ema(21)}) + sign({_ema(21)} - {_ema(50)})) / 2 AS ema_stack_align FROM t)""",
        "u JOIN rocs r ON u.ticker = r.ticker AND u.ts = r.ts JOIN days d ON d.ts = r.ts JOIN br ON br.ts = r.ts",
    ),
    "dataset_pivot": with_tables("SELECT ticker, " + ", ".join(f"max_by(value, {{'a': decision_ts, 'b': seq}}) FILTER (feature_key = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM features_pit GROUP BY ticker", "features_pit", doubles="click error purchase signup view"),
}

_ALL_KEYS = [c for keys in features.LAYERS.values() for c in keys]
_LAYERS_SQL = f"({ORACLES['location_features']}) l JOIN ({ORACLES['trigger_features']}) t USING (ticker, ts) JOIN ({ORACLES['regime_features']}) r USING (ticker, ts)"
_N_FEATURES = " + ".join(f"({c} IS NOT NULL)::INT" for c in _ALL_KEYS)
ORACLES |= {
    "feature_window": with_tables(f"SELECT ticker, ts, CAST(idx AS INTEGER) AS idx, {_N_FEATURES} AS n_features FROM (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS idx FROM bars) b JOIN {_LAYERS_SQL} USING (ticker, ts)", "bars"),
    "latest_feature_map": with_tables(f"SELECT ticker, ts, round(b.close, 6) AS close, {_N_FEATURES} AS n, momentum_roc AS roc FROM (SELECT ticker, max(ts) AS ts, max_by(close, ts) AS close FROM bars GROUP BY ticker) b JOIN {_LAYERS_SQL} USING (ticker, ts)", "bars"),
}
