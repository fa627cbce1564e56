"""Labels, backtests and validation statistics as queries."""

from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import scalars as sc
from tidemark.operators import crossval, features, labeling, metrics, regime
from tidemark.operators.ordered import positions
from tidemark.plans.indicator_plans import _ATR14, _REGIME_SQL, _STAGED, _W
from tidemark.sources import tables
from tidemark.sources.tables import rounded, with_tables


def _window(spark, sf):
    own = features.staged(tables.bars(spark, sf)).withColumns({"atr": ind.atr(F.col("tr"), 14), "roc10": ind.roc(F.col("close"), 10)})
    return own.select("ticker", "ts", "high", "low", "close", "atr", "roc10", F.col("i").cast("int").alias("idx"))


def _entries(w, side=1):
    return w.where("atr > 0").select("ticker", "idx", F.col("close").alias("entry_px"), F.lit(side).alias("side"), (F.col("atr") * 2.0).alias("target_dist"), (F.col("atr") * 1.0).alias("stop_dist"))


def _labels(side):
    def run(spark, sf):
        w = _window(spark, sf)
        out = labeling.triple_barrier(_entries(w, side), w)
        return rounded(out.select("ticker", "idx", "exit_idx", "outcome", "ret_r", "target_px", "stop_px", "reason"))

    return run


def cooldown_entries(spark, sf):
    own = _window(spark, sf).where("roc10 > 0").select("ticker", "idx")
    return labeling.greedy_cooldown(own, ["ticker"], 2)


def genome_fire(spark, sf):
    """Rows on which a conjunction fires, missing values failing it."""
    rule = labeling.fires([("roc10", "gt", 0.05), ("atr", "lte", 500.0)])
    return _window(spark, sf).select("ticker", "idx", rule.alias("fires"))


def backtest(spark, sf):
    w = _window(spark, sf)
    out = labeling.backtest(w, labeling.fires([("roc10", "gt", 0.0)]))
    return rounded(out.select("ticker", "idx", "exit_idx", "entry_ts", "t1", "outcome", "ret_r"))


def _dataset(spark, sf):
    """Labelled rows: position, time, end of label, return, a made-up probability."""
    t = tables.trades(spark, sf).where("pnl_r IS NOT NULL")
    own = t.groupBy("entry_ts").agg(F.avg("pnl_r").alias("r"), F.sum("trade_id").alias("k"))
    placed = positions(own, ["entry_ts"])
    return placed.select("pos", F.col("entry_ts").alias("ts"), (F.col("entry_ts") + F.make_dt_interval(F.lit(15))).alias("t1"), "r", ((F.col("k") % 997) / 997).alias("p"))


def meta_sizing(spark, sf):
    own = tables.trades(spark, sf).where("pnl_r IS NOT NULL").select("trade_id", "pnl_r", ((F.col("trade_id") % 997) / 997).alias("p")).distinct()
    size = labeling.act_size(F.col("p"), 0.6)
    return rounded(own.select("trade_id", "pnl_r", labeling.meta_label(F.col("pnl_r")).alias("label"), size.alias("size"), (size * F.col("pnl_r")).alias("sized_r")))


def uniqueness(spark, sf):
    own = _dataset(spark, sf).selectExpr("pos AS id", "ts", "t1")
    return rounded(labeling.uniqueness(own).select("id", "weight"))


def effective_n(spark, sf):
    own = _dataset(spark, sf).selectExpr("pos AS id", "ts", "t1")
    return rounded(labeling.uniqueness(own).agg(labeling.effective_n(F.col("weight")).alias("n_eff"), F.count("*").alias("n")))


def cpcv_groups(spark, sf):
    return crossval.spans(crossval.groups(_dataset(spark, sf), 6))


def cpcv_splits(spark, sf):
    return crossval.splits(_dataset(spark, sf), 6, 2, 3).select("split", "pos", "role")


def cpcv_sizes(spark, sf):
    return crossval.sizes(crossval.splits(_dataset(spark, sf), 6, 2, 3))


def cpcv_leaks(spark, sf):
    return crossval.leaks(crossval.splits(_dataset(spark, sf), 6, 2, 3))


def firewall(spark, sf):
    own = crossval.firewall(_dataset(spark, sf), F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-03-31 21:00:00").cast("timestamp_ntz"))
    return own.select("pos", "kept")


def calendar_split(spark, sf):
    return crossval.calendar_split(_dataset(spark, sf)).select("pos", "part")


def metrics_summary(spark, sf):
    return rounded(tables.trades(spark, sf).groupBy("strategy_id").agg(*metrics.summary(F.col("pnl_r"))))


def cost_aware_summary(spark, sf):
    return rounded(tables.trades(spark, sf).groupBy("scanner", "mode").agg(*metrics.summary(F.col("pnl_r") - metrics.COST_R)))


def _cvar(up):
    return lambda spark, sf: rounded(metrics.tail_mean(tables.trades(spark, sf), ["strategy_id"], "pnl_r", 0.05, up))


def drawdown_two_forms(spark, sf):
    return rounded(metrics.drawdowns(tables.trades(spark, sf), ["strategy_id"], "pnl_r", ["entry_ts", "trade_id", "pnl_r"]))


def equity_curve(spark, sf):
    own = tables.trades(spark, sf).where("pnl_r IS NOT NULL")
    return rounded(metrics.equity(own, ["strategy_id"], "pnl_r", ["entry_ts", "trade_id", "pnl_r"]).select("strategy_id", "trade_id", "pnl_r", "equity", "peak"))


def moments_bias_corrected(spark, sf):
    return rounded(metrics.moments(tables.trades(spark, sf), ["strategy_id"], "pnl_r"))


def psr_dsr(spark, sf):
    stats = metrics.moments(tables.trades(spark, sf), ["strategy_id"], "pnl_r")
    return rounded(metrics.deflated_sharpe(stats, 20).select("strategy_id", "n", "dsr"))


def _trials(spark, sf):
    t = tables.trades(spark, sf).where("pnl_r IS NOT NULL")
    return t.groupBy(F.date_trunc("month", "entry_ts").alias("t"), (F.col("strategy_id") % 10).cast("int").alias("trial")).agg(F.avg("pnl_r").alias("ret"))


def cscv_logits(spark, sf):
    return rounded(metrics.cscv(_trials(spark, sf), 6))


def pbo(spark, sf):
    return rounded(metrics.overfit_probability(metrics.cscv(_trials(spark, sf), 6)))


def wilson_lb(spark, sf):
    own = tables.scores(spark, sf)
    return rounded(own.select("score_id", sc.wilson_lower_bound(F.col("precision_oos"), F.col("n_acted")).alias("lb")))


def tau_grid(spark, sf):
    return rounded(metrics.tau_grid(_dataset(spark, sf)))


def threshold_stats(spark, sf):
    taus = spark.createDataFrame([(x / 10,) for x in range(3, 10)], "tau double")
    return rounded(metrics.at_thresholds(_dataset(spark, sf), taus))


def selected_tau(spark, sf):
    """The chosen threshold (one number of a driver-side choice over a grid)."""
    return spark.createDataFrame([(round(metrics.select_tau(_dataset(spark, sf)), 6),)], "tau double")


def regime_contrib(spark, sf):
    own = tables.trades(spark, sf).where("pnl_r IS NOT NULL").groupBy(F.col("mode").alias("regime"), "scanner").agg(F.avg("pnl_r").alias("mean_r"), F.count("*").alias("n"))
    return rounded(own.withColumn("positive", (F.col("n") >= 20) & (F.col("mean_r") > 0)))


def reliability_curve(spark, sf):
    own = _dataset(spark, sf).select("p", (F.col("r") > 0).cast("int").alias("y"))
    return rounded(metrics.reliability(own, "p", "y"))


def brier(spark, sf):
    return rounded(_dataset(spark, sf).agg(metrics.brier(F.col("p"), (F.col("r") > 0).cast("double")).alias("brier")))


def nearest_rank_quantile(spark, sf):
    return rounded(metrics.nearest_ranks(tables.bars(spark, sf), "ticker", "close", [0.2, 0.5, 0.8]).drop("n", "lo", "hi"))


def gate(spark, sf):
    return metrics.gate(tables.scores(spark, sf)).select("score_id", "passed", "survivor", "failures")


def leaderboard(spark, sf):
    """Scores by gate, expectancy, DSR, PBO: the top 50."""
    own = metrics.gate(tables.scores(spark, sf)).orderBy(F.col("passed").desc(), F.col("expectancy").desc_nulls_last(), F.col("dsr").desc_nulls_last(), F.col("pbo").asc_nulls_last(), "score_id").limit(50)
    return rounded(own.select("score_id", "passed", "expectancy"))


def promotable(spark, sf):
    own = metrics.gate(tables.scores(spark, sf))
    ok = F.col("passed") & (F.col("score_id") % 3 != 0) & (F.col("n_acted") >= 8) & (sc.wilson_lower_bound(F.col("precision_oos"), F.col("n_acted")) >= 0.45)
    return own.where(F.coalesce(ok, F.lit(False))).select("score_id")


def risk_geometry(spark, sf):
    """Stops and targets of parsed specs, for a side each."""
    specs = ["atr:1.0", "fixed:$5", "pct:2.5", "r:2", "bad", "atr:-1"]
    own = tables.read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("entry"), (F.col("p_size") / 10).alias("atr"), F.element_at(F.array(*[F.lit(s) for s in specs]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("spec"))
    own = own.withColumn("s", labeling.parse_spec(F.col("spec")))
    d = labeling.distance(F.col("s.kind"), F.col("s.value"), F.col("entry"), F.col("atr"), F.lit(1.5) * F.col("atr"))
    return rounded(own.select("p_partkey", "spec", d.alias("dist"), (F.col("entry") - d).alias("stop_long"), (F.col("entry") + d).alias("stop_short")))


def _regime_inputs(spark, sf):
    e = tables.read(spark, sf, "orders")
    x = lambda k: (F.col("o_totalprice") % k) / k
    return e.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, x(101)).alias("rv_percentile"), (0.7 + x(103) * 0.6).alias("vix_vix3m"), F.when(F.col("o_orderkey") % 5 != 0, 70 + x(107) * 70).alias("vvix"),
        F.when(F.col("o_orderkey") % 3 == 0, x(109) * 5.2).alias("rv20"), (x(113) * 0.04 - 0.02).alias("copper_gold"), F.when(F.col("o_orderkey") % 4 != 0, x(127) * 0.04 - 0.02).alias("dxy_trend"), (2 + x(131) * 4).alias("hy_oas"),
    )


def regime_label(spark, sf):
    return rounded(regime.classify(_regime_inputs(spark, sf)).select("o_orderkey", "label", "confidence", "observed_inputs"))


def regime_shares(spark, sf):
    return rounded(regime.shares(regime.classify(_regime_inputs(spark, sf))))


QUERIES = {f.__name__: f for f in (
    cooldown_entries, genome_fire, backtest, meta_sizing, uniqueness, effective_n, cpcv_groups, cpcv_splits, cpcv_sizes, cpcv_leaks, firewall, calendar_split, metrics_summary, cost_aware_summary,
    drawdown_two_forms, equity_curve, moments_bias_corrected, psr_dsr, cscv_logits, pbo, wilson_lb, tau_grid, threshold_stats, selected_tau, regime_contrib, reliability_curve, brier,
    nearest_rank_quantile, gate, leaderboard, promotable, risk_geometry, regime_label, regime_shares,
)} | {"triple_barrier": _labels(1), "triple_barrier_short": _labels(-1), "cvar_floor": _cvar(False), "cvar_ceil": _cvar(True)}

_WIN = f"win AS (SELECT ticker, ts, high, low, close, i AS idx, {_ATR14} AS atr, close / nullif(lag(close, 10) OVER w, 0) - 1 AS roc10 FROM staged {_W})"
_HEAD = f"WITH {_STAGED}, {_WIN}"


def _barrier(entries, s):
    op, po = (">=", "<=") if s > 0 else ("<=", ">=")
    hi, lo = ("high", "low") if s > 0 else ("low", "high")
    return f"""e AS ({entries}), px AS (SELECT *, entry_px + {s} * td AS target_px, entry_px - {s} * sd AS stop_px FROM e),
met AS (SELECT e.*, b.idx AS b, b.close AS bc, CASE WHEN b.{lo} {po} stop_px THEN 'stop' WHEN b.{hi} {op} target_px THEN 'target' END AS hit FROM px e LEFT JOIN win b ON b.ticker = e.ticker AND b.idx > e.idx AND b.idx <= e.idx + 15),
lab AS (SELECT ticker, idx, any_value(entry_px) AS entry_px, any_value(td) AS td, any_value(sd) AS sd, any_value(target_px) AS target_px, any_value(stop_px) AS stop_px, min(b) FILTER (hit IS NOT NULL) AS hb, arg_min(hit, b) FILTER (hit IS NOT NULL) AS ho, max(b) AS lb, arg_max(bc, b) AS lc FROM met GROUP BY ticker, idx),
labels AS (SELECT ticker, idx, CAST(coalesce(hb, lb) AS INTEGER) AS exit_idx, CASE WHEN lb IS NOT NULL THEN coalesce(ho, 'time') END AS outcome, CASE WHEN lb IS NULL THEN NULL WHEN ho = 'stop' THEN -1.0 WHEN ho = 'target' THEN td / sd ELSE {s} * (lc - entry_px) / sd END AS ret_r,
  target_px, stop_px, CASE WHEN lb IS NULL THEN 'no bar ahead' END AS reason FROM lab)"""


_EVERY = "SELECT ticker, idx, close AS entry_px, atr * 2.0::DOUBLE AS td, atr AS sd FROM win WHERE atr > 0"
_COOL = """cand AS (SELECT ticker, list(CAST(idx AS INTEGER) ORDER BY idx) AS c FROM ({src}) GROUP BY ticker),
cool AS (SELECT ticker, unnest(list_reduce(list_prepend({{'l': NULL::INTEGER, 'k': []::INTEGER[]}}, list_transform(c, lambda i: {{'l': i, 'k': []::INTEGER[]}})), lambda a, x: CASE WHEN a.l IS NULL OR x.l > a.l + 2 THEN {{'l': x.l, 'k': list_append(a.k, x.l)}} ELSE a END).k) AS idx FROM cand)"""
_DATA = "data AS (SELECT CAST(row_number() OVER (ORDER BY entry_ts) - 1 AS INTEGER) AS pos, entry_ts AS ts, entry_ts + to_days(15) AS t1, avg(pnl_r) AS r, (CAST(sum(trade_id) AS BIGINT) % 997) / 997 AS p FROM trades WHERE pnl_r IS NOT NULL GROUP BY entry_ts)"
_OPEN = "pts AS (SELECT DISTINCT ts AS x FROM data), op AS (SELECT x, count(*) AS c FROM pts JOIN data ON ts <= x AND t1 >= x GROUP BY x), uq AS (SELECT pos AS id, avg(1.0::DOUBLE / c) AS weight FROM data JOIN op ON x BETWEEN ts AND t1 GROUP BY pos)"
_GROUPS = "g AS (SELECT *, (SELECT count(*) FROM (SELECT unnest([1, 2, 3, 4, 5]) AS j) WHERE pos >= floor((SELECT count(*) FROM data) * j / 6)) AS grp FROM data), sp AS (SELECT CAST(grp AS INTEGER) AS grp, min(ts) AS lo, max(t1) AS hi, min(pos) AS first, max(pos) AS last FROM g GROUP BY grp)"
_SPLITS = """c AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split, a, b FROM (SELECT x.grp AS a, y.grp AS b FROM sp x, sp y WHERE x.grp < y.grp)),
spl AS (SELECT split, pos, g.ts, g.t1, CASE WHEN g.grp IN (a, b) THEN 'test' WHEN (g.ts <= x.hi AND g.t1 >= x.lo) OR (g.ts <= y.hi AND g.t1 >= y.lo) THEN 'purged' WHEN pos - x.last BETWEEN 1 AND 3 OR pos - y.last BETWEEN 1 AND 3 THEN 'embargoed' ELSE 'train' END AS role
  FROM g, c JOIN sp x ON x.grp = a JOIN sp y ON y.grp = b)"""
_SUMMARY = """count({r}) AS n, avg({r}) AS expectancy, CASE WHEN count({r}) >= 2 THEN stddev_samp({r}) END AS sd, CASE WHEN count({r}) >= 2 AND stddev_samp({r}) > 0 THEN avg({r}) / stddev_samp({r}) END AS sharpe,
  CASE WHEN sum(CASE WHEN {r} < 0 THEN -({r}) ELSE 0 END) > 0 THEN sum(CASE WHEN {r} > 0 THEN {r} ELSE 0 END) / sum(CASE WHEN {r} < 0 THEN -({r}) ELSE 0 END) END AS profit_factor, count(*) FILTER ({r} > 0) / nullif(count({r}), 0) AS hit_rate, sum({r}) AS total_r"""
_SUMMED = "expectancy sd sharpe profit_factor hit_rate total_r"
_EQ = "eq AS (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY entry_ts, trade_id, pnl_r ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, sum(pnl_r) OVER (PARTITION BY strategy_id ORDER BY entry_ts, trade_id, pnl_r ROWS UNBOUNDED PRECEDING) AS equity FROM trades WHERE pnl_r IS NOT NULL))"
_MOM = """mo AS (SELECT strategy_id, count(*) AS n, any_value(a) AS mean, stddev_samp(pnl_r) AS sd, avg(pow(pnl_r - a, 2)) AS m2, avg(pow(pnl_r - a, 3)) AS m3, avg(pow(pnl_r - a, 4)) AS m4 FROM (SELECT *, avg(pnl_r) OVER (PARTITION BY strategy_id) AS a FROM trades WHERE pnl_r IS NOT NULL) GROUP BY strategy_id),
ms AS (SELECT strategy_id, n, mean, sd, CASE WHEN n > 2 AND m2 > 0 THEN sqrt(n * (n - 1)) / (n - 2) * (m3 / pow(m2, 1.5)) END AS skew, CASE WHEN n > 3 AND m2 > 0 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3 END AS kurtosis FROM mo)"""
_Z = f"((mean / sd - sqrt((1 + 0.5::DOUBLE * (mean / sd) * (mean / sd)) / n) * {metrics.expected_max_sharpe(20)!r}::DOUBLE) * sqrt(n - 1) / sqrt(greatest(1 - coalesce(skew, 0) * mean / sd + (coalesce(kurtosis, 3) - 1) / 4 * (mean / sd) * (mean / sd), 1e-12)))"
_CSCV = """tr AS (SELECT date_trunc('month', entry_ts) AS t, CAST(strategy_id % 10 AS INTEGER) AS trial, avg(pnl_r) AS ret FROM trades WHERE pnl_r IS NOT NULL GROUP BY ALL),
bl AS (SELECT t, CAST(floor((row_number() OVER (ORDER BY t) - 1) / (SELECT floor(count(DISTINCT t) / 6) FROM tr)) AS INTEGER) AS block FROM (SELECT DISTINCT t FROM tr)),
co AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS combo, [a, b, c] AS parts FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a < b AND b < c),
pf AS (SELECT combo, trial, list_contains(parts, block) AS ins, CASE WHEN var_samp(ret) > 1e-18 THEN avg(ret) / sqrt(var_samp(ret)) ELSE 0 END AS perf FROM tr JOIN bl USING (t), co WHERE block < 6 GROUP BY ALL),
rk AS (SELECT combo, trial, round(max(perf) FILTER (ins), 12) AS ip, round(max(perf) FILTER (NOT ins), 12) AS op FROM pf GROUP BY combo, trial),
rr AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY op, trial) AS rank, count(*) OVER (PARTITION BY combo) AS n, row_number() OVER (PARTITION BY combo ORDER BY ip DESC, trial) AS br FROM rk),
lg AS (SELECT CAST(combo AS INTEGER) AS combo, ln((rank / (n + 1.0::DOUBLE)) / (1 - rank / (n + 1.0::DOUBLE))) AS logit FROM rr WHERE br = 1)"""
_WIL = "CASE WHEN m IS NOT NULL AND precision_oos IS NOT NULL THEN greatest(least((precision_oos + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (2 * m) - 1.959963984540054::DOUBLE * sqrt(precision_oos * (1 - precision_oos) / m + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (4 * m * m))) / (1 + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / m), 1), 0) ELSE 0 END"
_SC = "sm AS (SELECT *, CASE WHEN n_acted > 0 THEN n_acted::DOUBLE END AS m, coalesce(dsr > 0 AND pbo < 0.5 AND expectancy > 0 AND n_regimes >= 2, false) AS passed FROM scores)"
_ACT = "th AS (SELECT tau, count(*) FILTER (p >= tau) AS n_acted, coalesce(count(*) FILTER (p >= tau AND r > 0.05) / nullif(count(*) FILTER (p >= tau), 0), 0) AS precision, coalesce(count(*) FILTER (p >= tau AND r > 0.05) / nullif(count(*) FILTER (r > 0.05), 0), 0) AS recall, avg(r - 0.05::DOUBLE) FILTER (p >= tau) AS expectancy FROM data, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS tau) GROUP BY tau)"

_CHOICE = """grid AS (SELECT DISTINCT tau FROM (SELECT unnest(list_transform(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9))) AS tau FROM data UNION ALL SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE)),
halves AS (SELECT *, CASE WHEN pos < floor(0.7::DOUBLE * (SELECT count(*) FROM data)) THEN 0 ELSE 1 END AS k FROM data),
ok AS (SELECT k, tau, precision, recall, expectancy FROM (SELECT k, tau, count(*) AS size, count(*) FILTER (p >= tau) AS n_acted, count(*) FILTER (p >= tau AND r > 0.05) / nullif(count(*) FILTER (p >= tau), 0) AS precision,
  count(*) FILTER (p >= tau AND r > 0.05) / nullif(count(*) FILTER (r > 0.05), 0) AS recall, avg(r - 0.05::DOUBLE) FILTER (p >= tau) AS expectancy FROM halves, grid GROUP BY k, tau) WHERE n_acted >= greatest(8, ceil(0.1::DOUBLE * size)) AND expectancy > 0)"""


def _evidence(label):
    return " + ".join(f"CASE WHEN {regime.CONDITIONS[k].replace('gex_sign IS NULL', 'true')} THEN {w} ELSE 0 END" for k, w in regime.EVIDENCE[label].items() if not k.startswith("gamma"))


_RANKED = """rp AS (SELECT *, list_filter(ev, lambda e: e.s > 0) AS fe FROM rs), rq AS (SELECT *, list_max(list_transform(fe, lambda e: e.s)) AS top FROM rp),
rx AS (SELECT *, list_sum(list_transform(fe, lambda e: exp((e.s - top) / 0.6::DOUBLE))) AS tot FROM rq),
ro AS (SELECT *, list_sort(list_transform(fe, lambda e: {'np': -exp((e.s - top) / 0.6::DOUBLE) / tot, 'i': e.i, 'l': e.l})) AS rk FROM rx)"""
_TORN = "len(rk) > 1 AND abs(rk[1].np - rk[2].np) <= 0.08 AND list_sort([rk[1].l, rk[2].l]) IN (['vol_compression', 'vol_expansion'], ['risk_off', 'risk_on'], ['long_gamma', 'short_gamma'])"
_EV = ", ".join(f"{{'l': '{x}', 'i': {i}, 's': ({_evidence(x)})::DOUBLE}}" for i, x in enumerate(regime.LABELS))
_REG = """ri AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN (o_totalprice % 101) / 101 END AS rv_percentile, 0.7::DOUBLE + (o_totalprice % 103) / 103 * 0.6::DOUBLE AS vix_vix3m, CASE WHEN o_orderkey % 5 <> 0 THEN 70 + (o_totalprice % 107) / 107 * 70 END AS vvix,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice % 109) / 109 * 5.2::DOUBLE END AS rv20, (o_totalprice % 113) / 113 * 0.04::DOUBLE - 0.02::DOUBLE AS copper_gold, CASE WHEN o_orderkey % 4 <> 0 THEN (o_totalprice % 127) / 127 * 0.04::DOUBLE - 0.02::DOUBLE END AS dxy_trend, 2 + (o_totalprice % 131) / 131 * 4 AS hy_oas FROM orders),
rs AS (SELECT *, (rv_percentile IS NOT NULL)::INT + 1 + (vvix IS NOT NULL)::INT + (rv20 IS NOT NULL)::INT + 1 + (dxy_trend IS NOT NULL)::INT AS core, coalesce(rv20 NOT BETWEEN 0 AND 5, false) OR coalesce(vvix NOT BETWEEN 40 AND 280, false) AS far, [""" + _EV + """] AS ev FROM ri),
""" + _RANKED + """,
rl AS (SELECT o_orderkey, CASE WHEN core < 3 OR far THEN 'out_of_distribution' WHEN len(rk) = 0 OR (len(rk) > 1 AND abs(rk[1].np - rk[2].np) <= 0.08 AND list_sort([rk[1].l, rk[2].l]) IN (['vol_compression', 'vol_expansion'], ['risk_off', 'risk_on'], ['long_gamma', 'short_gamma'])) THEN 'transition' ELSE rk[1].l END AS label,
  CASE WHEN core < 3 OR far OR len(rk) = 0 THEN 1.0 ELSE -rk[1].np END AS confidence, CAST(core + 1 AS INTEGER) AS observed_inputs FROM ro)"""

_CORE, _SEEN = (" + ".join(f"({c} IS NOT NULL)::INT" for c in names) for names in (regime.CORE, [c for c in regime.INPUTS if c != "gex_sign"]))
_FAR = " OR ".join(f"coalesce({c} NOT BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in regime.ENVELOPE.items())
_BY_DAY = f"""WITH rs AS (SELECT *, {_CORE} AS core, {_SEEN} AS seen, {_FAR} AS far, [{_EV}] AS ev FROM ri), {_RANKED}
SELECT ticker, ts, CASE WHEN core < 3 OR far THEN 'out_of_distribution' WHEN len(rk) = 0 OR ({_TORN}) THEN 'transition' ELSE rk[1].l END AS label,
  CASE WHEN core < 3 OR far OR len(rk) = 0 THEN 1.0 ELSE -rk[1].np END AS confidence, CAST(seen AS INTEGER) AS observed_inputs FROM ro"""

ORACLES = {
    "regime_by_day": f"SELECT * REPLACE (round(confidence, 6) AS confidence) FROM (WITH ri AS ({with_tables(_REGIME_SQL, 'bars', 'regime_series')}), {_BY_DAY[5:]})",
    "triple_barrier": with_tables(f"{_HEAD}, {_barrier(_EVERY, 1)} SELECT CAST(idx AS INTEGER) AS idx, * EXCLUDE (idx) FROM labels", "bars", doubles="ret_r target_px stop_px"),
    "triple_barrier_short": with_tables(f"{_HEAD}, {_barrier(_EVERY, -1)} SELECT CAST(idx AS INTEGER) AS idx, * EXCLUDE (idx) FROM labels", "bars", doubles="ret_r target_px stop_px"),
    "cooldown_entries": with_tables(f"{_HEAD}, {_COOL.format(src='SELECT ticker, idx FROM win WHERE roc10 > 0')} SELECT * FROM cool", "bars"),
    "genome_fire": with_tables(f"{_HEAD} SELECT ticker, CAST(idx AS INTEGER) AS idx, coalesce(roc10 > 0.05, false) AND coalesce(atr <= 500, false) AS fires FROM win", "bars"),
    "backtest": with_tables(f"{_HEAD}, {_COOL.format(src='SELECT ticker, idx FROM win w0 WHERE roc10 > 0 AND atr > 0 AND idx < (SELECT max(idx) FROM win w1 WHERE w1.ticker = w0.ticker)')}, {_barrier('SELECT w.ticker, w.idx, close AS entry_px, atr * 2.0::DOUBLE AS td, atr AS sd FROM win w JOIN cool c ON c.ticker = w.ticker AND c.idx = w.idx', 1)} SELECT l.ticker, CAST(l.idx AS INTEGER) AS idx, l.exit_idx, a.ts AS entry_ts, b.ts AS t1, outcome, ret_r FROM labels l JOIN win a ON a.ticker = l.ticker AND a.idx = l.idx LEFT JOIN win b ON b.ticker = l.ticker AND b.idx = l.exit_idx", "bars", doubles="ret_r"),
    "meta_sizing": with_tables("SELECT DISTINCT trade_id, pnl_r, (pnl_r > 0)::INT AS label, CASE WHEN p >= 0.6 THEN (p - 0.6::DOUBLE) / (1 - 0.6::DOUBLE) ELSE 0 END AS size, CASE WHEN p >= 0.6 THEN (p - 0.6::DOUBLE) / (1 - 0.6::DOUBLE) ELSE 0 END * pnl_r AS sized_r FROM (SELECT *, (trade_id % 997) / 997 AS p FROM trades WHERE pnl_r IS NOT NULL)", "trades", doubles="pnl_r size sized_r"),
    "uniqueness": with_tables(f"WITH {_DATA}, {_OPEN} SELECT * FROM uq", "trades", doubles="weight"),
    "effective_n": with_tables(f"WITH {_DATA}, {_OPEN} SELECT pow(sum(weight), 2) / sum(weight * weight) AS n_eff, count(*) AS n FROM uq", "trades", doubles="n_eff"),
    "cpcv_groups": with_tables(f"WITH {_DATA}, {_GROUPS} SELECT * FROM sp", "trades"),
    "cpcv_splits": with_tables(f"WITH {_DATA}, {_GROUPS}, {_SPLITS} SELECT split, pos, role FROM spl", "trades"),
    "cpcv_sizes": with_tables(f"WITH {_DATA}, {_GROUPS}, {_SPLITS} SELECT split, " + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("train", "test", "purged", "embargoed")) + " FROM spl GROUP BY split", "trades"),
    "cpcv_leaks": with_tables(f"WITH {_DATA}, {_GROUPS}, {_SPLITS} SELECT DISTINCT a.split, a.pos FROM spl a JOIN spl b ON a.split = b.split AND a.role = 'train' AND b.role = 'test' AND a.ts <= b.t1 AND b.ts <= a.t1", "trades"),
    "firewall": with_tables(f"WITH {_DATA} SELECT pos, NOT (ts <= TIMESTAMP '1998-03-31 21:00:00' AND t1 >= TIMESTAMP '1998-01-01') AS kept FROM data", "trades"),
    "calendar_split": with_tables(f"WITH {_DATA}, mid AS (SELECT ts FROM data ORDER BY ts LIMIT 1 OFFSET (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM data)) SELECT pos, CASE WHEN ts < (SELECT ts FROM mid) THEN 'is' ELSE 'oos' END AS part FROM data", "trades"),
    "metrics_summary": with_tables(f"SELECT strategy_id, {_SUMMARY.format(r='pnl_r')} FROM trades GROUP BY strategy_id", "trades", doubles=_SUMMED),
    "cost_aware_summary": with_tables(f"SELECT scanner, mode, {_SUMMARY.format(r='(pnl_r - 0.05::DOUBLE)')} FROM trades GROUP BY scanner, mode", "trades", doubles=_SUMMED),
    "cvar_floor": with_tables("SELECT strategy_id, avg(pnl_r) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pnl_r) AS k, count(*) OVER (PARTITION BY strategy_id) AS n FROM trades WHERE pnl_r IS NOT NULL) WHERE k <= greatest(1, floor(0.05::DOUBLE * n)) GROUP BY strategy_id", "trades", doubles="cvar"),
    "cvar_ceil": with_tables("SELECT strategy_id, avg(pnl_r) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pnl_r) AS k, count(*) OVER (PARTITION BY strategy_id) AS n FROM trades WHERE pnl_r IS NOT NULL) WHERE k <= greatest(1, ceil(0.05::DOUBLE * n)) GROUP BY strategy_id", "trades", doubles="cvar"),
    "drawdown_two_forms": with_tables(f"WITH {_EQ} SELECT strategy_id, max(peak - equity) AS mdd, min(equity - greatest(peak, 0)) AS mdd_from_zero, sum(pnl_r) AS total, CASE WHEN max(peak - equity) > 0 THEN sum(pnl_r) / max(peak - equity) END AS mar FROM eq GROUP BY strategy_id", "trades", doubles="mdd mdd_from_zero total mar"),
    "equity_curve": with_tables(f"WITH {_EQ} SELECT strategy_id, trade_id, pnl_r, equity, peak FROM eq", "trades", doubles="pnl_r equity peak"),
    "moments_bias_corrected": with_tables(f"WITH {_MOM} SELECT * FROM ms", "trades", doubles="mean sd skew kurtosis"),
    "psr_dsr": with_tables(f"WITH {_MOM} SELECT strategy_id, n, CASE WHEN n < 2 THEN 0.5 WHEN sd = 0 THEN (mean > 0)::INT ELSE {sc.norm_cdf_sql(_Z)} END AS dsr FROM ms", "trades", doubles="dsr"),
    "cscv_logits": with_tables(f"WITH {_CSCV} SELECT * FROM lg", "trades", doubles="logit"),
    "pbo": with_tables(f"WITH {_CSCV} SELECT avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END) AS pbo, count(*) AS n_combinations FROM lg", "trades", doubles="pbo"),
    "wilson_lb": with_tables(f"WITH {_SC} SELECT score_id, {_WIL} AS lb FROM sm", "scores", doubles="lb"),
    "tau_grid": with_tables(f"WITH {_DATA} SELECT DISTINCT tau FROM (SELECT unnest(list_transform(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9))) AS tau FROM data UNION ALL SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE)", "trades", doubles="tau"),
    "threshold_stats": with_tables(f"WITH {_DATA}, {_ACT} SELECT * FROM th", "trades", doubles="tau precision recall expectancy"),
    "selected_tau": with_tables(f"WITH {_DATA}, {_CHOICE} SELECT coalesce((SELECT a.tau FROM ok a JOIN ok b ON b.tau = a.tau AND a.k = 0 AND b.k = 1 WHERE a.recall >= 0.10 ORDER BY b.k, a.precision DESC, a.expectancy DESC, a.tau LIMIT 1), 0.5::DOUBLE) AS tau", "trades", doubles="tau"),
    "regime_contrib": with_tables("SELECT mode AS regime, scanner, avg(pnl_r) AS mean_r, count(*) AS n, count(*) >= 20 AND avg(pnl_r) > 0 AS positive FROM trades WHERE pnl_r IS NOT NULL GROUP BY mode, scanner", "trades", doubles="mean_r"),
    "reliability_curve": with_tables(f"WITH {_DATA} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, avg(p) AS predicted, avg((r > 0)::INT) AS observed, count(*) AS n FROM data GROUP BY 1", "trades", doubles="predicted observed"),
    "brier": with_tables(f"WITH {_DATA} SELECT avg(pow(p - (r > 0)::INT, 2)) AS brier FROM data", "trades", doubles="brier"),
    "nearest_rank_quantile": with_tables("SELECT ticker, xs[CAST(round(0.2 * (len(xs) - 1)) AS INT) + 1] AS q20, xs[CAST(round(0.5 * (len(xs) - 1)) AS INT) + 1] AS q50, xs[CAST(round(0.8 * (len(xs) - 1)) AS INT) + 1] AS q80 FROM (SELECT ticker, list_sort(list(close)) AS xs FROM bars GROUP BY ticker)", "bars", doubles="q20 q50 q80"),
    "gate": with_tables("SELECT score_id, dsr > 0 AND pbo < 0.5 AND expectancy > 0 AND n_regimes >= 2 AS passed, dsr > 0 AND pbo < 0.5 AND expectancy > 0 AS survivor, array_to_string(list_filter([CASE WHEN NOT dsr > 0 THEN 'dsr' END, CASE WHEN NOT pbo < 0.5 THEN 'pbo' END, CASE WHEN NOT expectancy > 0 THEN 'expectancy' END, CASE WHEN NOT n_regimes >= 2 THEN 'n_regimes' END], lambda x: x IS NOT NULL), ',') AS failures FROM scores", "scores"),
    "leaderboard": with_tables(f"WITH {_SC} SELECT score_id, passed, expectancy FROM sm ORDER BY passed DESC, expectancy DESC, dsr DESC, pbo, score_id LIMIT 50", "scores", doubles="expectancy"),
    "promotable": with_tables(f"WITH {_SC} SELECT score_id FROM sm WHERE passed AND score_id % 3 <> 0 AND n_acted >= 8 AND {_WIL} >= 0.45", "scores"),
    "risk_geometry": "SELECT * REPLACE (round(dist, 6) AS dist, round(stop_long, 6) AS stop_long, round(stop_short, 6) AS stop_short) FROM (SELECT p_partkey, spec, d AS dist, e - d AS stop_long, e + d AS stop_short FROM (SELECT p_partkey, p_retailprice AS e, (['atr:1.0', 'fixed:$5', 'pct:2.5', 'r:2', 'bad', 'atr:-1'])[p_partkey % 6 + 1] AS spec, CASE p_partkey % 6 WHEN 0 THEN p_size / 10 WHEN 1 THEN 5 WHEN 2 THEN p_retailprice * 2.5::DOUBLE / 100 WHEN 3 THEN 2 * (1.5::DOUBLE * (p_size / 10)) END AS d FROM part))",
    "regime_label": f"SELECT * REPLACE (round(confidence, 6) AS confidence) FROM (WITH {_REG} SELECT * FROM rl)",
    "regime_shares": f"SELECT * REPLACE (round(share, 6) AS share) FROM (WITH {_REG} SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM rl) AS share FROM rl GROUP BY label)",
}
