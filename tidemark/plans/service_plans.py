"""Monitor, signals, journal and the read surface as queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import scalars as sc
from tidemark.operators import api, crossval, labeling, metrics, monitor, search, signals, sinks
from tidemark.operators.pit import top_one
from tidemark.plans import model_plans
from tidemark.plans.indicator_plans import _ATR14, _STAGED
from tidemark.plans.label_plans import _barrier
from tidemark.sources import tables
from tidemark.sources.tables import rounded, with_tables

NOW = "2001-06-30 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _recent(spark, sf):
    return monitor.recent_trades(tables.trades(spark, sf), tables.signals(spark, sf), _now(), 1500)


def recent_trades(spark, sf):
    return rounded(_recent(spark, sf).select("trade_id", "strategy_id", "pnl_r", "conviction"))


def _expected(spark, sf):
    return top_one(tables.scores(spark, sf), ["strategy_id"], ["evaluated_at", "score_id"])


def divergence_detector(spark, sf):
    return rounded(monitor.divergence(_recent(spark, sf), _expected(spark, sf)))


def decay_detector(spark, sf):
    return rounded(monitor.decay(_recent(spark, sf).withColumn("pnl_r", F.col("pnl_r") - F.when(F.col("strategy_id") % 2 == 0, 0.3).otherwise(0.0))))


def drawdown_detector(spark, sf):
    return rounded(monitor.drawdown(_recent(spark, sf)))


def calibration_detector(spark, sf):
    return rounded(monitor.calibration(_recent(spark, sf).withColumn("conviction", F.col("conviction") * (F.col("strategy_id") % 3) / 2)))


def source_freshness(spark, sf):
    return monitor.freshness(("bars", tables.bars(spark, sf)), ("macro", tables.macro(spark, sf)))


def staleness_detector(spark, sf):
    return rounded(monitor.staleness(source_freshness(spark, sf), F.lit("2001-12-31 00:00:00").cast("timestamp_ntz")))


def regime_ood_detector(spark, sf):
    labels = tables.read(spark, sf, "events").select(F.expr("CASE WHEN event_type = 'error' THEN 'out_of_distribution' ELSE 'risk_on' END").alias("label"), "ts")
    return rounded(monitor.regime_ood(labels, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))


def regate(spark, sf):
    return rounded(monitor.regate(tables.strategies(spark, sf), tables.scores(spark, sf)))


def _events(spark, sf):
    kinds = ["shrink_size", "quarantine", "demote", "disable", "recalibrate", "skip_degraded", "hold"]
    own = tables.read(spark, sf, "orders")
    return own.select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 10 + 1).alias("strategy_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("detector"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("action"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"note": "n'), F.col("o_orderkey").cast("string"), F.lit('"}'))).when(F.col("o_orderkey") % 3 == 1, F.lit('{"x": 1}')).alias("doc"),
    )


def changelog(spark, sf):
    out = monitor.changelog(_events(spark, sf).withColumn("week", sc.iso_week(F.col("ts"))))
    return out.select("week", *[F.array_join(c, ",").alias(c) for c in ("decayed", "retired", "adapted")])


def status_transitions(spark, sf):
    return monitor.transitions(_events(spark, sf)).select("event_id", "status")


def alert_pairs(spark, sf):
    return monitor.alerts(_events(spark, sf).select("event_id", "detector", "action")).groupBy("action").agg(F.count("*").alias("n"))


def monitor_report(spark, sf):
    return monitor.report(_events(spark, sf))


def monitor_feed(spark, sf):
    """The newest 500 events as operators see them."""
    own = api.page(_events(spark, sf), "ts", "event_id")
    return own.select("event_id", "ts", api.operator_action(F.col("action")).alias("action"), api.detail(F.col("doc")).alias("detail"))


def population(spark, sf):
    own = api.population(tables.strategies(spark, sf), tables.scores(spark, sf))
    return rounded(api.filtered(own, "dated", scanner="ETF", since="1995-06-01", until="2001-12-31").select("strategy_id", "name", "dated", "expectancy"))


def signals_page(spark, sf):
    own = api.filtered(tables.signals(spark, sf), "created_at", since="1996-01-01", until="2000-12-31")
    return rounded(api.page(own, "created_at", "signal_id").select("signal_id", "created_at", "ticker", "conviction"))


def signal_by_id(spark, sf):
    return rounded(tables.signals(spark, sf).where("signal_id = 7").select("signal_id", "ticker", "entry"))


def journal_page(spark, sf):
    own = api.filtered(tables.trades(spark, sf), "entry_ts", scanner="equity", until="not a date")
    return rounded(own.orderBy(F.col("entry_ts").desc(), "trade_id", "pnl_r").limit(500).select("trade_id", "entry_ts", "pnl_r"))


def realized_stats(spark, sf):
    return rounded(signals.tally(tables.trades(spark, sf).where("mode IN ('paper', 'live')"), "strategy_id"))


def trade_tally(spark, sf):
    return rounded(signals.tally(tables.trades(spark, sf).where("mode = 'backtest'"), "scanner"))


def journal_header(spark, sf):
    r = F.col("pnl_r")
    return rounded(tables.trades(spark, sf).agg(F.sum(r).alias("total_r"), F.avg(r).alias("avg_r"), F.count_if(r > 0).alias("winners"), F.count(r).alias("closed"), F.count_if(r.isNull()).alias("open")))


def adverse_fill(spark, sf):
    own = tables.trades(spark, sf)
    return rounded(own.select("trade_id", (sc.adverse_price(F.col("fill_px"), F.col("side"), True, 0.0004) + 1e-9).alias("entry_fill"), (sc.adverse_price(F.col("fill_px"), F.col("side"), False, 0.0004) + 1e-9).alias("exit_fill")))


def _journal_inputs(spark, sf):
    bars = signals.with_atr(tables.bars(spark, sf)).select("ticker", "ts", "idx", "open", "high", "low", "close", "atr")
    return tables.signals(spark, sf).select("signal_id", "ticker", "created_at", "side"), storage.Scratch(spark).written(bars, "bars")


def paper_trades(spark, sf):
    # Prices may end in an exact half at the seventh place, which engines round differently: a hair decides.
    out = signals.paper_trades(*_journal_inputs(spark, sf))
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("fill_px", "exit_px")}))


def earnings_blackout(spark, sf):
    days = tables.bars(spark, sf).select("ticker", F.col("ts").cast("date").alias("d"))
    return signals.blackout(days, tables.earnings(spark, sf))


def score_candidates(scores):
    """Each score's strategy as a candidate for the signal of the score's id."""
    return scores.select(
        "score_id", "strategy_id", (F.col("score_id") % 4 != 0).alias("fires"), F.when(F.col("score_id") % 9 == 0, "out_of_distribution").otherwise("risk_on").alias("regime"),
        F.when(F.col("score_id") % 13 == 0, F.lit("2000-01-01").cast("date")).alias("blackout"), F.when(F.col("score_id") % 17 != 0, F.col("dsr") * 3).alias("atr"), (F.col("score_id") % 19 != 0).alias("scored"),
        "precision_oos", "n_acted", "expectancy", F.when(F.col("score_id") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("pbo") * 100 + 50).alias("entry"), (F.col("dsr") * 3).alias("stop_dist"), (F.col("dsr") * 6).alias("target_dist"),
    )


def signal_reasons(spark, sf):
    """Candidates with the first reason that stops them."""
    own = score_candidates(tables.scores(spark, sf))
    return rounded(signals.build(own).select("score_id", "skip_reason", "stop", "target1", "rr1", "conviction"))


def signal_validation(spark, sf):
    own = tables.signals(spark, sf)
    return own.select("signal_id", signals.valid_geometry(F.col("entry"), F.col("stop"), F.col("target1"), F.col("side")).alias("valid"))


def genome_text(spark, sf):
    """Predicates in data: their summary and their order-free signature."""
    e = tables.read(spark, sf, "orders")
    p = F.array(F.struct(F.lit("trigger.roc").alias("feature_key"), F.lit("gt").alias("op"), (F.col("o_orderkey") % 7 / 8).alias("threshold")), F.struct(F.lit("location.dist").alias("feature_key"), F.lit("lte").alias("op"), (F.col("o_custkey") % 5 / 4).alias("threshold")))
    return e.select("o_orderkey", api.describe(p).alias("summary"), api.signature(p).alias("signature"))


def genome_parsed(spark, sf):
    """Stored genomes: some without a risk, some that are none."""
    e = tables.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    horizon = F.element_at(F.array(*[F.lit(h) for h in ("swing", "day", "scalp", "Swing", "yearly")]), (k % 5 + 1).cast("int"))
    risk = F.when(k % 3 == 0, F.struct(F.lit("pct").alias("kind"), (k % 4 / 2 + 0.5).alias("stop"), F.lit(2.5).alias("target")))
    side = F.when(k % 2 == 0, "long").otherwise("short")
    doc = F.to_json(F.struct(side.alias("side"), horizon.alias("horizon"), F.array(F.struct(F.lit("trigger.roc").alias("feature_key"), F.lit("gt").alias("op"), (k % 7 / 8).alias("threshold"))).alias("predicates"), risk.alias("risk")))
    g = api.genome_of(F.when(k % 11 == 0, F.lit("{not json")).otherwise(doc))
    return rounded(e.select("o_orderkey", g.alias("g")).select("o_orderkey", "g.side", "g.horizon", api.describe(F.col("g.predicates")).alias("summary"), "g.risk.kind", "g.risk.stop", "g.risk.target"))


def signal_text(spark, sf):
    """Signals as people read them; a hair is added so that exact halves are rounded alike."""
    own = tables.signals(spark, sf)
    hair = lambda c: F.col(c) + 1e-9
    k = F.col("signal_id")
    why = F.array(F.struct(F.lit("trigger.roc").alias("key"), (k % 8 / 8 - 0.5 + 1e-9).alias("contribution")), F.struct(F.lit("location.dist").alias("key"), (-(k % 3) / 4 + 1e-9).alias("contribution")))
    cols = {
        "horizon": F.lit("swing"), "entry": hair("entry"), "stop": hair("stop"), "target1": hair("target1"), "target2": F.when(k % 2 == 0, hair("target1") + 1), "rr1": k % 9 / 2 + 1e-9,
        "rr2": F.when(k % 2 == 0, k % 9 / 2 + 1 + 1e-9), "conviction": hair("conviction"), "cohort_n": k % 100, "regime": F.lit("risk_on"), "why": why, "invalidation": signals.invalidation(F.col("side"), hair("stop")),
        "expectancy": (k % 5 - 2) / 4 + 1e-9, "cvar5": -(k % 7) / 4 + 1e-9, "lead_time": F.lit("next session"),
    }
    return own.select("signal_id", signals.text(cols).alias("text"))


#: Strategies whose replay is a query.
REPLAYED = {"up": search.Genome((("trigger__momentum_roc", "gt", 0.02),)), "down": search.Genome((("trigger__momentum_roc", "lt", -0.05), ("location__range", "lt", 0.4)), -1, search.Risk("pct", 2.0, 1.5))}


def replayed_trades(spark, sf):
    """A backtest's journal, written in place of the scanner's earlier one and read back."""
    path = storage.new_path(spark, "journal")
    for _ in range(2):  # the second run replaces the first
        sinks.replace_partitions(signals.replay(REPLAYED, model_plans._window(spark, sf), "etf"), path, "mode", "scanner")
    return rounded(spark.read.parquet(path).select("strategy", "ticker", "side", "mode", "scanner", "entry_ts", "fill_px", "exit_ts", "exit_px", "pnl_r", "cost", "outcome"))


def genome_map_fire(spark, sf):
    """Predicates in data against features in a map."""
    from tidemark.operators.labeling import fires_map

    e = tables.read(spark, sf, "orders")
    p = F.array(F.struct(F.lit("a").alias("feature_key"), F.lit("gt").alias("op"), F.lit(0.5).alias("threshold")), F.struct(F.lit("b").alias("feature_key"), F.lit("lte").alias("op"), F.lit(0.7).alias("threshold")))
    m = F.map_from_arrays(F.array(F.lit("a"), F.when(F.col("o_orderkey") % 5 == 0, "c").otherwise("b")), F.array(F.col("o_totalprice") % 97 / 97, F.col("o_totalprice") % 89 / 89))
    return e.select("o_orderkey", fires_map(m, p).alias("fires"))


def key_columns(spark, sf):
    keys = tables.read(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("regime.adx"), F.lit("a.b.c"), F.lit("plain"), F.lit("event.is_opex")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("key"))
    own = keys.withColumn("column", sc.column_name(F.col("key")))
    return own.select("p_partkey", "column", api.layer_of(F.col("key")).alias("layer"), api.layer_of_column(F.col("column")).alias("column_layer"))


def json_details(spark, sf):
    own = tables.read(spark, sf, "events").select("event_id", "props", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    lead = api.leading_number(F.concat(F.col("k").cast("int").cast("string"), F.lit(" bars ahead")))
    return rounded(own.select("event_id", "k", lead.alias("lead"), api.detail(F.col("props")).alias("detail")))


def driver_docs(spark, sf):
    doc = F.expr("""CASE WHEN event_id % 3 = 0 THEN '[{"layer": "Trigger", "key": "a"}, {"key": "x"}]' WHEN event_id % 3 = 1 THEN '[{"layer": "REGIME", "key": "b", "contribution": 0.5}]' ELSE 'bad' END""")
    own = tables.read(spark, sf, "events").select("event_id", api.drivers(doc).alias("d"))
    return rounded(own.select("event_id", F.size("d").alias("n"), F.get("d", 0)["layer"].alias("layer"), F.get("d", 0)["contribution"].alias("contribution")))


def symbol_check(spark, sf):
    from tidemark.sources.provider import normalised

    own = tables.read(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("."))), F.lit(" ")).alias("s"))
    return own.select("p_partkey", normalised(F.col("s")).alias("symbol"))


def feature_catalog(spark, sf):
    """Features with enough and not constant values: count and three quantiles by nearest rank."""
    own = metrics.nearest_ranks(tables.features_pit(spark, sf), "feature_key", "value", [0.2, 0.5, 0.8])
    return rounded(own.where("n >= 30 AND lo < hi").drop("lo", "hi"))


def count_distinct_features(spark, sf):
    return tables.features_pit(spark, sf).groupBy("layer").agg(F.count_distinct("feature_key").alias("n_keys"))


def sorted_check(spark, sf):
    """Rows of the events out of order in time: none if the dataset may be written."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return tables.read(spark, sf, "events").withColumn("prev", F.lag("ts").over(w)).agg(F.count_if(F.col("ts") < F.col("prev")).alias("unsorted"))


def stream_since_mark(spark, sf):
    """The oldest 100 signals after a mark, as frames of kind and data."""
    own = api.since(tables.signals(spark, sf).select("created_at", "signal_id"), "created_at", F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    return api.envelope(("signal", own.select("signal_id")))


def high_water_marks(spark, sf):
    return tables.signals(spark, sf).agg(F.lit("signals").alias("kind"), F.max("created_at").alias("mark")).unionAll(_events(spark, sf).agg(F.lit("monitor_events").alias("kind"), F.max("ts").alias("mark")))


def session_bars(spark, sf):
    """Bursts of a user's events, six hours apart at least."""
    own = tables.read(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(own.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n", "total"))


def regime_rank(spark, sf):
    """Test-era gap: mean of out-of-sample less locked-era precision by number of regimes."""
    return rounded(tables.scores(spark, sf).groupBy("n_regimes").agg(F.avg(F.col("precision_oos") - F.col("dsr")).alias("gap"), F.count("precision_oos").alias("n")))


def firewall_counts(spark, sf):
    own = tables.trades(spark, sf).select(F.col("entry_ts").alias("ts"), (F.col("entry_ts") + F.make_dt_interval(F.lit(15))).alias("t1"))
    return crossval.firewall(own, F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-03-31 21:00:00").cast("timestamp_ntz")).groupBy("kept").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    recent_trades, divergence_detector, decay_detector, drawdown_detector, calibration_detector, source_freshness, staleness_detector, regime_ood_detector, regate, changelog, status_transitions, alert_pairs,
    monitor_report, monitor_feed, population, signals_page, signal_by_id, journal_page, realized_stats, trade_tally, journal_header, adverse_fill, paper_trades, earnings_blackout, signal_reasons, signal_validation,
    genome_text, genome_parsed, signal_text, replayed_trades, genome_map_fire, key_columns, json_details, driver_docs, symbol_check, feature_catalog, count_distinct_features, sorted_check, stream_since_mark, high_water_marks, session_bars, regime_rank, firewall_counts,
)}

_N = f"TIMESTAMP '{NOW}'"
_REC = f"rec AS (SELECT t.*, s.conviction FROM trades t LEFT JOIN signals s USING (signal_id) WHERE mode IN ('paper', 'live') AND entry_ts > {_N} - to_days(1500) AND entry_ts <= {_N})"
_LAST = "ls AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY evaluated_at DESC, score_id DESC) = 1)"
_EV = """ev AS (SELECT o_orderkey AS event_id, o_custkey % 10 + 1 AS strategy_id, o_orderdate AS ts, o_orderpriority AS detector, (['shrink_size', 'quarantine', 'demote', 'disable', 'recalibrate', 'skip_degraded', 'hold'])[o_orderkey % 7 + 1] AS action,
  CASE o_orderkey % 3 WHEN 0 THEN '{"note": "n' || o_orderkey || '"}' WHEN 1 THEN '{"x": 1}' END AS doc FROM orders)"""
_TALLY = "count(*) AS total, count(*) FILTER (pnl_r > 0) AS wins, count(*) FILTER (pnl_r <= 0) AS losses, sum(pnl_r) AS sum_r, avg(pnl_r) AS avg_r, count(*) FILTER (pnl_r > 0) / count(*) * 100 AS win_rate, sum(CASE WHEN pnl_r > 0 THEN pnl_r ELSE 0 END) / nullif(sum(CASE WHEN pnl_r <= 0 THEN -pnl_r ELSE 0 END), 0) AS profit_factor"


def _st(r):
    return f"st AS (SELECT strategy_id, count({r}) AS n, avg({r}) AS mean, stddev_samp({r}) AS sd FROM rec WHERE pnl_r IS NOT NULL GROUP BY strategy_id)"


_EQR = "eq AS (SELECT strategy_id, equity, max(equity) OVER (PARTITION BY strategy_id ORDER BY entry_ts, trade_id, pnl_r ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, sum(pnl_r) OVER (PARTITION BY strategy_id ORDER BY entry_ts, trade_id, pnl_r ROWS UNBOUNDED PRECEDING) AS equity FROM rec WHERE pnl_r IS NOT NULL)), dd AS (SELECT strategy_id, min(equity - greatest(peak, 0)) AS mdd FROM eq GROUP BY strategy_id), cv AS (SELECT strategy_id, avg(pnl_r) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pnl_r) AS k, count(*) OVER (PARTITION BY strategy_id) AS m FROM rec WHERE pnl_r IS NOT NULL) WHERE k <= greatest(1, ceil(0.05::DOUBLE * m)) GROUP BY strategy_id)"
_WLB = "((p + 3.8414588206941227::DOUBLE / (2 * n_acted) - 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n_acted + 3.8414588206941227::DOUBLE / (4 * n_acted::DOUBLE * n_acted))) / (1 + 3.8414588206941227::DOUBLE / n_acted))"
_PAPER = f"""nb AS (SELECT * RENAME (i AS idx) FROM (SELECT *, {_ATR14} AS atr FROM staged)), win AS (SELECT ticker, ts, open, high, low, close, idx, atr FROM nb),
sg AS (SELECT signal_id, s.ticker, side, (SELECT min(b.idx) FROM win b WHERE b.ticker = s.ticker AND b.ts >= s.created_at) + 1 AS fi FROM signals s),
op AS (SELECT sg.*, b.ts AS fill_ts, b.open, b.close, b.atr, b.open * (1 + side * 0.0002::DOUBLE) AS fill_px FROM sg JOIN win b ON b.ticker = sg.ticker AND b.idx = sg.fi),
{_barrier("SELECT DISTINCT ticker, fi AS idx, close AS entry_px, atr * 2.0::DOUBLE AS td, atr AS sd FROM op WHERE atr > 0 AND side = 1", 1).replace("e AS (", "le AS (").replace("px AS (SELECT *", "lpx AS (SELECT *").replace("FROM e)", "FROM le)").replace("met AS", "lmet AS").replace("FROM px e", "FROM lpx e").replace("lab AS", "llab AS").replace("FROM met", "FROM lmet").replace("labels AS", "llabels AS").replace("FROM lab)", "FROM llab)")},
{_barrier("SELECT DISTINCT ticker, fi AS idx, close AS entry_px, atr * 2.0::DOUBLE AS td, atr AS sd FROM op WHERE atr > 0 AND side = -1", -1)},
lb AS (SELECT 1 AS side, * FROM llabels UNION ALL SELECT -1, * FROM labels)
SELECT o.signal_id, o.ticker, o.side, o.fill_ts, o.fill_px + 1e-9 AS fill_px, x.ts AS exit_ts, CASE l.outcome WHEN 'target' THEN l.target_px WHEN 'stop' THEN l.stop_px WHEN 'time' THEN x.close END * (1 - o.side * 0.0002::DOUBLE) + 1e-9 AS exit_px, l.outcome, l.ret_r - 0.0004::DOUBLE * o.fill_px / o.atr AS pnl_r
FROM op o LEFT JOIN lb l ON l.ticker = o.ticker AND l.idx = o.fi AND l.side = o.side LEFT JOIN win x ON x.ticker = o.ticker AND x.idx = l.exit_idx"""

#: Of stored genomes that are one.
_G = "CASE WHEN o_orderkey % 11 <> 0 AND h <> 'yearly' THEN {} END"


def _horizons(constant):
    return "(CASE lower(h) " + " ".join(f"WHEN '{n}' THEN {getattr(p, constant)}" for n, p in labeling.PROFILES.items()) + " END)"


ORACLES = {
    "recent_trades": with_tables(f"WITH {_REC} SELECT trade_id, strategy_id, pnl_r, conviction FROM rec", "trades", "signals", doubles="pnl_r conviction"),
    "divergence_detector": with_tables(f"WITH {_REC}, {_LAST}, {_st('pnl_r')}, g AS (SELECT st.strategy_id, expectancy - mean AS gap, CASE WHEN sd > 0 THEN (expectancy - mean) / (sd / sqrt(n)) WHEN expectancy > mean THEN 1e300 ELSE 0 END AS z FROM st JOIN ls USING (strategy_id) WHERE n >= 10) SELECT strategy_id, 'divergence' AS detector, CASE WHEN z >= 2.33 AND gap >= 0.5 THEN 'quarantine' ELSE 'shrink_size' END AS action, gap AS metric, CASE WHEN z >= 2.33 AND gap >= 0.5 THEN 0.5 ELSE 0.25 END AS threshold FROM g WHERE (z >= 2.33 AND gap >= 0.5) OR (z >= 1.64 AND gap >= 0.25)", "trades", "signals", "scores", doubles="metric threshold"),
    "decay_detector": with_tables(f"WITH {_REC}, {_st('(pnl_r - CASE WHEN strategy_id % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END)')} SELECT strategy_id, 'decay' AS detector, 'demote' AS action, mean AS metric, 0.0 AS threshold FROM st WHERE n >= 15 AND CASE WHEN sd > 0 THEN -mean / (sd / sqrt(n)) WHEN mean < 0 THEN 1e300 ELSE 0 END >= 1.64", "trades", "signals", doubles="metric threshold"),
    "drawdown_detector": with_tables(f"WITH {_REC}, {_st('pnl_r')}, {_EQR} SELECT strategy_id, 'drawdown' AS detector, 'disable' AS action, CASE WHEN cvar <= -2 THEN cvar ELSE mdd END AS metric, CASE WHEN cvar <= -2 THEN -2.0 ELSE -6.0 END AS threshold FROM st JOIN dd USING (strategy_id) JOIN cv USING (strategy_id) WHERE n >= 10 AND (cvar <= -2 OR mdd <= -6)", "trades", "signals", doubles="metric threshold"),
    "calibration_detector": with_tables(f"WITH {_REC}, c AS (SELECT strategy_id, count(*) AS n, abs(avg(conviction * (strategy_id % 3) / 2) - avg((pnl_r > 0)::INT)) AS gap FROM rec WHERE pnl_r IS NOT NULL AND conviction IS NOT NULL GROUP BY strategy_id) SELECT strategy_id, 'calibration' AS detector, 'recalibrate' AS action, gap AS metric, 0.15 AS threshold FROM c WHERE n >= 20 AND gap >= 0.15", "trades", "signals", doubles="metric threshold"),
    "source_freshness": with_tables("SELECT 'bars' AS source, max(ts) AS latest FROM bars UNION ALL SELECT 'macro', max(ts) FROM macro", "bars", "macro"),
    "staleness_detector": with_tables("SELECT source, 'staleness' AS detector, 'skip_degraded' AS action, age AS metric, 48.0 AS threshold FROM (SELECT source, date_diff('second', latest, TIMESTAMP '2001-12-31') / 3600 AS age FROM (SELECT 'bars' AS source, max(ts) AS latest FROM bars UNION ALL SELECT 'macro', max(ts) FROM macro)) WHERE age > 48", "bars", "macro", doubles="metric threshold"),
    "regime_ood_detector": "SELECT 'regime_ood' AS detector, 'suppress' AS action, n::DOUBLE AS metric, 3.0::DOUBLE AS threshold FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-20') WHERE n >= 3",
    "regate": with_tables(f"WITH {_LAST} SELECT s.strategy_id, 'regate' AS detector, 'demote' AS action, expectancy AS metric, 0.0 AS threshold FROM strategies s JOIN ls USING (strategy_id) WHERE status = 'promoted' AND NOT coalesce(dsr > 0 AND pbo < 0.5 AND expectancy > 0 AND n_regimes >= 2, false)", "strategies", "scores", doubles="metric threshold"),
    "changelog": f"WITH {_EV} SELECT isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week, " + ", ".join(f"coalesce(string_agg(DISTINCT strategy_id::VARCHAR, ',' ORDER BY strategy_id::VARCHAR) FILTER (action IN ({a})), '') AS {k}" for k, a in (("decayed", "'demote', 'shrink_size'"), ("retired", "'disable', 'quarantine'"), ("adapted", "'recalibrate'"))) + " FROM ev WHERE action NOT IN ('skip_degraded', 'hold') GROUP BY 1",
    "status_transitions": f"WITH {_EV} SELECT event_id, CASE action WHEN 'quarantine' THEN 'quarantined' WHEN 'demote' THEN 'demoted' ELSE 'disabled' END AS status FROM ev WHERE action IN ('quarantine', 'demote', 'disable')",
    "alert_pairs": f"WITH {_EV} SELECT action, count(*) AS n FROM (SELECT action FROM ev UNION ALL SELECT 'alert' FROM ev WHERE action IN ('disable', 'skip_degraded')) GROUP BY action",
    "monitor_report": f"WITH {_EV} SELECT detector, count(*) AS n FROM ev GROUP BY detector",
    "monitor_feed": f"WITH {_EV} SELECT event_id, ts, CASE action WHEN 'shrink_size' THEN 'shrink' WHEN 'skip_degraded' THEN 'skip' WHEN 'hold' THEN 'alert' ELSE action END AS action, coalesce(CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END, doc, '') AS detail FROM ev ORDER BY ts DESC, event_id LIMIT 500",
    "population": with_tables(f"WITH {_LAST} SELECT strategy_id, name, coalesce(evaluated_at, created_at) AS dated, expectancy FROM strategies LEFT JOIN ls USING (strategy_id) WHERE scanner = 'etf' AND coalesce(evaluated_at, created_at) >= TIMESTAMP '1995-06-01' AND coalesce(evaluated_at, created_at) < TIMESTAMP '2002-01-01'", "strategies", "scores", doubles="expectancy"),
    "signals_page": with_tables("SELECT signal_id, created_at, ticker, conviction FROM signals WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2001-01-01' ORDER BY created_at DESC, signal_id LIMIT 500", "signals", doubles="conviction"),
    "signal_by_id": with_tables("SELECT signal_id, ticker, entry FROM signals WHERE signal_id = 7", "signals", doubles="entry"),
    "journal_page": with_tables("SELECT trade_id, entry_ts, pnl_r FROM trades WHERE scanner = 'equity' ORDER BY entry_ts DESC, trade_id, pnl_r NULLS FIRST LIMIT 500", "trades", doubles="pnl_r"),
    "realized_stats": with_tables(f"SELECT strategy_id, {_TALLY} FROM trades WHERE pnl_r IS NOT NULL AND mode IN ('paper', 'live') GROUP BY strategy_id", "trades", doubles="sum_r avg_r win_rate profit_factor"),
    "trade_tally": with_tables(f"SELECT scanner, {_TALLY} FROM trades WHERE pnl_r IS NOT NULL AND mode = 'backtest' GROUP BY scanner", "trades", doubles="sum_r avg_r win_rate profit_factor"),
    "journal_header": with_tables("SELECT sum(pnl_r) AS total_r, avg(pnl_r) AS avg_r, count(*) FILTER (pnl_r > 0) AS winners, count(pnl_r) AS closed, count(*) FILTER (pnl_r IS NULL) AS open FROM trades", "trades", doubles="total_r avg_r"),
    "adverse_fill": with_tables("SELECT trade_id, fill_px * (1 + side * 0.0002::DOUBLE) + 1e-9 AS entry_fill, fill_px * (1 - side * 0.0002::DOUBLE) + 1e-9 AS exit_fill FROM trades", "trades", doubles="entry_fill exit_fill"),
    "paper_trades": with_tables(f"WITH {_STAGED}, {_PAPER}", "bars", "signals", doubles="fill_px exit_px pnl_r"),
    "earnings_blackout": with_tables("SELECT b.ticker, CAST(b.ts AS DATE) AS d, min(e.date) AS blackout FROM bars b LEFT JOIN earnings e ON e.ticker = b.ticker AND e.date > CAST(b.ts AS DATE) AND e.date <= CAST(b.ts AS DATE) + 21 GROUP BY ALL", "bars", "earnings"),
    "signal_reasons": with_tables(f"""WITH c AS (SELECT *, precision_oos AS p, CASE WHEN score_id % 2 = 0 THEN 1 ELSE -1 END AS side, pbo * 100 + 50 AS entry, dsr * 3 AS sd, dsr * 6 AS td FROM scores)
SELECT score_id, CASE WHEN score_id % 4 = 0 THEN 'not_firing' WHEN score_id % 9 = 0 THEN 'regime' WHEN score_id % 13 = 0 THEN 'earnings' WHEN score_id % 17 = 0 THEN 'no_atr' WHEN score_id % 19 = 0 THEN 'no_score'
  WHEN p IS NOT NULL AND n_acted >= 8 AND {_WLB} < 0.40 THEN 'low_precision' WHEN NOT abs(entry - (entry - side * sd)) > 0 THEN 'geometry' END AS skip_reason, entry - side * sd AS stop, entry + side * td AS target1,
  coalesce(abs((entry + side * td) - entry) / nullif(abs(entry - (entry - side * sd)), 0), 0) AS rr1,
  CASE WHEN p IS NOT NULL AND n_acted >= 8 THEN greatest(least(p, 1), 0) ELSE greatest(least((expectancy + 1) / (CASE WHEN abs(entry - (entry - side * sd)) > 0 THEN abs((entry + side * td) - entry) / abs(entry - (entry - side * sd)) ELSE 1 END + 1), 1), 0) END AS conviction FROM c""", "scores", doubles="stop target1 rr1 conviction"),
    "signal_validation": with_tables("SELECT signal_id, side * (entry - stop) > 0 AND side * (target1 - entry) > 0 AS valid FROM signals", "signals"),
    "genome_text": "SELECT o_orderkey, 'trigger.roc > ' || printf('%.4f', o_orderkey % 7 / 8) || ' AND location.dist <= ' || printf('%.4f', o_custkey % 5 / 4) AS summary, 'location.dist:lte:' || printf('%.4f', o_custkey % 5 / 4) || '&trigger.roc:gt:' || printf('%.4f', o_orderkey % 7 / 8) AS signature FROM orders",
    "genome_parsed": f"SELECT o_orderkey, {_G.format('CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END')} AS side, {_G.format('lower(h)')} AS horizon, {_G.format("'trigger.roc > ' || printf('%.4f', o_orderkey % 7 / 8)")} AS summary, {_G.format("CASE WHEN o_orderkey % 3 = 0 THEN 'pct' ELSE 'atr' END")} AS kind, round({_G.format("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 / 2 + 0.5 ELSE " + _horizons('stop_atr') + " END")}, 6)::DOUBLE AS stop, round({_G.format("CASE WHEN o_orderkey % 3 = 0 THEN 2.5 ELSE " + _horizons('target_atr') + "::DOUBLE / " + _horizons('stop_atr') + " END")}, 6)::DOUBLE AS target FROM (SELECT *, (['swing', 'day', 'scalp', 'Swing', 'yearly'])[o_orderkey % 5 + 1] AS h FROM orders)",
    "signal_text": with_tables("SELECT signal_id, ticker || ' — ' || CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END || ' (swing)' || chr(10) || printf('Entry: %.2f   Stop: %.2f', entry + 1e-9, stop + 1e-9) || chr(10) || printf('Target 1: %.2f', target1 + 1e-9) || CASE WHEN signal_id % 2 = 0 THEN printf('   Target 2: %.2f', target1 + 1e-9 + 1) ELSE '' END || printf('   Risk:Reward %.1f', signal_id % 9 / 2 + 1e-9) || CASE WHEN signal_id % 2 = 0 THEN printf(' / %.1f', signal_id % 9 / 2 + 1 + 1e-9) ELSE '' END || chr(10) || printf('Conviction: %.2f (calibrated, regime-matched cohort n=%d)', conviction + 1e-9, signal_id % 100) || chr(10) || 'Regime: risk_on' || chr(10) || printf('Why: trigger.roc (%+.2f); location.dist (%+.2f)', signal_id % 8 / 8 - 0.5::DOUBLE + 1e-9, -(signal_id % 3) / 4 + 1e-9) || chr(10) || 'Invalidation: ' || CASE WHEN side > 0 THEN 'close below' ELSE 'close above' END || printf(' %.2f', stop + 1e-9) || chr(10) || printf('Expectancy(cohort): %+.2fR   CVaR(5%%): %.1fR   Lead-time: next session', (signal_id % 5 - 2) / 4 + 1e-9, -(signal_id % 7) / 4 + 1e-9) AS text FROM signals", "signals"),
    "genome_map_fire": "SELECT o_orderkey, o_totalprice % 97 / 97 > 0.5 AND o_orderkey % 5 <> 0 AND o_totalprice % 89 / 89 <= 0.7 AS fires FROM orders",
    "key_columns": "SELECT p_partkey, (['regime__adx', 'a__b_c', 'plain', 'event__is_opex'])[p_partkey % 4 + 1] AS \"column\", (['regime', 'trigger', 'trigger', 'event'])[p_partkey % 4 + 1] AS layer, (['regime', 'a', 'base', 'event'])[p_partkey % 4 + 1] AS column_layer FROM part",
    "json_details": "SELECT event_id, round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS k, round(trunc(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS lead, props AS detail FROM events",
    "driver_docs": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n, CASE event_id % 3 WHEN 0 THEN 'trigger' WHEN 1 THEN 'regime' END AS layer, CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS contribution FROM events",
    "symbol_check": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN upper(replace(p_brand, '#', '.')) END AS symbol FROM part",
    "feature_catalog": with_tables("SELECT feature_key, n, xs[CAST(round(0.2 * (n - 1)) AS INT) + 1] AS q20, xs[CAST(round(0.5 * (n - 1)) AS INT) + 1] AS q50, xs[CAST(round(0.8 * (n - 1)) AS INT) + 1] AS q80 FROM (SELECT feature_key, count(value) AS n, list_sort(list(value)) AS xs, min(value) AS lo, max(value) AS hi FROM features_pit GROUP BY feature_key) WHERE n >= 30 AND lo < hi", "features_pit", doubles="q20 q50 q80"),
    "count_distinct_features": with_tables("SELECT layer, count(DISTINCT feature_key) AS n_keys FROM features_pit GROUP BY layer", "features_pit"),
    "sorted_check": "SELECT count(*) FILTER (ts < prev) AS unsorted FROM (SELECT ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM events)",
    "stream_since_mark": with_tables("SELECT 'signal' AS kind, '{\"signal_id\":' || signal_id || '}' AS data FROM (SELECT * FROM signals WHERE created_at > TIMESTAMP '1999-01-01' ORDER BY created_at, signal_id LIMIT 100)", "signals"),
    "high_water_marks": "SELECT 'signals' AS kind, max(o_orderdate) AS mark FROM orders UNION ALL SELECT 'monitor_events', max(o_orderdate) FROM orders",
    "session_bars": "SELECT * REPLACE (round(total, 6) AS total) FROM (SELECT user_id, min(ts) AS started, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g)",
    "regime_rank": with_tables("SELECT n_regimes, avg(precision_oos - dsr) AS gap, count(precision_oos) AS n FROM scores GROUP BY n_regimes", "scores", doubles="gap"),
    "firewall_counts": with_tables("SELECT NOT (entry_ts <= TIMESTAMP '1998-03-31 21:00:00' AND entry_ts + to_days(15) >= TIMESTAMP '1998-01-01') AS kept, count(*) AS n FROM trades GROUP BY 1", "trades"),
}
