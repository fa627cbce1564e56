"""Learners, search and streams as queries; no SQL expresses these."""

from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import indicators as ind
from tidemark.operators import crossval, features, labeling, learners, pit, search, validation
from tidemark.operators.ordered import positions
from tidemark.sources import tables
from tidemark.sources.tables import rounded, with_tables
from tidemark.streaming import feeds

#: Trials of the grid, and trees of a fit.
TRIALS, TREES = 4, 60
FEATURES = ["trigger__momentum_roc", "location__range", "trigger__vol", "location__gap"]


def _shared(spark) -> str:
    return storage.new_path(spark, "stream")


def _window(spark, sf):
    return window_of(tables.bars(spark, sf))


def window_of(bars):
    """The features that the search and its strategies read, one row a bar."""
    own = features.staged(bars).withColumns({"atr": ind.atr(F.col("tr"), 14), "roc": ind.roc(F.col("close"), 10), "hi": F.max("high").over(ind.trailing(20)), "lo": F.min("low").over(ind.trailing(20)), "adv": F.avg("volume").over(ind.trailing(20))})
    return own.select(
        "ticker", "ts", "high", "low", "close", "atr", F.col("i").cast("int").alias("idx"), F.col("roc").alias("trigger__momentum_roc"),
        ((F.col("close") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).alias("location__range"),
        (F.col("volume") / F.col("adv")).alias("trigger__vol"), (F.col("open") / F.col("prev_close") - 1).alias("location__gap"),
    )


def _rows(spark, sf):
    """Labelled entries of all tickers with features, in order of time: position, span, return, weight (the label's uniqueness)."""
    tables = storage.Scratch(spark)  # the window and its labels are read several times over
    w = tables.written(_window(spark, sf), "window")
    done = tables.written(labeling.backtest(w, F.col("atr") > 0).where("ret_r IS NOT NULL AND t1 IS NOT NULL"), "labels")
    own = done.join(w.select("ticker", "idx", *FEATURES), ["ticker", "idx"])
    placed = positions(own, ["entry_ts", "ticker"])
    weights = labeling.uniqueness(placed.selectExpr("pos AS id", "ticker", "entry_ts AS ts", "t1"), ["ticker"]).selectExpr("id AS pos", "weight")
    return placed.join(weights, "pos").select("pos", F.col("entry_ts").alias("ts"), "t1", F.col("ret_r").alias("r"), "weight", *FEATURES)


def gbdt_oos_proba(spark, sf):
    rows = _rows(spark, sf)
    splits = crossval.splits(rows.select("pos", "ts", "t1"), 4, 1, 3)
    return rounded(learners.oos_predictions(rows, splits.select("split", "pos", "role"), learners.trial_grid(TRIALS, FEATURES), FEATURES, trees=TREES))


def permutation_importance(spark, sf):
    return rounded(learners.permutation_importance(_rows(spark, sf), FEATURES, repeats=5, trees=TREES))


def shap_importance(spark, sf):
    return rounded(learners.shap_importance(_rows(spark, sf), FEATURES, trees=TREES))


def importance_by_layer(spark, sf):
    return rounded(learners.by_layer(learners.shap_importance(_rows(spark, sf), FEATURES, trees=TREES)))


def validated(spark, sf):
    """Validation and gate of all labelled entries; months of the year stand for regimes."""
    rows = _rows(spark, sf).withColumn("regime", F.date_format("ts", "MM"))
    return rounded(validation.decide(rows, FEATURES, validation.Plan(n_trials=TRIALS, trees=TREES)))


def planted(spark, n: int, leak: bool):
    """A dataset whose label follows from two features and noise; with ``leak``, from none but one that knows it and turns its sign half way."""
    z = lambda k: F.sqrt(-2 * F.ln((F.pmod(F.xxhash64("pos", F.lit(2 * k)), F.lit(1 << 30)) + 1) / (1 << 30))) * F.cos(2 * 3.141592653589793 * F.pmod(F.xxhash64("pos", F.lit(2 * k + 1)), F.lit(1 << 30)) / (1 << 30))
    base = spark.range(n).select(F.col("id").cast("int").alias("pos"))
    own = base.select("pos", z(1).alias("momentum__signal"), z(2).alias("trend__slope"), z(3).alias("volatility__atr_norm"), z(4).alias("noise"))
    r = F.col("noise") if leak else 0.9 * F.col("momentum__signal") + 0.6 * F.col("trend__slope") - 0.3 * F.col("volatility__atr_norm") + F.col("noise")
    r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(2.0))
    ts = F.timestamp_seconds(F.col("pos") * 86400 + 1_600_000_000).cast("timestamp_ntz")
    out = own.select("pos", ts.alias("ts"), (ts + F.expr("INTERVAL 3 DAYS")).alias("t1"), r.alias("r"), F.lit(1.0).alias("weight"), F.element_at(F.array(F.lit("bull"), F.lit("bear"), F.lit("chop")), F.col("pos") % 3 + 1).alias("regime"), "momentum__signal", "trend__slope", "volatility__atr_norm")
    return out.withColumn("leak__lookahead", F.when(F.col("pos") < n // 2, F.col("r")).otherwise(-F.col("r"))) if leak else out


def leak_checkpoint(spark, sf):
    """The harness on made datasets of 900 rows: whether it rejects the leak and passes the edge."""
    names = ["momentum__signal", "trend__slope", "volatility__atr_norm"]
    return validation.leak_checkpoint(planted(spark, 900, True), planted(spark, 900, False), ([*names, "leak__lookahead"], names), validation.Plan(n_trials=4, trees=40))


def mean_optimism_gap(spark, sf):
    """Precision out of sample less that in the locked era, for the newest score of each strategy."""
    last = pit.top_one(tables.scores(spark, sf), ["strategy_id"], ["evaluated_at", "score_id"])
    won = F.avg((F.col("pnl_r") > 0).cast("double"))
    era = tables.trades(spark, sf).where("pnl_r IS NOT NULL AND entry_ts >= '1998-01-01'").groupBy("strategy_id").agg(won.alias("precision_test"))
    return rounded(validation.optimism_gap(last.join(era, "strategy_id", "left")))


def calibrate(spark, sf):
    rows = tables.scores(spark, sf).select(F.col("dsr").alias("p"), (F.col("expectancy") > 0).cast("int").alias("y"))
    name, knots = learners.calibrate(rows)
    return rounded(rows.select(F.lit(name).alias("method"), learners.interpolate(F.col("p"), knots).alias("q")))


def search_generation(spark, sf):
    """The search at its defaults: every generation's genomes are scored in one job."""
    w = storage.Scratch(spark).written(_window(spark, sf), "window")
    found = search.evolve(w)
    return rounded(spark.createDataFrame([(g.signature, e, d) for g, e, d in found], "signature string, expectancy double, dsr double"))


def tumbling_bars(spark, sf):
    stream = feeds.tumbling_bars(feeds.event_stream(spark, sf))
    return rounded(feeds.run_available(stream, _shared(spark), ["event_type", "ts"]))


def sliding_counts(spark, sf):
    return feeds.run_available(feeds.sliding_counts(feeds.event_stream(spark, sf)), _shared(spark), ["event_type", "ts"])


def stream_dedup(spark, sf):
    stream = feeds.once_each(feeds.event_stream(spark, sf)).select("event_id", "event_type", "value")
    return rounded(feeds.run_available(stream, _shared(spark), ["event_id"], mode="append"))


def stream_vintages(spark, sf):
    """A user's value of a day, corrected whenever a later event of the day comes."""
    facts = feeds.event_stream(spark, sf).select("user_id", F.date_trunc("day", "ts").alias("day"), "ts", "event_id", "value")
    stream = feeds.latest_vintage(facts, ["user_id", "day"], ["ts", "event_id"])
    last = feeds.run_available(stream, _shared(spark), ["user_id", "day"])
    return rounded(last.select("user_id", F.col("day").cast("timestamp_ntz").alias("day"), F.col("ts").cast("timestamp_ntz").alias("as_of"), "value"))


def stream_as_of(spark, sf):
    """For each event the newest value of its type that had happened and was released (1 to 72 hours later) by its time, both as streams."""
    asks = feeds.event_stream(spark, sf).select("event_type", F.col("event_id").alias("id"), F.col("ts").alias("t"))
    lag = F.make_dt_interval(hours=(F.col("event_id") % 72 + 1).cast("int"))
    facts = feeds.event_stream(spark, sf).select("event_type", "ts", (F.col("ts") + lag).alias("as_of"), "value")
    stream = feeds.as_of(asks, facts, ["event_type"], salts=4)
    last = feeds.run_available(stream, _shared(spark), ["event_type", "id"])
    return rounded(last.select("event_type", "id", F.col("t").cast("timestamp_ntz").alias("t"), "value", F.col("known_at").cast("timestamp_ntz").alias("known_at")))


QUERIES = {f.__name__: f for f in (gbdt_oos_proba, permutation_importance, shap_importance, importance_by_layer, validated, leak_checkpoint, mean_optimism_gap, calibrate, search_generation, tumbling_bars, sliding_counts, stream_dedup, stream_vintages, stream_as_of)}

_BARS = "SELECT event_type, date_trunc('day', ts) AS ts, min_by(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, max_by(value, {'a': ts, 'b': event_id}) AS close, count(*) AS volume FROM events GROUP BY ALL"
ORACLES = {
    "mean_optimism_gap": with_tables("WITH ls AS (SELECT strategy_id, max_by(precision_oos, {'a': evaluated_at, 'b': score_id}) AS o, max_by({'p': precision_oos}, {'a': evaluated_at, 'b': score_id}).p AS precision_oos FROM scores GROUP BY 1), era AS (SELECT strategy_id, avg((pnl_r > 0)::INT) AS precision_test FROM trades WHERE pnl_r IS NOT NULL AND entry_ts >= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT avg(precision_oos - precision_test) AS mean_gap, count(precision_oos - precision_test) AS n FROM ls LEFT JOIN era USING (strategy_id)", "scores", "trades", doubles="mean_gap"),
    "tumbling_bars": f"SELECT * REPLACE (round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close) FROM ({_BARS})",
    "sliding_counts": "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS ts, count(*) AS n FROM events, range(4) t(k) GROUP BY ALL",
    "stream_vintages": "SELECT user_id, date_trunc('day', ts) AS day, max(ts) AS as_of, round(max_by(value, {'a': ts, 'b': event_id}), 6) AS value FROM events GROUP BY ALL",
    "stream_as_of": "WITH line AS (SELECT event_type, ts AS p, 1 AS ask, event_id AS id, NULL AS fact FROM events UNION ALL SELECT event_type, ts + to_hours(CAST(event_id % 72 + 1 AS INT)), 0, NULL, {'ts': ts, 'as_of': ts + to_hours(CAST(event_id % 72 + 1 AS INT)), 'value': value} FROM events), told AS (SELECT event_type, id, p, ask, max(fact) OVER (PARTITION BY event_type ORDER BY p, ask) AS f FROM line) SELECT event_type, id, p AS t, round(f.value, 6) AS value, f.as_of AS known_at FROM told WHERE ask = 1",
    "stream_dedup": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
}
