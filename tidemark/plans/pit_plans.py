"""Point-in-time reads, sources, joins and sinks as queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.operators import pit, sinks
from tidemark.sources import answers, provider, tables
from tidemark.sources.tables import rounded, with_tables

T_EVENTS, T_MACRO, T_BARS = "2024-01-20 00:00:00", "1998-06-30 00:00:00", "1999-06-30 00:00:00"


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


def daily_bars(spark, sf):
    return rounded(tables.bars(spark, sf))


def bars_range_scan(spark, sf):
    own = tables.bars(spark, sf).where((F.col("ts") >= _at("1997-01-01 00:00:00")) & (F.col("ts") <= _at("1998-12-31 00:00:00")))
    return rounded(own.select("ticker", "ts", "close"))


def pit_latest_features(spark, sf):
    out = pit.latest(tables.features_pit(spark, sf), _at(T_EVENTS), ["ticker", "feature_key"], "decision_ts", ["seq"])
    return rounded(out.select("ticker", "feature_key", "decision_ts", "as_of", "value"))


def pit_layer_features(spark, sf):
    out = pit.latest(tables.features_pit(spark, sf), _at(T_EVENTS), ["ticker", "feature_key"], "decision_ts", ["seq"], layer="trigger")
    return rounded(out.select("ticker", "feature_key", "value"))


def pit_bars_lookback(spark, sf):
    return rounded(pit.last_bars(tables.bars(spark, sf), _at(T_BARS), 22).select("ticker", "pos", "ts", "close"))


def pit_macro_asof(spark, sf):
    days = tables.bars(spark, sf).select("ts").distinct()
    series = tables.macro(spark, sf).select("series").distinct()
    asks = days.join(F.broadcast(series))  # a handful of series for every decision day
    return rounded(pit.as_of(asks, tables.macro(spark, sf), ["series"], "ts", "value", ["series"]))


def pit_macro_history(spark, sf):
    return rounded(pit.history(tables.macro(spark, sf), _at(T_MACRO), 21).select("series", "pos", "ts", "value"))


def pit_vintage(spark, sf):
    """How many vintages of a date were visible at T, and the last of them."""
    seen = pit.at(tables.macro(spark, sf), _at(T_MACRO))
    return rounded(seen.groupBy("series", "ts").agg(F.count("*").alias("vintages"), F.max("as_of").alias("as_of"), F.max_by("value", "as_of").alias("value")))


def pit_window_around(spark, sf):
    return rounded(pit.around(tables.bars(spark, sf), _at(T_BARS), 19, 20).select("ticker", "side", "k", "ts", "close"))


def pit_latest_bar(spark, sf):
    return pit.latest_bar(tables.bars(spark, sf))


def leakage_invariant(spark, sf):
    """Rows that any read at T would have to hide, and that it does not: none."""
    out = pit.latest(tables.features_pit(spark, sf), _at(T_EVENTS), ["ticker", "feature_key"], "decision_ts", ["seq"])
    return out.where((F.col("as_of") > _at(T_EVENTS)) | (F.col("decision_ts") > _at(T_EVENTS))).select("ticker", "feature_key")


def hidden_facts(spark, sf):
    """Facts that had happened by T but were not known yet."""
    own = tables.features_pit(spark, sf).where((F.col("decision_ts") <= _at(T_EVENTS)) & ~pit.observable(F.col("as_of"), _at(T_EVENTS)))
    return own.groupBy("feature_key").agg(F.count("*").alias("hidden"))


def treasury_unpivot(spark, sf):
    """Wide rows of yields as series rows; nulls are dropped."""
    wide = tables.read(spark, sf, "part").selectExpr("p_partkey AS day", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10 END AS year2", "p_retailprice / 1000 AS year10")
    return rounded(provider.yields_long(wide, "day", {"year2": "ust2y", "year10": "ust10y"}))


def fred_observations(spark, sf):
    """Observations as text: a dot is no value; known a day after."""
    raw = tables.read(spark, sf, "orders").selectExpr("o_orderpriority AS series", "CAST(o_orderdate AS DATE) AS date", "o_orderkey AS k", "CASE WHEN o_orderkey % 4 = 0 THEN '.' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END AS value")
    return provider.observations(raw, 1).selectExpr("series", "k", "ts", "as_of", "value")


def universe_dedup(spark, sf):
    """Symbols by size, funds dropped, the first of repeats kept, at most 50 (a top-k)."""
    raw = tables.read(spark, sf, "part").selectExpr("upper(replace(p_brand, '#', '-')) AS symbol", "p_retailprice AS market_cap", "p_type AS kind", "p_partkey AS k")
    return rounded(provider.universe(raw.where("kind NOT LIKE '%STEEL%'"), 50))


def universe_parse(spark, sf):
    """Symbols of a list in text, split, checked, first of repeats kept."""
    raw = tables.read(spark, sf, "supplier").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")))), ", ").alias("text"))
    return provider.symbols(raw, "text")


def earnings_calendar(spark, sf):
    return tables.earnings(spark, sf)


def earnings_ingest(spark, sf):
    """The calendar of the tickers that have bars."""
    return provider.for_universe(tables.earnings(spark, sf), tables.bars(spark, sf).select("ticker"))


def macro_router(spark, sf):
    """Rows of each wanted series by source, and the series that no source has."""
    wanted = spark.createDataFrame([("1-URGENT", "a"), ("2-HIGH", "b"), ("VIX", "a")], "series string, source string")
    return provider.ingest_report(wanted, tables.macro(spark, sf))


def etf_profile(spark, sf):
    return rounded(provider.fund_profile(tables.profiles(spark, sf)))


def latest_score_lateral(spark, sf):
    """Strategies with their latest score; those without any too."""
    last = pit.top_one(tables.scores(spark, sf), ["strategy_id"], ["evaluated_at", "score_id"])
    own = tables.strategies(spark, sf).join(last, "strategy_id", "left")
    return rounded(own.select("strategy_id", "name", "status", "score_id", "evaluated_at", "expectancy", "dsr", "pbo"))


def promoted_scores(spark, sf):
    last = pit.top_one(tables.scores(spark, sf), ["strategy_id"], ["evaluated_at", "score_id"])
    return rounded(tables.strategies(spark, sf).where("status = 'promoted'").join(last, "strategy_id").select("strategy_id", "score_id", "expectancy"))


def trades_with_signals(spark, sf):
    own = tables.trades(spark, sf).alias("t")
    return rounded(own.join(tables.signals(spark, sf).alias("s"), F.col("t.signal_id") == F.col("s.signal_id"), "left").select("t.trade_id", "t.pnl_r", "s.conviction"))


def upsert_keyed(spark, sf):
    """Bars after an update of some keys: the newest write of each key stays."""
    old = tables.bars(spark, sf).select("ticker", "ts", "close")
    new = old.where("ticker % 2 = 0").withColumn("close", F.col("close") + 1)
    return rounded(sinks.merged(old, new, ["ticker", "ts"]))


def coalesce_merge(spark, sf):
    """Trades after an update that fills only missing exits."""
    rows = sinks.spread(tables.trades(spark, sf).select("trade_id", "entry_ts", "pnl_r"), ["trade_id"])
    old = sinks.newest(rows, ["trade_id"], ["entry_ts", "pnl_r"])
    new = old.where("pnl_r IS NULL").select("trade_id", F.lit(None).cast("timestamp_ntz").alias("entry_ts"), F.lit(0.5).alias("pnl_r"))
    return rounded(sinks.filled(old, new, ["trade_id"]))


def anti_join_once_only(spark, sf):
    """Scores that may still be written: strategies scored once already are refused."""
    done = tables.scores(spark, sf).where("strategy_id <= 5").select("strategy_id")
    return sinks.unseen(tables.strategies(spark, sf).select("strategy_id", "name"), done, ["strategy_id"])


def _answered(spark, rows, keys, answer):
    """Answers as a provider gives them, a file for each of ``keys``, written and read back."""
    path = storage.new_path(spark, "answers")
    rows.groupBy(*keys).agg(answer.alias("value")).select("value").repartition(16).write.option("lineSep", "\u0001").text(path)
    raw = answers.answers(spark, path)
    return raw.select(F.explode(F.split("answer", "\u0001")).alias("answer")).where("answer <> ''")


def _newest_first(*fields):
    """The rows of a group (a year at most) as a list, newest first."""
    return F.sort_array(F.collect_list(F.struct(*fields)), asc=False)


def provider_bars(spark, sf):
    """Daily bars through answers of a ticker and year each: newest first, complete at 21:00."""
    own = tables.bars(spark, sf)
    bar = [F.date_format("ts", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume"]
    doc = F.to_json(F.struct(F.concat(F.lit(" t"), F.first("ticker").cast("string")).alias("symbol"), _newest_first(*bar).alias("historical")))
    return rounded(answers.eod_bars(_answered(spark, own, ["ticker", F.year("ts")], doc)))


def provider_quotes(spark, sf):
    """Quotes through batches of an hour each, times in seconds."""
    own = tables.read(spark, sf, "events")
    quote = [F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("symbol"), F.col("value").alias("price")]
    got = answers.quotes(_answered(spark, own, [F.date_trunc("hour", "ts")], F.to_json(_newest_first(*quote))))
    return rounded(got.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def provider_macro(spark, sf):
    """Macro series through answers for the provider's symbols, one of which is none of ours."""
    own = tables.macro(spark, sf).withColumn("symbol", F.concat(F.lit("^"), F.substring("series", 3, 3)))
    rows = [F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").alias("close"), F.col("symbol")]
    symbols = {"urgent": "^URG", "high": "^HIG", "medium": "^MED", "low": "^LOW"}
    return rounded(answers.macro(_answered(spark, own, ["symbol", F.date_trunc("month", "ts")], F.to_json(_newest_first(*rows))), symbols))


def keyed_table(spark, sf):
    """Bars through a table of deltas: written, some replaced, some filled, new ones added, some deleted, two buckets' worth of deltas folded."""
    own = tables.bars(spark, sf).select("ticker", "ts", "close", "volume")
    table = sinks.KeyedTable(spark, storage.new_path(spark, "keyed"), "ticker bigint, ts timestamp_ntz, close double, volume double", ["ticker", "ts"], buckets=8)
    table.upsert(own.where("day(ts) <= 20").withColumn("volume", F.when(F.day("ts") % 3 > 0, F.col("volume"))))
    table.upsert(own.where("day(ts) % 5 = 0 AND day(ts) <= 20").withColumns({"close": F.col("close") + 1, "volume": F.lit(7.0)}))
    table.fill(own.where("day(ts) <= 10").withColumn("close", F.lit(-1.0)))
    table.compact()
    table.insert(own.where("day(ts) > 15").withColumn("close", F.col("close") * 2))
    table.delete((F.month("ts") == 12) & (F.day("ts") > 25))
    return rounded(table.read())


def delete_by_source(spark, sf):
    return rounded(sinks.without(tables.macro(spark, sf), F.col("series") == "1-URGENT"))


QUERIES = {f.__name__: f for f in (
    daily_bars, bars_range_scan, pit_latest_features, pit_layer_features, pit_bars_lookback, pit_macro_asof, pit_macro_history, pit_vintage, pit_window_around, pit_latest_bar,
    leakage_invariant, hidden_facts, treasury_unpivot, fred_observations, universe_dedup, universe_parse, earnings_calendar, earnings_ingest, macro_router, etf_profile,
    latest_score_lateral, promoted_scores, trades_with_signals, upsert_keyed, coalesce_merge, anti_join_once_only, delete_by_source, keyed_table, provider_bars, provider_quotes, provider_macro,
)}

_E, _M, _B = (f"TIMESTAMP '{t}'" for t in (T_EVENTS, T_MACRO, T_BARS))
_VISIBLE = f"SELECT *, row_number() OVER (PARTITION BY ticker, feature_key ORDER BY decision_ts DESC, as_of DESC, seq DESC) AS r FROM features_pit WHERE decision_ts <= {_E} AND as_of <= {_E}"
_LAST_SCORE = "last_score AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY evaluated_at DESC, score_id DESC) = 1)"

ORACLES = {
    "daily_bars": with_tables("SELECT * FROM bars", "bars", doubles="open high low close volume"),
    "bars_range_scan": with_tables("SELECT ticker, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'", "bars", doubles="close"),
    "pit_latest_features": with_tables(f"SELECT ticker, feature_key, decision_ts, as_of, value FROM ({_VISIBLE}) WHERE r = 1", "features_pit", doubles="value"),
    "pit_layer_features": with_tables(f"SELECT ticker, feature_key, value FROM ({_VISIBLE}) WHERE r = 1 AND layer = 'trigger'", "features_pit", doubles="value"),
    "pit_bars_lookback": with_tables(f"SELECT ticker, n + 1 - r AS pos, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS r, least(22, count(*) OVER (PARTITION BY ticker)) AS n FROM bars WHERE ts <= {_B}) WHERE r <= 22", "bars", doubles="close"),
    "pit_macro_asof": with_tables("SELECT s.series, d.ts, (SELECT max({'a': m.ts, 'b': m.as_of, 'v': m.value}) FROM macro m WHERE m.series = s.series AND m.ts <= d.ts AND m.as_of <= d.ts).v AS value FROM (SELECT DISTINCT ts FROM bars) d, (SELECT DISTINCT series FROM macro) s", "bars", "macro", doubles="value"),
    "pit_macro_history": with_tables(f"SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r FROM (SELECT series, ts, max_by(value, as_of) AS value FROM macro WHERE ts <= {_M} AND as_of <= {_M} GROUP BY ALL)) WHERE r <= 21", "macro", doubles="value"),
    "pit_vintage": with_tables(f"SELECT series, ts, count(*) AS vintages, max(as_of) AS as_of, max_by(value, as_of) AS value FROM macro WHERE ts <= {_M} AND as_of <= {_M} GROUP BY series, ts", "macro", doubles="value"),
    "pit_window_around": with_tables(f"SELECT ticker, side, k, ts, close FROM (SELECT *, CASE WHEN ts <= {_B} THEN 'past' ELSE 'ahead' END AS side, CASE WHEN ts <= {_B} THEN row_number() OVER (PARTITION BY ticker, ts <= {_B} ORDER BY ts DESC) ELSE row_number() OVER (PARTITION BY ticker, ts <= {_B} ORDER BY ts) END AS k FROM bars) WHERE k <= CASE side WHEN 'past' THEN 19 ELSE 20 END", "bars", doubles="close"),
    "pit_latest_bar": with_tables("SELECT ticker, max(ts) AS latest_ts FROM bars GROUP BY ticker", "bars"),
    "leakage_invariant": with_tables("SELECT ticker, feature_key FROM features_pit WHERE false", "features_pit"),
    "hidden_facts": with_tables(f"SELECT feature_key, count(*) AS hidden FROM features_pit WHERE decision_ts <= {_E} AND as_of > {_E} GROUP BY feature_key", "features_pit"),
    "treasury_unpivot": "SELECT * REPLACE (round(value, 6) AS value) FROM (SELECT p_partkey AS day, 'ust2y' AS series, p_size / 10 AS value FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'ust10y', p_retailprice / 1000 FROM part WHERE p_retailprice IS NOT NULL)",
    "fred_observations": "SELECT o_orderpriority AS series, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_days(1) AS as_of, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS DOUBLE) AS value FROM orders WHERE o_orderkey % 4 <> 0",
    "universe_dedup": "SELECT symbol, round(market_cap, 6) AS market_cap, row_number() OVER (ORDER BY market_cap DESC, k) AS pos FROM (SELECT upper(replace(p_brand, '#', '-')) AS symbol, p_retailprice AS market_cap, p_partkey AS k FROM part WHERE p_type NOT LIKE '%STEEL%' AND regexp_full_match(upper(replace(p_brand, '#', '-')), '[A-Z0-9.-]{1,15}') QUALIFY row_number() OVER (PARTITION BY upper(replace(p_brand, '#', '-')) ORDER BY p_retailprice DESC, p_partkey) = 1) ORDER BY market_cap DESC, k LIMIT 50",
    "universe_parse": "SELECT upper('s' || m) AS symbol, row_number() OVER (ORDER BY m) AS pos FROM (SELECT DISTINCT s_suppkey % 7 AS m FROM supplier)",
    "earnings_calendar": with_tables("SELECT * FROM earnings", "earnings"),
    "earnings_ingest": with_tables("SELECT * FROM earnings WHERE ticker IN (SELECT ticker FROM bars)", "earnings", "bars"),
    "macro_router": with_tables("SELECT w.series, w.source, count(m.value) AS n_rows, count(m.value) > 0 AS available FROM (VALUES ('1-URGENT', 'a'), ('2-HIGH', 'b'), ('VIX', 'a')) w(series, source) LEFT JOIN macro m ON m.series = w.series GROUP BY ALL", "macro"),
    "etf_profile": with_tables("SELECT symbol, aum, holdings, expense_pct / 100 AS expense, kind, max(expense_pct) OVER (PARTITION BY kind) / 100 AS max_weight FROM profiles", "profiles", doubles="aum expense max_weight"),
    "latest_score_lateral": with_tables(f"WITH {_LAST_SCORE} SELECT s.strategy_id, s.name, s.status, l.score_id, l.evaluated_at, l.expectancy, l.dsr, l.pbo FROM strategies s LEFT JOIN last_score l USING (strategy_id)", "scores", "strategies", doubles="expectancy dsr pbo"),
    "promoted_scores": with_tables(f"WITH {_LAST_SCORE} SELECT s.strategy_id, l.score_id, l.expectancy FROM strategies s JOIN last_score l USING (strategy_id) WHERE s.status = 'promoted'", "scores", "strategies", doubles="expectancy"),
    "trades_with_signals": with_tables("SELECT t.trade_id, t.pnl_r, s.conviction FROM trades t LEFT JOIN signals s ON s.signal_id = t.signal_id", "trades", "signals", doubles="pnl_r conviction"),
    "upsert_keyed": with_tables("SELECT ticker, ts, CASE WHEN ticker % 2 = 0 THEN close + 1 ELSE close END AS close FROM bars", "bars", doubles="close"),
    "coalesce_merge": with_tables("SELECT trade_id, entry_ts, coalesce(pnl_r, 0.5) AS pnl_r FROM trades QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY entry_ts DESC, pnl_r DESC NULLS LAST) = 1", "trades", doubles="pnl_r"),
    "anti_join_once_only": with_tables("SELECT strategy_id, name FROM strategies WHERE strategy_id NOT IN (SELECT strategy_id FROM scores WHERE strategy_id <= 5)", "strategies", "scores"),
    "provider_bars": with_tables("SELECT 'T' || ticker AS ticker, date_trunc('day', ts) + to_hours(21) AS ts, open, high, low, close, volume FROM bars", "bars", doubles="open high low close volume"),
    "provider_quotes": "SELECT upper(event_type) AS ticker, date_trunc('second', ts) AS ts, round(value, 6) AS price FROM events",
    "provider_macro": with_tables("SELECT CASE substr(series, 3, 3) WHEN 'URG' THEN 'urgent' WHEN 'HIG' THEN 'high' WHEN 'MED' THEN 'medium' WHEN 'LOW' THEN 'low' END AS series, date_trunc('day', ts) AS ts, date_trunc('day', ts) + to_days(1) AS as_of, value FROM macro WHERE substr(series, 3, 3) IN ('URG', 'HIG', 'MED', 'LOW')", "macro", doubles="value"),
    "keyed_table": with_tables("SELECT ticker, ts, CASE WHEN d > 20 THEN close * 2 WHEN d % 5 = 0 THEN close + 1 ELSE close END AS close, CASE WHEN d > 20 THEN volume WHEN d % 5 = 0 THEN 7 WHEN d <= 10 OR d % 3 > 0 THEN volume END AS volume FROM (SELECT *, day(ts) AS d FROM bars) WHERE NOT (month(ts) = 12 AND d > 25)", "bars", doubles="close volume"),
    "delete_by_source": with_tables("SELECT * FROM macro WHERE series <> '1-URGENT'", "macro", doubles="value"),
}
