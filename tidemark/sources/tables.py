"""Domain tables of the engine as views of the star-schema tables, and the same views as SQL for DuckDB.

Every table is a plain projection or one pre-aggregated group-by of a Parquet scan, so filters and
columns reach the scan. Timestamps stay without time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ten tickers: ``ticker, ts, open, high, low, close, volume``. Ticker 0 is the benchmark."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        read(spark, sf_dir, "lineitem")
        .select((F.col("l_suppkey") % 10).alias("ticker"), F.col("l_shipdate").alias("ts"), px.alias("px"), "l_quantity", order.alias("o"))
        .groupBy("ticker", "ts")
        .agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintages of macro series: ``series, ts, as_of, value``."""
    return (
        read(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 8 AS INT))").alias("as_of"), "o_totalprice")
        .groupBy("series", "ts", "as_of")
        .agg(F.avg("o_totalprice").alias("value"))
    )


#: Macro series that the regime layer reads (fixed values).
REGIME_SERIES = ["vix9d", "vix", "vix3m", "vvix", "hy_oas", "ig_oas", "fed_balance_sheet", "tga", "reverse_repo", "dxy", "ust2y", "ust10y", "copper", "gold", "oil"]


def regime_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintages of the regime layer's series: ``series, ts, as_of, value``; a date may be known late, and revised."""
    name = F.element_at(F.array(*[F.lit(s) for s in REGIME_SERIES]), (F.col("o_orderkey") % 15 + 1).cast("int"))
    late = F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 8 AS INT))")
    return (
        read(spark, sf_dir, "orders")
        .select(name.alias("series"), F.col("o_orderdate").alias("ts"), late.alias("as_of"), (F.col("o_totalprice") / 1000).alias("value"))
        .groupBy("series", "ts", "as_of")
        .agg(F.avg("value").alias("value"))
    )


def features_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal features: ``ticker, feature_key, layer, decision_ts, as_of, value, seq``."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"),
        F.col("event_type").alias("feature_key"),
        F.expr("CASE WHEN event_type < 'm' THEN 'location' ELSE 'trigger' END").alias("layer"),
        F.col("ts").alias("decision_ts"),
        F.expr("ts + make_dt_interval(0, CAST(event_id % 7 AS INT))").alias("as_of"),
        "value",
        F.col("event_id").alias("seq"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade journal: ``trade_id, signal_id, strategy_id, scanner, mode, side, entry_ts, fill_px, pnl_r`` (null: open)."""
    return read(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey").alias("trade_id"),
        F.col("l_orderkey").alias("signal_id"),
        F.col("l_suppkey").alias("strategy_id"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'equity' ELSE 'etf' END").alias("scanner"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'paper' WHEN l_partkey % 3 = 0 THEN 'backtest' ELSE 'live' END").alias("mode"),
        F.expr("CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END").alias("side"),
        F.col("l_shipdate").alias("entry_ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_px"),
        F.expr("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE round((l_discount - 0.05D) * 40, 4) END").alias("pnl_r"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample scores of strategies, a row for each evaluation."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 10 + 1 AS strategy_id",
        "o_orderkey AS score_id",
        "o_orderdate AS evaluated_at",
        "(o_totalprice % 1000) / 500 - 0.6D AS expectancy",
        "(o_totalprice % 97) / 97 AS dsr",
        "(o_totalprice % 89) / 89 AS pbo",
        "CAST(o_orderkey % 5 AS INT) AS n_regimes",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_totalprice % 71) / 71 END AS precision_oos",
        "CAST(o_orderkey % 60 AS INT) AS n_acted",
    )


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS strategy_id",
        "s_name AS name",
        "element_at(array('candidate', 'promoted', 'demoted', 'quarantined'), CAST(s_nationkey % 4 AS INT) + 1) AS status",
        "CASE WHEN s_nationkey % 2 = 0 THEN 'etf' ELSE 'equity' END AS scanner",
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(s_suppkey AS INT)) AS created_at",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS signal_id",
        "o_custkey % 10 + 1 AS strategy_id",
        "o_custkey % 10 AS ticker",
        "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side",
        "o_totalprice / 1000 AS entry",
        "o_totalprice / 1000 * (1 - 0.02D * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS stop",
        "o_totalprice / 1000 * (1 + (o_orderkey % 9) / 100 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS target1",
        "(o_totalprice % 100) / 100 AS conviction",
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date for each ticker and quarter."""
    return (
        read(spark, sf_dir, "orders")
        .selectExpr("o_custkey % 10 AS ticker", "CAST(o_orderdate AS DATE) AS d")
        .groupBy("ticker", F.expr("trunc(d, 'QUARTER')").alias("quarter"))
        .agg(F.max("d").alias("date"))
        .select("ticker", "date")
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fund profiles: ``symbol, aum`` (null for some), ``holdings, expense_pct``."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS symbol",
        "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice * 1000000 END AS aum",
        "p_size AS holdings",
        "p_retailprice % 1 AS expense_pct",
        "p_type AS kind",
    )


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a fund: ``symbol, as_of`` (its last trade), ``dollar_adv`` and its account as ``aum`` (null for some)."""
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.max("l_shipdate").alias("as_of"), (F.sum("l_extendedprice") * 10).alias("dollar_adv"))
    aum = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS symbol", "CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) * 1000000 END AS aum")
    return last.join(aum, "symbol", "left")


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "bars": """bars AS (SELECT ticker, ts, min_by(px, o) AS open, max(px) AS high, min(px) AS low, max_by(px, o) AS close, sum(q) AS volume
  FROM (SELECT l_suppkey % 10 AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS px, l_quantity AS q, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey} AS o FROM lineitem) GROUP BY ticker, ts)""",
    "macro": """macro AS (SELECT o_orderpriority AS series, o_orderdate AS ts, o_orderdate + to_days(CAST(o_orderkey % 8 AS INTEGER)) AS as_of, avg(o_totalprice) AS value FROM orders GROUP BY ALL)""",
    "regime_series": f"""regime_series AS (SELECT ({REGIME_SERIES!r})[o_orderkey % 15 + 1] AS series, o_orderdate AS ts, o_orderdate + to_days(CAST(o_orderkey % 8 AS INTEGER)) AS as_of, avg(o_totalprice / 1000) AS value FROM orders GROUP BY ALL)""",
    "features_pit": """features_pit AS (SELECT user_id AS ticker, event_type AS feature_key, CASE WHEN event_type < 'm' THEN 'location' ELSE 'trigger' END AS layer,
  ts AS decision_ts, ts + to_hours(CAST(event_id % 7 AS INTEGER)) AS as_of, value, event_id AS seq FROM events)""",
    "trades": """trades AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS trade_id, l_orderkey AS signal_id, l_suppkey AS strategy_id,
  CASE WHEN l_returnflag = 'A' THEN 'equity' ELSE 'etf' END AS scanner, CASE WHEN l_linestatus = 'O' THEN 'paper' WHEN l_partkey % 3 = 0 THEN 'backtest' ELSE 'live' END AS mode,
  CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS side, l_shipdate AS entry_ts, l_extendedprice / l_quantity AS fill_px,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE round((l_discount - 0.05::DOUBLE) * 40, 4) END AS pnl_r FROM lineitem)""",
    "scores": """scores AS (SELECT o_custkey % 10 + 1 AS strategy_id, o_orderkey AS score_id, o_orderdate AS evaluated_at, (o_totalprice % 1000) / 500 - 0.6::DOUBLE AS expectancy,
  (o_totalprice % 97) / 97 AS dsr, (o_totalprice % 89) / 89 AS pbo, CAST(o_orderkey % 5 AS INTEGER) AS n_regimes,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_totalprice % 71) / 71 END AS precision_oos, CAST(o_orderkey % 60 AS INTEGER) AS n_acted FROM orders)""",
    "strategies": """strategies AS (SELECT s_suppkey AS strategy_id, s_name AS name, (['candidate', 'promoted', 'demoted', 'quarantined'])[s_nationkey % 4 + 1] AS status,
  CASE WHEN s_nationkey % 2 = 0 THEN 'etf' ELSE 'equity' END AS scanner, TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(s_suppkey AS INTEGER)) AS created_at FROM supplier)""",
    "signals": """signals AS (SELECT o_orderkey AS signal_id, o_custkey % 10 + 1 AS strategy_id, o_custkey % 10 AS ticker, o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side,
  o_totalprice / 1000 AS entry, o_totalprice / 1000 * (1 - 0.02::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS stop,
  o_totalprice / 1000 * (1 + (o_orderkey % 9) / 100 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS target1, (o_totalprice % 100) / 100 AS conviction FROM orders)""",
    "earnings": """earnings AS (SELECT ticker, max(d) AS date FROM (SELECT o_custkey % 10 AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ticker, date_trunc('quarter', d))""",
    "profiles": """profiles AS (SELECT p_partkey AS symbol, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice * 1000000 END AS aum, p_size AS holdings, p_retailprice % 1 AS expense_pct, p_type AS kind FROM part)""",
}


def with_tables(sql: str, *tables: str, doubles: str = "") -> str:
    """``sql`` after the named tables; ``doubles``: result columns rounded to six places."""
    ctes = ",\n".join(SQL[t] for t in tables)
    head = f"WITH {ctes}\n" if ctes and not sql.lstrip().upper().startswith("WITH") else f"WITH {ctes},\n" if ctes else ""
    body = sql.lstrip()[4:] if ctes and sql.lstrip().upper().startswith("WITH") else sql
    if not doubles:
        return head + body
    rounded = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({rounded}) FROM (\n{head}{body})"


def rounded(df: DataFrame) -> DataFrame:
    """Every double to six places, without negative zeros and NaN, as results are compared across engines."""
    return df.select(*[(F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
