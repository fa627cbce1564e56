"""Readers of provider files and the shaping of what they hold. There is no network: files stand in for answers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOL = "^[A-Z0-9.-]{1,15}$"


class Provider(Protocol):
    """What a data source offers; what it lacks it returns as None, never made up."""

    def daily_bars(self, spark: SparkSession) -> DataFrame | None: ...
    def quotes(self, spark: SparkSession) -> DataFrame | None: ...
    def macro_series(self, spark: SparkSession) -> DataFrame | None: ...
    def earnings(self, spark: SparkSession) -> DataFrame | None: ...


class FileProvider:
    """A provider whose answers are JSON files in a folder."""

    def __init__(self, path: str):
        self.path = path

    def daily_bars(self, spark: SparkSession) -> DataFrame:
        """``ticker, ts, open, high, low, close, volume``; bad dates and symbols are dropped, bars close at 21:00."""
        raw = spark.read.schema("symbol STRING, date STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE").json(f"{self.path}/bars")
        day = F.expr("try_cast(date AS DATE)")
        own = raw.select(normalised(F.col("symbol")).alias("ticker"), (day.cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR")).alias("ts"), "open", "high", "low", "close", "volume")
        return own.where("ticker IS NOT NULL AND ts IS NOT NULL")

    def quotes(self, spark: SparkSession) -> DataFrame:
        raw = spark.read.schema("symbol STRING, price DOUBLE, timestamp LONG").json(f"{self.path}/quotes")
        return raw.select(normalised(F.col("symbol")).alias("ticker"), "price", F.timestamp_seconds("timestamp").alias("ts")).where("ticker IS NOT NULL")

    def macro_series(self, spark: SparkSession, lag_days: int = 1) -> DataFrame:
        return observations(spark.read.schema("series STRING, date DATE, value STRING").json(f"{self.path}/macro"), lag_days)

    def earnings(self, spark: SparkSession) -> DataFrame:
        raw = spark.read.schema("symbol STRING, date STRING").json(f"{self.path}/earnings")
        own = raw.select(normalised(F.col("symbol")).alias("ticker"), F.expr("try_cast(date AS DATE)").alias("date"))
        return own.where("ticker IS NOT NULL AND date IS NOT NULL").distinct()


def normalised(symbol: Column) -> Column:
    """Upper-cased and trimmed; null unless 1 to 15 letters, digits, dots or dashes."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(SYMBOL), s)


def yields_long(wide: DataFrame, key: str, series: dict[str, str]) -> DataFrame:
    """Columns of yields as rows ``key, series, value``, without nulls."""
    long = wide.unpivot([key], list(series), "column", "value").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for pair in series.items() for x in pair])
    return long.select(key, names[F.col("column")].alias("series"), "value")


def observations(raw: DataFrame, lag_days: int) -> DataFrame:
    """``value`` as a number (rows whose text is none are dropped), known ``lag_days`` after its date."""
    ts = F.col("date").cast("timestamp_ntz")
    return (
        raw.withColumns({"value": F.expr("try_cast(value AS DOUBLE)"), "ts": ts, "as_of": ts + F.make_dt_interval(F.lit(lag_days))})
        .where("value IS NOT NULL")
        .drop("date")
    )


def universe(raw: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest symbols (``symbol, market_cap, k``): each once, at its largest; ties by ``k``."""
    ok = raw.where(F.col("symbol").rlike(SYMBOL))
    one = ok.groupBy("symbol").agg(F.max_by(F.struct("market_cap", "k"), F.struct("market_cap", -F.col("k"))).alias("v"))
    top = one.select("symbol", "v.market_cap", "v.k").orderBy(F.col("market_cap").desc(), "k").limit(n)
    return top.select("symbol", "market_cap", F.row_number().over(Window.orderBy(F.col("market_cap").desc(), "k")).alias("pos"))


def symbols(raw: DataFrame, column: str) -> DataFrame:
    """Valid symbols of a text, split at white space and commas, in order, each once: ``symbol, pos``."""
    each = raw.select(F.posexplode(F.split(column, r"[, \n\t\r]+")).alias("p", "s")).select("p", normalised(F.col("s")).alias("symbol"))
    first = each.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("p").alias("p"))
    return first.select("symbol", F.row_number().over(Window.orderBy("p")).alias("pos"))


def for_universe(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    return rows.join(tickers.distinct(), "ticker", "left_semi")


def ingest_report(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """``series, source, n_rows, available`` for every wanted series."""
    counts = facts.groupBy("series").agg(F.count("value").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return wanted.join(counts, "series", "left").select("series", "source", n.alias("n_rows"), (n > 0).alias("available"))


def fund_profile(raw: DataFrame) -> DataFrame:
    """Expenses as fractions, and the largest one of the fund's kind."""
    weight = F.max("expense_pct").over(Window.partitionBy("kind")) / 100
    return raw.select("symbol", "aum", "holdings", (F.col("expense_pct") / 100).alias("expense"), "kind", weight.alias("max_weight"))


def mock_bars(spark: SparkSession, tickers: Iterable[str], start: dt.date, end: dt.date) -> DataFrame:
    """Made-up weekday bars that depend on ticker and date alone: two slow waves and hashed noise."""
    days = spark.sql("SELECT explode(sequence(DATE '%s', DATE '%s', INTERVAL 1 DAY)) AS d" % (start, end)).where(F.weekday("d") < 5)
    own = days.select(F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker"), "d")
    x = F.unix_date("d").cast("double")
    noise = lambda k: (F.pmod(F.xxhash64("ticker", "d", F.lit(k)), F.lit(10007)) / 10007.0 - 0.5)
    base = 100 + F.pmod(F.xxhash64("ticker"), F.lit(300))
    close = base * (1 + 0.1 * F.sin(x / 40) + 0.03 * F.sin(x / 7) + 0.02 * noise(1))
    own = own.withColumns({"close": close, "open": close * (1 + 0.01 * noise(2))})
    return own.select(
        "ticker",
        (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR")).alias("ts"),
        "open",
        (F.greatest("open", "close") * (1 + 0.01 * F.abs(noise(3)))).alias("high"),
        (F.least("open", "close") * (1 - 0.01 * F.abs(noise(4)))).alias("low"),
        "close",
        (1e6 * (1 + noise(5))).alias("volume"),
    )


def mock_macro(spark: SparkSession, series: Iterable[str], start: dt.date, end: dt.date, lag_days: int = 1) -> DataFrame:
    """Made-up daily values that depend on series and date alone: ``series, ts, as_of, value``."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d").where(F.weekday("d") < 5)
    own = days.select(F.explode(F.array(*[F.lit(s) for s in series])).alias("series"), "d")
    level = 10 + F.pmod(F.xxhash64("series"), F.lit(40))
    value = level * (1 + 0.2 * F.sin(F.unix_date("d") / 30.0) + 0.05 * (F.pmod(F.xxhash64("series", "d"), F.lit(10007)) / 10007.0 - 0.5))
    ts = F.col("d").cast("timestamp_ntz")
    return own.select("series", ts.alias("ts"), (ts + F.make_dt_interval(F.lit(lag_days))).alias("as_of"), value.alias("value"))


def mock_universe(spark: SparkSession, n: int) -> DataFrame:
    """Made-up symbols with market caps that fall: ``symbol, market_cap, k``."""
    k = F.col("id")
    return spark.range(n).select(F.concat(F.lit("MOCK"), k.cast("string")).alias("symbol"), (1e12 / (k + 1)).alias("market_cap"), k.alias("k"))


def mock_profiles(universe: DataFrame) -> DataFrame:
    """Made-up fund profiles of symbols, in the columns of ``fund_profile``'s input; every seventh symbol has no AUM."""
    h = F.pmod(F.xxhash64("symbol"), F.lit(1000))
    aum = F.when(h % 7 != 0, (h + 1) * 1e7)
    return universe.select("symbol", aum.alias("aum"), (h % 500 + 20).alias("holdings"), (h % 90 / 100).alias("expense_pct"), F.when(h % 2 == 0, "equity").otherwise("sector").alias("kind"))


def mock_earnings(universe: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A made-up report of each symbol in every quarter, on a weekday: ``ticker, date``."""
    quarters = [F.lit(r.quarter) for r in quarter_starts(universe.sparkSession, start, end).collect()]  # four a year
    own = universe.select("symbol", F.explode(F.array(*quarters)).alias("quarter"))
    day = F.date_add("quarter", F.pmod(F.xxhash64("symbol"), F.lit(60)).cast("int"))
    weekday = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    return own.select(F.col("symbol").alias("ticker"), weekday.alias("date")).where(F.col("date").between(F.lit(start), F.lit(end)))


def with_proprietary(rows: DataFrame, **feeds: DataFrame | None) -> DataFrame:
    """``rows`` (``ticker, ts``) with a column for each feed (``ticker, ts, value``), such as ``gex_net``, ``order_flow_imbalance`` or ``dix``.

    A feed that is not there gives nulls: nothing is made up in its place. ``gex_net`` brings its sign, ``gex_sign`` (1 from 0 on), with it.
    """
    for name, feed in feeds.items():
        if feed is None:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
        else:
            rows = rows.join(feed.select("ticker", "ts", F.col("value").cast("double").alias(name)), ["ticker", "ts"], "left")
        if name == "gex_net":
            rows = rows.withColumn("gex_sign", F.when(F.col(name) >= 0, 1.0).when(F.col(name) < 0, -1.0))
    return rows


def quarter_starts(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(trunc(DATE '{start}', 'QUARTER'), DATE '{end}', INTERVAL 3 MONTH)) AS quarter").where(F.col("quarter") >= F.lit(start))


def read_dataset(spark: SparkSession, path: str, required: Iterable[str] = ("ts", "t1", "label")) -> DataFrame:
    """A labelled dataset; refuses one that lacks a required column."""
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ts", "t1", "label", "regime")]
