"""Answers of a market-data provider, kept as JSON files: one answer a file, as it came. Read whole or followed as a stream, whose checkpoint keeps which files were read.

Everything is Spark's own file source and expressions, so files may lie wherever Spark reads. An answer that is no JSON, or not of its kind, gives no rows; a row without a proper symbol or date is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.provider import normalised

#: When a day's bar is complete: the exchange's close, in UTC.
CLOSE = "INTERVAL '21' HOUR"
_BAR = "date: string, open: double, high: double, low: double, close: double, volume: double"
#: The provider's symbols of macro series (fixed values).
MACRO_SYMBOLS = {"vix": "^VIX", "vix9d": "^VIX9D", "vix3m": "^VIX3M", "vvix": "^VVIX", "dxy": "DXUSD", "gold": "GCUSD", "copper": "HGUSD", "oil": "CLUSD"}


def answers(spark: SparkSession, path: str) -> DataFrame:
    """``answer``: the text of each file below ``path``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "answer")


def followed(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: files that are there, then those that come."""
    own = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return own.text(path).withColumnRenamed("value", "answer")


def _day(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date").cast("timestamp_ntz")


def eod_bars(texts: DataFrame) -> DataFrame:
    """``ticker, ts, open, high, low, close, volume`` of end-of-day answers: ``{symbol, historical: [...]}``, or a list whose rows have the symbol; newest first or in any order."""
    nested = F.from_json("answer", f"struct<symbol: string, historical: array<struct<{_BAR}>>>")
    flat = F.from_json("answer", f"array<struct<symbol: string, {_BAR}>>")
    is_list = F.ltrim("answer").startswith("[")
    names = ["open", "high", "low", "close", "volume"]
    rows = F.when(is_list, flat).otherwise(F.transform(nested["historical"], lambda b: F.struct(nested["symbol"].alias("symbol"), b["date"].alias("date"), *[b[n].alias(n) for n in names])))
    own = texts.select(F.inline(rows))
    out = own.select(normalised(F.col("symbol")).alias("ticker"), (_day(F.col("date")) + F.expr(CLOSE)).alias("ts"), *names)
    return out.where("ticker IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL")


def quotes(texts: DataFrame) -> DataFrame:
    """``ticker, ts, price`` of batches of quotes: ``[{symbol, price, timestamp}]``, in seconds since 1970. A quote without a price or time is none."""
    own = texts.select(F.inline(F.from_json("answer", "array<struct<symbol: string, price: double, timestamp: bigint>>")))
    out = own.select(normalised(F.col("symbol")).alias("ticker"), F.timestamp_seconds("timestamp").alias("ts"), "price")
    return out.where("ticker IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL")


def macro(texts: DataFrame, symbols: Mapping[str, str] = MACRO_SYMBOLS, lag_days: int = 1) -> DataFrame:
    """``series, ts, as_of, value`` of end-of-day answers for the provider's symbols of ``symbols`` (series to symbol); others are no macro series. Known ``lag_days`` after its day."""
    bars = f"array<struct<{_BAR}>>"
    nested = F.from_json("answer", f"struct<symbol: string, historical: {bars}>")
    flat = F.from_json("answer", f"array<struct<symbol: string, {_BAR}>>")
    rows = F.when(F.ltrim("answer").startswith("["), F.transform(flat, lambda b: F.struct(b["symbol"].alias("symbol"), b["date"].alias("date"), b["close"].alias("value"))))
    rows = rows.otherwise(F.transform(nested["historical"], lambda b: F.struct(nested["symbol"].alias("symbol"), b["date"].alias("date"), b["close"].alias("value"))))
    series = F.create_map(*[F.lit(x) for name, symbol in symbols.items() for x in (symbol, name)])
    own = texts.select(F.inline(rows)).select(F.try_element_at(series, F.upper(F.trim("symbol"))).alias("series"), _day(F.col("date")).alias("ts"), "value")
    known = F.col("ts") + F.make_dt_interval(F.lit(lag_days))
    return own.where("series IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").select("series", "ts", known.alias("as_of"), "value")
