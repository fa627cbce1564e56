"""Point-in-time reads: the only code that reads bitemporal tables.

A fact is visible at T if it happened by T and was known by T. No function here takes a
knowledge time apart from the decision time.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Ordered


def observable(as_of: Column, decision: Column) -> Column:
    return as_of <= decision


def at(facts: DataFrame, t: Column, time: str = "ts") -> DataFrame:
    """The facts visible at ``t``; both bounds are simple predicates that reach the scan."""
    return facts.where((F.col(time) <= t) & observable(F.col("as_of"), t))


def latest(facts: DataFrame, t: Column, keys: Sequence[str], time: str, tie: Sequence[str] = (), layer: str | None = None) -> DataFrame:
    """The newest visible version of each key: one partial and one final aggregate, no sort."""
    seen = at(facts, t, time)
    if layer:
        seen = seen.where(F.col("layer") == layer)
    rest = [c for c in facts.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(time, "as_of", *tie)).alias("v")
    return seen.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def last_bars(bars: DataFrame, t: Column, n: int) -> DataFrame:
    """The last ``n`` bars of each ticker at ``t``, with ``pos`` from 1, oldest first."""
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc())
    own = bars.where(F.col("ts") <= t).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("ts"))).drop("back")


def as_of(left: DataFrame, facts: DataFrame, keys: Sequence[str], left_time: str, value: str, equal: Sequence[str] = (), hot: bool = False) -> DataFrame:
    """Each left row with the newest ``value`` visible at its time: newest event, then newest vintage.

    Facts and questions are laid on one line per ``equal`` group in order of when they take effect, and a
    running maximum carries the newest fact to each question: one shuffle, linear in both sides, where an
    inequality join would meet every pair. A fact takes effect when it has both happened and become known. Without ``equal``, or where one group of it is ``hot``,
    the line is cut into ranges, each of which starts from the newest fact before it.
    """
    rest = [c for c in left.columns if c not in equal]
    asks = left.select(*equal, F.col(left_time).alias("_t"), F.lit(1).alias("_ask"), F.struct(*rest).alias("_row"), F.lit(None).cast(_fact_type(facts, value)).alias("_fact"))
    tells = facts.select(
        *equal, F.greatest("ts", "as_of").alias("_t"), F.lit(0).alias("_ask"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"),
        F.struct(F.col("ts"), F.col("as_of"), F.col(value).alias("value")).alias("_fact"),
    )
    both = asks.unionByName(tells)
    if equal and not hot:
        line = Window.partitionBy(*equal).orderBy("_t", "_ask").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        told = both.withColumn("_newest", F.max("_fact").over(line))
    else:  # one order of many rows: questions of one time may be in several ranges, after its facts
        tied = both.withColumn("_tie", F.when(F.col("_ask") == 1, F.xxhash64("_row")).otherwise(0))
        told = Ordered(tied, ["_t", "_ask", "_tie"], equal).running(_newest=("max", F.col("_fact")))
    told = told.where("_ask = 1")
    return told.select(*equal, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_newest.value").alias(value))


def _fact_type(facts: DataFrame, value: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema}
    return f"struct<ts:{kinds['ts']},as_of:{kinds['as_of']},value:{kinds[value]}>"


def trailing_dates(days: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """``ts, series, dates``: for each of ``days`` (``ts``) and each series, the last ``n`` dates visible on the day as an array of
    ``struct(ts, value)`` with each date's newest vintage, oldest first.

    Facts and days are laid on one line in order of when they take effect, and the line of a series is walked once with only its last ``n`` dates in
    hand. A series has as many rows as the calendar has days and vintages, whatever the number of tickers.
    """
    t_type, v_type = facts.schema["ts"].dataType.simpleString(), facts.schema["value"].dataType.simpleString()
    series = facts.select("series").distinct()
    # A boolean says which rows ask; among rows of one time, facts come first.
    asks = days.select("ts").distinct().crossJoin(F.broadcast(series)).select("series", F.col("ts").alias("at"), F.lit(True).alias("asks"), F.lit(None).cast(t_type).alias("ts"), F.lit(None).cast("timestamp_ntz").alias("as_of"), F.lit(None).cast(v_type).alias("value"))
    tells = facts.select("series", F.greatest("ts", "as_of").alias("at"), F.lit(False).alias("asks"), "ts", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "value")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "asks"], kind="stable")
        held: dict = {}  # date -> (as_of, value); the last n dates only
        out = []
        for at, ask, ts, as_of, value in zip(pdf["at"], pdf["asks"], pdf["ts"], pdf["as_of"], pdf["value"], strict=True):
            if ask:
                out.append((at, [{"ts": d, "value": held[d][1]} for d in sorted(held)]))
            elif ts not in held or held[ts][0] <= as_of:
                held[ts] = (as_of, value)
                if len(held) > n:
                    held.pop(min(held))
        return pd.DataFrame({"ts": [a for a, _ in out], "series": pdf["series"].iloc[0], "dates": [d for _, d in out]})

    schema = f"ts {t_type}, series string, dates array<struct<ts:{t_type},value:{v_type}>>"
    return asks.unionByName(tells).groupBy("series").applyInPandas(walk, schema)


def history(facts: DataFrame, t: Column, n: int) -> DataFrame:
    """The last ``n`` dates of each series at ``t``, each with its newest vintage, oldest first (``pos``)."""
    newest = at(facts, t).groupBy("series", "ts").agg(F.max_by("value", "as_of").alias("value"))
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.col("ts").desc()))
    own = newest.withColumn("back", back).where(F.col("back") <= n)
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("series").orderBy("ts"))).drop("back")


def around(bars: DataFrame, t: Column, before: int, after: int) -> DataFrame:
    """The last ``before`` bars up to ``t`` and the first ``after`` bars past it."""
    past = Window.partitionBy("ticker").orderBy(F.col("ts").desc())
    ahead = Window.partitionBy("ticker").orderBy("ts")
    a = bars.where(F.col("ts") <= t).withColumn("k", F.row_number().over(past)).where(F.col("k") <= before).withColumn("side", F.lit("past"))
    b = bars.where(F.col("ts") > t).withColumn("k", F.row_number().over(ahead)).where(F.col("k") <= after).withColumn("side", F.lit("ahead"))
    return a.unionByName(b)


def latest_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("ts").alias("latest_ts"))


def top_one(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (which must break all ties): a lateral top-1 as one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])
