"""Indicators as column expressions over point-in-time windows.

Every indicator sees a bar and those before it, and no more than its layer's lookback, so values do not
depend on where the stored history begins. Plain aggregates over sliding frames stay in generated code;
the recursive ones (EMA, RSI, ADX), seeded at the frame's first bar, are in ``recursive``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_bar():
    """Bars of a ticker in order of time."""
    return Window.partitionBy("ticker").orderBy("ts")


def trailing(n: int, before: int = 0):
    """The ``n`` bars up to ``before`` bars ago."""
    return by_bar().rowsBetween(-(n - 1) - before, -before)


def upto(n: int):
    return trailing(n)


def back(c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_bar())


def simple_return(c: Column) -> Column:
    return F.when(back(c) == 0, 0.0).otherwise(c / back(c) - 1)


def log_return(c: Column) -> Column:
    return F.when((c > 0) & (back(c) > 0), F.ln(c / back(c)))


def full(value: Column, n: int, over: Column) -> Column:
    """``value``, if the frame of ``n`` bars has that many of ``over``."""
    return F.when(F.count(over).over(trailing(n)) == n, value)


def sma(c: Column, n: int) -> Column:
    return full(F.avg(c).over(trailing(n)), n, c)


def realized_vol(log_ret: Column, n: int) -> Column:
    """Annualized population deviation of the last ``n`` log returns; 0 for fewer than two."""
    return F.when(F.count(log_ret).over(trailing(n)) < 2, 0.0).otherwise(F.stddev_pop(log_ret).over(trailing(n)) * (TRADING_DAYS**0.5))


def true_range(high: Column, low: Column, close: Column) -> Column:
    prev = back(close)
    return F.when(prev.isNotNull(), F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)))


def atr(tr: Column, n: int) -> Column:
    """Mean of the last ``n`` true ranges."""
    return full(F.avg(tr).over(trailing(n)), n, tr)


def roc(c: Column, n: int) -> Column:
    return F.when(back(c, n) != 0, c / back(c, n) - 1)


def signed_volume(c: Column, volume: Column) -> Column:
    return F.coalesce(F.signum(c - back(c)) * volume, F.lit(0.0))


def obv(signed: Column) -> Column:
    return F.sum(signed).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))


def slope_sign(y: Column, i: Column, n: int) -> Column:
    """Sign of the least-squares slope of the last ``n`` values of ``y`` against their places ``i``."""
    w = trailing(n)
    return full(F.signum(F.sum(i * y).over(w) - F.sum(i).over(w) * F.sum(y).over(w) / n), n, y)


def pivot(c: Column, k: int, above: bool) -> Column:
    """``c`` where it is beyond the ``k`` values on either side; confirmed ``k`` bars later."""
    beyond = lambda o: (c > o) if above else (c < o)
    test = F.lit(True)
    for d in range(1, k + 1):
        test = test & beyond(F.lag(c, d).over(by_bar())) & beyond(F.lead(c, d).over(by_bar()))
    return F.when(test, c)


def last_pivot(flag: Column, k: int, lookback: int) -> Column:
    """The latest pivot whose ``k`` neighbours on both sides lie inside the lookback."""
    return F.last(flag, ignorenulls=True).over(by_bar().rowsBetween(-(lookback - 1 - k), -k))


def divergence(c: Column, move: Column, n: int = 10) -> Column:
    """-1 where a new high in the window's later half has less momentum, 1 where a new low has more, else 0."""
    half = n // 2
    early, late = trailing(half, half), trailing(half)
    # The window's first move counts as 0.
    rest = by_bar().rowsBetween(-(n - 2), -half)
    hi_early = F.greatest(F.max(move).over(rest), F.lit(0.0))
    lo_early = F.least(F.min(move).over(rest), F.lit(0.0))
    bear = (F.max(c).over(late) > F.max(c).over(early)) & (F.max(move).over(late) < hi_early)
    bull = (F.min(c).over(late) < F.min(c).over(early)) & (F.min(move).over(late) > lo_early)
    return F.when(F.count(c).over(trailing(n)) < n, 0.0).when(bear, -1.0).when(bull, 1.0).otherwise(0.0)
