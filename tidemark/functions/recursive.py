"""Indicators that are recursions over a bounded lookback: EMA, RSI, ADX, and ranks inside it.

A series is cut into blocks of bars; each block is one group that also has the bars of its lookback, so a block needs nothing from others and a hot ticker is many tasks. Inside,
one step of smoothing is an affine map of the state. The state of a window that is seeded at its first bar is the composition of its maps, and since maps compose, all windows of one
length follow from two scans over runs of that length: suffixes of one run, prefixes of the next. No bar gets a list of its lookback.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bars in a block, at least; a lookback that is longer makes longer blocks.
BLOCK = 4096


def blocked(bars: DataFrame, needs: Sequence[str], adds: Sequence[str], lookback: int, run: Callable[..., Sequence[np.ndarray]]) -> DataFrame:
    """``bars`` (``ticker``, its bar number ``i`` from 1, and flat columns) with the doubles ``adds`` that ``run`` makes of the columns ``needs``.

    ``run`` gets arrays in order of ``i``: a block's bars after up to ``lookback`` bars before them, or from the series' first bar on. NaN and null are alike.
    """
    size = max(BLOCK, lookback)
    at = (F.col("i") - 1).cast("long")
    own = F.floor(at / size)
    # The last bars of a block are also the lookback of the next.
    blocks = F.when(at % size >= size - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = bars.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    keep = bars.columns

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        mine = pa.array(table["_own"].to_numpy() == table["_block"].to_numpy())
        arrays = [table[c].to_numpy().astype(np.float64) for c in needs]
        with np.errstate(divide="ignore", invalid="ignore"):
            made = run(*arrays)
        out = table.select(keep)
        for name, values in zip(adds, made, strict=True):
            out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return out.filter(mine)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields), *(f"`{a}` double" for a in adds)])
    return dealt.groupBy("ticker", "_block").applyInArrow(group, schema)


def smoothed(seed: np.ndarray, x: np.ndarray, keep: float, gain: float, window: int) -> np.ndarray:
    """For each place the state of ``s = keep * s + gain * x`` at it, begun as ``seed`` at the first place of the ``window`` places that end there (or of the series)."""
    n = len(x)
    runs = -(-n // window) if n else 0
    z, v = (np.concatenate([a, np.zeros(runs * window - n)]).reshape(runs, window) for a in (seed, x))
    power = keep ** np.arange(window)
    # Prefixes: what a run's first places add to a state that came in, and their state when seeded at the run's first place.
    added, begun = np.empty_like(v), np.empty_like(v)
    added[:, :1], begun[:, :1] = gain * v[:, :1], z[:, :1]
    for j in range(1, window):
        added[:, j] = keep * added[:, j - 1] + gain * v[:, j]
        begun[:, j] = keep * begun[:, j - 1] + gain * v[:, j]
    # Suffixes: the state at a run's end when seeded at each of its places.
    ended, tail = np.empty_like(v), np.zeros(runs)
    for j in range(window - 1, -1, -1):
        ended[:, j] = power[window - 1 - j] * z[:, j] + tail
        tail = tail + power[window - 1 - j] * gain * v[:, j]
    out = begun.copy()
    if window > 1:
        out[1:, :-1] = ended[:-1, 1:] * (keep * power[:-1]) + added[1:, :-1]
    return out.reshape(-1)[:n]


def ema(closes: np.ndarray, span: int, lookback: int) -> np.ndarray:
    k = 2.0 / (span + 1)
    return smoothed(closes, closes, 1 - k, k, lookback)


def rsi(closes: np.ndarray, n: int, lookback: int) -> np.ndarray:
    """Wilder's RSI of the last ``lookback`` closes; 100 without losses, undefined for ``n`` closes or fewer."""
    out = np.full(len(closes), np.nan)
    if len(closes) <= n:
        return out
    moves = np.diff(closes)
    state = []
    for part in (np.maximum(moves, 0.0), np.maximum(-moves, 0.0)):
        seed = sliding_window_view(part, n).sum(axis=1) / n  # exactly 0 where all are
        state.append(smoothed(seed, part[n - 1 :], (n - 1) / n, 1 / n, lookback - n))
    gain, loss = state
    out[n:] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / np.where(loss == 0, 1.0, loss)))
    return out


def rsi_slope(closes: np.ndarray, n: int, k: int, lookback: int) -> np.ndarray:
    """RSI now less the RSI of the same window without its last ``k`` closes."""
    before = np.concatenate([np.full(min(k, len(closes)), np.nan), rsi(closes, n, lookback - k)[: max(len(closes) - k, 0)]])
    return rsi(closes, n, lookback) - before


def adx(tr: np.ndarray, up: np.ndarray, down: np.ndarray, n: int, lookback: int) -> np.ndarray:
    """Wilder's ADX of the last ``lookback`` moves (the series' first bar has none). Its last smoothing is over values that depend on where
    the window begins, so no scan serves two windows: all windows take each step together."""
    first = 1 if len(tr) and np.isnan(tr[0]) else 0
    place = np.arange(len(tr))
    begin = np.maximum(first, place - lookback + 1)
    size = np.maximum(place - begin + 1, 0)
    out = np.full(len(tr), np.nan)
    todo = np.flatnonzero(size >= 2 * n)
    if not len(todo):
        return out
    begin, size = begin[todo], size[todo]
    # The sums of each window's first n moves.
    sums = [sliding_window_view(a, n).sum(axis=1)[begin] for a in (tr, up, down)]
    count, avg = np.zeros(len(todo)), np.zeros(len(todo))
    for i in range(n, int(size.max()) + 1):
        total = sums[1] + sums[2]
        dx = np.where(total > 0, 100 * np.abs(sums[1] - sums[2]) / np.where(total > 0, total, 1.0), 0.0)
        take = (sums[0] > 0) & (i <= size)
        # The sum of the first n, then its mean, smoothed on.
        nxt = np.where(count < n - 1, avg + dx, np.where(count == n - 1, (avg + dx) / n, (avg * (n - 1) + dx) / n))
        avg, count = np.where(take, nxt, avg), count + take
        here = np.minimum(begin + i, len(tr) - 1)
        sums = [s - s / n + a[here] for s, a in zip(sums, (tr, up, down), strict=True)]
    out[todo] = np.where(count >= n, avg, np.where(count > 0, avg / np.maximum(count, 1), np.nan))
    return out


def share_below(x: np.ndarray, lookback: int) -> np.ndarray:
    """For each value the share of those in the last ``lookback`` places that are at or below it; places without a value don't count."""
    padded = sliding_window_view(np.concatenate([np.full(lookback - 1, np.nan), x]), lookback) if len(x) else np.zeros((0, lookback))
    out = np.full(len(x), np.nan)
    for at in range(0, len(x), 1024):  # as many comparisons at a time as fit a cache
        own = padded[at : at + 1024]
        out[at : at + 1024] = (own <= x[at : at + 1024, None]).sum(axis=1) / np.maximum((~np.isnan(own)).sum(axis=1), 1)
    return np.where(np.isnan(x), np.nan, out)
