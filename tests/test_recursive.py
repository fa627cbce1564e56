"""Scans over blocks against recursions that are run for every window by itself."""

import math

import numpy as np
import pytest

from tidemark.functions import recursive
from tidemark.operators import features


def plain_ema(xs, span):
    k, a = 2 / (span + 1), xs[0]
    for x in xs[1:]:
        a = x * k + a * (1 - k)
    return a


def plain_rsi(xs, n):
    moves = np.diff(xs)
    if len(xs) <= n:
        return math.nan
    gain, loss = np.maximum(moves[:n], 0).mean(), np.maximum(-moves[:n], 0).mean()
    for d in moves[n:]:
        gain, loss = (gain * (n - 1) + max(d, 0)) / n, (loss * (n - 1) + max(-d, 0)) / n
    return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)


def plain_adx(tr, up, down, n):
    if len(tr) < 2 * n:
        return math.nan
    sums, dxs = [sum(a[:n]) for a in (tr, up, down)], []
    for i in range(n, len(tr) + 1):
        if sums[0] > 0:
            total = sums[1] + sums[2]
            dxs.append(100 * abs(sums[1] - sums[2]) / total if total > 0 else 0.0)
        if i < len(tr):
            sums = [s - s / n + a[i] for s, a in zip(sums, (tr, up, down), strict=True)]
    if len(dxs) < n:
        return sum(dxs) / len(dxs) if dxs else math.nan
    avg = sum(dxs[:n]) / n
    for d in dxs[n:]:
        avg = (avg * (n - 1) + d) / n
    return avg


def series(n, seed=0):
    return np.random.default_rng(seed).integers(1, 50, n).astype(float)


def close_to(got, want):
    assert np.allclose(got, np.array(want, float), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n", [0, 1, 14, 15, 79, 80, 81, 333])
@pytest.mark.parametrize("lookback", [80, 21, 400])
def test_windows(n, lookback):
    x = series(n)
    window = lambda t: x[max(0, t - lookback + 1) : t + 1]
    close_to(recursive.ema(x, 9, lookback), [plain_ema(window(t), 9) for t in range(n)])
    close_to(recursive.rsi(x, 14, lookback), [plain_rsi(window(t), 14) for t in range(n)])
    close_to(recursive.rsi_slope(x, 14, 5, lookback), [plain_rsi(window(t), 14) - plain_rsi(window(t)[:-5], 14) for t in range(n)])
    close_to(recursive.share_below(x, lookback), [(window(t) <= x[t]).mean() for t in range(n)])


def test_flat_and_rising_series():
    assert (recursive.rsi(np.full(100, 5.0), 14, 80)[14:] == 100).all() and (recursive.rsi(np.arange(200.0), 14, 80)[14:] == 100).all()
    assert np.abs(recursive.rsi(np.arange(200.0)[::-1].copy(), 14, 80)[14:]).max() == 0


@pytest.mark.parametrize("lookback", [60, 276])
def test_adx(lookback):
    tr, up, down = series(350, 1), np.maximum(series(350, 2) - 25, 0), np.maximum(series(350, 3) - 25, 0)
    tr[0] = np.nan
    tr[100:130] = up[100:130] = down[100:130] = 0
    want = [plain_adx(*(a[max(1, t - lookback + 1) : t + 1].tolist() for a in (tr, up, down)), 14) for t in range(350)]
    close_to(recursive.adx(tr, up, down, 14, lookback), want)


def test_blocks_make_no_difference(spark, monkeypatch):
    x = series(700)
    rows = [(t, float(i), float(c)) for t in (0, 1) for i, c in enumerate(x[: 700 - 20 * t], 1)]
    bars = spark.createDataFrame(rows, "ticker int, i double, close double")
    whole = sorted(map(tuple, features.oscillators(bars).collect()))
    monkeypatch.setattr(recursive, "BLOCK", 100)  # seven tasks a ticker
    parts = sorted(map(tuple, features.oscillators(bars).collect()))
    assert len(parts) == len(whole) == len(rows)
    close_to(np.array(parts, float), np.array(whole, float))
    close_to([r[5] for r in parts if r[0] == 0], recursive.ema(x, 9, features.TRIGGER_LOOKBACK))
    assert features.oscillators(bars.where("false")).collect() == []
