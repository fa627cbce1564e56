"""Hand-computed values, invariants, and behaviour that SQL does not express."""

import datetime as dt
import math
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import scalars as sc
from tidemark.operators import api, crossval, features, labeling, learners, metrics, monitor, pit, regime, search, signals, sinks, validation
from tidemark.sources import provider

ROOT = Path(__file__).resolve().parent.parent
DAY0 = dt.datetime(2024, 1, 1)


def bars(spark, rows, ticker=1):
    """``rows``: (open, high, low, close, volume)."""
    own = [(ticker, DAY0 + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(own, "ticker long, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def closes(spark, xs, volumes=None):
    return bars(spark, [(x, x + 1, x - 1, x, v) for x, v in zip(xs, volumes or [1] * len(xs), strict=True)])


def last(df, **columns):
    r = df.select("ts", *[c.alias(k) for k, c in columns.items()]).orderBy(F.col("ts").desc()).first()
    return tuple(r)[1:]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sma_roc_obv(spark):
    assert last(closes(spark, [1, 2, 3, 4]), a=ind.sma(F.col("close"), 2), b=ind.sma(F.col("close"), 9)) == (3.5, None)
    assert last(closes(spark, [100, 101, 99, 110]), a=ind.roc(F.col("close"), 3))[0] == pytest.approx(0.10)
    own = features.staged(closes(spark, [100, 101, 100, 102], [10, 5, 7, 3])).withColumn("obv", ind.obv(F.col("signed")))
    assert [r.obv for r in own.orderBy("ts").collect()] == [0, 5, -2, 1]


def test_rsi_of_rising_closes(spark):
    own = features.oscillators(features.staged(closes(spark, range(1, 40))).select("ticker", "ts", "i", "close"))
    assert last(own, a=F.col("rsi14"))[0] == 100


def naive_adx(rows, n):
    tr, up, dn = [], [], []
    for (_, h0, l0, c0, _), (_, h, l, _, _) in zip(rows, rows[1:], strict=False):  # noqa: E741
        u, d = h - h0, l0 - l
        up.append(u if u > d and u > 0 else 0)
        dn.append(d if d > u and d > 0 else 0)
        tr.append(max(h - l, abs(h - c0), abs(l - c0)))
    s, dxs = [sum(x[:n]) for x in (tr, up, dn)], []
    for i in range(n, len(tr) + 1):
        if s[0] > 0:
            dxs.append(100 * abs(s[1] - s[2]) / (s[1] + s[2]) if s[1] + s[2] > 0 else 0)
        if i < len(tr):
            s = [a - a / n + x[i] for a, x in zip(s, (tr, up, dn), strict=True)]
    out = sum(dxs[:n]) / n
    for d in dxs[n:]:
        out = (out * (n - 1) + d) / n
    return out


def test_adx_matches_its_definition(spark):
    rng = np.random.default_rng(3)
    c = 100 + np.cumsum(rng.normal(size=60))
    rows = [(x, x + abs(a), x - abs(b), x, 1) for x, a, b in zip(c, rng.normal(size=60), rng.normal(size=60), strict=True)]
    got = features.volatility(bars(spark, rows)).orderBy(F.col("ts").desc()).first().adx
    assert got == pytest.approx(naive_adx(rows, 14))


def test_calendar(spark):
    fridays = [one(spark, sc.third_friday(F.lit(d).cast("date"))) for d in ("2024-03-05", "2024-06-30", "2025-01-01")]
    assert fridays == [dt.date(2024, 3, 15), dt.date(2024, 6, 21), dt.date(2025, 1, 17)]
    days = spark.createDataFrame([(dt.date(2024, 3, d),) for d in (13, 15, 18)], "d date")
    assert [r.days_to_opex for r in features.calendar(days).orderBy("d").collect()] == [2, 0, -1]
    assert one(spark, sc.last_weekday_of_month(F.lit("2024-03-02").cast("date"))) == dt.date(2024, 3, 29)


BARRIER = {
    "target": ([(100, 100, 100, 100), (100, 102.5, 99.5, 102)], 1, "target", 2.0),
    "stop": ([(100, 100, 100, 100), (100, 101, 98.5, 99)], 1, "stop", -1.0),
    "both": ([(100, 100, 100, 100), (100, 103, 98, 101)], 1, "stop", -1.0),
    "time": ([(100, 100, 100, 100)] + [(100, 100.9, 99.5, 100.5)] * 20, 1, "time", 0.5),
    "short": ([(100, 100, 100, 100), (100, 100.5, 97.5, 98)], -1, "target", 2.0),
}


@pytest.mark.parametrize("case", BARRIER)
def test_triple_barrier(spark, case):
    rows, side, outcome, ret = BARRIER[case]
    b = bars(spark, [(*r, 1) for r in rows]).withColumn("idx", F.row_number().over(ind.by_bar()))
    e = spark.createDataFrame([(1, 1, 100.0, side, 2.0, 1.0)], "ticker long, idx int, entry_px double, side int, target_dist double, stop_dist double")
    got = labeling.triple_barrier(e, b).first()
    assert (got.outcome, got.ret_r, got.exit_idx) == (outcome, pytest.approx(ret), 16 if case == "time" else 2)


def test_unlabelled_entries_say_why(spark):
    b = bars(spark, [(1, 1, 1, 1, 1)]).withColumn("idx", F.row_number().over(ind.by_bar()))
    e = spark.createDataFrame([(1, 1, 1.0, 1, 1.0, 1.0), (1, 1, 1.0, -1, 1.0, 0.0)], "ticker long, idx int, entry_px double, side int, target_dist double, stop_dist double")
    assert sorted(r.reason for r in labeling.triple_barrier(e.where("side = 1"), b).union(labeling.triple_barrier(e.where("side = -1"), b)).collect()) == ["no bar ahead", "no positive risk"]


def test_cooldown(spark):
    c = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4, 7, 8, 10)], "ticker long, idx int")
    assert sorted(r.idx for r in labeling.greedy_cooldown(c, ["ticker"], 2).collect()) == [1, 4, 7, 10]


def test_uniqueness(spark):
    get = lambda spans: [r.weight for r in labeling.uniqueness(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "id int, ts int, t1 int")).orderBy("id").collect()]
    assert get([(0, 2), (1, 3), (2, 4)]) == pytest.approx([11 / 18, 5 / 12, 1 / 3])
    spans = [(a, a + b) for a, b in np.random.default_rng(5).integers(0, 12, size=(40, 2)).tolist()]
    assert get(spans) == pytest.approx(brute_uniqueness(spans))
    assert get([(0, 1), (2, 3), (4, 5)]) == [1.0, 1.0, 1.0] and get([(3, 1)]) == [1.0]


def brute_uniqueness(spans):
    points = sorted({a for a, _ in spans})
    n = {p: sum(a <= p <= b for a, b in spans) for p in points}
    return [np.mean([1 / n[p] for p in points if a <= p <= b]) for a, b in spans]


def test_sharpe_statistics(spark):
    assert metrics.expected_max_sharpe(100) == pytest.approx(2.5306, abs=1e-3)
    rows = [("up", 0.1)] * 20 + [("down", -0.1)] * 20 + [("one", 1.0)]
    own = metrics.deflated_sharpe(metrics.moments(spark.createDataFrame(rows, "k string, r double"), ["k"], "r").withColumn("sd", F.when(F.col("sd") < 1e-12, 0.0).otherwise(F.col("sd"))), 10)
    assert {r.k: r.dsr for r in own.collect()} == {"up": 1.0, "down": 0.0, "one": 0.5}
    for x in (-3.0, -0.5, 0.0, 1.96):
        assert one(spark, sc.norm_cdf(F.lit(x))) == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-6)


def test_moments_are_bias_corrected(spark):
    xs = np.random.default_rng(0).normal(size=50) ** 3
    got = metrics.moments(spark.createDataFrame([(1, float(x)) for x in xs], "k int, r double"), ["k"], "r").first()
    n, d = len(xs), xs - xs.mean()
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert got.skew == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * g1)
    assert got.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)


def test_tails_and_drawdowns(spark):
    own = spark.createDataFrame([(1, i, r) for i, r in enumerate([1.0] * 9 + [-4.0])], "k int, t int, r double")
    assert metrics.tail_mean(own, ["k"], "r", 0.05, True).first().cvar == -4
    own = spark.createDataFrame([(1, i, r) for i, r in enumerate([1.0, 1.0, -3.0, -1.0])], "k int, t int, r double")
    got = metrics.drawdowns(own, ["k"], "r", ["t"]).first()
    assert (got.mdd, got.mdd_from_zero) == (4.0, -4.0)
    pf = spark.createDataFrame([(r,) for r in (2.0, -1.0, 2.0, -1.0, -1.0)], "r double").agg(metrics.profit_factor(F.col("r")).alias("x")).first().x
    assert pf == pytest.approx(4 / 3)


def overfit(spark, edge):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[:, 0] += edge
    rows = [(t, n, float(m[t, n])) for t in range(300) for n in range(8)]
    return metrics.overfit_probability(metrics.cscv(spark.createDataFrame(rows, "t int, trial int, ret double"), 6)).first()


def test_overfit_probability(spark):
    good = overfit(spark, 0.5)
    assert good.pbo < 0.2 and good.n_combinations == 20
    assert overfit(spark, 0.0).pbo > good.pbo


def test_splits_purge_and_embargo(spark):
    rows = spark.createDataFrame([(i, i, i + 5) for i in range(120)], "pos int, ts int, t1 int")
    own = crossval.splits(rows, 6, 2, 3).cache()
    assert own.select("split").distinct().count() == 15
    assert crossval.leaks(own).count() == 0
    assert crossval.leaks(own.withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role")))).count() > 0
    n = crossval.sizes(own).agg(F.min("n_purged"), F.min("n_embargoed")).first()
    assert n[0] > 0 and crossval.sizes(own).agg(F.sum("n_embargoed")).first()[0] >= 0
    with pytest.raises(ValueError):
        crossval.splits(rows, 6, 6, 0)


def test_tau_falls_back_without_an_edge(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(size=200)
    rows = lambda r: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, r, strict=True))], "pos int, p double, r double")
    assert metrics.select_tau(rows(-np.ones(200))) == 0.5
    assert metrics.select_tau(rows(np.where(p > 0.7, 1.0, -1.0))) > 0.55


def test_wilson_and_conviction(spark):
    lb = lambda p, n: one(spark, sc.wilson_lower_bound(F.lit(p), F.lit(n)))
    assert lb(0.70, 8) < 0.45 < lb(0.55, 400) and lb(0.5, 0) == 0
    assert one(spark, signals.conviction(F.lit(None).cast("double"), F.lit(0), F.lit(0.0), F.lit(2.0))) == pytest.approx(1 / 3)


REGIMES = {
    "calm": (dict(rv_percentile=0.15, vix_vix3m=0.88, vvix=85.0, rv20=0.10, hy_oas=3.0, copper_gold=0.02, dxy_trend=-0.01), {"risk_on", "vol_compression"}),
    "stress": (dict(rv_percentile=0.95, vix_vix3m=1.20, vvix=130.0, rv20=0.55, hy_oas=7.5, copper_gold=-0.06, dxy_trend=0.03), {"risk_off", "vol_expansion"}),
    "thin": (dict(rv_percentile=0.5, vix_vix3m=0.97), {regime.OUT}),
    "absurd": (dict(rv_percentile=0.5, vix_vix3m=9.9, vvix=90.0, rv20=0.2), {regime.OUT}),
    "nan": (dict(rv_percentile=0.5, vix_vix3m=float("nan"), vvix=90.0, rv20=0.2, dxy_trend=0.0), {regime.OUT}),
}


@pytest.mark.parametrize("case", REGIMES)
def test_regimes(spark, case):
    values, labels = REGIMES[case]
    got = regime.classify(spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))).first()
    assert got.label in labels and sum(got.prob_map.values()) == pytest.approx(1)


def test_leak_pair_and_vintages(spark):
    t = dt.datetime(2025, 1, 10, 21)
    f = spark.createDataFrame([("a", t, t, 1.0), ("a", t, t + dt.timedelta(days=1), 9.0)], "k string, ts timestamp_ntz, as_of timestamp_ntz, value double")
    at = lambda x: pit.latest(f, F.lit(x).cast("timestamp_ntz"), ["k"], "ts").first().value
    assert at(str(t)) == 1.0 and at(str(t + dt.timedelta(days=2))) == 9.0
    asks = spark.createDataFrame([(t,), (t + dt.timedelta(days=2),), (t - dt.timedelta(days=1),)], "ts timestamp_ntz")
    got = [r.value for r in pit.as_of(asks, f, [], "ts", "value").orderBy("ts").collect()]
    assert got == [None, 1.0, 9.0]


def test_filters_reach_the_scan(spark, capsys):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id AS ticker", "ts AS decision_ts", "ts AS as_of", "value")
    pit.latest(df, F.lit("2024-01-10").cast("timestamp_ntz"), ["ticker"], "decision_ts").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_keyed_table(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), "k int, v double", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    t.upsert(rows((1, 1.0), (2, None)))
    t.upsert(rows((1, 5.0)))
    t.fill(rows((1, 9.0), (2, 7.0)))
    t.insert(rows((2, 0.0), (3, 3.0)))
    assert sorted(map(tuple, t.read().collect())) == [(1, 5.0), (2, 7.0), (3, 3.0)]
    with pytest.raises(ValueError):
        t.insert_once(rows((3, 1.0)))
    t.delete(F.col("k") == 2)
    assert sinks.KeyedTable(spark, t.path, "k int, v double", ["k"]).read().count() == 2


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, 3, 1.0, 0.5, 0.1), (1, 2, 0.0, 0.4, 0.2)], "ts int, t1 int, label double, b double, a double")
    sinks.write_dataset(rows, str(tmp_path / "d"))
    own = provider.read_dataset(spark, str(tmp_path / "d"))
    assert own.columns == ["ts", "t1", "label", "a", "b"] and provider.feature_columns(own) == ["a", "b"]
    with pytest.raises(ValueError):
        provider.read_dataset(spark, str(tmp_path / "d"), ["missing"])
    with pytest.raises(ValueError):
        sinks.write_dataset(rows.where("ts > 5"), str(tmp_path / "e"))


def test_files_as_provider(spark, tmp_path):
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars/x.json").write_text('{"symbol": " spy ", "date": "2024-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}\n{"symbol": "b@d", "date": "2024-01-02"}\n{"symbol": "A", "date": "no"}\n')
    got = provider.FileProvider(str(tmp_path)).daily_bars(spark).collect()
    assert [(r.ticker, r.ts) for r in got] == [("SPY", dt.datetime(2024, 1, 2, 21))]


def test_mock_bars_depend_on_ticker_and_date_alone(spark):
    a = provider.mock_bars(spark, ["SPY", "QQQ"], dt.date(2024, 6, 3), dt.date(2024, 6, 30))
    b = provider.mock_bars(spark, ["QQQ"], dt.date(2024, 6, 10), dt.date(2024, 6, 20))
    assert a.where("weekday(ts) >= 5").count() == 0 and a.where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    assert b.exceptAll(a.where("ticker = 'QQQ'")).count() == 0
    assert [r.quarter for r in provider.quarter_starts(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).collect()] == [dt.date(2024, m, 1) for m in (1, 4, 7, 10)]


def test_column_names_and_weeks(spark):
    assert one(spark, sc.column_name(F.lit("regime.adx"))) == "regime__adx" and one(spark, sc.column_name(F.lit("a.b.c"))) == "a__b_c"
    assert one(spark, sc.iso_week(F.lit("2024-12-30").cast("timestamp_ntz"))) == "2025-W01"
    assert api.scanner_of(" Equity ") == "equity" and api.scanner_of("x") == "etf"
    assert one(spark, api.leading_number(F.lit("2.5 bars"))) == 2.5


def planted(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    noise = rng.normal(size=n)
    r = np.clip(0.9 * x[:, 0] + 0.6 * x[:, 1] + noise, -1, 2) if kind == "genuine" else noise
    if kind == "leaky":
        x[:, 0] = np.where(np.arange(n) < n // 2, r, -r)
    return x, r


def oos_mean(spark, kind):
    """Expectancy of acting on out-of-sample predictions."""
    x, r = planted(400, kind)
    rows = spark.createDataFrame([(i, i, i + 3, float(r[i]), 1.0, *map(float, x[i])) for i in range(400)], "pos int, ts int, t1 int, r double, weight double, a__x double, a__y double, a__z double")
    splits = crossval.splits(rows.select("pos", "ts", "t1"), 4, 1, 3).select("split", "pos", "role")
    names = ["a__x", "a__y", "a__z"]
    p = crossval.oos_averaged(learners.oos_predictions(rows, splits, learners.trial_grid(1, names), names, trees=20)).join(rows, "pos")
    return p.agg(F.avg(F.when(F.col("p") >= 0.5, F.col("r")).otherwise(0.0))).first()[0]


def test_genuine_edge_passes_and_a_leak_does_not(spark):
    genuine, leaky = oos_mean(spark, "genuine"), oos_mean(spark, "leaky")
    assert genuine > 0.2 and leaky < 0.5 * genuine


def dataset(spark, kind, n=900, seed=2):
    x, r = planted(n, kind, seed)
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(i, day(i), day(i + 3), float(r[i]), 1.0, ("bull", "bear", "chop")[i % 3], *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "pos int, ts timestamp_ntz, t1 timestamp_ntz, r double, weight double, regime string, a__x double, a__y double, a__z double")


def test_leak_checkpoint(spark):
    """A genuine edge passes the gate, a planted leak is rejected, and an error is a rejection."""
    names, plan = ["a__x", "a__y", "a__z"], validation.Plan(n_groups=4, k_test=1, n_trials=2, trees=20)
    got = {r.dataset: r for r in validation.leak_checkpoint(dataset(spark, "leaky"), dataset(spark, "genuine"), (names, names), plan).collect()}
    assert got["genuine"].passed and not got["leaky"].passed and got["leaky"].ok and got["genuine"].ok
    passed, why = validation.fail_closed(lambda: validation.decide(dataset(spark, "genuine").limit(3), names, plan))
    assert not passed and why.startswith("validation failed")


def test_forward_holdout(spark):
    """An edge that lasts is found after the boundary; one that ends before it is not; an empty side gives zeros."""
    rows, trial = dataset(spark, "genuine"), learners.trial_grid(1, ["a__x", "a__y", "a__z"])[0]
    precision, expectancy, n = validation.forward_holdout(rows, trial, 20)
    assert precision > 0.6 and expectancy > 0.3 and n > 50
    ended = rows.withColumn("r", F.when(F.col("pos") < 720, F.col("r")).otherwise(-F.col("r")))
    assert validation.forward_holdout(ended, trial, 20, dt.datetime(2021, 12, 21))[1] < 0
    assert validation.forward_holdout(rows, trial, 20, dt.datetime(2000, 1, 1)) == (0.0, 0.0, 0)


def test_macro_features_know_only_what_was_known(spark):
    """A date known late and a revision count from the day they are known; a missing leg gives no ratio; 21 dates make a trend."""
    d = lambda k: dt.datetime(2025, 1, 1) + dt.timedelta(days=k)
    facts = [("vix", d(1), d(1), 20.0), ("vix", d(2), d(9), 30.0), ("vix3m", d(1), d(1), 25.0), ("vix3m", d(1), d(4), 40.0)]
    facts += [("oil", d(k), d(k), 100.0 + k) for k in range(30)] + [("copper", d(k), d(k), 4.0 + k) for k in range(3)] + [("gold", d(k), d(k), 2.0 if k else 0.0) for k in range(3)]
    macro = spark.createDataFrame(facts, "series string, ts timestamp_ntz, as_of timestamp_ntz, value double")
    days = spark.createDataFrame([(d(k),) for k in (0, 1, 3, 5, 10, 29)], "ts timestamp_ntz")
    got = {r.ts: r for r in features.macro_regime(days, macro).collect()}
    assert [got[d(k)].vix_vix3m for k in (0, 1, 3, 5, 10)] == [None, 0.8, 0.8, 0.5, 0.75]
    assert got[d(29)].oil_trend == pytest.approx(129 / 109 - 1) and got[d(0)].oil_trend is None
    assert got[d(29)].copper_gold == pytest.approx(6 / 5 - 1)  # the pair without gold is left out
    assert got[d(29)].vix9d_vix is None and got[d(29)].net_liquidity is None


def test_importance_of_all_rows(spark):
    rows = dataset(spark, "genuine", 400)
    by = {r.feature: r.importance for r in learners.permutation_importance(rows, ["a__x", "a__z"], 2, 20).collect()}
    shap = {r.feature: r.importance for r in learners.shap_importance(rows, ["a__x", "a__z"], 20).collect()}
    assert by["a__x"] > by["a__z"] >= 0 and shap["a__x"] > shap["a__z"] >= 0


def test_interpolation(spark):
    knots = [(0.2, 0.1), (0.4, 0.5), (0.4, 0.7), (0.8, 0.9)]
    got = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,), (None,)], "p double").select(learners.interpolate(F.col("p"), knots).alias("q")).collect()
    assert [r.q for r in got] == [0.1, pytest.approx(0.3), pytest.approx(0.8), 0.9, None]


def test_trees_route_missing_values_and_shapley_adds_up():
    x, r = planted(300, "genuine", 4)
    x[::7, 0] = np.nan
    model = learners.fit(x, (r > 0).astype(float), trees=10)
    assert ((model.proba(x) >= 0.5) == (r > 0)).mean() > 0.7
    base = model.base + model.rate * sum(t.mean() for t in model.trees)
    assert model.shapley(x[:20]).sum(axis=1) + base == pytest.approx(model.margin(x[:20]))


def test_genomes_stay_valid():
    import random

    rng, cat = random.Random(1), {f"trigger__{c}": [0.1, 0.2, 0.3, 0.4, 0.5] for c in "abcd"} | {"trigger__nr7": [0.0, 0.5, 1.0, 1.5, 2.0]}
    pool = search.seed_population(cat, 10, rng)
    for _ in range(300):
        g = search.mutate(rng.choice(pool), cat, rng) if rng.random() < 0.5 else search.cross(rng.choice(pool), rng.choice(pool), rng)
        assert 1 <= len(g.predicates) <= search.MAX_PREDICATES and g.risk.stop > 0 and g.risk.target in search.TARGETS and all(k in cat for k, _, _ in g.predicates)
        pool[rng.randrange(len(pool))] = g
    a, b = search.Genome((("x", "gt", 0.1), ("y", "lt", -0.0))), search.Genome((("y", "lt", 0.0), ("x", "gt", 0.1)))
    assert a.signature == b.signature


def test_archetypes_take_the_quantiles_of_their_ideas():
    cat = {k: [float(q) for q in search.QUANTILES] for _, idea in search.ARCHETYPES.values() for k, _, _ in idea}
    got = search.archetypes(cat)
    assert len(got) == 7 and sum(g.side for g in got) == 1 and all(g.actionable for g in got)
    assert dict((k, (op, t)) for k, op, t in got[2].predicates)["trigger__rsi14"] == ("lt", pytest.approx(0.25))
    assert len(search.archetypes({k: v for k, v in cat.items() if k != "regime__adx"})) == 1  # an idea needs all of its features


def test_risk_space():
    import random

    rng, fixed = random.Random(3), search.Risk("fixed", 5.0, 2.0, 3.0)
    space = search.RiskSpace(fixed)
    drawn = [space.sample(rng) for _ in range(200)]
    assert all(r.kind == "fixed" and 3.75 <= r.stop <= 6.25 and r.target in search.TARGETS and r.second == min(r.target + 1, 5.0) for r in drawn)
    kinds, r = set(), search.Risk()
    for _ in range(300):
        r = space.mutate(r, rng)
        kinds.add(r.kind)
        assert r.stop > 0 and r.target in search.TARGETS and r.second is None
    assert kinds == {"atr", "pct", "fixed"}
    child = space.cross(search.Risk("atr", 1.0, 1.5, None), search.Risk("pct", 2.0, 3.0, 4.0), rng)
    assert (child.kind, child.stop) in (("atr", 1.0), ("pct", 2.0)) and child.target in (1.5, 3.0) and child.second in (None, 4.0)
    locked = search.RiskSpace(fixed, locked=True)
    assert locked.sample(rng) == fixed and locked.mutate(fixed, rng) == fixed


def test_survivors(spark):
    rows = [(1, "candidate", True, True), (2, "candidate", False, True), (3, "candidate", False, False), (4, "candidate", None, None), (5, "promoted", False, False)]
    got = search.select_survivors(spark.createDataFrame(rows, "id int, status string, passed boolean, survivor boolean")).orderBy("id").collect()
    assert [(r.status, r.carried) for r in got] == [("promoted", True), ("candidate", True), ("retired", False), ("candidate", False), ("retired", False)]


def test_made_up_sources(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 6, 30)
    macro = provider.mock_macro(spark, ["vix", "oil"], a, b)
    assert macro.count() == 2 * 130 and macro.exceptAll(provider.mock_macro(spark, ["oil", "vix"], a, b)).isEmpty()
    universe = provider.mock_universe(spark, 20)
    assert [r.symbol for r in provider.universe(universe, 3).orderBy("pos").collect()] == ["MOCK0", "MOCK1", "MOCK2"]
    assert provider.fund_profile(provider.mock_profiles(universe)).count() == 20
    earnings = provider.mock_earnings(universe, a, b).collect()
    assert len(earnings) > 35 and all(r.date.weekday() < 5 for r in earnings)


def test_proprietary_feeds_are_never_made_up(spark):
    rows = spark.createDataFrame([(1, DAY0), (2, DAY0), (3, DAY0)], "ticker long, ts timestamp_ntz")
    feed = spark.createDataFrame([(1, DAY0, -5.0), (2, DAY0, 0.0)], "ticker long, ts timestamp_ntz, value double")
    got = provider.with_proprietary(rows, gex_net=feed, dix=None).orderBy("ticker").collect()
    assert [(r.gex_net, r.gex_sign, r.dix) for r in got] == [(-5.0, -1.0, None), (0.0, 1.0, None), (None, None, None)]


def test_models_tables_and_periods(spark, tmp_path):
    x, r = planted(100, "genuine")
    model, path = learners.fit(x, (r > 0).astype(float), trees=3), f"file://{tmp_path}"
    name = learners.model_id(["a", "b", "c"], {"trees": 3}, 0)
    for _ in range(2):
        learners.save_model(spark, path, name, ["a", "b", "c"], model)
    names, back = learners.load_model(spark, path, name)
    assert names == ["a", "b", "c"] and np.array_equal(back.proba(x), model.proba(x))
    for k in range(2):  # what is there stays
        tables = sinks.migrate(spark, f"{path}/db", {"t": "id int, v int"}, {"t": ["id"]})
        tables["t"].upsert(spark.createDataFrame([(k, k)], "id int, v int"))
    assert tables["t"].read().count() == 2
    labels = spark.createDataFrame([(dt.datetime(2020, 3, d), "risk_off" if d < 4 else "risk_on") for d in range(1, 6)], "ts timestamp_ntz, label string")
    got = {r.name: (r.n, r.share, r.passed) for r in monitor.regime_sanity(labels).collect()}
    assert got["COVID crash"] == (5, 0.6, True) and got["calm uptrend"] == (0, 0.0, False)


def test_path_of_predictions(spark):
    p = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (2, 0, 0.5)], "pos int, split int, p double")
    assert {r.pos: r.p for r in crossval.oos_single_path(p).collect()} == {1: 0.6, 2: 0.5}
    assert {r.pos: r.p for r in crossval.oos_averaged(p).collect()} == {1: pytest.approx(0.4), 2: 0.5}


def test_library_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
