"""Genomes from JSON, signals as text, and the replay of a backtest."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import api, labeling, monitor, search, signals, sinks
from tidemark.plans import nightly
from tidemark.sources import tables


def test_genome_without_a_risk_has_its_horizons(spark):
    docs = [
        '{"side": "long", "horizon": "short_swing", "predicates": [{"feature_key": "trigger.roc", "op": "gt", "threshold": 0.5}]}',
        '{"side": "SHORT", "horizon": "Swing", "predicates": [], "risk": {"kind": "fixed", "stop": 5, "target": 3}}',
        '{"side": "long", "horizon": "decade", "predicates": []}',
        '{"side": "up", "horizon": "swing", "predicates": []}',
        '{"side": "long", "horizon": "swing"}',
        "no json",
        None,
    ]
    got = [r.g for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string").orderBy("i").select(api.genome_of(F.col("doc")).alias("g")).collect()]
    assert (got[0].side, got[0].predicates[0].feature_key, tuple(got[0].risk)) == (1, "trigger.roc", ("atr", 0.8, 1.875))
    assert (got[1].side, got[1].horizon, tuple(got[1].risk)) == (-1, "swing", ("fixed", 5.0, 3.0)) and got[2:] == [None] * 5


def test_signal_text(spark):
    row = dict(ticker="SPY", side=-1, horizon="swing", entry=450.1, stop=455.0, target1=440.25, target2=None, rr1=2.0, rr2=None, conviction=0.61, cohort_n=42, regime="risk_off",
               why=[("trigger.roc", -0.5), ("location.dist", 0.25)], invalidation="close above 455.00", expectancy=0.33, cvar5=-1.0, lead_time="next session")
    schema = "ticker string, side int, horizon string, entry double, stop double, target1 double, target2 double, rr1 double, rr2 double, conviction double, cohort_n int, regime string, why array<struct<key:string,contribution:double>>, invalidation string, expectancy double, cvar5 double, lead_time string"
    df = spark.createDataFrame([tuple(row.values()), tuple((row | {"target2": 430.0, "rr2": 4.0, "side": 1, "why": []}).values())], schema)
    one, two = [r.t for r in df.select(signals.text().alias("t")).collect()]
    assert one.split("\n") == [
        "SPY — SHORT (swing)", "Entry: 450.10   Stop: 455.00", "Target 1: 440.25   Risk:Reward 2.0", "Conviction: 0.61 (calibrated, regime-matched cohort n=42)", "Regime: risk_off",
        "Why: trigger.roc (-0.50); location.dist (+0.25)", "Invalidation: close above 455.00", "Expectancy(cohort): +0.33R   CVaR(5%): -1.0R   Lead-time: next session",
    ]
    assert "SPY — LONG" in two and "Target 1: 440.25   Target 2: 430.00   Risk:Reward 2.0 / 4.0" in two and "Why: \n" in two


def test_replay_is_the_backtest_of_each_strategy_and_replaces_itself(spark, tmp_path):
    rnd, rows = random.Random(2), []
    for t in range(3):
        px = 100.0
        for i in range(150):
            px *= 1 + rnd.gauss(0, 0.02)
            rows.append((t, i + 1, datetime(2020, 1, 1) + timedelta(i), px * 1.02, px * 0.98, px, 2.0, rnd.random()))
    spark.createDataFrame(rows, "ticker int, idx int, ts timestamp_ntz, high double, low double, close double, atr double, trigger__a double").write.parquet(str(tmp_path / "w"))
    window = spark.read.parquet(str(tmp_path / "w"))
    genomes = {"x": search.Genome((("trigger__a", "gt", 0.7),)), "never": search.Genome((("trigger__a", "gt", 2.0),)), "y": search.Genome((("trigger__a", "lt", 0.2),), -1)}
    got = signals.replay(genomes, window, "etf")
    for name, g in genomes.items():
        want = labeling.backtest(window, labeling.fires(g.predicates), g.side).where("ret_r IS NOT NULL")
        key = lambda df, r: sorted((x.ticker, x.entry_ts, round(x[r], 9)) for x in df.collect())
        assert key(got.where(F.col("strategy") == name), "pnl_r") == key(want, "ret_r")
    for r in got.collect():
        assert r.exit_px == pytest.approx(r.fill_px + r.side * r.pnl_r * 2.0) and r.mode == "backtest" and r.cost == pytest.approx(0.0004)
    path = str(tmp_path / "j")
    sinks.replace_partitions(got, path, "mode", "scanner")
    sinks.replace_partitions(signals.replay(genomes, window, "equity"), path, "mode", "scanner")
    sinks.replace_partitions(signals.replay({"x": genomes["x"]}, window, "etf"), path, "mode", "scanner")
    held = {(r.scanner, r.strategy): r["count"] for r in spark.read.parquet(path).groupBy("scanner", "strategy").count().collect()}
    n = got.groupBy("strategy").count()
    counts = {r.strategy: r["count"] for r in n.collect()}
    assert held == {("etf", "x"): counts["x"], ("equity", "x"): counts["x"], ("equity", "y"): counts["y"]}
    scores = spark.createDataFrame([(1, 1, 0, 9.0), (1, 2, 1, 0.2), (2, 1, 2, 0.4)], "strategy_id int, evaluated_at int, score_id int, expectancy double")
    row = signals.against_out_of_sample(got, scores).first()
    assert row.out_of_sample == pytest.approx(0.3) and row.gap == pytest.approx(row.in_sample - 0.3)


def test_a_drawdown_of_just_the_limit_disables(spark):
    path = [-0.4, -0.4, -0.4, -0.8, -0.4, -0.4, -0.4, -1.2, -0.8, -0.8]  # -6 exactly; one after another, doubles give -5.999999999999999
    rows = [(s, k, datetime(2001, 1, 1) + timedelta(k), r + (0.4 if s == 2 and k == 9 else 0.0)) for s in (1, 2) for k, r in enumerate(path)]
    got = monitor.drawdown(spark.createDataFrame(rows, "strategy_id long, trade_id long, entry_ts timestamp, pnl_r double")).collect()
    assert [(r.strategy_id, round(r.metric, 6), r.threshold) for r in got] == [(1, -6.0, -6.0)]


def test_ingest_makes_its_rows_once(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    bars = tables.bars
    monkeypatch.setattr(tables, "bars", lambda spark, sf: bars(spark, sf).mapInArrow(counted, bars(spark, sf).schema))
    got = {r.dataset: (r.written, r.stored) for r in nightly.ingest(spark, "/root/testdata/sf0.001", str(tmp_path)).collect()}
    n = bars(spark, "/root/testdata/sf0.001").count()
    assert got["bars"] == (n, n) and made.value == n


@pytest.fixture(scope="module")
def night(spark, tmp_path_factory):
    """The steps of a night by name, after its ingest."""
    path = str(tmp_path_factory.mktemp("night"))
    steps = {s.name: s for s in nightly.steps(spark, "/root/testdata/sf0.001", path)}
    own = {}
    for name in ("ingest", "scan", "features"):
        steps[name].run(own).write.parquet(f"{path}/{name}")
        own[name] = spark.read.parquet(f"{path}/{name}")
    return steps, own, path


def _population(spark, *rows):
    """Strategies ``id, status`` that fire at any bar with a volume."""
    own = [(i, f"g{i}", 1, [("trigger__vol", "gt", 0.0)], "atr", 1.0, 2.0, datetime(2001, 1, 1), 50, 0.4, 0.9, 0.1, 3, 0.8, status) for i, status in rows]
    return spark.createDataFrame(own, nightly.STRATEGIES)


def test_each_step_of_the_night_works_on_those_before(spark, night):
    steps, own, path = night
    assert all(set(s.after) <= set(steps) for s in steps.values())
    scan = own["scan"]
    assert scan.count() == tables.funds(spark, "/root/testdata/sf0.001").count() > 0
    one = scan.withColumn("passed", F.col("symbol") % 10 == 3)
    assert {r.ticker for r in steps["features"].run(own | {"scan": one}).select("ticker").distinct().collect()} == {3}
    window = own["features"]
    labels = window.select("ticker", "ts", F.lit("risk_on").alias("label"))
    strategies = _population(spark, (-1, "promoted"), (-2, "candidate"))
    given = {r.strategy_id: r for r in steps["signals"].run(own | {"search": strategies, "regime": labels}).where("found").groupBy("strategy_id").agg(F.collect_set("skip_reason").alias("why"), F.count_if(F.col("skip_reason").isNull()).alias("n")).collect()}
    assert given[-1].n > 0 and "not_promoted" not in given[-1].why and given[-2].why == ["not_promoted"] and given[-2].n == 0
    out = steps["signals"].run(own | {"search": strategies, "regime": labels.withColumn("label", F.lit("out_of_distribution"))}).where("found AND strategy_id = -1")
    assert {r.skip_reason for r in out.collect()} == {"regime"}


def test_the_search_promotes_by_the_regimes_of_the_night(spark, night, monkeypatch):
    steps, own, _ = night
    rows = []
    for t in range(2):
        px = 100.0
        for i in range(400):  # it rises by a percent from every other bar on, falls back in two
            px *= 1.04 if i % 4 == 0 else 1.02 if i % 4 == 1 else 0.98
            rows.append((t, i + 1, datetime(2000, 1, 1) + timedelta(i), px * 1.001, px * 0.999, px, 0.5, float(i % 4 == 3), ["risk_on", "risk_off"][i // 200]))
    spark_rows = spark.createDataFrame(rows, "ticker bigint, idx int, ts timestamp_ntz, high double, low double, close double, atr double, trigger__vol double, label string")
    genome = search.Genome((("trigger__vol", "gt", 0.5),))
    monkeypatch.setattr(search, "evolve", lambda *a, registry, **k: registry.add([genome]) and [(genome, 1.0, 0.9)])
    monkeypatch.setattr(nightly.validation, "overfit", lambda *a: 0.1)
    before = own | {"features": spark_rows.drop("label"), "regime": spark_rows.select("ticker", "ts", "label")}
    got = steps["search"].run(before).where(F.col("signature") == genome.signature).first()
    assert (got.status, got.n_regimes, got.strategy_id) == ("promoted", 2, -1) and got.precision_oos == 1.0
    odd = before | {"regime": before["regime"].withColumn("label", F.lit("out_of_distribution"))}
    got = steps["search"].run(odd).where(F.col("signature") == genome.signature).first()
    assert (got.status, got.n_regimes) == ("candidate", 0)


def test_what_is_given_is_traded_and_what_is_lost_is_condemned(spark, night):
    steps, own, path = night
    days = [r.ts for r in tables.bars(spark, "/root/testdata/sf0.001").where("ticker = 0").orderBy("ts").limit(30).collect()][20:]
    names = "signal_id bigint, strategy_id bigint, found boolean, ticker bigint, created_at timestamp_ntz, side int, skip_reason string, conviction double"
    given = spark.createDataFrame([(-1, -1, True, 0, days[0], 1, None, 0.5), (-2, -1, True, 0, days[1], 1, "regime", 0.5), (7, 3, False, 0, days[2], 1, None, 0.5), (8, 3, False, 0, days[2], 1, "no_atr", 0.5)], names)
    trades = steps["journal"].run(own | {"signals": given})
    assert {(r.signal_id, r.strategy_id) for r in trades.collect()} == {(-1, -1), (7, 3)}
    assert {r.signal_id for r in steps["journal"].run(own | {"signals": given.where("found IS NULL")}).collect()} == {-1}  # of an earlier night
    promoted = _population(spark, (-9, "promoted"))
    sinks.KeyedTable(spark, f"{path}/store/strategies", nightly.STRATEGIES, ["strategy_id"], buckets=1).upsert(promoted)
    late = own["ingest"].where("dataset = 'bars'").first().latest
    lost = spark.range(12).selectExpr("-100 - id AS signal_id", "-9L AS strategy_id", f"CAST('{late}' AS TIMESTAMP_NTZ) AS entry_ts", "-1.5D AS pnl_r")
    before = own | {"search": promoted, "regime": own["features"].select("ticker", "ts", F.lit("risk_on").alias("label")), "journal": lost}
    events = steps["monitor"].run(before).where("strategy_id = -9")
    assert ("drawdown", "disable") in {(r.detector, r.action) for r in events.collect()}
    assert steps["monitor"].run(before | {"journal": lost.where("false")}).where("strategy_id = -9").isEmpty()
    weeks = steps["changelog"].run(before | {"monitor": events}).collect()
    assert [r.retired for r in weeks] == [["-9"]]
    held = sinks.KeyedTable(spark, f"{path}/store/strategies", nightly.STRATEGIES, ["strategy_id"], buckets=1).read().where("strategy_id = -9").first()
    assert held.status == "disabled"


def test_an_open_trade_is_closed_by_the_journal(spark):
    t = datetime(2001, 1, 1)
    trades = spark.createDataFrame([(1, 10, 5, "paper", t, None), (2, 11, 5, "paper", t, 0.4), (3, 12, 5, "live", t, None)], "trade_id long, signal_id long, strategy_id long, mode string, entry_ts timestamp, pnl_r double")
    journal = spark.createDataFrame([(10, 6, t, -1.0), (11, 6, t, -1.0), (12, 6, t, -1.0), (13, 6, t, 2.0)], "signal_id long, strategy_id long, entry_ts timestamp, pnl_r double")
    got = {r.signal_id: (r.strategy_id, r.mode, r.pnl_r) for r in nightly.closed(trades, journal).collect()}
    assert got == {10: (5, "paper", -1.0), 11: (5, "paper", 0.4), 12: (5, "live", None), 13: (6, "paper", 2.0)}
