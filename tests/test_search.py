"""The search's registry: ids that stay, trials that add up, and what both do to the deflation."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import metrics, search


@pytest.fixture(scope="module")
def window(spark, tmp_path_factory):
    rnd, rows = random.Random(1), []
    for t in range(4):
        px = 100.0
        for i in range(400):
            px *= 1 + rnd.gauss(0.0005, 0.01)
            rows.append((t, i + 1, datetime(2020, 1, 1) + timedelta(i), px * 1.01, px * 0.99, px, 1.5, rnd.random(), rnd.random(), 1.0 if i % 50 == 0 else 0.0))
    path = str(tmp_path_factory.mktemp("w"))
    schema = "ticker int, idx int, ts timestamp, high double, low double, close double, atr double, trigger__a double, location__b double, trigger__rare double"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_quantiles_are_exact(window):
    cat = search.catalog(window)
    for name in ("trigger__a", "location__b"):
        values = sorted(r[0] for r in window.select(name).collect())
        assert cat[name] == [values[round(q * (len(values) - 1))] for q in search.QUANTILES]
    assert "trigger__rare" not in cat  # its quantiles don't vary


def test_registry_goes_on_between_runs(spark, window, tmp_path):
    first = search.Registry.at(spark, str(tmp_path / "r"), "monday")
    short = search.evolve(window, 1, 6, seed=1, registry=first)
    again = search.Registry.at(spark, str(tmp_path / "r"), "tuesday")
    assert again.ids == first.ids and again.trials == first.trials >= 6
    long = search.evolve(window, 3, 6, seed=1, registry=again)
    assert again.trials > first.trials and {s: again.ids[s] for s in first.ids} == first.ids
    assert sorted(again.ids.values()) == list(range(again.trials))
    dsr = {g.signature: d for g, _, d in short}
    met = [(dsr[g.signature], d) for g, _, d in long if g.signature in dsr]
    assert met and all(b <= a for a, b in met) and any(b < a for a, b in met)  # a longer search makes the same genome less sure


def test_all_generations_are_deflated_alike(spark, window):
    registry = search.Registry()
    rank = search.evolve(window, 2, 5, seed=3, registry=registry)
    for g, mean, dsr in rank:
        r = metrics.deflated_sharpe(search.measured([g], window), registry.trials).first()
        assert (mean, dsr) == (pytest.approx(r["mean"]), pytest.approx(r.dsr))


def test_few_entries_are_not_labelled(window):
    rare = search.Genome((("trigger__rare", "gt", 0.5),))
    often = search.Genome((("trigger__a", "gt", 0.5),))
    got = search.measured([rare, often], window).collect()
    assert [r.genome for r in got] == [1] and got[0].n >= search.MIN_ENTRIES
