"""Boosted trees over rows that no task holds: histograms are summed over executors, a level of all trees of all fits at a time.

Rows are blocks of bytes (the bin of each value), cut at quantiles that are found by counting. One job sums, for every fit and every node of its tree's frontier, the slopes by feature and
bin; the driver sees these sums alone (as many as there are bins, whatever the rows) and splits. Margins are written with the blocks every ROUNDS trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import nearest_ranks
from tidemark.operators.trees import BINS, Boosted, Growing, coded, histograms, slopes, start
from tidemark.storage import Scratch, scratch

#: Trees between two writes of the margins.
ROUNDS = 10
_BLOCK = "by int, n int, codes binary, y binary, w binary, margins binary"


def fit_all(train: DataFrame, by: str, features: Sequence[str], settings: Mapping[int, dict], trees: int) -> dict[tuple[int, int], tuple[list[str], Boosted | float]]:
    """A model of each of ``settings`` (``depth, rate, features``, by number) for the rows of each value of ``by``, by ``(number, value)``; what ``trees.fit`` gives on
    them, of all rows whatever their number. Of under ten rows, or of one class, their share of wins.

    ``train``: ``by, r, weight`` and ``features``.
    """
    names = list(features)
    with scratch(train.sparkSession) as tables:
        own = tables.written(train.select(F.col(by).cast("int").alias("by"), (F.col("r") > 0).cast("double").alias("y"), F.col("weight").cast("double").alias("w"), *[F.col(f).cast("double").alias(f) for f in names]), "train")
        sums = own.groupBy("by").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"))
        totals = {r.by: r for r in sums.collect()}  # one row a value
        flat = {b: r.mean for b, r in totals.items() if r.n < 10 or r.lo == r.hi}
        out: dict = {(s, b): (names, float(mean)) for b, mean in flat.items() for s in settings}
        base = {b: start(r.wy, r.w) for b, r in totals.items() if b not in flat}
        if not base:
            return out
        cuts = _cuts(own, names)
        rows = own.where(F.col("by").isin(list(base)))
        models = _grow(rows, names, {b: cuts[b] for b in base}, base, settings, trees)
        return out | {key: (names, model) for key, model in models.items()}


def _cuts(rows: DataFrame, names: list[str]) -> dict[int, list[list[float]]]:
    """For each value of ``by`` and feature the values at ranks an even grid apart, each once: what ``trees.cuts_of`` finds in memory."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(c).alias("v")) for j, c in enumerate(names)])).alias("x")
    keyed = rows.select("by", each).select(F.concat_ws("|", "by", "x.f").alias("key"), F.when(~F.isnan("x.v") & (F.abs("x.v") < float("inf")), F.col("x.v")).alias("v"))
    grid = [k / BINS for k in range(1, BINS)]
    out: dict = {}
    for r in nearest_ranks(keyed, "key", "v", grid).collect():  # a row a value and feature
        b, j = map(int, r.key.split("|"))
        out.setdefault(b, {})[j] = sorted({r[f"q{round(q * 100)}"] for q in grid})
    values = [r.by for r in rows.select("by").distinct().collect()]
    return {b: [out.get(b, {}).get(j, []) for j in range(len(names))] for b in values}


def _packed(rows: DataFrame, names: list[str], cuts: dict, base: dict[int, float], n_settings: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, own in pdf.groupby("by"):
                codes = coded(own[names].to_numpy(dtype=float), cuts[b])
                margins = np.full((n_settings, len(own)), base[b])
                yield pd.DataFrame({"by": [b], "n": len(own), "codes": [codes.tobytes()], "y": [own["y"].to_numpy().tobytes()], "w": [own["w"].to_numpy().tobytes()], "margins": [margins.tobytes()]})

    return rows.mapInPandas(run, _BLOCK)


def _grow(rows: DataFrame, names: list[str], cuts: dict, base: dict[int, float], settings: Mapping[int, dict], trees: int) -> dict[tuple[int, int], Boosted]:
    spark, order = rows.sparkSession, list(settings)
    held = Scratch(spark)
    blocks = held.written(_packed(rows, names, cuts, base, len(order)), "blocks")
    models = {(s, b): Boosted([], base[b], settings[s]["rate"]) for s in order for b in base}
    recent: dict[tuple[int, int], list[Growing]] = {key: [] for key in models}
    try:
        for t in range(trees):
            growing = {(s, b): Growing(cuts[b], [names.index(f) for f in settings[s]["features"]], settings[s]["depth"]) for s, b in models}
            active = dict(growing)
            while active:
                found = _summed(blocks, len(names), order, settings, recent, active)
                active = {key: g for key, g in active.items() if g.grow(*found[key])}
            for key, g in growing.items():
                models[key].trees.append(g.tree)
                recent[key].append(g)
            if (t + 1) % ROUNDS == 0 and t + 1 < trees:
                later = Scratch(spark)
                blocks = later.written(_moved(blocks, len(names), order, settings, recent), "blocks")
                held.drop()
                held, recent = later, {key: [] for key in models}
        return models
    finally:
        held.drop()


def _read(row, n_features: int, n_settings: int) -> tuple[np.ndarray, ...]:
    return (
        np.frombuffer(row.codes, np.uint8).reshape(row.n, n_features),
        np.frombuffer(row.y),
        np.frombuffer(row.w),
        np.frombuffer(row.margins).reshape(n_settings, row.n),
    )


def _margin(margins: np.ndarray, i: int, codes: np.ndarray, rate: float, trees: list[Growing]) -> np.ndarray:
    out = margins[i]
    for g in trees:
        out = out + rate * np.array(g.tree.value)[g.leaves(codes)]
    return out


def _summed(blocks: DataFrame, n_features: int, order: list[int], settings: Mapping[int, dict], recent: dict, active: dict[tuple[int, int], Growing]) -> dict[tuple[int, int], np.ndarray]:
    """For each growing tree the sums of slopes, curvatures and weights by node, feature and bin: one job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for row in pdf.itertuples():
                codes, y, w, margins = _read(row, n_features, len(order))
                for i, s in enumerate(order):
                    g = active.get((s, row.by))
                    if g:
                        a, h = slopes(y, w, _margin(margins, i, codes, settings[s]["rate"], recent[s, row.by]))
                        made = histograms(codes, g.route(codes), g.n_nodes, (a, h, w))
                        total[s, row.by] = total.get((s, row.by), 0) + made
        for (s, b), sums in total.items():
            flat = sums.reshape(3, -1)
            at = np.flatnonzero(flat.any(axis=0))
            yield pd.DataFrame({"s": s, "by": b, "at": at, "g": flat[0, at], "h": flat[1, at], "c": flat[2, at]})

    rows = blocks.mapInPandas(run, "s int, by int, at int, g double, h double, c double").groupBy("s", "by", "at").agg(*[F.sum(x).alias(x) for x in "ghc"]).toPandas()  # a row a bin
    out = {key: np.zeros((3, g.n_nodes * n_features * (BINS + 2))) for key, g in active.items()}
    for (s, b), own in rows.groupby(["s", "by"]):
        out[s, b][:, own["at"].to_numpy()] = own[["g", "h", "c"]].to_numpy().T
    return {key: x.reshape(3, active[key].n_nodes, n_features, BINS + 2) for key, x in out.items()}


def _moved(blocks: DataFrame, n_features: int, order: list[int], settings: Mapping[int, dict], recent: dict) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, row in enumerate(pdf.itertuples()):
                codes, _, _, margins = _read(row, n_features, len(order))
                new = np.stack([_margin(margins, i, codes, settings[s]["rate"], recent[s, row.by]) for i, s in enumerate(order)])
                yield pdf.iloc[[k]].assign(margins=[new.tobytes()])

    return blocks.mapInPandas(run, _BLOCK)
