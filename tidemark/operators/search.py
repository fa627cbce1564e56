"""Genetic search over rule genomes. The loop, over a few dozen genomes, is on the driver; each generation is one Spark job.

A genome is a side, a risk (a stop and targets), and predicates ``(feature, op, threshold)`` whose thresholds are
quantiles seen in the data. Genomes are ranked by out-of-sample results alone.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import labeling, metrics
from tidemark.operators.sinks import KeyedTable

OPS = ("gt", "lt")
#: The share of random genomes that are made able to trade.
BIAS = 0.6
MIN_ROWS, MAX_PREDICATES, MIN_ENTRIES = 30, 4, 40
#: Quantiles of each feature that thresholds are taken from.
QUANTILES = [0.2 + 0.05 * i for i in range(13)]
#: Ideas that seed a population (fixed values): side, and for each feature the comparison and the quantile of its threshold.
ARCHETYPES = {
    "trend_follow_long": (1, [("regime__adx", "gt", 0.65), ("location__dist_50dma", "gt", 0.60), ("trigger__momentum_roc", "gt", 0.60)]),
    "rs_breakout_long": (1, [("regime__adx", "gt", 0.55), ("trigger__rs_vs_spy", "gt", 0.70), ("location__pct_range_position", "gt", 0.70)]),
    "mean_revert_long": (1, [("trigger__rsi14", "lt", 0.25), ("location__dist_200dma", "gt", 0.45), ("regime__adx", "lt", 0.50)]),
    "vwap_reclaim_long": (1, [("location__anchored_vwap_dist", "lt", 0.30), ("trigger__rsi14", "lt", 0.35), ("regime__rv_percentile", "lt", 0.60)]),
    "trend_follow_short": (-1, [("regime__adx", "gt", 0.65), ("location__dist_50dma", "lt", 0.40), ("trigger__momentum_roc", "lt", 0.40)]),
    "rs_breakdown_short": (-1, [("regime__adx", "gt", 0.55), ("trigger__rs_vs_spy", "lt", 0.30), ("location__pct_range_position", "lt", 0.30)]),
    "mean_revert_short": (-1, [("trigger__rsi14", "gt", 0.75), ("location__dist_200dma", "gt", 0.70), ("regime__adx", "lt", 0.50)]),
}
#: Stops in ATRs and targets in multiples of the risk that the search tries, and the farthest second target (fixed values).
STOPS, TARGETS, FARTHEST = (0.5, 0.75, 1.0, 1.5, 2.0), (1.5, 2.0, 2.5, 3.0), 5.0


@dataclass(frozen=True)
class Risk:
    """A stop (``atr`` multiples, ``fixed`` amounts or ``pct`` of the price) and targets in multiples of its distance."""

    kind: str = "atr"
    stop: float = 1.0
    target: float = 2.0
    second: float | None = None


@dataclass(frozen=True)
class RiskSpace:
    """Where risks are drawn from. The operator's own stop stays of its kind when sampled; ``locked``: nothing but the operator's risk."""

    operator: Risk = Risk()
    locked: bool = False

    def sample(self, rng: random.Random) -> Risk:
        if self.locked:
            return self.operator
        return self._aimed(replace(self.operator, stop=self._stop(self.operator, rng), second=0.0), rng)

    def mutate(self, risk: Risk, rng: random.Random) -> Risk:
        """One change: the size of the stop, the targets, or the kind of the stop."""
        if self.locked:
            return risk
        change = rng.choice(("stop", "target", "kind"))
        if change == "stop":
            return replace(risk, stop=self._stop(risk, rng))
        if change == "target":
            return self._aimed(risk, rng)
        kind = rng.choice(("atr", "pct", "fixed") if risk.kind == "atr" else (risk.kind, "atr", "atr"))
        if kind == risk.kind:
            return replace(risk, stop=self._stop(risk, rng))
        size = {"atr": lambda: rng.choice(STOPS), "pct": lambda: rng.uniform(1, 3), "fixed": lambda: rng.uniform(2, 8)}[kind]()
        return replace(risk, kind=kind, stop=size)

    def cross(self, a: Risk, b: Risk, rng: random.Random) -> Risk:
        if self.locked:
            return a
        stop, near, far = (rng.choice((a, b)) for _ in range(3))
        return Risk(stop.kind, stop.stop, near.target, far.second)

    @staticmethod
    def _stop(risk: Risk, rng: random.Random) -> float:
        return rng.choice(STOPS) if risk.kind == "atr" else max(1e-6, abs(risk.stop) * rng.uniform(0.75, 1.25))

    @staticmethod
    def _aimed(risk: Risk, rng: random.Random) -> Risk:
        target = rng.choice(TARGETS)
        return replace(risk, target=target, second=None if risk.second is None else min(target + 1, FARTHEST))


@dataclass(frozen=True)
class Genome:
    predicates: tuple[tuple[str, str, float], ...]
    side: int = 1
    risk: Risk = Risk()

    @property
    def signature(self) -> str:
        """The same for any order of the predicates."""
        body = "&".join(sorted(f"{k}:{op}:{round(t, 4) + 0.0:.4f}" for k, op, t in self.predicates))
        r = self.risk
        return f"{self.side}|{r.kind}:{r.stop:.4g}|{r.target:g}:{r.second or 0:g}|{body}"

    @property
    def actionable(self) -> bool:
        return any(k.split("__")[0] in ("trigger", "location") for k, _, _ in self.predicates)


def catalog(window: DataFrame) -> dict[str, list[float]]:
    """QUANTILES of each feature with enough values that vary, exactly: by counts of values, then of ranges of them; a few numbers a feature reach the driver."""
    names = [c for c in window.columns if "__" in c]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")
    rows = metrics.nearest_ranks(window.select(each).select("x.*"), "feature", "value", QUANTILES).where(F.col("n") >= MIN_ROWS).collect() if names else []
    cat = {r.feature: [r[f"q{round(q * 100)}"] for q in QUANTILES] for r in rows}
    return {c: q for c, q in sorted(cat.items()) if len(set(q)) > 1}


def random_genome(cat: dict[str, list[float]], rng: random.Random, space: RiskSpace = RiskSpace()) -> Genome:
    names = rng.sample(sorted(cat), k=min(len(cat), rng.randint(1, 3)))
    return Genome(tuple((n, rng.choice(OPS), rng.choice(cat[n])) for n in names), rng.choice((1, -1)), space.sample(rng))


def archetypes(cat: dict[str, list[float]], risk: Risk = Risk()) -> list[Genome]:
    """The ideas whose features are all there, bound to the quantiles seen."""
    at = lambda name, q: cat[name][round((q - QUANTILES[0]) / 0.05)]
    return [Genome(tuple((k, op, at(k, q)) for k, op, q in idea), side, risk) for side, idea in ARCHETYPES.values() if all(k in cat for k, _, _ in idea)]


def seed_population(cat: dict[str, list[float]], n: int, rng: random.Random, space: RiskSpace = RiskSpace()) -> list[Genome]:
    """The archetypes, then genomes at random; of these a share of BIAS has a feature of the trigger or location layers."""
    own = archetypes(cat, space.operator)
    ready = [c for c in sorted(cat) if c.split("__")[0] in ("trigger", "location")]
    for _ in range(50 * n):
        if not cat or len(distinct(own)) >= n:
            break
        g = random_genome(cat, rng, space)
        if ready and not g.actionable and rng.random() < BIAS:
            name = rng.choice(ready)
            g = replace(g, predicates=((name, rng.choice(OPS), rng.choice(cat[name])), *g.predicates[1:]))
        own.append(g)
    return distinct(own)[:n]


def distinct(genomes: Sequence[Genome]) -> list[Genome]:
    return list({g.signature: g for g in genomes}.values())


def mutate(g: Genome, cat: dict[str, list[float]], rng: random.Random, space: RiskSpace = RiskSpace()) -> Genome:
    """One change: add, drop or replace a predicate, move its threshold, turn its comparison, or change side or risk."""
    preds = list(g.predicates)
    kind = rng.choice(["add", "drop", "swap", "threshold", "op", "side", "risk", "risk"])
    i = rng.randrange(len(preds))
    name, op, _ = preds[i]
    if kind == "add" and len(preds) < MAX_PREDICATES:
        return replace(g, predicates=(*preds, random_genome(cat, rng).predicates[0]))
    if kind == "drop" and len(preds) > 1:
        return replace(g, predicates=tuple(preds[:i] + preds[i + 1 :]))
    if kind == "side":
        return replace(g, side=-g.side)
    if kind == "risk" and not space.locked:
        return replace(g, risk=space.mutate(g.risk, rng))
    preds[i] = {"threshold": (name, op, rng.choice(cat[name])), "op": (name, "lt" if op == "gt" else "gt", preds[i][2])}.get(kind, random_genome(cat, rng).predicates[0])
    return replace(g, predicates=tuple(preds))


def cross(a: Genome, b: Genome, rng: random.Random, space: RiskSpace = RiskSpace()) -> Genome:
    i, j = rng.randint(1, len(a.predicates)), rng.randint(0, len(b.predicates))
    return Genome((a.predicates[:i] + b.predicates[j:])[:MAX_PREDICATES], a.side, space.cross(a.risk, b.risk, rng))


def labelled(genomes: Sequence[Genome], window: DataFrame, profile: labeling.Profile = labeling.SWING, least: int = 0) -> DataFrame:
    """The labelled entries of every genome (``genome``: its place) over all tickers: one job. Those of genomes with under ``least`` entries are not labelled.

    Each bar is tested against all genomes in one pass (an array of flags, exploded where set), so the window is read once.
    """
    own = list(enumerate(genomes))
    flags = F.filter(F.array(*[F.when(labeling.fires(g.predicates), F.lit(i)) for i, g in own]), lambda x: x.isNotNull())
    last = window.groupBy("ticker").agg(F.max("idx").alias("last"))
    fired = window.join(last, "ticker").where((F.col("atr") > 0) & (F.col("idx") < F.col("last"))).select("ticker", "idx", F.explode(flags).alias("genome"))
    taken = labeling.greedy_cooldown(fired, ["genome", "ticker"], max(profile.min_hold, 1))
    if least:
        taken = taken.join(taken.groupBy("genome").count().where(F.col("count") >= least).select("genome"), "genome")
    pick = lambda f: F.element_at(F.array(*[F.lit(f(g)) for _, g in own]), F.col("genome") + 1)
    stop = labeling.distance(pick(lambda g: g.risk.kind), pick(lambda g: g.risk.stop), F.col("entry_px"), F.col("atr"))
    entries = taken.join(window.select("ticker", "idx", F.col("close").alias("entry_px"), "atr"), ["ticker", "idx"]).select(
        "genome", "ticker", "idx", "entry_px", pick(lambda g: g.side).alias("side"), (pick(lambda g: g.risk.target) * stop).alias("target_dist"), stop.alias("stop_dist")
    )
    return labeling.triple_barrier(entries, window, profile.max_hold).where("ret_r IS NOT NULL")


def measured(genomes: Sequence[Genome], window: DataFrame, profile: labeling.Profile = labeling.SWING) -> DataFrame:
    """``genome, n, mean, sd, skew, kurtosis`` of every genome's entries. Genomes with under MIN_ENTRIES have no row."""
    labels = labelled(genomes, window, profile, MIN_ENTRIES)
    return metrics.moments(labels.withColumn("net_r", F.col("ret_r") - metrics.COST_R), ["genome"], "net_r")


def evaluate(genomes: Sequence[Genome], window: DataFrame, profile: labeling.Profile = labeling.SWING, trials: int = 0) -> DataFrame:
    """``measured`` with ``dsr``, deflated for the larger of ``trials`` (all genomes tried so far) and these, 2 at least."""
    return metrics.deflated_sharpe(measured(genomes, window, profile), max(2, trials, len(genomes)))


class Registry:
    """Every genome that was ever tried, by its signature: an id that stays its own, and how many there are, over all searches.

    Without a table it lasts as long as the object. With one (a keyed table of ``signature, id, run``) later searches go on from it: what was tried
    before is counted again in no one's favour.
    """

    SCHEMA = "signature string, id int, run string"

    def __init__(self, table: KeyedTable | None = None, run: str = ""):
        self.table, self.run = table, run
        self.ids: dict[str, int] = {r.signature: r.id for r in table.read().collect()} if table else {}  # genomes, not data

    @classmethod
    def at(cls, spark: SparkSession, path: str, run: str = "") -> Registry:
        return cls(KeyedTable(spark, path, cls.SCHEMA, ["signature"], buckets=1), run)

    @property
    def trials(self) -> int:
        return len(self.ids)

    def add(self, genomes: Sequence[Genome]) -> list[int]:
        """Their ids; those of new ones go on from the last."""
        new = [g.signature for g in distinct(genomes) if g.signature not in self.ids]
        self.ids |= {s: len(self.ids) + i for i, s in enumerate(new)}
        if new and self.table:
            self.table.insert(self.table.spark.createDataFrame([(s, self.ids[s], self.run) for s in new], self.SCHEMA))
        return [self.ids[g.signature] for g in genomes]


def evolve(
    window: DataFrame, generations: int = 2, size: int = 12, seed: int = 7, space: RiskSpace = RiskSpace(), registry: Registry | None = None
) -> list[tuple[Genome, float, float]]:
    """The best genomes with expectancy and DSR. Elites stay, the rest are mutations and crossovers, none is scored twice.

    Every DSR is deflated for all genomes that the registry has seen when the search ends, so those of early and late generations can be ranked together.
    """
    registry = registry or Registry()
    rng, cat = random.Random(seed), catalog(window)
    pool, scored = seed_population(cat, size, rng, space), {}
    rank: list[tuple[Genome, float, float]] = []
    for _ in range(generations):
        fresh = [g for g in pool if g.signature not in scored]
        if fresh:
            registry.add(fresh)
            rows = {r.genome: r for r in measured(fresh, window).collect()}  # one row a genome
            scored |= {g.signature: (g, rows.get(i)) for i, g in enumerate(fresh)}
            rank = _ranked(window.sparkSession, scored, registry.trials)
        elite = [x[0] for x in rank[: max(2, size // 4)]] or pool[:2]
        if not elite:  # no feature varies
            break
        pool = list(elite)
        for _ in range(20 * size):
            if len(distinct(pool)) >= size:
                break
            pool.append(mutate(rng.choice(elite), cat, rng, space) if rng.random() < 0.6 else cross(rng.choice(elite), rng.choice(elite), rng, space))
        pool = distinct(pool)[:size]
    return rank


def _ranked(spark: SparkSession, scored: dict, trials: int) -> list[tuple[Genome, float, float]]:
    """The genomes with enough results, best first."""
    own = [(s, int(r.n), r.mean, r.sd, r.skew, r.kurtosis) for s, (_, r) in scored.items() if r and r.n >= MIN_ENTRIES]
    stats = spark.createDataFrame(own, "signature string, n int, mean double, sd double, skew double, kurtosis double")
    found = [(scored[r.signature][0], r.mean, r.dsr) for r in metrics.deflated_sharpe(stats, max(2, trials)).collect()]
    return sorted(found, key=lambda x: (-x[1], -(x[2] or 0), x[0].signature))


def select_survivors(evaluated: DataFrame) -> DataFrame:
    """``evaluated`` (``status`` and the gate's ``passed, survivor``; all null where a genome was not scored) with the ``status`` it gets and whether
    its genome is carried into the next generation: promoted if it passes, kept as it is if it survives, retired if it was scored and does neither."""
    passed, survivor = F.coalesce("passed", F.lit(False)), F.coalesce("survivor", F.lit(False))
    status = F.when(passed, "promoted").when(F.col("survivor").isNotNull() & ~survivor, "retired").otherwise(F.col("status"))
    return evaluated.withColumns({"status": status, "carried": passed | survivor})
