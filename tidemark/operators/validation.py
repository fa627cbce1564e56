"""Validation of a labelled dataset: trials under purged cross-validation, the promotion gate, and the leak checkpoint.

Rows are ``pos`` (from 0 in order of time), ``ts, t1, r, weight, regime`` and features. Only single numbers reach the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import crossval, labeling, learners, metrics
from tidemark.storage import Scratch, scratch

#: Rows that a regime needs to count, and the share of the timeline that the forward holdout learns from.
MIN_REGIME_ROWS, FORWARD_SHARE = 20, 0.7


@dataclass(frozen=True)
class Plan:
    n_groups: int = 6
    k_test: int = 2
    embargo: int = 3
    n_trials: int = 16
    #: Genomes tried so far: the deflation counts the larger of this and the trials.
    search_trials: int = 1
    trees: int = 120
    seed: int = 7


@dataclass(frozen=True)
class Validation:
    dsr: float
    pbo: float
    expectancy: float
    profit_factor: float | None
    cvar: float | None
    n_regimes: int
    tau: float
    n_acted: int
    precision_oos: float
    recall_oos: float
    precision_forward: float
    expectancy_forward: float
    n_forward: int


def validate(rows: DataFrame, features: Sequence[str], plan: Plan = Plan(), boundary=None) -> Validation:
    """The trial that is best in-sample, judged out of sample where its path-averaged predictions act at a threshold chosen in-sample.

    Without an act the rows that the trial trades count, and without those all rows out of sample. Rows without a return are left out; none at all
    is an error.
    """
    with scratch(rows.sparkSession) as tables:
        return _validate(tables, tables.written(rows.where("r IS NOT NULL"), "rows"), features, plan, boundary)


def _validate(tables: Scratch, rows: DataFrame, features: Sequence[str], plan: Plan, boundary) -> Validation:
    # Every table that later steps read more than once is written: plans stay short, and each number costs one scan.
    splits = tables.written(crossval.splits(rows.select("pos", "ts", "t1"), plan.n_groups, plan.k_test, plan.embargo).select("split", "pos", "role"), "splits")
    trials = learners.trial_grid(plan.n_trials, features, plan.seed)
    predicted = tables.written(learners.oos_predictions(rows, splits, trials, features, plan.trees), "predicted")
    parts = tables.written(crossval.calendar_split(rows.select("pos", "ts")).select("pos", "part"), "parts")
    last = predicted.groupBy("trial", "pos").agg(F.max_by("p", "split").alias("p"))
    returns = tables.written(crossval.trial_returns(last.join(rows.select("pos", "r"), "pos").withColumn("t", F.col("pos"))), "returns")
    ranked = returns.join(parts.where("part = 'is'").select(F.col("pos").alias("t")), "t").groupBy("trial").agg(F.avg("ret").alias("m"))
    best = ranked.orderBy(F.desc("m"), "trial").first().trial
    judged = tables.written(crossval.oos_averaged(predicted.where(F.col("trial") == best)).join(rows, "pos").join(parts, "pos"), "judged")
    early, late = judged.where("part = 'is'"), judged.where("part = 'oos'")
    tau = metrics.select_tau(early.select("pos", "p", "r"))
    at = metrics.at_thresholds(late, rows.sparkSession.createDataFrame([(tau,)], "tau double")).first()
    acted = late.where(F.col("p") >= tau)
    if not at.n_acted:
        traded = late.join(returns.where((F.col("trial") == best) & (F.col("ret") != 0)).select(F.col("t").alias("pos")), "pos")
        acted = late if traded.isEmpty() else traded
    net = tables.written(acted.select("pos", "ts", "t1", "regime", "r", (F.col("r") - metrics.COST_R).alias("net"), F.lit(0).alias("all")), "net")
    weights = labeling.uniqueness(net.select(F.col("pos").alias("id"), "ts", "t1", "all"), ["all"])
    n_eff = weights.agg(labeling.effective_n(F.col("weight")).alias("n")).first().n
    stats = metrics.moments(net, ["all"], "net").withColumn("n_eff", F.lit(n_eff))
    dsr = metrics.deflated_sharpe(stats, max(1, plan.n_trials, plan.search_trials), "n_eff").first()
    if dsr is None:
        raise ValueError("no rows out of sample")
    money = net.agg(F.avg("net").alias("m"), metrics.profit_factor(F.col("net")).alias("pf")).first()
    cvar = metrics.tail_mean(net, ["all"], "net", 0.05, False).first()
    regimes = net.groupBy("regime").agg(F.avg("r").alias("m"), F.count("*").alias("n"))
    good = regimes.where((F.col("m") > 0) & (F.col("n") >= MIN_REGIME_ROWS) & F.col("regime").isNotNull()).count()
    chosen = next(t for t in trials if t["trial"] == best)
    forward = forward_holdout(rows, chosen, plan.trees, boundary)
    gap = overfit(returns, plan.n_trials)
    return Validation(float(dsr.dsr), gap, money.m, money.pf, cvar.cvar if cvar else None, good, tau, at.n_acted, at.precision, at.recall, *forward)


def overfit(returns: DataFrame, n_trials: int) -> float:
    """The probability of overfit by CSCV over an even number of blocks, 16 at most; of a single trial, or of too few rows, 1."""
    n = returns.select("t").distinct().count()
    if n_trials < 2 or n < 2:
        return 1.0
    found = metrics.overfit_probability(metrics.cscv(returns, max(2, min(16, n - n % 2)))).first().pbo
    return 1.0 if found is None else found


def forward_holdout(rows: DataFrame, trial: dict, trees: int = 120, boundary=None) -> tuple[float, float, int]:
    """Precision, expectancy and number of acts of a trial fitted on the rows before a time and judged from it on.

    The boundary is a time, or else the place at FORWARD_SHARE of the rows. The threshold comes from the early rows. Where a side is
    empty or nothing is acted on, zeros. It is reported and gates nothing.
    """
    n = rows.count()
    early = F.col("ts") < F.lit(boundary) if boundary is not None else F.col("pos") < int(FORWARD_SHARE * n)
    marked = rows.withColumn("early", early)
    n_early = marked.where("early").count()
    if not 0 < n_early < n:
        return 0.0, 0.0, 0
    both = F.explode(F.when(F.col("early"), F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("test"))))  # early rows are predicted too
    splits = marked.select(F.lit(0).alias("split"), "pos", both.alias("role"))
    with scratch(rows.sparkSession) as tables:
        p = learners.oos_predictions(rows, tables.written(splits, "splits"), [trial], trial["features"], trees).select("pos", "p")
        judged = tables.written(marked.select("pos", "r", "early").join(p, "pos"), "forward")
        tau = metrics.select_tau(judged.where("early").select("pos", "p", "r"))
        at = metrics.at_thresholds(judged.where("NOT early"), rows.sparkSession.createDataFrame([(tau,)], "tau double")).first()
    return (at.precision, at.expectancy, at.n_acted) if at.n_acted else (0.0, 0.0, 0)


def decide(rows: DataFrame, features: Sequence[str], plan: Plan = Plan(), boundary=None) -> DataFrame:
    """One row: the validation and the gate's ``passed, failures``."""
    found = validate(rows, features, plan, boundary)
    kinds = {"int": "int", "float": "double", "float | None": "double"}
    schema = ", ".join(f"{k} {kinds[t]}" for k, t in Validation.__annotations__.items())
    return metrics.gate(rows.sparkSession.createDataFrame([tuple(asdict(found).values())], schema)).drop("survivor")


def fail_closed(decision: Callable[[], DataFrame]) -> tuple[bool, str]:
    """Whether a dataset passed and why not; whatever goes wrong on the way is a rejection, never a pass.

    Data that can't be judged (``ValueError``) says what is wrong with it; anything else, a lost cluster too, is a crash, which is logged and named as one: it says nothing of the data.
    """
    try:
        row = decision().first()
        return bool(row.passed), row.failures
    except ValueError as e:
        return False, f"validation failed: {e}"
    except Exception as e:  # noqa: BLE001
        logging.getLogger(__name__).exception("validation crashed")
        return False, f"validation crashed: {type(e).__name__}: {e}"


def leak_checkpoint(leaky: DataFrame, genuine: DataFrame, features: tuple[Sequence[str], Sequence[str]], plan: Plan = Plan()) -> DataFrame:
    """``dataset, passed, failures, ok``: a planted leak must be rejected and a genuine edge must pass."""
    rows = []
    for name, data, columns, want in (("leaky", leaky, features[0], False), ("genuine", genuine, features[1], True)):
        passed, why = fail_closed(lambda d=data, c=columns: decide(d, c, plan))
        rows.append((name, passed, why, passed == want))
    return leaky.sparkSession.createDataFrame(rows, "dataset string, passed boolean, failures string, ok boolean")


def optimism_gap(scores: DataFrame) -> DataFrame:
    """``scores`` (``precision_oos, precision_test``) as one row ``mean_gap, n``: over strategies that have both; null without any."""
    gap = F.col("precision_oos") - F.col("precision_test")
    return scores.agg(F.avg(gap).alias("mean_gap"), F.count(gap).alias("n"))
