"""Performance and validation statistics as aggregates over rows; paths are windows in time order."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import norm_cdf
from tidemark.operators.ordered import positions

EULER_GAMMA = 0.5772156649015329
COST_R = 0.05


def tail_mean(rows: DataFrame, keys: Sequence[str], value: str, alpha: float, up: bool) -> DataFrame:
    """CVaR: the mean of the lowest ``alpha`` of each group, at least one value, the count rounded ``up`` or down."""
    w = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), (F.ceil if up else F.floor)(F.lit(alpha) * F.count(value).over(w)))
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"_k": k, "_r": F.row_number().over(w.orderBy(value))})
    return ranked.where("_r <= _k").groupBy(*keys).agg(F.avg(value).alias("cvar"))


def profit_factor(r: Column) -> Column:
    """Gains over losses; null without losses."""
    gain, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return F.when(loss > 0, gain / loss)


def summary(r: Column) -> list[Column]:
    """Count, expectancy, deviation, Sharpe, profit factor, hit rate and total; a breakeven is no win."""
    n, mean, sd = F.count(r), F.avg(r), F.stddev_samp(r)
    return [
        n.alias("n"), mean.alias("expectancy"), F.when(n >= 2, sd).alias("sd"), F.when((n >= 2) & (sd > 0), mean / F.when(sd > 0, sd)).alias("sharpe"),
        profit_factor(r).alias("profit_factor"), (F.count_if(r > 0) / F.when(n > 0, n)).alias("hit_rate"), F.sum(r).alias("total_r"),
    ]


def equity(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("equity", F.sum(value).over(w)).withColumn("peak", F.max("equity").over(w))


def drawdowns(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Both conventions: ``mdd`` (at least 0, the first equity is the first peak) and ``mdd_from_zero`` (at most 0, the first peak is 0)."""
    path = equity(rows.where(F.col(value).isNotNull()), keys, value, order)
    return path.groupBy(*keys).agg(
        F.max(F.col("peak") - F.col("equity")).alias("mdd"),
        F.min(F.col("equity") - F.greatest("peak", F.lit(0.0))).alias("mdd_from_zero"),
        F.sum(value).alias("total"),
    ).withColumn("mar", F.when(F.col("mdd") > 0, F.col("total") / F.col("mdd")))


def moments(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, and bias-corrected skew and (non-excess) kurtosis, from power sums about the mean."""
    w = Window.partitionBy(*keys)
    own = rows.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(w))
    p = own.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        *[F.avg(F.pow("_d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)],
    )
    n, g1, g2 = F.col("n"), F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2")) - 3
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when((n > 3) & (F.col("m2") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)
    return p.select(*keys, "n", "mean", "sd", skew.alias("skew"), kurt.alias("kurtosis"))


def expected_max_sharpe(n_trials: int, variance: float = 1.0) -> float:
    """The best Sharpe ratio that this many trials without skill would show."""
    if n_trials < 1 or variance < 0:
        raise ValueError("at least one trial and a variance that is not negative")
    if n_trials == 1:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER_GAMMA) * z(1 - 1 / n_trials) + EULER_GAMMA * z(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    spread = F.greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, F.lit(1e-12))
    return F.when(n < 2, 0.5).otherwise(norm_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(spread)))


def deflated_sharpe(stats: DataFrame, n_trials: int, effective_n: str | None = None) -> DataFrame:
    """``stats`` (from ``moments``) with ``dsr``: the chance that the true Sharpe ratio beats what selection alone gives.

    The variance of trials' Sharpe ratios is the estimator's own. Under two values: 0.5; without spread: 1 or 0.
    """
    sr, n = F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")), F.col("n").cast("double")
    length = F.when(F.col(effective_n) >= 2, F.col(effective_n)).otherwise(n) if effective_n else n
    bar = F.sqrt((1 + 0.5 * sr * sr) / n) * expected_max_sharpe(n_trials)
    psr = probabilistic_sharpe(sr, bar, length, F.coalesce("skew", F.lit(0.0)), F.coalesce("kurtosis", F.lit(3.0)))
    return stats.withColumn("dsr", F.when(n < 2, 0.5).when(F.col("sd") == 0, (F.col("mean") > 0).cast("double")).otherwise(psr))


def combos(spark: SparkSession, n: int, k: int) -> DataFrame:
    """``combo, part`` for every choice of ``k`` of ``n`` parts: a few numbers, made from n and k alone."""
    rows = [(c, p) for c, parts in enumerate(combinations(range(n), k)) for p in parts]
    return F.broadcast(spark.createDataFrame(rows, "combo int, part int"))


def cscv(returns: DataFrame, n_splits: int) -> DataFrame:
    """``returns`` (``t, trial, ret``) as one logit for each way to call half of the blocks in-sample.

    Rows meet the data once: each block and trial gives count, sum and sum of squares, and every half is a sum of those.
    The trial that is best in-sample (the first of equals) gets its rank out of sample.
    """
    if n_splits % 2 or n_splits > 16:
        raise ValueError("an even number of blocks, 16 at most")  # C(16, 8) halves, which are broadcast
    spark, times = returns.sparkSession, returns.select("t").distinct()
    n = times.count()
    size = n // n_splits
    if not size:
        raise ValueError("more blocks than observations")
    blocks = positions(times, ["t"]).withColumn("block", F.floor(F.col("pos") / size).cast("int")).where(F.col("block") < n_splits).drop("pos")
    parts = returns.join(blocks, "t").groupBy("block", "trial").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    chosen = combos(spark, n_splits, n_splits // 2)
    member = chosen.groupBy("combo").agg(F.collect_set("part").alias("parts"))
    met = parts.join(F.broadcast(member)).withColumn("is", F.array_contains("parts", F.col("block")))
    total = met.groupBy("combo", "trial").agg(*[F.sum(F.when(F.col("is") == side, F.col(c))).alias(f"{c}_{side}".lower()) for side in (True, False) for c in ("n", "s", "q")])

    def perf(side: str) -> Column:
        m, s, q = (F.col(f"{c}_{side}").cast("double") for c in ("n", "s", "q"))
        var = (q - s * s / m) / (m - 1)
        return F.when(var > 1e-18, s / m / F.sqrt(F.when(var > 1e-18, var))).otherwise(0.0)

    scored = total.select("combo", "trial", F.round(perf("true"), 12).alias("is_perf"), F.round(perf("false"), 12).alias("oos_perf"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("combo").orderBy("oos_perf", "trial")))
    best = ranked.groupBy("combo").agg(F.max_by("rank", F.struct("is_perf", -F.col("trial"))).alias("rank"), F.count("*").alias("n"))
    omega = F.col("rank") / (F.col("n") + 1.0)
    return best.select("combo", F.ln(omega / (1 - omega)).alias("logit"))


def overfit_probability(logits: DataFrame) -> DataFrame:
    return logits.agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("n_combinations"))


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array: the element at ``round(q * (n - 1))``."""
    return F.element_at(values, F.round(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)


def nearest_ranks(rows: DataFrame, key: str, value: str, quantiles: Sequence[float], buckets: int = 1024) -> DataFrame:
    """``key, n, lo, hi`` and for each quantile ``q20`` and so on: the value at ``round(q * (n - 1))`` in order, exactly.

    Values are counted first, so a frequent one is a single row; counts of value buckets then tell which bucket holds a rank, and
    only that one is put in order: no group is collected. Null values do not count.
    """
    v = F.col(value)
    counted = rows.where(v.isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    whole = counted.groupBy(key).agg(F.sum("c").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = counted.join(whole, key).withColumn("bucket", at.cast("int"))
    sums = placed.groupBy(key, "n", "bucket").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy("bucket")) - F.col("c")  # at most ``buckets`` rows a key
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.round(F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")) for q in quantiles])).alias("w")
    wanted = sums.withColumn("before", before).select(key, "bucket", "c", "before", ranks).where("w.rank >= before AND w.rank < before + c").select(key, "bucket", "w.q", (F.col("w.rank") - F.col("before")).alias("left"))
    upto = F.sum("c").over(Window.partitionBy(key, "bucket", "q").orderBy(value))
    found = placed.join(wanted, [key, "bucket"]).withColumn("upto", upto).where("left < upto AND left >= upto - c")
    return found.groupBy(key, "n", "lo", "hi").agg(*[F.max(F.when(F.col("q") == q, v)).alias(f"q{round(q * 100)}") for q in quantiles])


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate in equal bins; the last is closed; empty ones have no row."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"), F.count("*").alias("n"))


def at_thresholds(rows: DataFrame, taus: DataFrame, cost: float = COST_R) -> DataFrame:
    """``rows`` (``p, r``) acted on at each of a few thresholds ``tau``: counts, precision and recall net of cost, expectancy."""
    grid = sorted(r.tau for r in taus.select("tau").distinct().collect())  # a few dozen numbers
    win = F.col("r") > cost
    all_won = F.count_if(win)

    def one(tau: float) -> Column:
        act = F.col("p") >= tau
        n, won = F.count_if(act), F.count_if(act & win)
        return F.struct(
            F.lit(tau).alias("tau"),
            n.alias("n_acted"),
            F.coalesce(won / F.when(n > 0, n), F.lit(0.0)).alias("precision"),
            F.coalesce(won / F.when(all_won > 0, all_won), F.lit(0.0)).alias("recall"),
            F.avg(F.when(act, F.col("r") - cost)).alias("expectancy"),
        )

    # One pass over the rows: each threshold is an aggregate of its own. Without rows, nothing is acted on.
    return rows.agg(F.array(*[one(t) for t in grid]).alias("at")).select(F.inline("at"))


def tau_grid(rows: DataFrame, p: str = "p") -> DataFrame:
    """Deciles of the predictions (interpolated) and seven steps from 0.3 to 0.9, each once."""
    steps = [0.3 + 0.1 * i for i in range(7)]
    deciles = F.percentile(p, F.array(*[F.lit(i / 10) for i in range(10)]))
    all_of = F.array_union(F.transform(deciles, lambda x: F.round(x, 9)), F.array(*[F.lit(round(s, 9)) for s in steps]))
    return rows.agg(F.array_sort(F.array_distinct(all_of)).alias("taus")).select(F.explode("taus").alias("tau"))


def select_tau(rows: DataFrame, cost: float = COST_R) -> float:
    """The threshold for acting: chosen on the first 70 % of ``rows`` (``pos, p, r``), confirmed on the rest; else 0.5.

    Best precision first, then expectancy, then the lower threshold; it must act on enough rows at a profit on both
    parts, and find a tenth of the winners on the first.
    """
    n = rows.count()
    if not n:
        return 0.5
    cut = int(0.7 * n)
    grid = tau_grid(rows)
    parts = [(rows.where(F.col("pos") < cut), cut), (rows.where(F.col("pos") >= cut), n - cut)] if 0 < cut < n else [(rows, n)]
    ranked = None
    for k, (part, size) in enumerate(parts):
        least = max(8, math.ceil(0.1 * size))
        ok = at_thresholds(part, grid, cost).where((F.col("n_acted") >= least) & (F.col("expectancy") > 0))
        ranked = ok.where(F.col("recall") >= 0.10) if k == 0 else ranked.join(ok.select("tau"), "tau")
    best = ranked.orderBy(F.col("precision").desc(), F.col("expectancy").desc(), "tau").first()
    return best.tau if best else 0.5


def gate(row: DataFrame) -> DataFrame:
    """Promotion: ``dsr > 0, pbo < 0.5, expectancy > 0`` and two regimes with a profit; what is missing fails."""
    tests = {"dsr": F.col("dsr") > 0, "pbo": F.col("pbo") < 0.5, "expectancy": F.col("expectancy") > 0, "n_regimes": F.col("n_regimes") >= 2}
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    passed = ok["dsr"] & ok["pbo"] & ok["expectancy"] & ok["n_regimes"]
    why = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in ok.items()]))
    return row.withColumns({"passed": passed, "failures": F.array_join(why, ","), "survivor": passed | (ok["dsr"] & ok["pbo"] & ok["expectancy"])})
