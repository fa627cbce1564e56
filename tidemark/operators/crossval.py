"""Purged and embargoed combinatorial cross-validation as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import combos


def groups(rows: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` (``pos`` from 0 in time order) with ``grp``: contiguous groups whose bounds are those of an even grid, rounded down."""
    n = rows.count()
    if n < n_groups:
        raise ValueError("more groups than rows")
    bounds = [int(n * g / n_groups) for g in range(n_groups + 1)]
    grp = F.lit(0)
    for b in bounds[1:-1]:
        grp = grp + (F.col("pos") >= b).cast("int")
    return rows.withColumn("grp", grp)


def spans(grouped: DataFrame) -> DataFrame:
    """Of each group: the time its labels span, and the positions it holds."""
    return grouped.groupBy("grp").agg(F.min("ts").alias("lo"), F.max("t1").alias("hi"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def splits(rows: DataFrame, n_groups: int, k: int, embargo: int) -> DataFrame:
    """``split, pos, role``: test rows, and the train rows whose labels touch no test span and that no embargo bars.

    ``rows``: ``pos, ts, t1``. Spans are one for each group and are broadcast; each row meets the few test groups of a split.
    """
    if not 0 < k < n_groups:
        raise ValueError("fewer test groups than groups")
    grouped = groups(rows, n_groups)
    test = combos(rows.sparkSession, n_groups, k).select(F.col("combo").alias("split"), F.col("part").alias("grp"))
    held = F.broadcast(test.join(spans(grouped), "grp").groupBy("split").agg(F.collect_list(F.struct("grp", "lo", "hi", "last")).alias("tests")))  # k spans a split
    met = grouped.join(held)
    is_test = F.exists("tests", lambda t: t["grp"] == F.col("grp"))
    touched = F.exists("tests", lambda t: (F.col("ts") <= t["hi"]) & (F.col("t1") >= t["lo"]))
    barred = F.exists("tests", lambda t: (F.col("pos") > t["last"]) & (F.col("pos") <= t["last"] + embargo))
    role = F.when(is_test, "test").when(touched, "purged").when(barred, "embargoed").otherwise("train")
    return met.select("split", "pos", "ts", "t1", role.alias("role"))


def sizes(split_rows: DataFrame) -> DataFrame:
    count = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return split_rows.groupBy("split").agg(count("train"), count("test"), count("purged"), count("embargoed"))


def leaks(split_rows: DataFrame) -> DataFrame:
    """Pairs of a train row and a test row of one split whose labels overlap: none, if purging works.

    Sorted by start, a row overlaps an earlier one just if that one's end, running, is not before its start.
    """
    used = split_rows.where("role IN ('train', 'test')")
    before = Window.partitionBy("split").orderBy("ts", "pos").rowsBetween(Window.unboundedPreceding, -1)
    other = used.withColumns({f"end_{r}": F.max(F.when(F.col("role") == r, F.col("t1"))).over(before) for r in ("train", "test")})
    return other.where(((F.col("role") == "train") & (F.col("end_test") >= F.col("ts"))) | ((F.col("role") == "test") & (F.col("end_train") >= F.col("ts")))).select("split", "pos")


def firewall(rows: DataFrame, lo, hi) -> DataFrame:
    """``rows`` with ``kept``: false for those whose label touches the locked era."""
    return rows.withColumn("kept", ~((F.col("ts") <= hi) & (F.col("t1") >= lo)))


def _middle(rows: DataFrame):
    """The time at rank ``n // 2`` of the distinct times: counted by month, then ranked inside the one month that holds it."""
    month = F.date_trunc("month", "ts")
    times = rows.where("ts IS NOT NULL").select("ts").distinct()
    counts = times.groupBy(month.alias("m")).agg(F.count("*").alias("n")).orderBy("m").collect()  # one row a month
    left = sum(r.n for r in counts) // 2
    for r in counts:
        if left < r.n:
            own = times.where(month == F.lit(r.m))
            return own.withColumn("k", F.row_number().over(Window.partitionBy(month).orderBy("ts"))).where(F.col("k") == left + 1).first().ts
        left -= r.n
    return None


def calendar_split(rows: DataFrame, least: int = 20) -> DataFrame:
    """``rows`` with ``part`` (``is``, ``oos``): before and from the median time; by position if that leaves under ``least`` on a side."""
    mid = _middle(rows)
    early = rows.where(F.col("ts") < mid).count() if mid is not None else 0
    n = rows.count()
    cut = F.col("ts") < F.lit(mid) if early >= least and n - early >= least else F.col("pos") < n // 2
    return rows.withColumn("part", F.when(cut, "is").otherwise("oos"))


def oos_single_path(predictions: DataFrame) -> DataFrame:
    """Of each row the prediction of its last split."""
    return predictions.groupBy("pos").agg(F.max_by("p", "split").alias("p"))


def oos_averaged(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("pos").agg(F.avg("p").alias("p"), F.count("*").alias("paths"))


def trial_returns(predictions: DataFrame, tau: float = 0.5) -> DataFrame:
    """``t, trial, ret``: a trial earns a row's return where it acts, else nothing."""
    return predictions.select("t", "trial", F.when(F.col("p") >= tau, F.col("r")).otherwise(0.0).alias("ret"))
