"""Gradient-boosted trees over histograms: fitted on all rows, applied to all rows.

Up to FIT_ROWS rows a fit is one task; beyond that its histograms are summed over executors, and the trees are the same. Missing values go to the side of a split
that fits better. Fitted models are a few kilobytes a tree; they are broadcast, and every row is scored, explained or permuted
in parallel. Calibration uses Spark ML.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.trees import Boosted, fit

#: Rows up to which a fit is one task, and the most bytes of models that are broadcast.
FIT_ROWS, MAX_MODEL_BYTES = 100_000, 64 << 20
#: Tasks, at least, that fits and predictions are dealt over: few bytes, much work.
TASKS = 32
#: Rows, about, inside which values are permuted together.
PERMUTED = 20_000
#: Knots of a calibration, which Spark ML holds on the driver.
MAX_KNOTS = 1_000_000


def trial_grid(n: int, features: Sequence[str], seed: int = 7) -> list[dict]:
    """Settings of ``n`` trials: depth, rate, and a random half of the features at least; the first has all."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = len(features) if i == 0 else int(rng.integers(max(1, len(features) // 2), len(features) + 1))
        out.append({"trial": i, "depth": int(rng.choice([2, 3, 4])), "rate": float(rng.choice([0.05, 0.1])), "features": sorted(rng.choice(list(features), size=k, replace=False).tolist())})
    return out


def _fitted(train: DataFrame, by: str, features: Sequence[str], settings: dict[int, dict], trees: int, fit_rows: int | None = None) -> dict[tuple[int, int], tuple[list[str], Boosted | float]]:
    """A model of each of ``settings`` for the rows of each value of ``by``, by ``(number, value)``: names of features, and trees (or a share of wins).

    ``train``: ``by, pos, r, weight`` and features. Where no value has over ``fit_rows`` rows, a fit is one task; else histograms are summed over all executors. Both see all rows and
    grow the same trees.
    """
    most = train.groupBy(by).count().agg(F.max("count")).first()[0]  # one number
    if most is None:
        return {}
    if most > (FIT_ROWS if fit_rows is None else fit_rows):
        return _bounded(boosting.fit_all(train, by, features, settings, trees))
    keys = ["trial", by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = settings[int(key[0])]
        pdf = pdf.sort_values("pos")
        x, y = pdf[own["features"]].to_numpy(dtype=float), (pdf["r"] > 0).to_numpy(dtype=float)
        if len(y) < 10 or y.min() == y.max():
            model: Boosted | float = float(y.mean())
        else:
            model = fit(x, y, pdf["weight"].to_numpy(), trees=trees, depth=own["depth"], rate=own["rate"])
        return pd.DataFrame({"trial": [int(key[0])], by: [int(key[1])], "model": [pickle.dumps((own["features"], model))]})

    each = train.withColumn("trial", F.explode(F.array(*[F.lit(t).cast("int") for t in settings])))
    # A task a fit, however few bytes its rows are.
    found = each.repartition(_tasks(train.sparkSession), *keys).groupBy(*keys).applyInPandas(run, f"trial int, {by} int, model binary").collect()  # one row a fit
    return _bounded({(r.trial, r[by]): pickle.loads(bytes(r.model)) for r in found})


def _bounded(models: dict) -> dict:
    """Models go to every task, so their size is checked."""
    if len(pickle.dumps(models)) > MAX_MODEL_BYTES:
        raise ValueError(f"models of over {MAX_MODEL_BYTES} bytes; fit fewer trials at a time")
    return models


def _tasks(spark: SparkSession) -> int:
    return max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _one_model(rows: DataFrame, features: list[str], trees: int) -> Boosted | float:
    found = _fitted(rows.withColumn("all", F.lit(0)), "all", features, {0: {"features": features, "depth": 3, "rate": 0.1}}, trees)
    return found[0, 0][1] if found else 0.5


def oos_predictions(rows: DataFrame, splits: DataFrame, trials: list[dict], features: Sequence[str], trees: int = 40) -> DataFrame:
    """``trial, split, pos, p``: each trial fitted on each split's train rows predicts its test rows.

    ``rows``: ``pos, r, weight`` and features; ``splits``: ``split, pos, role``. All fits at once (see ``_fitted``); then each test row meets the broadcast models of its split.
    A split without train rows predicts 0.5.
    """
    assert set(features) >= {f for t in trials for f in t["features"]}
    settings = {t["trial"]: t for t in trials}
    train = splits.where("role = 'train'").join(rows, "pos")
    models = rows.sparkSession.sparkContext.broadcast(_fitted(train, "split", list(features), settings, trees))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for split, own in b.groupby("split"):
                for trial in settings:
                    names, model = models.value.get((trial, int(split)), ([], 0.5))
                    p = model if isinstance(model, float) else model.proba(own[names].to_numpy(dtype=float))
                    yield pd.DataFrame({"trial": trial, "split": int(split), "pos": own["pos"].to_numpy(), "p": p})

    tests = splits.where("role = 'test'").select("split", "pos").join(rows, "pos").repartition(_tasks(rows.sparkSession))
    return tests.select("split", "pos", *features).mapInPandas(run, "trial int, split int, pos int, p double")


def permutation_importance(rows: DataFrame, features: Sequence[str], repeats: int = 5, trees: int = 40) -> DataFrame:
    """``feature, importance``: the loss of accuracy when a feature is shuffled, at least 0.

    One fit; the model is broadcast. Rows are dealt at random into blocks of about PERMUTED, and a feature is shuffled inside each of them.
    """
    names = list(features)
    model = rows.sparkSession.sparkContext.broadcast(_one_model(rows, names, trees))
    blocks = max(1, rows.count() // PERMUTED)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = model.value
        pdf = pdf.sort_values("pos")
        x, y = pdf[names].to_numpy(dtype=float), (pdf["r"] > 0).to_numpy()

        def hits(a: np.ndarray) -> int:
            p = np.full(len(a), own) if isinstance(own, float) else own.proba(a)
            return int(((p >= 0.5) == y).sum())

        whole, out = hits(x), []
        for j, name in enumerate(names):
            for k in range(repeats):
                mixed = x.copy()
                mixed[:, j] = np.random.default_rng([int(pdf["block"].iloc[0]), j, k]).permutation(mixed[:, j])
                out.append((name, whole - hits(mixed), len(y)))
        return pd.DataFrame(out, columns=["feature", "lost", "n"])

    block = F.pmod(F.xxhash64("pos", F.lit(3)), F.lit(blocks)).cast("int")
    each = rows.select("pos", "r", *names, block.alias("block")).groupBy("block").applyInPandas(run, "feature string, lost long, n long")
    return each.groupBy("feature").agg(F.greatest(F.sum("lost") / F.sum("n"), F.lit(0.0)).alias("importance"))


def shap_importance(rows: DataFrame, features: Sequence[str], trees: int = 30) -> DataFrame:
    """``feature, importance``: the mean size of each feature's Shapley value over all rows; one fit, whose model is broadcast."""
    names = list(features)
    model = rows.sparkSession.sparkContext.broadcast(_one_model(rows, names, trees))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.value
        for b in batches:
            x = b[names].to_numpy(dtype=float)
            size = np.zeros(len(names)) if isinstance(own, float) else np.abs(own.shapley(x)).sum(axis=0)
            yield pd.DataFrame({"feature": names, "size": size, "n": len(b)})

    sums = rows.select(*names).mapInPandas(run, "feature string, size double, n long").groupBy("feature").agg(F.sum("size").alias("s"), F.sum("n").alias("n"))
    return sums.select("feature", (F.col("s") / F.col("n")).alias("importance"))


def by_layer(importance: DataFrame) -> DataFrame:
    """Shares of the whole, by layer of the feature's name."""
    whole = F.sum("importance").over(Window.partitionBy(F.lit(0)))  # one row a feature
    share = importance.withColumn("share", F.col("importance") / F.when(whole > 0, whole))
    return share.groupBy(F.split_part("feature", F.lit("__"), F.lit(1)).alias("layer")).agg(F.sum("share").alias("share"))


def calibrate(rows: DataFrame) -> tuple[str, list[tuple[float, float]]]:
    """``rows`` (``p, y``): the better by Brier score of isotonic and logistic calibration, as knots to interpolate.

    A target without both classes gives its base rate everywhere.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    base = rows.agg(F.avg(F.col("y").cast("double")).alias("m")).first().m
    if base is None or base in (0.0, 1.0):
        return "flat", [(0.0, base or 0.0), (1.0, base or 0.0)]
    vectors = VectorAssembler(inputCols=["p"], outputCol="features").transform(rows.select("p", F.col("y").cast("double").alias("label")))
    iso = IsotonicRegression(isotonic=True).fit(vectors)
    iso_knots = [(float(a), float(min(max(b, 0), 1))) for a, b in zip(iso.boundaries, iso.predictions, strict=True)]
    line = LogisticRegression(regParam=1e-6).fit(vectors)
    a, b = float(line.coefficients[0]), float(line.intercept)
    platt = [(k / 49, float(1 / (1 + np.exp(-(a * k / 49 + b))))) for k in range(50)]
    score = lambda knots: rows.agg(F.avg(F.pow(interpolate(F.col("p"), knots) - F.col("y"), F.lit(2)))).first()[0]
    return ("isotonic", iso_knots) if score(iso_knots) <= score(platt) else ("platt", platt)


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, flat beyond them; null stays null. The knots go with the function, not into the plan."""
    if len(knots) > MAX_KNOTS:
        raise ValueError(f"more than {MAX_KNOTS} knots")
    xs, ys = (np.array(c) for c in zip(*knots, strict=True))

    @F.pandas_udf("double")
    def at(p: pd.Series) -> pd.Series:
        return pd.Series(np.where(p.isna(), np.nan, np.interp(p.fillna(0.0), xs, ys)))

    return F.nanvl(at(x), F.lit(None).cast("double"))


def save_model(spark: SparkSession, path: str, name: str, features: Sequence[str], model: Boosted | float) -> None:
    """A fitted model with its features under ``path``, by its ``model_id``; the same name again replaces it."""
    blob = pickle.dumps((list(features), model))
    spark.createDataFrame([(name, blob)], "name string, model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, name: str) -> tuple[list[str], Boosted | float]:
    """Only for files that this library wrote: they are unpickled."""
    return pickle.loads(bytes(spark.read.parquet(f"{path}/{name}").first().model))


def model_id(features: Sequence[str], params: dict, seed: int) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps([sorted(features), params, seed], sort_keys=True).encode()).hexdigest()[:12]
