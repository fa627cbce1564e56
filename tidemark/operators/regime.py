"""Regime classifier as column expressions: gates, weighed evidence, softmax, conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import finite

CORE = ["rv_percentile", "vix_vix3m", "vvix", "rv20", "copper_gold", "dxy_trend"]
INPUTS = [*CORE, "hy_oas", "vix9d_vix", "gex_sign"]
MIN_CORE, TEMPERATURE, NEAR_TIE = 3, 0.60, 0.08
OUT, TRANSITION = "out_of_distribution", "transition"

#: Plausible ranges of inputs; a value outside is no basis for a label (fixed values).
ENVELOPE = {"vix_vix3m": (0.4, 3.0), "vix9d_vix": (0.4, 3.0), "rv_percentile": (0.0, 1.0), "rv20": (0.0, 5.0), "vvix": (40.0, 280.0)}

#: Conditions, and the evidence each gives: label and weight (fixed values). Labels rank in this order on ties.
LABELS = ["risk_on", "risk_off", "vol_expansion", "vol_compression", "long_gamma", "short_gamma"]
CONDITIONS = {
    "rv_high": "rv_percentile >= 0.80", "rv_low": "rv_percentile <= 0.30", "backwardation": "vix_vix3m >= 1.00", "contango": "vix_vix3m <= 0.95",
    "vvix_high": "vvix >= 110", "vvix_low": "vvix <= 90", "credit_wide": "hy_oas >= 5.0", "credit_tight": "hy_oas <= 3.5",
    "metal_up": "copper_gold > 0.005", "metal_down": "copper_gold < -0.005", "dollar_up": "dxy_trend > 0.005", "dollar_down": "dxy_trend < -0.005",
    "gamma_long": "gex_sign >= 0", "gamma_short": "gex_sign < 0",
    "proxy_short": "gex_sign IS NULL AND (coalesce(rv_percentile >= 0.80, false) OR coalesce(vix_vix3m >= 1.00, false)) AND vvix >= 110",
    "proxy_long": "gex_sign IS NULL AND rv_percentile <= 0.30 AND vix_vix3m <= 0.95 AND vvix <= 90",
}
EVIDENCE = {
    "vol_expansion": {"rv_high": 1.0, "backwardation": 1.0, "vvix_high": 0.5},
    "vol_compression": {"rv_low": 1.0, "contango": 1.0, "vvix_low": 0.5},
    "risk_off": {"credit_wide": 1.5, "backwardation": 0.75, "metal_down": 0.75, "dollar_up": 0.5, "rv_high": 0.5},
    "risk_on": {"credit_tight": 1.5, "contango": 0.75, "metal_up": 0.75, "dollar_down": 0.5, "rv_low": 0.5},
    "long_gamma": {"gamma_long": 2.0, "proxy_long": 0.6},
    "short_gamma": {"gamma_short": 2.0, "proxy_short": 0.6},
}
OPPOSED = [("vol_expansion", "vol_compression"), ("risk_off", "risk_on"), ("short_gamma", "long_gamma")]


def tradeable(label: Column) -> Column:
    return label != OUT


def classify(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label, confidence, prob_map, observed_inputs`` from the columns INPUTS (a missing column is null)."""
    there = [c for c in ENVELOPE if c in rows.columns]
    odd = F.coalesce(F.greatest(F.lit(False), *[F.col(c).isNotNull() & finite(F.col(c)).isNull() for c in there]), F.lit(False))
    own = rows.withColumns({c: finite(F.col(c)) if c in rows.columns else F.lit(None).cast("double") for c in INPUTS} | {"_odd": odd})
    core = sum((F.col(c).isNotNull().cast("int") for c in CORE[1:]), F.col(CORE[0]).isNotNull().cast("int"))
    outside = F.col("_odd")  # a value that is there but not finite is outside too
    for c, (lo, hi) in ENVELOPE.items():
        outside = outside | F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
    own = own.withColumns({"_observed": sum(F.col(c).isNotNull().cast("int") for c in INPUTS), "_out": (core < MIN_CORE) | outside})
    fired = {k: F.coalesce(F.expr(e), F.lit(False)) for k, e in CONDITIONS.items()}
    weigh = lambda label: sum((F.when(fired[k], w).otherwise(0.0) for k, w in EVIDENCE[label].items()), F.lit(0.0))
    scored = own.withColumn("_scores", F.array(*[F.struct(weigh(x).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(LABELS)]))
    scored = scored.withColumn("_scores", F.filter("_scores", lambda x: x["s"] > 0))
    scored = scored.withColumn("_top", F.array_max(F.transform("_scores", lambda x: x["s"])))
    scored = scored.withColumn("_exps", F.transform("_scores", lambda x: F.struct(F.exp((x["s"] - F.col("_top")) / TEMPERATURE).alias("e"), x["i"].alias("i"), x["label"].alias("label"))))
    scored = scored.withColumn("_sum", F.aggregate("_exps", F.lit(0.0), lambda a, x: a + x["e"]))
    scored = scored.withColumn("_ranked", F.array_sort(F.transform("_exps", lambda x: F.struct((-x["e"] / F.col("_sum")).alias("np"), x["i"].alias("i"), x["label"].alias("label")))))
    first, second = F.get("_ranked", 0), F.get("_ranked", 1)
    against = F.lit(False)
    for a, b in OPPOSED:
        against = against | ((first["label"] == a) & (second["label"] == b)) | ((first["label"] == b) & (second["label"] == a))
    torn = F.coalesce(against & (F.abs(first["np"] - second["np"]) <= NEAR_TIE), F.lit(False))
    none = F.size("_ranked") == 0
    label = F.when(F.col("_out"), OUT).when(none | torn, TRANSITION).otherwise(first["label"])
    certain = lambda x: F.create_map(F.lit(x), F.lit(1.0))
    probs = F.map_from_entries(F.transform("_ranked", lambda x: F.struct(x["label"], -x["np"])))
    return scored.select(
        *rows.columns,
        label.alias("label"),
        F.when(F.col("_out") | none, 1.0).otherwise(-first["np"]).alias("confidence"),
        F.when(F.col("_out"), certain(OUT)).when(none, certain(TRANSITION)).otherwise(probs).alias("prob_map"),
        F.col("_observed").alias("observed_inputs"),
    )


def shares(labels: DataFrame) -> DataFrame:
    """Share of each label."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))  # nine labels, one total
