"""The read surface: filters from text, pages in order, and rows shaped for clients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.labeling import PROFILES
from tidemark.operators.pit import top_one

PAGE = 500
#: What operators see of the engine's actions (fixed values); any other is an alert.
OPERATOR_ACTION = {"shrink_size": "shrink", "quarantine": "quarantine", "demote": "demote", "disable": "disable", "recalibrate": "recalibrate", "skip_degraded": "skip", "suppress": "suppress", "refit": "refit"}


def bound(text: str | None, upper: bool) -> Column | None:
    """A bound from a timestamp or a date in text; an upper date means its end; bad text is no bound."""
    if not text:
        return None
    t = F.lit(text).try_cast("timestamp_ntz")
    day = F.lit(text).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(day, t + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND")).otherwise(t) if upper else t


def scanner_of(text: str | None) -> str:
    """Blank and unknown scanners are ``etf``."""
    own = (text or "").strip().lower()
    return own if own in ("etf", "equity") else "etf"


def filtered(rows: DataFrame, time: str, scanner: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Inclusive bounds, each left out where it is missing; predicates are simple, so they reach the scan."""
    if scanner is not None:
        rows = rows.where(F.col("scanner") == scanner_of(scanner))
    for text, upper in ((since, False), (until, True)):
        b = bound(text, upper)
        if b is not None:
            rows = rows.where(b.isNull() | ((F.col(time) <= b) if upper else (F.col(time) >= b)))
    return rows


def page(rows: DataFrame, time: str, key: str, n: int = PAGE) -> DataFrame:
    """The newest ``n`` rows: a top-k, not a sort of all."""
    return rows.orderBy(F.col(time).desc(), key).limit(n)


def population(strategies: DataFrame, scores: DataFrame) -> DataFrame:
    """Strategies with their latest score and the time that dates them: when scored, else when created."""
    last = top_one(scores, ["strategy_id"], ["evaluated_at", "score_id"])
    return strategies.join(last, "strategy_id", "left").withColumn("dated", F.coalesce("evaluated_at", "created_at"))


def operator_action(action: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OPERATOR_ACTION.items() for x in kv]), action), F.lit("alert"))


def detail(doc: Column) -> Column:
    """The note of a JSON document, else the document, else nothing."""
    return F.coalesce(F.get_json_object(doc, "$.note"), doc, F.lit(""))


def drivers(doc: Column) -> Column:
    """Drivers of a JSON array: layers in lower case, no contribution is 0, entries without layer or key are dropped."""
    parsed = F.from_json(doc, "array<struct<layer string, key string, contribution double>>")
    kept = F.filter(parsed, lambda d: d["layer"].isNotNull() & d["key"].isNotNull())
    return F.coalesce(F.transform(kept, lambda d: F.struct(F.lower(d["layer"]).alias("layer"), d["key"].alias("key"), F.coalesce(d["contribution"], F.lit(0.0)).alias("contribution"))), F.array().cast("array<struct<layer string, key string, contribution double>>"))


def strings(doc: Column) -> Column:
    return F.coalesce(F.from_json(doc, "array<string>"), F.array().cast("array<string>"))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([0-9.-]+)", 1).try_cast("double")


def layer_of(key: Column) -> Column:
    """The layer that a dotted key names; ``trigger`` if it names none."""
    head = F.substring_index(key, ".", 1)
    return F.when(head.isin("tradeability", "regime", "location", "trigger", "event"), head).otherwise("trigger")


def layer_of_column(name: Column) -> Column:
    return F.when(F.instr(name, "__") > 1, F.split_part(name, F.lit("__"), F.lit(1))).otherwise("base")


def describe(predicates: Column) -> Column:
    """``key op threshold AND ...``."""
    signs = F.create_map(*[F.lit(x) for x in ("gt", ">", "lt", "<", "gte", ">=", "lte", "<=")])
    return F.array_join(F.transform(predicates, lambda p: F.concat_ws(" ", p["feature_key"], signs[p["op"]], F.format_number(p["threshold"], 4))), " AND ")


def signature(predicates: Column) -> Column:
    """The same for any order of the predicates; thresholds to four places, no negative zero."""
    one = F.transform(predicates, lambda p: F.concat_ws(":", p["feature_key"], p["op"], F.format_string("%.4f", F.round(p["threshold"], 4) + F.lit(0.0))))
    return F.array_join(F.array_sort(one), "&")


#: What a stored genome may hold.
_GENOME = "struct<side: string, horizon: string, predicates: array<struct<feature_key: string, op: string, threshold: double>>, risk: struct<kind: string, stop: double, target: double>>"


def genome_of(doc: Column) -> Column:
    """A genome from JSON: ``side`` (1, -1), ``horizon, predicates, risk``. One without a risk has that of its horizon's profile, under which it was labelled; null where the text is no genome."""
    raw = F.from_json(doc, _GENOME)
    side = F.when(F.lower(raw["side"]) == "long", 1).when(F.lower(raw["side"]) == "short", -1)
    own = {name: F.struct(F.lit("atr").alias("kind"), F.lit(p.stop_atr).alias("stop"), F.lit(p.target_atr / p.stop_atr).alias("target")) for name, p in PROFILES.items()}
    horizon = F.lower(raw["horizon"])
    usual = reduce(lambda out, kv: out.when(horizon == kv[0], kv[1]), list(own.items())[1:], F.when(horizon == next(iter(own)), next(iter(own.values()))))
    known = side.isNotNull() & horizon.isin(list(own)) & raw["predicates"].isNotNull()
    return F.when(known, F.struct(side.alias("side"), horizon.alias("horizon"), raw["predicates"].alias("predicates"), F.coalesce(raw["risk"], usual).alias("risk")))


def camel_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object with camel-case names; nulls are left out."""
    camel = lambda n: n.split("_")[0] + "".join(p.title() for p in n.split("_")[1:])
    return rows.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in rows.columns])).alias("json"))


def envelope(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several tables as ``kind, data``."""
    out = None
    for kind, df in kinds:
        own = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("data"))
        out = own if out is None else out.unionAll(own)
    return out


def since(rows: DataFrame, time: str, mark: Column, n: int = 100) -> DataFrame:
    """The oldest ``n`` rows after a mark: what a poll pushes."""
    return rows.where(F.col(time) > mark).orderBy(time, *[c for c in rows.columns if c != time]).limit(n)


def preset(name: str, today: Column) -> Column | None:
    """The first day of 1M, 3M, 6M, 1Y or YTD; None for all."""
    months = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12}
    return F.add_months(today, -months[name]) if name in months else F.trunc(today, "YEAR") if name == "YTD" else None
