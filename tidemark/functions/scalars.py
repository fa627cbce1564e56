"""Scalar functions: scales, calendars, costs, text forms, and the normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Announcement dates of rate decisions (fixed values).
FOMC_DATES = """
2018-01-31 2018-03-21 2018-05-02 2018-06-13 2018-08-01 2018-09-26 2018-11-08 2018-12-19
2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
2020-01-29 2020-03-18 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-10-29 2025-12-10
2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-10-28 2026-12-09
""".split()


def clamp01(c: Column) -> Column:
    """Between 0 and 1; a null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def log_scale(c: Column, floor: float, good: float) -> Column:
    """0 at ``floor``, 1 at ``good``, linear in the logarithm between."""
    return F.when(c > 0, clamp01((F.ln(c) - math.log(floor)) / (math.log(good) - math.log(floor)))).otherwise(0.0)


def third_friday(d: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "FR"), 14)


def weekdays_upto(d: Column) -> Column:
    """Weekdays from a fixed Monday up to ``d``, inclusive; differences count weekdays in ``(a, b]``."""
    n = F.datediff(d, F.lit("1900-01-01").cast("date")) + 1
    return (F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))).cast("int")


def weekday_diff(a: Column, b: Column) -> Column:
    return weekdays_upto(b) - weekdays_upto(a)


def last_weekday_of_month(d: Column) -> Column:
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def last_weekday(d: Column) -> Column:
    """The last weekday at or before ``d``."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def fomc_days(d: Column) -> Column:
    """Signed weekdays to the nearest decision, the earlier one of two as near."""
    dates = F.array(*[F.lit(x).cast("date") for x in FOMC_DATES])
    diffs = F.transform(dates, lambda x: weekday_diff(d, x))
    return F.element_at(F.array_sort(F.transform(diffs, lambda v, i: F.struct(F.abs(v).alias("far"), i.alias("i"), v.alias("v")))), 1)["v"]


def session_close(d: Column) -> Column:
    """21:00 of a date."""
    return d.cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR")


def adverse_price(raw: Column, side: Column, entering: bool, round_trip: float) -> Column:
    """A fill made worse by half the round-trip cost: buyers pay more, sellers get less."""
    sign = side if entering else -side
    return raw * (1 + sign * (round_trip / 2))


def wilson_lower_bound(p: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Lower bound of a proportion ``p`` seen in ``n`` trials; 0 without either."""
    m = F.when(n > 0, n.cast("double"))
    centre = p + z * z / (2 * m)
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.coalesce(clamp01((centre - spread) / (1 + z * z / m)), F.lit(0.0))


def norm_cdf(x: Column) -> Column:
    """The normal distribution function, by a rational approximation of the tail (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    tail = f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * {poly})"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def column_name(key: Column) -> Column:
    """``regime.adx`` as ``regime__adx``: the first dot doubles, later ones are single underscores."""
    head = F.substring_index(key, ".", 1)
    rest = F.substring(key, F.length(head) + 2, F.length(key))
    return F.when(F.instr(key, ".") > 0, F.concat(head, F.lit("__"), F.replace(rest, F.lit("."), F.lit("_")))).otherwise(key)


def iso_week(ts: Column) -> Column:
    """``YYYY-Www``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
