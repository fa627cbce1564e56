"""Running values over one order of all rows, without a task that sees them all.

The order is cut into ranges, each range is one group, and what a range starts from is the total of those before it: a table with a row for each range (and key).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import Scratch

#: How a running value takes in a row, and how the one before a range meets the one inside it (either may be null).
_KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


class Ordered:
    """``rows`` in the order of ``order``, inside each of ``keys``.

    By default the ranges are of even size, found by Spark's range partitioner: the rows are written once with their range. Rows that are alike in ``keys`` and ``order``
    share a range; name something that tells them apart where many can be. ``ranges`` may name the range of a row instead, a column that never falls in the order
    (the year of a time): nothing is written then.
    """

    def __init__(self, rows: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ranges: Column | None = None):
        self.order, self.keys = list(order), list(keys)
        self.columns = rows.columns
        if ranges is not None:
            self.rows = rows.withColumn("_range", ranges)
        else:
            dealt = rows.repartitionByRange(*self.keys, *self.order).withColumn("_range", F.spark_partition_id())
            self.rows = Scratch(rows.sparkSession).written(dealt, "ordered")

    def running(self, **values: tuple[str, Column]) -> DataFrame:
        """The rows with a column for each of ``values`` (``sum``, ``max`` or ``last``, and of what): its value over the rows up to each, itself included."""
        at = ["_range", *self.keys]
        inside = Window.partitionBy(*at).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # One row a range and key; of a range that has no key, null.
        before = Window.partitionBy(*self.keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        own = self.rows.withColumns({f"_own_{k}": _KINDS[kind][0](c).over(inside) for k, (kind, c) in values.items()})
        # The last value of a range is found by its order.
        total = lambda kind, c: F.max_by(c, F.when(c.isNotNull(), F.struct(*self.order))) if kind == "last" else _KINDS[kind][0](c)
        sums = self.rows.groupBy(*at).agg(*[total(kind, c).alias(k) for k, (kind, c) in values.items()])
        starts = sums.select(*[F.col(c).alias(f"_at_{c}") for c in at], *[_KINDS[kind][0](F.col(k)).over(before).alias(f"_before_{k}") for k, (kind, _) in values.items()])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in at])
        met = own.join(starts, same)
        return met.select(*self.columns, *[_KINDS[kind][1](F.col(f"_before_{k}"), F.col(f"_own_{k}")).alias(k) for k, (kind, _) in values.items()])


def positions(rows: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``rows`` with their places from 0 in an order that tells them all apart."""
    return Ordered(rows, order).running(**{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, (F.col(name) - 1).cast("int"))
