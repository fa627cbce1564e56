"""Writes by key over Parquet tables, which have no MERGE: changed rows are written beside the table and merged when it is read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.storage import delete, file_system

#: Rows of a task that sorts or groups by keys, about.
TASK_ROWS = 500_000
#: Every so many writes the log has the whole layout, so that reading it stays short.
SNAPSHOT = 50


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key. ``new`` has a key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def spread(rows: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as their number asks for, whatever the session's count. They are counted first: for tables that are scanned, not computed."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // task_rows)), *keys)


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def filled(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with its nulls filled from ``new``; values that are there stay."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    pick = [F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))), F.max(F.when(F.col("_new") == 1, F.col(c)))).alias(c) for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(*pick)


def unseen(new: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key was never written: what an insert that ignores conflicts appends."""
    return new.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """What a delete leaves: rows for which ``condition`` is not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


@dataclass
class Layout:
    """What a version of a table consists of: the number of the last write, and for each bucket the folders of its base and of the deltas since."""

    version: int = -1
    buckets: dict[int, list[str]] = field(default_factory=dict)

    def deltas(self, b: int) -> int:
        return len(self.buckets.get(b, [])) - 1


class KeyedTable:
    """A Parquet table with one row for each key, in ``buckets`` by a hash of the key under ``path``.

    A write adds a delta: the changed rows of the buckets it touches, and marks for deleted keys; nothing else is read or rewritten. Reading takes the newest row of each key
    in buckets that have deltas, and scans the others as they are. ``compact`` folds the deltas of a bucket into a new base; files of other buckets stay.
    ``log/N`` names the folders of write N and is created, never replaced: a writer that dies before leaves the table as it was, and of two writers of one
    version the second fails and may try again. Readers keep what they have opened, since folders are never changed; ``vacuum`` deletes those that no version needs.
    New rows of a write must have a key once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 16, most_deltas: int = 8):
        self.spark, self.path, self.keys, self.most_deltas = spark, path.rstrip("/"), list(keys), most_deltas
        self.schema = spark.createDataFrame([], schema).schema
        extra = [StructField("_version", LongType()), StructField("_gone", BooleanType())]
        self._stored = StructType([*self.schema.fields, *extra])
        if not self._versions():
            self._commit(0, {"buckets": buckets})
        self.n_buckets = self._entry(0)["buckets"]  # the first entry's count stays

    # The log

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("log") if n.isdigit())

    def _names(self, folder: str) -> list[str]:
        files, at = file_system(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def _entry(self, version: int) -> dict:
        files, at = file_system(self.spark, f"{self.path}/log/{version}")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, entry: dict) -> None:
        if version and version % SNAPSHOT == 0:
            entry = {**entry, "layout": self.layout().buckets}
        files, at = file_system(self.spark, f"{self.path}/log/{version}")
        stream = files.create(at, False)  # fails if the version is there
        try:
            stream.write(json.dumps({"version": version, **entry}).encode())
        finally:
            stream.close()

    def layout(self, version: int | None = None) -> Layout:
        """The newest version, or an earlier one: the last snapshot, and the entries since."""
        entries: list[dict] = []
        for v in reversed([v for v in self._versions() if version is None or v <= version]):
            entries.append(self._entry(v))
            if "layout" in entries[-1]:
                break
        out = Layout()
        for e in reversed(entries):
            out.version = e["version"]
            if "layout" in e:
                out.buckets = {int(b): dirs for b, dirs in e["layout"].items()}
            for b in e.get("touched", []):
                if e["kind"] == "empty":
                    out.buckets.pop(b, None)
                else:
                    out.buckets[b] = [e["dir"]] if e["kind"] == "base" else [*out.buckets.get(b, []), e["dir"]]
        return out

    # Reading

    def _scan(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*folders) if folders else self.spark.createDataFrame([], self._stored)

    def _rows(self, layout: Layout, buckets: Sequence[int] | None = None) -> DataFrame:
        chosen = [b for b in sorted(layout.buckets) if buckets is None or b in buckets]
        at = lambda b: [f"{self.path}/{d}/bucket={b}" for d in layout.buckets[b]]
        # A bucket's only folder has each key once, and marks for keys that it never had.
        plain = self._scan([p for b in chosen if layout.deltas(b) == 0 for p in at(b)]).where("NOT _gone")
        parts = [p for b in chosen if layout.deltas(b) for p in at(b)]
        if not parts:
            return plain.select(*self.schema.names)
        last = newest(self._scan(parts), self.keys, ["_version"]).where("NOT _gone")
        return plain.select(*self.schema.names).unionByName(last.select(*self.schema.names))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.layout(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets

    # Writing

    def _write(self, rows: DataFrame, kind: str, version: int, gone: bool = False) -> None:
        folder = f"data/v{version}-{uuid.uuid4().hex}"
        stored = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(version).cast("long").alias("_version"), F.lit(gone).alias("_gone"), self._bucket().alias("bucket"))
        stored.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        touched = sorted(int(n.split("=")[1]) for n in self._names(folder) if n.startswith("bucket="))
        self._commit(version, {"kind": kind, "dir": folder, "touched": touched})

    def _delta(self, rows: DataFrame, layout: Layout, gone: bool = False) -> None:
        self._write(rows, "delta", layout.version + 1, gone)
        if any(self.layout().deltas(b) > self.most_deltas for b in layout.buckets):
            self.compact()

    def upsert(self, new: DataFrame) -> None:
        """``new`` takes the place of rows with the same keys. The table is not read."""
        self._delta(new, self.layout())

    def fill(self, new: DataFrame) -> None:
        """New keys are added; of those that are there the nulls are filled, and values stay. Only rows with the keys of ``new`` are written."""
        layout = self.layout()
        met = self._rows(layout, self._touched(new)).join(new.select(*self.keys), self.keys, "left_semi")
        self._delta(filled(met, new, self.keys), layout)

    def insert(self, new: DataFrame) -> None:
        """Rows with keys that are there are left out."""
        layout = self.layout()
        self._delta(unseen(new, self._rows(layout, self._touched(new)), self.keys), layout)

    def insert_once(self, new: DataFrame) -> None:
        """Refuses the whole write if any key is there."""
        layout = self.layout()
        if not self._rows(layout, self._touched(new)).join(new.select(*self.keys), self.keys, "left_semi").isEmpty():
            raise ValueError("already written")
        self._delta(new, layout)

    def delete(self, condition: Column) -> None:
        """Rows for which ``condition`` is true go."""
        layout = self.layout()
        self._delta(self._rows(layout).where(condition), layout, gone=True)

    def compact(self, least: int = 1) -> list[int]:
        """The buckets with at least that many deltas get a new base; the others keep their files."""
        layout = self.layout()
        due = [b for b in layout.buckets if layout.deltas(b) >= least]
        if due:
            self._write(self._rows(layout, due), "base", layout.version + 1)
            left = set(due) - set(self._entry(layout.version + 1)["touched"])
            if left:  # a bucket whose keys are all gone has no files: its marks go too
                self._commit(layout.version + 2, {"kind": "empty", "dir": None, "touched": sorted(left)})
        return due

    def vacuum(self) -> int:
        """Deletes the buckets' folders that the newest version doesn't need (a write under way has a later version), and how many. Readers of earlier ones must be done."""
        layout = self.layout()
        needed = {f"{d}/bucket={b}" for b, dirs in layout.buckets.items() for d in dirs}
        written = [f"data/{n}" for n in self._names("data") if int(n[1:].split("-")[0]) <= layout.version]
        old = {f"{d}/{n}" for d in written for n in self._names(d) if n.startswith("bucket=")} - needed
        for folder in old:
            delete(self.spark, f"{self.path}/{folder}")
        return len(old)


def migrate(spark: SparkSession, path: str, tables: dict[str, str], keys: dict[str, list[str]]) -> dict[str, KeyedTable]:
    """A keyed table for each name and schema under ``path``: made where it is missing, left as it is where it is there, however often this runs."""
    return {name: KeyedTable(spark, f"{path}/{name}", schema, keys[name]) for name, schema in tables.items()}


def write_dataset(rows: DataFrame, path: str, time: str = "ts") -> None:
    """A labelled dataset: refuses an empty one, orders by time, feature columns by name."""
    if rows.isEmpty():
        raise ValueError("no rows")
    first = [c for c in (time, "t1", "label", "regime") if c in rows.columns]
    rows.select(*first, *sorted(c for c in rows.columns if c not in first)).orderBy(time).write.mode("overwrite").parquet(path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
