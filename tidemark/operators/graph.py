"""Steps that depend on one another, each with its result and its state on record, so that a run can be taken up where it ended."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sinks import KeyedTable

STATES = "run string, step string, pos int, state string, attempts int, n_rows long, seconds double, output string, error string"


@dataclass(frozen=True)
class Step:
    """``run`` makes a table of the tables of the steps it comes ``after``, by name."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()


class Graph:
    """Steps in an order that respects ``after``, with their results and states under ``path``.

    A step is done when its table is written whole and its state says where: one that is killed on the way leaves files that nothing names. A step that raises is ``failed`` with its error,
    those after it are ``blocked``, and others go on. ``run`` of the same name skips what is done, reads those results back, and tries the rest (again).
    """

    def __init__(self, spark: SparkSession, path: str, steps: Sequence[Step]):
        seen: set[str] = set()
        for s in steps:
            if s.name in seen or not set(s.after) <= seen:
                raise ValueError(f"{s.name}: named twice, or before a step that it comes after")
            seen.add(s.name)
        self.spark, self.path, self.steps = spark, path.rstrip("/"), list(steps)
        self.states = KeyedTable(spark, f"{self.path}/states", STATES, ["run", "step"], buckets=1)

    def state(self, run: str) -> DataFrame:
        """One row a step that was begun."""
        return self.states.read().where(F.col("run") == run)

    def run(self, name: str) -> DataFrame:
        """The states at the end."""
        held = {r.step: r for r in self.state(name).collect()}  # one row a step
        done: dict[str, DataFrame] = {}
        for pos, step in enumerate(self.steps):
            before = held.get(step.name)
            if before and before.state == "done":
                done[step.name] = self.spark.read.parquet(before.output)
                continue
            attempts = (before.attempts if before else 0) + 1
            note = lambda state, n=None, took=None, out=None, why=None: self._note((name, step.name, pos, state, attempts, n, took, out, why))  # noqa: B023, E731
            if not set(step.after) <= set(done):
                attempts -= 1
                note("blocked", why="waits for " + ", ".join(sorted(set(step.after) - set(done))))
                continue
            note("running")
            output, began = f"{self.path}/results/{name}/{step.name}-{uuid.uuid4().hex}", time.monotonic()
            try:
                step.run({k: done[k] for k in step.after}).write.parquet(output)
                done[step.name] = self.spark.read.parquet(output)
                n = done[step.name].count()
            except Exception as e:  # noqa: BLE001 - any failure is the step's, and is on record
                done.pop(step.name, None)
                note("failed", took=time.monotonic() - began, why=f"{type(e).__name__}: {e}"[:2000])
                continue
            note("done", n, time.monotonic() - began, output)
        return self.state(name)

    def _note(self, row: tuple) -> None:
        self.states.upsert(self.spark.createDataFrame([row], STATES))

    def result(self, run: str, step: str) -> DataFrame:
        found = [r.output for r in self.state(run).where(f"step = '{step}' AND state = 'done'").collect()]
        if not found:
            raise LookupError(f"{step} is not done in {run}")
        return self.spark.read.parquet(found[0])
