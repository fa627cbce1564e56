"""Embedding whitening: the leading principal components by block subspace iteration, without ever forming the covariance.

Every pass over the vectors computes ``Xᵀ(XQ)`` on centred rows for a narrow block ``Q``; QR keeps blocks orthonormal and Rayleigh-Ritz turns them into
estimates, until the residual of each component certifies it. The directions of earlier passes stay in the Rayleigh-Ritz step (restarted when they are
many): of a block alone, eigenvalues that lie close need hundreds of passes. A last pass over the components themselves measures residuals and
the whitened covariance anew.

Vectors that are null or hold a null, NaN or infinite entry take no part, nor do those of another length than the commonest (of equally common
ones the longest): they are in no result. No vectors give no rows. Repeated rows count, and each has its result. Entries become integers
(``floor(1024 c) + 100000``, at most 2**40 in size), so sums and deviations are exact; a deviation beyond a long is null. A component without variance
(too few rows, equal vectors) has a null ``whitened``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 40
COMPONENTS = 8
#: Directions in a block for each component, blocks kept for Rayleigh-Ritz, and those that a restart leaves.
WIDTH, KEPT, LEFT = 2, 8, 3
#: A component is certified when its residual is below this share of the largest eigenvalue; below ZERO of it an eigenvalue counts as none.
TOLERANCE, ZERO = 1e-12, 1e-13


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # one a column
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, x`` (longs) of the usable vectors of ``vectors``; written, as every pass reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b["v"]), 0).to_numpy(zero_copy_only=False)
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null lists have no entries, null entries are NaN
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fit = b["v"].is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
            x = np.clip(np.floor(np.where(np.isfinite(flat), flat, 0.0) * SCALE) + SHIFT, -MOST, MOST).astype(np.int64)
            x = x[np.repeat(fit, size)]
            bounds = np.concatenate([[0], np.cumsum(size[fit])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["k"].filter(pa.array(fit)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))], names=["vec_id", "x"])

    read = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v"))
    sound = written(read.mapInArrow(run, "vec_id long, x array<long>"), "vectors")
    sizes = sound.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    size = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return sound.where(F.size("x") == (size["size"] if size else 0)).where(F.size("x") > 0)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            if b.num_rows:
                n, total = n + b.num_rows, total + _matrix(b).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(-1, len(total), dtype=np.int32), "s": np.concatenate([[n], total]).astype(np.int64)})

    rows = x.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # one a dimension
    return (rows[0].s, [r.s for r in rows[1:]]) if rows else (0, [])


class _Centre:
    """Rows less their mean: whole numbers first, so that nothing is lost to the size of the entries."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.n = n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = x - self.whole
        if self.n * int(np.abs(d).max(initial=0) + 1) < 2 ** ((63 - len(self.whole).bit_length()) // 2):
            own = d * self.n - self.rest
            return (own * own).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in d]
        return [v if v < 1 << 63 else None for v in exact]


def _apply(x: DataFrame, centre: _Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``q``, and its trace: one pass. A task sends one number for each entry of the product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros(q.shape), 0.0
        for b in batches:
            if b.num_rows:
                c = centre(_matrix(b))
                total += c.T @ (c @ q)
                trace += float((c * c).sum())
        yield pa.RecordBatch.from_pydict({"at": np.arange(-1, total.size, dtype=np.int32), "y": np.concatenate([[trace], total.ravel()])})

    rows = x.select("x").mapInArrow(run, "at int, y double").groupBy("at").agg(F.sum("y").alias("y")).collect()  # dimensions x block
    out = np.zeros(q.size + 1)
    out[[r.at + 1 for r in rows]] = [r.y for r in rows]
    return out[1:].reshape(q.shape) / centre.n, out[0] / centre.n


def _orthogonal(block: np.ndarray, against: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to ``against``; directions shorter than ``least`` are noise."""
    block = block[:, np.linalg.norm(block, axis=0) > least]
    q, r = np.linalg.qr(block - against @ (against.T @ block))
    q = q[:, np.abs(np.diag(r)) > least]
    return np.linalg.qr(q - against @ (against.T @ q))[0]


def _ritz(base: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance on the base, falling, and how the base makes their vectors."""
    h = base.T @ image
    values, mix = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], mix[:, ::-1]


def fit(x: DataFrame, components: int = COMPONENTS, seed: int = 11) -> Whitening | None:
    """The ``components`` leading components (as many as there are dimensions) of the vectors of ``integers``; None without any."""
    n, sums = _sums(x)
    if not n:
        return None
    centre, d = _Centre(n, sums), len(sums)
    k, width = min(components, d), min(WIDTH * components, d)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    base, image, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    while True:
        made, trace = _apply(x, centre, block)
        passes += 1
        base, image = np.hstack([base, block]), np.hstack([image, made])
        values, mix = _ritz(base, image)
        vectors, images = base @ mix, image @ mix
        residuals = images[:, :width] - vectors[:, :width] * values[:width]
        size = np.linalg.norm(residuals[:, :k], axis=0).max(initial=0.0)
        added = np.zeros((d, 0)) if base.shape[1] == d else _orthogonal(residuals, base, TOLERANCE * values[0] / 10)
        if size > TOLERANCE * values[0] and added.shape[1]:
            if base.shape[1] + added.shape[1] > KEPT * width:
                base, image = vectors[:, : LEFT * width], images[:, : LEFT * width]
            block = added
            continue
        # The components themselves, measured in a pass of their own.
        q = np.linalg.qr(vectors[:, :k])[0]
        made, trace = _apply(x, centre, q)
        passes += 1
        values, mix = _ritz(q, made)
        q, made = q @ mix, made @ mix
        size = float(np.linalg.norm(made - q * values, axis=0).max(initial=0.0))
        if size <= 100 * TOLERANCE * max(values[0], 1.0) or base.shape[1] == d:
            break
        base, image, block = q, made, _orthogonal(made - q * values, q, 0.0)
    sign = np.where(q[np.abs(q).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    q, made = q * sign, made * sign
    values = np.where(values > ZERO * max(values[0], 0.0), values, 0.0)
    there = values > 0
    scaled = q[:, there] / np.sqrt(values[there])
    error = float(np.abs(scaled.T @ (made[:, there] / np.sqrt(values[there])) - np.eye(int(there.sum()))).max(initial=0.0))
    return Whitening(n, sums, q, values, trace, error, size, passes)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id, component`` (from 1), ``n, deviation, whitened, explained, identity_error`` of every vector and component."""
    if model is None:
        return x.sparkSession.createDataFrame([], SCHEMA)
    centre, k, e = _Centre(model.n, model.sums), model.components.shape[1], model.eigenvalues
    scaled = model.components / np.sqrt(np.where(e > 0, e, 1.0))
    explained = e / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, own = b.num_rows, _matrix(b)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": b["vec_id"].take(pa.array(each)),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                        "n": np.full(m * k, model.n, np.int64),
                        "deviation": pa.array(centre.deviation(own), pa.int64()).take(pa.array(each)),
                        "whitened": pa.array((centre(own) @ scaled).ravel(), mask=np.tile(e <= 0, m)),
                        "explained": np.tile(explained, m),
                        "identity_error": np.full(m * k, model.identity_error),
                    }
                )

    return x.mapInArrow(run, SCHEMA)
