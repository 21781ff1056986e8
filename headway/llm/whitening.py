"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers floor(SCALE * c); the fit list is each distinct vector once, written as blocks of rows. Every step of the
bidiagonalisation makes two passes over the blocks. The left vectors u are as long as the list and are never stored: each is the
centred list times a vector p as long as a row (u = Xp), so a task gets its part of all u from its rows. A step is

1. w = Xv - b u' (as X times one vector), and all products of w with the earlier u: what they show is taken out of w;
2. the products with the earlier u again (taken out as well, linearly), the length of w, and X'w, for the next v.

The right vectors v are orthogonalised twice against all earlier ones on the driver, where everything is a row long, at most a row
wide. The small bidiagonal matrix gives singular values and right vectors; its last row bounds their error. Steps go on until that bound is at rounding for
all components asked for and one more, or the rows' space is spent; where a direction ends early, a new one that is orthogonal to all before begins.
Each task sends one row of sums, at most as wide as two rows and the steps so far.

Defined results: rows whose vector is null, empty or has null or non-finite entries are dropped, and so are rows of another length than
most rows have (of equally frequent lengths the smaller counts); entries of 2**53 / SCALE and beyond raise an error, and so does, in the
query, a deviation beyond 64 bits; rows that repeat count once in the fit and are each reported; a null vec_id is kept; directions without
variance are no components, so equal vectors, one vector or an empty table give no rows; other columns are not read.
Components of equal variance are any basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import removed, written

SCALE, COMPONENTS, SEED = 256, 4, 20261128
#: Where a singular triple counts as found, and a direction as spent, as a share of the largest singular value.
FOUND, SPENT = 1e-14, 1e-12
#: Rows in a block of sums.
ROWS = 4096


def scaled(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with an array of whole numbers ``x``; rows without a usable vector are gone."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < float(1 << 53) / SCALE, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("an entry is too large to be scaled")).cast("long"))
    good = rows.filter(usable).withColumn("x", F.transform(v, lambda c: whole(c.cast("double"))))
    return good


def usual_length(rows: DataFrame) -> int:
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return lengths["d"] if lengths else 0


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class FitList:
    """The distinct vectors of a list, written once; ``n``, exact sums ``s`` (Python integers) and the mean."""

    def __init__(self, rows: DataFrame):
        """``rows`` has an array ``x`` of one length."""
        self.d = usual_length(rows)
        self.table = written(rows.filter(F.size("x") == self.d).select("x").distinct(), "fit")
        self.n, self.s = self._sums()
        self.mean = np.array([float(v) / self.n for v in self.s]) if self.n else np.zeros(self.d)

    def _sums(self) -> tuple[int, list[int]]:
        d = self.d
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), d)
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(0)
                high += (x >> 32).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["n", "low", "high"])

        parts = self.table.mapInArrow(of, "n long, low array<long>, high array<long>").collect()  # one row a task
        sums = [sum(p["low"][k] for p in parts) + (sum(p["high"][k] for p in parts) << 32) for k in range(d)]
        return sum(p["n"] for p in parts), sums

    def total(self, of_block: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum of ``of_block(centred rows)`` over all rows, added up task by task."""
        d, mean = self.d, self.mean

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                x = _matrix(batch.column(0), d) - mean
                for k in range(0, len(x), ROWS):
                    out += of_block(x[k : k + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = self.table.mapInArrow(of, "sums array<double>").toArrow().column(0)
        return _matrix(parts, width).sum(0) if len(parts) else np.zeros(width)


def _fresh(rng: np.random.Generator, basis: list[np.ndarray], d: int) -> np.ndarray | None:
    """A unit vector orthogonal to ``basis``, or none if it spans the space."""
    if len(basis) >= d:
        return None
    for _ in range(10):
        v = _without(rng.normal(size=d), basis)
        if np.linalg.norm(v) > 1e-6:
            return v / np.linalg.norm(v)
    return None


def _without(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        m = np.stack(basis)
        for _ in range(2):
            v = v - m.T @ (m @ v)
    return v


def bidiagonalised(fit: FitList, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values of the centred list, right vectors as columns), largest first; at most ``components``, without those of no variance."""
    d = fit.d
    if not d or fit.n < 2:
        return np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(SEED)
    v = _fresh(rng, [], d)
    vs: list[np.ndarray] = [v]  # right vectors
    ps: list[np.ndarray] = []  # u = Xp
    gs: list[np.ndarray] = []  # X'u
    alphas: list[float] = []
    betas: list[float] = [0.0]  # betas[j] stands above alphas[j]
    largest = 0.0
    while True:
        q = vs[-1] - (betas[-1] * ps[-1] if ps else 0)
        m = np.stack(ps, axis=1) if ps else np.zeros((d, 0))
        if ps:
            q = q - m @ fit.total(lambda x, q=q, m=m: (x @ m).T @ (x @ q), m.shape[1])

        def step(x: np.ndarray, q: np.ndarray = q, m: np.ndarray = m) -> np.ndarray:
            w = x @ q
            return np.concatenate([(x @ m).T @ w, [w @ w], x.T @ w])

        sums = fit.total(step, m.shape[1] + 1 + d)
        again, square, z = sums[: m.shape[1]], sums[m.shape[1]], sums[m.shape[1] + 1 :]
        alpha = float(np.sqrt(max(square - again @ again, 0.0)))
        largest = max(largest, alpha, betas[-1])
        if largest == 0.0:
            return np.zeros(0), np.zeros((d, 0))  # no variance at all
        if alpha <= SPENT * largest:  # Xv lies in what the earlier u span: v adds no direction of variance
            alphas.append(0.0)
            ps.append(np.zeros(d))
            gs.append(np.zeros(d))
        else:
            ps.append((q - m @ again) / alpha)
            gs.append((z - (np.stack(gs, axis=1) @ again if gs else 0)) / alpha)
            alphas.append(alpha)
        rest = _without(gs[-1] - alphas[-1] * vs[-1], vs)
        beta = float(np.linalg.norm(rest))
        k = len(vs)
        b = np.diag(alphas) + np.diag(betas[1:], 1)
        left, values, right = np.linalg.svd(b)
        asked = min(components + 1, k)
        if k == d or (k > components and (beta * np.abs(left[-1, :asked]) <= FOUND * values[0]).all()):
            keep = [j for j in range(min(components, k)) if values[j] > SPENT * values[0]]
            return values[keep], np.stack(vs, axis=1) @ right[keep].T
        if beta <= SPENT * largest:
            following, beta = _fresh(rng, vs, d), 0.0
            if following is None:
                keep = [j for j in range(min(components, k)) if values[j] > SPENT * values[0]]
                return values[keep], np.stack(vs, axis=1) @ right[keep].T
        else:
            following = rest / beta
        vs.append(following)
        betas.append(beta)


class Whitening:
    """Mean, variances ``e`` and components of a fit list, and how far its whitened covariance is from the identity."""

    def __init__(self, fit: FitList, components: int = COMPONENTS):
        values, vectors = bidiagonalised(fit, components)
        self.fit, self.vectors = fit, vectors / np.linalg.norm(vectors, axis=0) if len(values) else vectors
        self.e = values**2 / max(fit.n, 1)
        trace = float(fit.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / max(fit.n, 1) if len(values) else 1.0
        self.explained = self.e / trace
        self.identity_error = self._identity_error() if len(values) else 0.0

    def _identity_error(self) -> float:
        turn, k = self.vectors / np.sqrt(self.e), len(self.e)
        mean = self.fit.total(lambda x: (x @ turn).sum(0), k) / self.fit.n

        def products(x: np.ndarray) -> np.ndarray:
            y = x @ turn - mean
            return (y.T @ y).ravel()

        cov = self.fit.total(products, k * k).reshape(k, k) / self.fit.n
        return float(np.abs(cov - np.eye(k)).max())

    def apply(self, rows: DataFrame, key: str = "vec_id") -> DataFrame:
        """(key, component, deviation, whitened) of every row of ``rows`` (with ``x``) and every component."""
        d, n, s, mean = self.fit.d, self.fit.n, self.fit.s, self.fit.mean
        turn, k = self.vectors / np.sqrt(np.maximum(self.e, np.finfo(float).tiny)), len(self.e)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), d)
                bound = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, s), default=0)
                if bound * bound * d < 1 << 63:
                    deviation = pa.array(((n * x - np.array(s, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(1)
                    deviation = pa.array([Decimal(int(v)) for v in exact], pa.decimal128(38, 0))
                y = (x - mean) @ turn
                at = np.repeat(np.arange(len(x)), k)
                kinds = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32())]
                kinds += [deviation.take(pa.array(at)), pa.array(y.ravel())]
                yield pa.RecordBatch.from_arrays(kinds, names=[key, "component", "deviation", "whitened"])

        kind = rows.schema[key].dataType.simpleString()
        usual = rows.filter(F.size("x") == d).select(key, "x")
        return usual.mapInArrow(of, f"{key} {kind}, component int, deviation decimal(38,0), whitened double")


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    good = scaled(rows.select(key, vector), vector)
    fit = FitList(good)
    white = Whitening(fit, components)
    explained = F.element_at(F.array(*(F.lit(float(v)) for v in white.explained), F.lit(0.0)), F.col("component"))
    out = white.apply(good, key).select(key, "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(white.identity_error).alias("identity_error"))
    removed(fit.table)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
