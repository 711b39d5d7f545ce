"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers (floor of ``SCALE`` times the entry); every distinct vector counts once in the fit. A pass over the
stored fit list multiplies a narrow block Q by the covariance, XᵀXQ with X centred first: each task gives one row per
dimension, which Spark adds up, so that the driver sees a block of (dimensions, columns) and never a vector of the table.
A polynomial recurrence of such passes damps what lies under the block's least Ritz value; QR and Rayleigh-Ritz follow,
until the residuals of the wanted pairs are at the level of rounding. A last pass measures the whitened covariance.

Nulls: a null vector, or one with a null or non-finite entry, is left out. Shorter vectors (an empty one too) count as filled
up with zeros to the longest. Entries beyond the range of a long take its end. Repeated vectors weigh once in the fit and
each gets its rows. A component without variance can't be whitened and gives no rows, so equal vectors alone give none; nor
does an empty table. Columns of other names are carried if named in ``keep``; the operator's own names win over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize

SCALE = 256
#: Columns of the block beyond the wanted ones; passes of one filter; filters at most.
GUARD, DEGREE, FILTERS = 16, 10, 60
OWN = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


class Whitening(NamedTuple):
    """What a fit learns; ``components``: unit vectors as columns, by falling ``variances``. ``residual``: relative to the largest."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    identity_error: float


def integers(vector: Column) -> Column:
    """The vector as longs; null if it is null or holds a null or non-finite entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def filled(xs: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs, filled up with zeros."""
    flat, ends = xs.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *xs.value_lengths().to_numpy(zero_copy_only=False)])
    if len(flat) == len(xs) * dims and (np.diff(ends) == dims).all():
        return flat.reshape(len(xs), dims)
    out = np.zeros((len(xs), dims), dtype=np.int64)
    for i in range(len(xs)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x``, as Python's integers if results of up to ``most`` leave the range of a long."""
    return x if most < 2**62 else x.astype(object)


def totals(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            x = filled(b.column(0), dims)
            if len(x):
                far = max(abs(int(x.min())), abs(int(x.max())))
                n, sums = n + len(x), [s + int(v) for s, v in zip(sums, exact(x, far * len(x)).sum(axis=0))]
        if n:
            yield pa.record_batch({"j": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "s": pa.array(map(Decimal, sums), pa.decimal128(38, 0))})

    rows = fit_list.select("x").mapInArrow(add, "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    own = sorted((r["j"], int(r["n"]), int(r["s"])) for r in rows)
    return (own[0][1], [s for _, _, s in own]) if own else (0, [])


def product(fit_list: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Covariance times ``q``, by one pass over the stored vectors; a last column holds each dimension's variance."""
    dims, width = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, width + 1))
        for b in batches:
            x = filled(b.column(0), dims) - mean
            out[:, :width] += x.T @ (x @ q)
            out[:, width] += (x * x).sum(axis=0)
        yield pa.record_batch({"j": pa.array(range(dims), pa.int32()), **{f"c{k}": pa.array(out[:, k]) for k in range(width + 1)}})

    names = [f"c{k}" for k in range(width + 1)]
    added = fit_list.select("x").mapInArrow(multiply, ", ".join(["j int", *[f"{c} double" for c in names]])).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
    return np.array([list(r)[1:] for r in sorted(added.collect())]) / n


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, their vectors, and V times these; ``q`` has orthonormal columns and vq = V q."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], q @ turn[:, ::-1], vq @ turn[:, ::-1]


def filtered(multiply, q: np.ndarray, vq: np.ndarray, under: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance times ``q``, scaled to about 1 at ``top``; small on 0 to ``under``."""
    middle = half = under / 2
    first = scale = half / (top - middle)
    before, now = q, (vq - middle * q) * (scale / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - scale)
        before, now = now, 2 * after / half * (multiply(now) - middle * now) - scale * after * before
        scale = after
    return now


def fit(fit_list: DataFrame, components: int, seed: int = 0) -> Whitening | None:
    """Leading eigenpairs of the covariance of the stored table ``fit_list`` (one column ``x``)."""
    dims = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = totals(fit_list, dims) if dims else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    wanted, width = min(components, dims), min(components + GUARD, dims)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    first = product(fit_list, mean, q, n)
    trace = float(first[:, -1].sum())
    values, q, vq = ritz(q, first[:, :-1])
    level, best = 4 * dims * np.finfo(float).eps, np.inf
    for _ in range(FILTERS):
        top = max(values[0], 0.0)
        off = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max())
        if off <= level * top or width == dims:  # a block of all dimensions holds the pairs themselves
            break
        if off <= 1e-10 * top and off > best / 2:  # rounding ends it: no filter makes it smaller
            break
        best = min(best, off)
        under = max(values[-1], level * top)
        multiply = lambda block: product(fit_list, mean, block, n)[:, :-1]
        q = np.linalg.qr(filtered(multiply, q, vq, under, top) if under < top else multiply(q))[0]
        values, q, vq = ritz(q, multiply(q))
    else:
        raise ArithmeticError(f"residual {off / top:.1e} of the largest eigenvalue after {FILTERS} filters")
    some = int((values[:wanted] > level * top).sum())
    q, values = q[:, :some], values[:some]
    return Whitening(n, sums, q, values, trace, off / top if top else 0.0, identity_error(fit_list, mean, q, values, n) if some else 0.0)


def identity_error(fit_list: DataFrame, mean: np.ndarray, q: np.ndarray, values: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from the whitened vectors themselves."""
    dims, width = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for b in batches:
            w = ((filled(b.column(0), dims) - mean) @ q) / np.sqrt(values)
            out += w.T @ w
        yield pa.record_batch({"j": pa.array(range(width), pa.int32()), **{f"c{k}": pa.array(out[:, k]) for k in range(width)}})

    names = [f"c{k}" for k in range(width)]
    added = fit_list.select("x").mapInArrow(multiply, ", ".join(["j int", *[f"{c} double" for c in names]])).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
    return float(np.abs(np.array([list(r)[1:] for r in sorted(added.collect())]) / n - np.eye(width)).max())


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] = ("vec_id",), components: int = 4, seed: int = 0) -> DataFrame:
    """``keep`` of each row with a finite vector, once per component, with the columns ``OWN``.

    ``deviation`` is the exact sum over dimensions of (n x - S)², decimal(38,0), null if it has more digits.
    """
    keep = carried(list(keep), OWN)
    rows = df.select(*keep, integers(F.col(vector)).alias("x_")).where("x_ IS NOT NULL")
    fit_list = materialize(rows.select(F.col("x_").alias("x")).distinct(), "vectors")
    model = fit(fit_list, components, seed)
    own = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kept = [f for f in rows.schema.fields if f.name != "x_"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], own])
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    dims, count = model.components.shape
    mean, turn = np.array([s / model.n for s in model.sums]), model.components / np.sqrt(model.variances)
    explained, names = model.variances / model.trace, [f.name for f in kept]
    sums = np.array(model.sums, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = filled(b.column(b.num_columns - 1), dims)
            if not len(x):
                continue
            far = model.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, model.sums))
            whole = exact(x, dims * far * far)
            off = whole * model.n - (sums if whole.dtype == object else sums.astype(np.int64))
            deviation = [v if abs(v) < 10**38 else None for v in map(int, (off * off).sum(axis=1))]
            again = pa.array(np.repeat(np.arange(len(x)), count))
            fixed = {"component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), "n": np.full(len(x) * count, model.n)}
            out = {c: b.column(k).take(again) for k, c in enumerate(names)} | {c: pa.array(v) for c, v in fixed.items()}
            out["deviation"] = pa.array([None if v is None else Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(again)
            out["whitened"] = pa.array(((x - mean) @ turn).reshape(-1))
            out["explained"] = pa.array(np.tile(explained, len(x)))
            out["identity_error"] = pa.array(np.full(len(x) * count, model.identity_error))
            yield pa.record_batch(out)

    return rows.mapInArrow(project, schema)
