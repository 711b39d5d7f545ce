"""Centroid clustering by Shallot search: exact Lloyd rounds that look at few centroids.

Vectors and centroids are integers. Each vector remembers its nearest centroid, its second-nearest one, an upper bound of
its distance to the first and a lower bound of that to all others. After the centroids moved, the bounds move with them; a
vector whose bounds stay apart keeps its centroid unseen. Else it is measured against the two remembered ones and starts
from the closer: that one's neighbours are scanned by distance, and the scan ends at the first neighbour outside the ball
of radius (distance to the start + distance to the second-nearest so far), which shrinks as the second-nearest improves.
Who survives is compared in integers, ties go to the smaller number. Bounds are floating point and widened, so that they
never decide what integers must.

A round is one pass: it writes vectors and bounds as a table, from which the moved vectors' sums and counts are added up
exactly per centroid. The driver holds the centroids alone; the table of the round before is removed.

Nulls: a null vector, one with a null or non-finite component or of another length is left out. A null id comes last in the
order of the first centroids, equal ids are told apart by their vectors. Repeated rows each get a row. With fewer vectors
than centroids, each vector is one; an empty table gives an empty table. Components beyond the range of a long take its end;
distances are decimal(38,0). Columns of other names are carried if named in ``keep``; the operator's own names win.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, drop_path, new_path
from .whitening import exact, filled, integers

DIMS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Bounds are moved apart by this share, far more than the rounding of a square root or a sum.
SLACK = 1e-9
OWN = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
STATE = "near int, second int, upper double, lower double, was int"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid: the others by distance, and the distances."""
    apart = roots(np.array([squared(centroids, c) for c in centroids]).reshape(len(centroids), -1))
    order = np.argsort(apart, axis=1, kind="stable")
    order = np.array([o[o != i] for i, o in enumerate(order)]).reshape(len(centroids), -1)
    return order, np.take_along_axis(apart, order, axis=1)


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest and second-nearest centroid of each vector, with squared distances, from two remembered ones; and how many distances that took."""
    d1, d2 = squared(x, centroids[near]), squared(x, centroids[second])
    swap = (d2 < d1) | ((d2 == d1) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, other, from_start, seen = near.copy(), second.copy(), roots(d1), 2 * len(x)
    active = np.arange(len(x))
    for step in range(order.shape[1]):
        ball = (from_start[active] + roots(d2[active])) * (1 + SLACK)
        active = active[apart[start[active], step] <= ball]
        if not len(active):
            break
        found = order[start[active], step]
        known = found == other[active]
        look, c = active[~known], found[~known]
        d = squared(x[look], centroids[c])
        seen += len(look)
        first = (d < d1[look]) | ((d == d1[look]) & (c < near[look]))
        next_ = ~first & ((d < d2[look]) | ((d == d2[look]) & (c < second[look])))
        at, c1 = look[first], c[first]
        second[at], d2[at], near[at], d1[at] = near[at], d1[at], c1, d[first]
        second[look[next_]], d2[look[next_]] = c[next_], d[next_]
    return near, second, d1, d2, seen


def moved(x: np.ndarray, state: dict, drift: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> int:
    """Brings ``state`` (near, second, upper, lower) to the centroids as they are now; how many distances that took."""
    near, second, upper, lower = (state[c] for c in ("near", "second", "upper", "lower"))
    most = np.argsort(drift)[::-1]
    others = np.where(near == most[0], drift[most[1]] if len(most) > 1 else 0.0, drift[most[0]])
    upper += drift[near] * (1 + SLACK)
    lower -= others * (1 + SLACK)
    open_ = np.flatnonzero(upper * (1 + SLACK) >= lower * (1 - SLACK))
    seen = len(open_)
    upper[open_] = roots(squared(x[open_], centroids[near[open_]]))
    open_ = open_[upper[open_] * (1 + SLACK) >= lower[open_] * (1 - SLACK)]
    if len(open_) and len(centroids) > 1:
        near[open_], second[open_], d1, d2, more = search(x[open_], near[open_], second[open_], centroids, order, apart)
        upper[open_], lower[open_], seen = roots(d1), roots(d2), seen + more
    return seen


def kmeans(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", keep: list[str] = ("vec_id",), dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``keep`` of each vector of ``dims`` finite components, with the columns ``OWN`` and no others."""
    spark, keep = df.sparkSession, carried(list(keep), OWN)
    own = df.where(F.size(vector) == dims).select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(ident).cast("string").alias("ident_"), integers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("ident_")), 256)
    start = own.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields], "cluster int, distance decimal(38,0), cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"])
    if not start:
        return spark.createDataFrame([], out)
    centroids = [[int(v) for v in r["x"]] for r in start]
    names = [f"k_{c}" for c in keep]
    state = own.select(*names, "x", F.lit(0).alias("near"), F.lit(min(1, len(centroids) - 1)).alias("second"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    drift, sums, counts, path = [0.0] * len(centroids), [[0] * dims for _ in centroids], [0] * len(centroids), None
    for step in range(rounds + 1):
        last, before = step == rounds, path
        path = new_path(spark, "vectors")
        assign(state, centroids, drift, dims, step == 0, last).write.option("compression", "zstd").parquet(path)
        state = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        if not last:
            add_moves(state, dims, sums, counts)
            after = [[s // n for s in sums[c]] if (n := counts[c]) else centroids[c] for c in range(len(centroids))]
            drift = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y))))) for x, y in zip(after, centroids)]
            centroids = after
    inertias = {r["near"]: int(r["d"]) for r in state.groupBy("near").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, Decimal(inertias.get(c, 0)), Decimal(sum(inertias.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    known = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"))
    return state.select(*[F.col(f"k_{c}").alias(c) for c in keep], F.col("near").alias("cluster"), "distance").join(known, "cluster").select(*keep, *OWN)


def assign(state: DataFrame, centroids: list, drift: list, dims: int, first: bool, last: bool) -> DataFrame:
    """One round of every vector: its columns with the new centroid and bounds, the old one in ``was`` (-1: none); at the last its distance instead."""
    names = [c for c in state.columns if c not in ("near", "second", "upper", "lower", "was")]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*names).schema.fields if not (last and f.name == "x")]
    furthest = max(abs(v) for c in centroids for v in c)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict = {}
        for b in batches:
            x = filled(b.column("x"), dims)
            if not len(x):
                continue
            far = max(abs(int(x.min())), abs(int(x.max())), furthest)
            wide = 4 * dims * far * far >= 2**62
            if wide not in ways:
                c = np.array(centroids, dtype=object if wide else np.int64)
                ways[wide] = (c, *neighbours(c))
            x = exact(x, 4 * dims * far * far)
            own = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "second", "upper", "lower")}
            was = np.full(len(x), -1) if first else own["near"].copy()
            moved(x, own, np.array(drift), *ways[wide])
            out = {n: b.column(n) for n in names if not (last and n == "x")}
            if last:
                out |= {"near": pa.array(own["near"], pa.int32()), "distance": pa.array([Decimal(int(d)) for d in squared(x, ways[wide][0][own["near"]])], pa.decimal128(38, 0))}
            else:
                out |= {"near": pa.array(own["near"], pa.int32()), "second": pa.array(own["second"], pa.int32()), "upper": pa.array(own["upper"]), "lower": pa.array(own["lower"]), "was": pa.array(was, pa.int32())}
            yield pa.record_batch(out)

    return state.mapInArrow(go, ", ".join([*kept, "near int, distance decimal(38,0)" if last else STATE]))


def add_moves(state: DataFrame, dims: int, sums: list, counts: list) -> None:
    """Adds to each centroid's exact sums and count the vectors that came, and takes off those that went."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict = {}
        for b in batches:
            near, was = (b.column(c).to_numpy(zero_copy_only=False) for c in ("near", "was"))
            x = filled(b.column("x"), dims)
            if not len(x):
                continue
            x = exact(x, max(abs(int(x.min())), abs(int(x.max()))) * len(x))
            for side, sign in ((near, 1), (was, -1)):
                for c in np.unique(side[(near != was) & (side >= 0)]):
                    at = (side == c) & (near != was)
                    own = more.setdefault(int(c), [0, [0] * dims])
                    own[0] += sign * int(at.sum())
                    own[1] = [s + sign * int(v) for s, v in zip(own[1], x[at].sum(axis=0))]
        if more:
            yield pa.record_batch({"c": pa.array(more, pa.int32()), "n": pa.array([v[0] for v in more.values()], pa.int64()), **{f"s{j}": pa.array([Decimal(v[1][j]) for v in more.values()], pa.decimal128(38, 0)) for j in range(dims)}})

    names = ["n", *[f"s{j}" for j in range(dims)]]
    schema = ", ".join(["c int, n long", *[f"s{j} decimal(38,0)" for j in range(dims)]])
    for r in state.select("x", "near", "was").mapInArrow(add, schema).groupBy("c").agg(*[F.sum(c).alias(c) for c in names]).collect():
        counts[r["c"]] += int(r["n"])
        sums[r["c"]] = [s + int(r[f"s{j}"]) for j, s in enumerate(sums[r["c"]])]
