"""What pairs of segments say of two routes is put together in the task that finds them: few rows leave it."""

import random

import pytest
from pyspark.sql import functions as F

from planweave.functions import corridor, geo, near
from planweave.operators import pairs, routes


def bent(spark, n=120):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        y, x = 33 + rng.random() * 0.3, -84 + rng.random() * 0.3
        route = [(y, x)]
        for _ in range(rng.randint(0, 14)):
            y, x = y + rng.uniform(-0.02, 0.03), x + rng.uniform(-0.02, 0.03)
            route.append((y, x))
        rows.append((i, f"U{i % 4}", route + route[-1:] * (i % 9 == 0)))
    return spark.createDataFrame(rows, "id long, utility string, route array<struct<lat: double, lng: double>>")


def segment_pairs(df, radius):
    return pairs.candidate_pairs(routes.segments(df), radius)


@pytest.fixture
def handed(monkeypatch):
    met, join = [], pairs.candidate_pairs

    def watched(*args, **kwargs):
        met.append(join(*args, **kwargs))
        return met[-1]

    monkeypatch.setattr(pairs, "candidate_pairs", watched)
    return met


def test_distances_of_routes(spark, handed):
    df = bent(spark)
    want = {(r.a_id, r.b_id): r.m for r in segment_pairs(df, 6000.0).groupBy("a_id", "b_id").agg(F.min("metres").alias("m")).collect()}
    got = {(r.a_id, r.b_id): r.metres for r in routes.route_pairs(df, 6000.0).collect()}
    assert got == want and len(want) > 1000 and handed[-1].count() * 5 < handed[0].count()


def test_links_of_routes(spark, handed):
    df = bent(spark)
    found = geo.nearest_points(segment_pairs(df, 8000.0), planar=True)
    square = lambda c: (F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}"))
    rank = F.struct(F.round(F.sqrt(square("lat") + square("lng")), 12), F.col("a_seg"), F.col("b_seg"))
    ends = F.struct(*[F.round(c, 5).alias(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")])
    best = found.groupBy("a_id", "b_id").agg(F.min("metres").alias("metres"), F.min_by(ends, rank).alias("e")).where("metres <= 4000")
    want = sorted(map(tuple, best.select("a_id", "b_id", "metres", "e.*").collect()))
    got = routes.route_links(df, 4000.0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500 and handed[-1].count() * 5 < handed[0].count()


@pytest.mark.parametrize("batch", [50, 20_000])
def test_corridors_of_routes(spark, handed, monkeypatch, batch):
    df, strip = bent(spark), 1600.0
    found = segment_pairs(df.where(F.size("route") > 1), strip)
    for stage in [*corridor.local("a", "b"), *corridor.inside("p", "q", "r", "s", "ia", strip), *corridor.inside("r", "s", "p", "q", "ib", strip)]:
        found = found.withColumns({k: F.expr(v) for k, v in stage.items()})
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_seg").alias("seg"), F.sqrt(f"i{s}_a").alias("length"), F.col(f"i{s}_first").alias("first"), F.col(f"i{s}_last").alias("last"))
    spans = found.select("a_id", "b_id", F.inline(F.array(side("a"), side("b"))))
    some = F.when((F.col("last") > F.col("first")) & (F.col("length") > 0), F.struct("first", "last"))
    per = spans.groupBy("a_id", "b_id", "side", "seg").agg(F.max("length").alias("length"), F.collect_list(some).alias("spans"))
    metres = F.coalesce(F.col("length"), F.lit(0.0)) * routes.covered(F.col("spans"))
    both = per.groupBy("a_id", "b_id").agg(*[F.sum(F.when(F.col("side") == s, metres).otherwise(0.0)).alias(s) for s in "ab"])
    want = {(r.a_id, r.b_id): min(r.a, r.b) / 1000 for r in both.collect()}
    monkeypatch.setattr(near, "ROWS", batch)
    rows = [(r.a_id, r.b_id, r.shared_km) for r in routes.route_corridors(df, strip).collect()]
    assert len(rows) == len(want) > 500 and {(a, b): pytest.approx(km, abs=1e-9) for a, b, km in rows} == want
    assert {"side", "first", "last", "length"} <= set(handed[-1].columns) and "a_lat1" not in handed[-1].columns
