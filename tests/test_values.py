"""Pairs carry what the wanted values are made of; land is measured for near routes alone; a sort doesn't search pairs twice."""

from planweave.operators import pairs, views
from planweave.plans.fixtures import AS_OF, projects, registry

DIR = "/root/testdata/sf0.001"
WANTED = ("pair_id", "shared_km", "total_low", "total_high", "if_aligned_low", "if_aligned_high")


def crowded(spark):
    """Projects drawn together, so that routes are near each other."""
    own = projects(spark, DIR)
    return own.withColumns({c: own[c] / 100 + (31 if c.startswith("la") else -81) for c in (*pairs.SHAPE, "lat", "lng")})


def test_land_is_valued_as_before_by_a_join_of_its_own(spark, monkeypatch):
    own, carried, join = crowded(spark), [], pairs.candidate_pairs
    monkeypatch.setattr(pairs, "candidate_pairs", lambda *a, **k: carried.append(k.get("wanted")) or join(*a, **k))
    got = pairs.overlaps(own, AS_OF, registry=registry(spark, DIR), facts=(), values=WANTED)
    want = pairs.overlaps(own, AS_OF, registry=registry(spark, DIR), facts=()).select(*WANTED)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 1000
    assert sum(r[1] is not None for r in rows) > 10 and sum(r[1] is None for r in rows) > 10
    assert "lat1" in carried[0] and "lat1" not in carried[1] and "type" not in carried[1]


def test_a_sort_reads_stored_pairs(spark):
    own = pairs.overlaps(projects(spark, DIR), AS_OF, registry=registry(spark, DIR), facts=(), values=("pair_id", "a_id", "b_id", "ratio", "gap_days"))
    assert own.columns == ["pair_id", "a_id", "b_id", "ratio", "gap_days"]
    ordered = views.in_order(own, "overlap")
    assert "MapInArrow" in own._jdf.queryExecution().toString() and "MapInArrow" not in ordered._jdf.queryExecution().toString()
    rows = [(-round(r.ratio, 4), r.gap_days, r.a_id, r.b_id) for r in ordered.collect()]
    assert rows == sorted(rows) and len(rows) == own.count() > 10
