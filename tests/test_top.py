"""The best pairs are searched tier after tier, no farther than it takes."""

from planweave.operators import pairs, views
from planweave.plans.fixtures import AS_OF, projects, registry

DIR = "/root/testdata/sf0.001"


def test_top_pairs_need_not_all_pairs(spark, monkeypatch):
    own = projects(spark, DIR)
    own = own.withColumns({c: own[c] / 60 + (31 if c.startswith("la") else -81) for c in (*pairs.SHAPE, "lat", "lng")}).cache()
    reg = registry(spark, DIR)
    whole = pairs.overlaps(own, AS_OF, registry=reg).cache()
    met, join = [], pairs.candidate_pairs
    monkeypatch.setattr(pairs, "candidate_pairs", lambda df, radius_m, *a, **k: met.append(round(radius_m)) or join(df, radius_m, *a, **k))
    rows = lambda df: [(r.pair_id, r.tier, r.miles) for r in df.collect()]
    far = round(pairs.RADIUS_M)
    for asked, reach in ((("Georgia Power", "GA", 3), [1600]), (("TVA", None, 20), [1600, 8000]), ((None, "FL", 20), [1600]), (("Nobody", "GA", 2), [1600, 8000, 40000, far]), ((None, None, 5), [1600])):
        met.clear()
        got = rows(views.top_pairs_of(own, AS_OF, *asked, reg))
        assert got == rows(views.top_pairs(whole, *asked)) and met == reach[: len(met)] and len(got) == (asked[2] if asked[0] != "Nobody" else 0), (asked, met)
        assert asked[0] != "Nobody" or met == reach
    assert whole.where("tier <= 1").count() < whole.count() / 10
