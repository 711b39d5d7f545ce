"""What decides on pairs is decided before the join: the join gets a narrower radius, or a side with fewer projects."""

from planweave.operators import pairs, views
from planweave.plans.fixtures import AS_OF, projects, registry

SF = "/root/testdata/sf0.001"


def test_the_join_gets_less(spark, monkeypatch):
    met, candidate_pairs = [], pairs.candidate_pairs

    def watched(own, radius_m=pairs.RADIUS_M, extra=None, others=None):
        met.append((radius_m, others is not None))
        return candidate_pairs(own, radius_m, extra, others)

    monkeypatch.setattr(pairs, "candidate_pairs", watched)
    own, reg = projects(spark, SF), registry(spark, SF)
    views.pairs_in_bands(own, AS_OF, ["touching", "under_8"], reg)
    views.pairs_touching(own, AS_OF, own.lat1 > 30, reg)
    views.pairs_listed(own, AS_OF, " Jasper", ["TVA", "JEA"], reg)
    assert met == [(8000.0, False), (pairs.RADIUS_M, True), (pairs.RADIUS_M, True)]
