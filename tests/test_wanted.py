"""Pairs leave the join with the columns that a query shows or scores by, and no more; names are read once, not once a project."""

import pytest
from pyspark.sql import functions as F

from planweave.functions import owners
from planweave.operators import pairs
from planweave.plans import registry
from planweave.plans.fixtures import projects

SF = "/root/testdata/sf0.001"
CARRIED = {
    "pair_counts_by_state": {"state"}, "pairs_in_view": set(), "pairs_listed": set(), "pair_partners": {"company"}, "pairs_in_bands": set(), "pairs_of_projects": {"type", "voltage_kv", "build_start", "build_end"},
    "export_pairs": {"state", "utility", "type", "voltage_kv", "build_start", "build_end"}, "shared_corridors": {*pairs.SHAPE},
    "pair_briefs": {"company", "type", "voltage_kv", "cost_usd", "routed", "build_start", "build_end"}, "export_rows": {"company", "name", "utility", "type", "voltage_kv", "cost_usd", "routed", "build_start", "build_end"},
}


@pytest.mark.parametrize("name", sorted(CARRIED))
def test_pairs_carry_what_is_wanted(spark, monkeypatch, name):
    met, join = [], pairs.candidate_pairs

    def watched(*args, **kwargs):
        met.append(join(*args, **kwargs))
        return met[-1]

    monkeypatch.setattr(pairs, "candidate_pairs", watched)
    registry.QUERIES[name](spark, SF)
    sides = {c[2:] for c in met[-1].columns if c[:2] == "a_"}  # of two joins the last one holds most pairs
    assert sides - {"id", "both"} == CARRIED[name]


def test_names_are_read_once(spark, monkeypatch):
    read, canonical = spark.sparkContext.accumulator(0), owners.canonical_utility

    def counted(name):
        read.add(1)
        return name

    monkeypatch.setattr(owners, "canonical_utility", lambda c: canonical(F.udf(counted, "string")(c)))
    registry.QUERIES["pair_partners"](spark, SF).collect()
    n, every = projects(spark, SF).select("utility").distinct().count(), projects(spark, SF).count()
    assert n <= read.value < every
