"""Leaders of posting lists: the lists of one group agree on them."""

from planweave.llm import near_dedup


def test_a_node_meets_few_leaders_however_many_lists_it_is_in(spark):
    own = spark.createDataFrame([(key, node, node % 7, node) for key in range(26) for node in range(key % 3, 100)], "key long, node long, common long, comp long")
    for round_ in (0, 1, 2):
        met = near_dedup.meet_leaders(own, round_).collect()
        assert all(r.node != r.leader for r in met) and {r.node for r in met} >= set(range(100)) - {r.leader for r in met}
        assert len(met) <= 100 * 6
    one = own.withColumn("comp", own.node * 0)
    assert near_dedup.meet_leaders(one, 1).isEmpty()
