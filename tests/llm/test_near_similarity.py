import random

import corpus_pipeline
from planweave.llm import near_dedup
from planweave.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pair(rng, words, same):
    """Two texts of so many five-word shingles, the first ``same`` words of them alike."""
    own = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    return " ".join(own), " ".join(own[:same] + [f"x{rng.randrange(10**9)}" for _ in range(words - same)])


def test_the_pipeline_drops_near_copies_from_80_percent_on(spark):
    rng = random.Random(19)
    texts = []
    for _ in range(30):  # 180 of 220 shingles alike: 0.818; 176 of 224: 0.786
        texts += [*pair(rng, 204, 184), *pair(rng, 204, 180)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    gone = [i for i in range(len(texts)) if i % 4 == 1]
    path = new_path(spark, "near-test")
    docs.coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == [i for i in range(len(texts)) if i not in gone]
    assert near_dedup.near_dedup(docs).where("kept").count() == len(texts)
