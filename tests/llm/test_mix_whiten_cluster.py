"""Mixing, whitening and clustering against brute force, and their defined results for odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import clustering, mixing, whitening

VECTORS = "vec_id long, embedding array<float>, cluster string, component string, n string"
DOCS = "doc_id long, text string, source string, size string, target string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, None) for i, v in rows], VECTORS)


def some_vectors(rng, n, dims, spread=1.0):
    centres = rng.normal(size=(5, dims))
    return [(i, [float(v) for v in centres[i % 5] * spread + rng.normal(size=dims) * 0.3]) for i in range(n)]


def whole(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


ODD = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 64), (-4, [float("inf")] * 64)]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    own = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, at_limit = {s: weights[i % 3] for i, s in enumerate(own)}, share * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in at_limit)) / max(1e-9, sum(weight[s] for s in own if s not in at_limit))
        above = {s for s in own if s not in at_limit and level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in at_limit else level * weight[s] for s in own}
        at_limit |= above


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), rng.choice(["a", "a", "a", "a", "b", "é", None, "Z"]), "x", None) for i in range(3000)]
    rows += [(3001, None, "a", "x", None), (3002, "\t \n", "b", "x", None), (3003, "w " * 30_000, "a", "x", None), (7, "w w", "b", "x", None), (7, "w w", "b", "x", None), (None, "w w w", "c", "x", None)]
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("block", [20_000, 100])
def test_mix_comes_near_its_targets(mixed, block, monkeypatch):
    rows, docs = mixed
    if block == 100:  # blocks of under 10,000 words can't make up for the text of 30,000
        rows, docs = [r for r in rows if r[0] != 3003], docs.where("doc_id IS NULL OR doc_id <> 3003")
    monkeypatch.setattr(mixing, "BLOCK", block)
    got = mixing.mix(docs, ["doc_id", "source", "text"]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, len((t or "").split())) for d, t, *_ in rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size and r.copies in (int(want[r.source] // max(1, sizes[r.source])), int(want[r.source] // max(1, sizes[r.source])) + 1) and r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in want.items():
        assert abs(taken[s] - n) <= max(2.0, 0.001 * n)
    again = mixing.mix(docs.repartition(7), ["doc_id"]).collect()
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in again if r.size != 2) == sorted((r.doc_id or -1, r.size, r.copies) for r in got if r.size != 2)


def test_flight_keeps_words_and_documents_and_its_probabilities():
    rng = random.Random(3)
    size, times = [rng.randint(0, 300) for _ in range(60)], np.zeros(60)
    for seed in range(400):
        p = [0.3] * 60
        left = mixing.flight(size, p, list(range(60)), random.Random(seed))
        assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
        assert sum(p) == pytest.approx(18) and np.dot(size, p) == pytest.approx(0.3 * sum(size))
        times += p
    assert np.abs(times / 400 - 0.3).max() < 0.12


def test_mix_of_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, "x", "y"), (2, "", "a", "x", "y")], DOCS)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    same = mixing.mix(spark.createDataFrame([(1, "w w w", "a", None, None)] * 10, DOCS)).collect()
    assert sum(r.taken for r in same) == 45 and {r.size for r in same} == {3}


def test_whitening_equals_eigenvectors(spark):
    rows = some_vectors(np.random.default_rng(5), 300, 24)
    table = rows + rows[:40] + ODD
    got = whitening.whiten(vectors(spark, table), components=4).collect()
    x = {tuple(whole(v)) for _, v in rows}
    xs = np.array(sorted(x), dtype=float)
    mean = xs.mean(axis=0)
    values, own = np.linalg.eigh((xs - mean).T @ (xs - mean) / len(xs))
    sums = [sum(v[j] for v in x) for j in range(24)]
    by = dict(rows)
    assert len(got) == 340 * 4
    signs = {}
    for r in got:
        v = whole(by[r.vec_id])
        assert r.n == len(x) and r.deviation == sum((len(x) * a - s) ** 2 for a, s in zip(v, sums))
        want = (np.array(v) - mean) @ own[:, -r.component] / np.sqrt(values[-r.component])
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened * sign == pytest.approx(want, abs=1e-9)
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


def test_whitening_filters_a_wide_space(spark):
    """More dimensions than the block holds, so that the pairs come from the filter."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=80) * np.linspace(1, 2, 80)]) for i in range(400)]
    model = whitening.fit(vectors(spark, rows).select(whitening.integers(F.col("embedding")).alias("x")), 4)
    xs = np.array([whole(v) for _, v in rows], dtype=float)
    values, own = np.linalg.eigh(np.cov(xs.T, bias=True))
    assert model.variances == pytest.approx(values[::-1][:4], rel=1e-12) and model.residual < 1e-12
    assert np.abs(np.abs(np.diag(model.components.T @ own[:, ::-1][:, :4])) - 1).max() < 1e-12


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, ODD)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).collect() == []  # no variance
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [1e30, 0.0])])).collect()
    assert sorted({r.vec_id for r in got}) == [1, 2, 3, 4] and {r.n for r in got} == {4}


def brute_clusters(rows, dims, k, rounds):
    own = [(i, whole(v)) for i, v in rows if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    h = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [list(v) for _, v in sorted(own, key=lambda r: (h(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in own]
        for j in range(len(centres)):
            if members := [v for (_, v), a in zip(own, at) if a == j]:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    found = [(i, *near(v)[::-1]) for i, v in own]
    total = sum(d for _, _, d in found)
    return sorted((i or -9, j, d, sum(e for _, c, e in found if c == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize("k", [1, 2, 11])
def test_clusters_equal_plain_rounds(spark, k):
    rows = some_vectors(np.random.default_rng(k), 250, 6, 0.5)
    rows = rows + rows[:30] + [(None, [0.0] * 6), (900, [0.0] * 6), (901, [0.0] * 5), (902, [0.5] * 6), (903, [0.5] * 6)] + ODD
    got = clustering.kmeans(vectors(spark, rows), dims=6, k=k).collect()
    assert sorted((r.vec_id or -9 if r.vec_id != 0 else -9, r.cluster, int(r.distance), int(r.cluster_inertia), int(r.inertia), r.centroid_sha256) for r in got) == brute_clusters(rows, 6, k, 5)


def test_the_search_finds_both_and_looks_at_few():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-900, 900, size=(200, 4))
    centroids[17] = centroids[5]  # a tie
    x = np.repeat(centroids, 10, axis=0) + rng.integers(-40, 40, size=(2000, 4))
    own = np.array([clustering.squared(centroids, v) for v in x])
    rank = np.lexsort((np.tile(np.arange(200), (2000, 1)), own), axis=1)
    guess = np.arange(2000) // 10
    near, second, d1, d2, seen = clustering.search(x, guess, (guess + 1) % 200, centroids, *clustering.neighbours(centroids))
    assert (near == rank[:, 0]).all() and (d1 == own.min(axis=1)).all() and (d2 == np.sort(own, axis=1)[:, 1]).all()
    assert seen < 0.2 * own.size


def test_clusters_of_odd_tables(spark):
    assert clustering.kmeans(vectors(spark, ODD)).collect() == []
    got = clustering.kmeans(vectors(spark, [(1, [1e30, -1e30]), (2, [0.0, 0.0])]), dims=2).collect()
    assert sorted((r.vec_id, int(r.distance)) for r in got) == [(1, 0), (2, 0)]
