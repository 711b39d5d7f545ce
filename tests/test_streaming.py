import json

from planweave.operators import maintenance
from planweave.plans.fixtures import projects
from planweave.operators import views
from planweave.streaming import jobs, store


def test_stream_of_sources_is_the_batch(spark, tmp_path):
    for name, rows in (("a", [("s1", 1), ("s1", 2), ("s2", 3)]), ("b", [("s1", 9), ("s3", 4)])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"source_key": s, "id": i}) + "\n" for s, i in rows))
        jobs.stream_plans(spark, str(tmp_path / "in"), "source_key string, id long", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.source_key, r.id) for r in jobs.current(spark, str(tmp_path / "out")).collect())
    assert got == [("s1", 9), ("s2", 3), ("s3", 4)]


def test_last_patch_of_a_batch_counts(spark, tmp_path):
    own = projects(spark, "/root/testdata/sf0.001").where("id < 20")
    jobs.put(own, str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    rows = [{"id": 5, "ts": 1, "cost_usd": 1}, {"id": 5, "ts": 3, "cost_usd": 3}, {"id": 5, "ts": 2, "cost_usd": 2}, {"id": 7, "ts": 1, "end_date": "1990-01-01"}]
    (tmp_path / "in" / "p.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    kinds = "id long, ts long, lat double, lng double, start_date date, end_date date, cost_usd long"
    jobs.stream_patches(spark, str(tmp_path / "in"), kinds, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.id: r for r in jobs.current(spark, str(tmp_path / "out")).collect()}
    assert got[5].cost_usd == 3 and len(got) == own.count()
    patch = spark.createDataFrame([(5, None, None, None, None, 3)], "id long, lat double, lng double, start_date date, end_date date, cost_usd long")
    after, _ = maintenance.apply_patches(own, patch)
    assert sorted(map(str, (r for r in after.collect() if r.id != 7))) == sorted(map(str, (r for i, r in got.items() if i != 7)))


KINDS = "id long, ts long, lat double, lng double, end_date date, cost_usd long"


def test_patches_and_briefs_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    own = projects(spark, "/root/testdata/sf0.001").where("id < 400")
    pairs_ = [r for r in own.where("lat1 IS NOT NULL").select("id").collect()][:6]
    briefs = spark.createDataFrame([(f"{a.id}-{b.id}", a.id, b.id, 1.0, 30, 9999, False) for a, b in zip(pairs_, pairs_[1:])], "pair_id string, a_id long, b_id long, miles double, overlap_days int, radius int, stale boolean")
    folder = str(tmp_path / "out")
    jobs.put(own, folder)
    jobs.put(briefs, folder, "briefs")
    (tmp_path / "in").mkdir()
    edits = [{"id": pairs_[1].id, "ts": 1, "lat": 34.0, "lng": -84.0}, {"id": pairs_[4].id, "ts": 1, "cost_usd": 5}]
    run = lambda: jobs.stream_patches(spark, str(tmp_path / "in"), KINDS, folder, str(tmp_path / "ck"), "1999-01-01").awaitTermination()
    (tmp_path / "in" / "p.json").write_text("".join(json.dumps(e) + "\n" for e in edits))
    before = store.pointer(spark, folder)
    with monkeypatch.context() as m:  # the process dies between the tables and the pointer

        def lost(*_):
            raise OSError("gone")

        m.setattr(store, "move_pointer", lost)
        try:
            run()
            raise AssertionError("no failure came through")
        except Exception as e:
            assert "gone" in str(e)
    assert store.pointer(spark, folder) == before and {r.stale for r in jobs.current(spark, folder, "briefs").collect()} == {False}
    run()
    run()  # nothing new
    patches = spark.createDataFrame([(e["id"], e["ts"], e.get("lat"), e.get("lng"), None, e.get("cost_usd")) for e in edits], KINDS)
    want = jobs.patched(own, briefs, patches, "1999-01-01")
    for name, df in want.items():
        assert sorted(map(str, jobs.current(spark, folder, name).collect())) == sorted(map(str, df.collect()))
    left = {r.pair_id for r in jobs.current(spark, folder, "briefs").collect()}
    assert left <= {r.pair_id for r in briefs.collect()}
    now = {r.pair_id for r in views.briefed_pairs(briefs, want["projects"], "1999-01-01").collect()}
    touched = {f"{a.id}-{b.id}" for a, b in zip(pairs_, pairs_[1:]) if {a.id, b.id} & {e["id"] for e in edits}}
    assert left == {r.pair_id for r in briefs.collect()} - (touched - now)


def test_a_batch_that_comes_again_and_old_versions(spark, tmp_path):
    folder = str(tmp_path / "out")
    frame = lambda n: spark.createDataFrame([(n,)], "n int")
    for n in range(4):
        store.commit(spark, folder, {"projects": frame(n)}, "s", n)
    store.commit(spark, folder, {"projects": frame(99)}, "s", 2)
    assert jobs.current(spark, folder).first().n == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")) == ["v-s-2", "v-s-3"]
    assert jobs.current(spark, str(tmp_path / "nothing")) is None
