"""What many ask alike is worked out once; the best pairs are searched tier after tier."""

from pyspark.sql import functions as F

from planweave.operators import lookup, pairs, place
from planweave.plans.fixtures import AS_OF, projects, registry

SF = "/root/testdata/sf0.001"


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    met, parse = [], lookup.parse_texts

    def watched(texts, companies):
        met.append(texts.count())
        return parse(texts, companies)

    monkeypatch.setattr(lookup, "parse_texts", watched)
    texts = ["TVA lines", "show me TVA in GA", None, ""]
    asked = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "id long, q string")
    got = lookup.parse_queries(asked, spark.createDataFrame([("TVA", 2)], "utility string, n long")).collect()
    assert met == [4] and sorted(r.id for r in got) == list(range(40)) and all(r.q == texts[r.id % 4] for r in got)
    assert all((r.utilities == ["TVA"]) == (r.id % 4 < 2) and (r.states == ["GA"]) == (r.id % 4 == 1) for r in got)


def test_entries_that_ask_the_same_are_placed_once(spark, monkeypatch):
    met, distinct = [], place.locate_distinct

    def watched(entries, *rest):
        met.append(entries.count())
        return distinct(entries, *rest)

    monkeypatch.setattr(place, "locate_distinct", watched)
    rows = [(i, ["Evans Tap"] if i % 3 else None, ["GA"], "TVA" if i % 2 else None) for i in range(30)]
    entries = spark.createDataFrame(rows, "id long, endpoints array<string>, states array<string>, operator string")
    stations = spark.createDataFrame([("GA", "Evans Substation", "substation", "X", 33.0, -82.0)], "state string, name string, power string, operator string, lat double, lng double")
    towns = spark.createDataFrame([], "name string, state string, lat double, lng double")
    rules = spark.createDataFrame([], "operator string, name string, lat double, lng double, state string, approximate boolean")
    got = {r.id: (r.lat, r.requires_review) for r in place.locate(entries, stations, towns, rules).collect()}
    assert met == [4] and got == {i: (33.0, False) if i % 3 else (None, True) for i in range(30)}


def test_best_pairs_need_not_all_pairs(spark, monkeypatch):
    near = {c: F.lit(33.0 if c < "ln" else -84.0) + F.col(c) / 40 for c in ("lat1", "lng1", "lat2", "lng2")}
    own, reg = projects(spark, SF).withColumns(near), registry(spark, SF)
    whole = pairs.overlaps(own, AS_OF, registry=reg).select("tier", "composite", "miles", "a_id", "b_id").cache()
    met, matched = [], pairs.matched

    def watched(*rest):
        found = matched(*rest)
        met.append(found)
        return found

    monkeypatch.setattr(pairs, "matched", watched)
    got = sorted(map(tuple, pairs.best_pairs(own, AS_OF, registry=reg).collect()))
    assert got == sorted(map(tuple, pairs.best_per_project(whole).collect())) and len({t for _, _, t in got}) > 1
    assert len(met) == 3 and sum(m.select("a_id").count() for m in met) < whole.count() / 2
