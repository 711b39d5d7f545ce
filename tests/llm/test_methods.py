"""The methods themselves against naive versions, and the rows that are easily mishandled."""

import itertools
import random
import time

import numpy as np
import pytest

from planweave.llm import decontamination, html_extract, language_id, line_dedup, near_dedup, packing, quality_rules, toxicity, warc
from planweave.llm.common import new_path
from tests.llm.test_operators import brute_classes, frame, prose

LONG = "Long running text of the page. " * 13


def test_forward_backward_is_the_sum_over_all_labelings():
    rng = np.random.default_rng(1)
    field = language_id.Field(["a", "b", "c"], [], transitions=rng.normal(size=(3, 3)), start=rng.normal(size=3))
    for n in (1, 2, 5):
        e, moves = rng.normal(size=(n, 3)), np.zeros((3, 3))
        (got,) = language_id.posteriors([e], field, moves)
        want, pairs, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for y in itertools.product(range(3), repeat=n):
            p = np.exp(field.start[y[0]] + sum(e[t, k] for t, k in enumerate(y)) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
            total += p
            for t, k in enumerate(y):
                want[t, k] += p
            for a, b in zip(y, y[1:]):
                pairs[a, b] += p
        assert np.allclose(got, want / total, atol=1e-4) and np.allclose(moves, pairs / total, atol=1e-3)


def test_all_of_a_long_word_and_of_a_long_text_is_seen():
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    links, owner = language_id.links_of(f"one ({word}), two")
    assert "".join(links[1:-1]) == word and max(map(len, links)) <= language_id.PIECE and owner[1] == owner[-2] == 1 and owner[-1] == 2
    field = language_id.train([["kala", "mina"] * 20, ["ostr", "ubyk"] * 20], [0, 1], ["k", "o"])
    text = "kala mina " * 40_000 + "ostr ubyk " * 90_000  # 260,000 words: most of them at the end
    assert language_id.predict([text, "ostrubyk" * 40, None, "12"], language_id.Emitter(field))[0] == ["o", "o", "und", "und"]
    (runs,) = language_id.spans([text], language_id.Emitter(field))
    assert [r[0] for r in runs] == ["k", "o"] and runs[0][2] == 79_999


def naive_split(x, y, w, p):
    """Gain of the best split of one feature by trying every threshold."""
    g, h = w * (y - p), w * p * (1 - p)
    best = (-1.0, None)
    for t in sorted(set(x))[:-1]:
        left = x <= t
        gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
        best = max(best, (gain, t))
    return best


def test_a_tree_splits_where_trying_every_threshold_does():
    rng = np.random.default_rng(2)
    for _ in range(5):
        x = rng.integers(0, 12, 60).astype(float)
        y = (x + rng.normal(0, 2, 60) > 6).astype(float)
        w = rng.uniform(0.5, 2, 60)
        model = toxicity.boost(x[:, None], y, w, trees=1, depth=1)
        p = np.full(60, np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
        left = toxicity.Boosted.bins(model, x[:, None])[:, 0] <= model.trees[0][1]
        g, h = w * (y - p), w * p * (1 - p)
        gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
        assert abs(gain - naive_split(x, y, w, p)[0]) < 1e-9


def test_isotonic_is_the_min_max_of_means():
    rng = np.random.default_rng(3)
    m, y, w = rng.permutation(40).astype(float), rng.integers(0, 2, 40).astype(float), rng.uniform(0.5, 2, 40)
    knots, values = toxicity.isotonic(m, y, w)
    order = np.argsort(m)
    mean = lambda a, b: (w[order][a:b] * y[order][a:b]).sum() / w[order][a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9))) and values == sorted(values) and knots == sorted(knots)


def test_labels_that_contradict_and_rows_that_repeat(spark):
    rng = random.Random(4)
    texts = [prose(rng, 30) + (" vile scum" if i % 3 == 0 else "") for i in range(90)]
    docs = frame(spark, [*enumerate(texts), (3, texts[3]), (None, None)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumnRenamed("size", "score"), model, ["doc_id", "score", "n_words"])
    assert got.columns == ["doc_id", "n_words", "score"] and got.count() == 92
    scores = [r.score for r in got.where("doc_id = 3").collect()]
    assert len(scores) == 2 and scores[0] == scores[1] > 0.5
    assert toxicity.score(frame(spark, []), model).count() == 0


def naive_smooth(ratios, groups, sigma):
    out = []
    for i in range(len(ratios)):
        near = [(np.exp(-((i - j) ** 2) / (2 * sigma**2)), ratios[j]) for j in range(len(ratios)) if abs(i - j) <= 3 * sigma and groups[i] == groups[j]]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def naive_cluster(lines, sigma=html_extract.SIGMA, share=html_extract.SHARE):
    s = np.array(naive_smooth([len(x.text) / (1 + x.tags) * (html_extract.BOOST if x.region else 1) for x in lines], [(x.part, x.region or -x.box) for x in lines], sigma))
    return [bool(x >= share * (s.mean() + s.std()) / 2) for x in s]


PAGES = {
    # no article: lines of links before and after the text, in boxes of their own
    "bare": f"<div>{'<p><a href=x>go</a> <a href=y>on</a>' * 12}</div><section><p>{LONG}<p>{LONG}</section><div>{'<p><a href=x>go</a> <a href=y>on</a>' * 9}</div>",
    # articles hold teasers alone, the text stands in a section
    "misleading": "".join(f"<article><div><a href=x>See</a> <b>it</b> <i>{k}</i></div></article>" for k in range(9)) + f"<section><p>{LONG}<p>{LONG}<p>{LONG}</section>",
    "article": f"<article><h1>Head</h1><p>{LONG}<p>Short.</article>",
}


def test_regions_come_from_the_clustered_ratios(monkeypatch):
    two = (LONG.strip() + " ") * 2
    want = {"bare": two.strip(), "misleading": (two + LONG).strip(), "article": f"Head {LONG.strip()} Short."}
    assert {k: html_extract.extract(p) for k, p in PAGES.items()} == want
    for page in PAGES.values():
        lines = html_extract.lines_of(page)
        assert html_extract.cluster(lines) == naive_cluster(lines)
    monkeypatch.setattr(html_extract, "cluster", lambda lines, *_: [True] * len(lines))  # the method switched off
    assert {k for k, p in PAGES.items() if html_extract.extract(p) != want[k]} == {"bare", "misleading"}


def test_time_of_a_page_grows_with_its_length():
    def took(k):
        best = 9e9
        for page in ("<div>" + "<b>x" * k + "</i>" * k + "</b>" * k, "<i><div>" + "<b>x" * k + "</i>" * k, "<div>" * k + "deep"):
            begun = time.process_time()
            html_extract.extract(page)
            best = min(best, time.process_time() - begun)
        return best

    assert took(40_000) < 24 * max(took(5_000), 0.002)


def test_pages_of_clashing_columns_and_none(spark):
    rows = [(1, "u", f"<p>{LONG}", "t"), (1, "u", f"<p>{LONG}", "t"), (2, "u", "<p>" + "word " * 400_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.main_text(pages, ["page_id", "text"])
    assert got.columns == ["page_id", "text"] and [len(r.text) for r in got.collect()] == [len(LONG) - 1] * 2 + [1_999_999]
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_fewer_fingerprints_than_lines_and_no_result_without_them(spark, monkeypatch):
    rng = random.Random(5)
    shared = [prose(rng, 14) for _ in range(6)]
    docs = frame(spark, ["\n".join([prose(rng, 12) for _ in range(5)] + shared + [prose(rng, 12) for _ in range(5)]) for _ in range(20)]).coalesce(1)
    numbered = line_dedup.number_rows(docs, ["doc_id", docs.doc_id.alias("id_"), docs.text.alias("text_")])
    lines = line_dedup.hash_lines(numbered, 51)
    posted = line_dedup.fingerprints(lines, 51)
    assert posted.count() < 20 * 16 * 0.7 and posted.count() == posted.select("row_", "position").distinct().count()
    assert line_dedup.line_dedup(docs).where("n_deleted_lines = 6").count() == 19
    monkeypatch.setattr(line_dedup, "joined_positions", lambda own: line_dedup.fingerprints(lines, 51).limit(0).selectExpr("row_", "array(position) AS positions"))
    assert line_dedup.line_dedup(docs).where("n_deleted_lines > 0").count() == 0


def test_line_dedup_of_clashing_columns(spark):
    got = line_dedup.line_dedup(frame(spark, ["x", None]), ["doc_id", "text", "n_words", "size"])
    assert got.columns == ["doc_id", "n_words", "size", "text", "n_lines", "n_deleted_lines", "n_deleted_words"] and got.count() == 2


def test_words_repeated_in_item_and_document_cost_their_number(spark):
    query = decontamination.Query([("x", [b"a"] * 3000)], {b"a": 9000}, 13)
    hits = list(query.matches({b"a": list(range(9000))}))
    assert len(hits) == 9000 - 12
    got = decontamination.find_contamination(frame(spark, ["a " * 300_000, "a " * 12, ""]), spark.createDataFrame([(1, "A " * 40), (1, "A " * 40)], "item_id long, text string"), ["doc_id", "n_words"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == [(300_000, 300_000, ["1"]), (12, 0, []), (0, 0, [])]
    assert decontamination.find_contamination(frame(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_a_large_group_of_near_copies_costs_its_size(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(2000):
        own = list(base)
        for _ in range(rng.choice((1, 1, 1, 2))):
            own[rng.randrange(60)] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(own))
    texts += [" ".join(base)] + [prose(rng, 40) for _ in range(50)]
    rows = list(enumerate(texts))
    made = {}
    real = near_dedup.materialize

    def counted(df, what="table", n=None):
        out = real(df, what, n)
        made[what] = made.get(what, 0) + (out.count() if what.startswith(("pairs", "rest")) else 0)
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(rows))
    assert sum(made.values()) < 8 * len(rows)


def test_a_chain_of_near_copies_is_one_class(spark):
    rng = random.Random(8)
    own, texts = prose(rng, 120).split(), []
    for _ in range(60):  # each text links with its neighbours alone
        own = own[3:] + prose(rng, 3).split()
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(rows)) and {r.component_id for r in got} == {0}


def naive_two_fit(lengths, size):
    """Best-two-fit by trying all pairs."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], size
        while fit := [n for n in left if n <= gap]:
            n = max(fit)
            left.remove(n)
            own.append(n)
            gap -= n
        if gap and left:
            n = own[-1]
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[:i] if n < a + b <= gap + n]
            if pairs:
                _, a, b = max(pairs)
                own[-1:] = [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, n])
        bins.append(sum(own))
    return bins


def test_fill_is_best_two_fit():
    rng = random.Random(10)
    for _ in range(30):
        lengths = sorted(rng.randint(1, 60) for _ in range(rng.randint(1, 60)))
        bins = packing.fill(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in b) for b in bins) == sorted(naive_two_fit(lengths, 100))


def test_tokens_of_every_latin_letter_and_of_long_texts(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    own = packing.word_ids(None)
    letters = "".join(map(chr, range(0xA0, 0x180)))
    texts = [*(f"{c}x x{c} A{c}b{c.upper()}{c.lower()}, {c}" for c in letters), "á b", "it's IT'S, ... !? x!? K 123abc", "", "İstanbul.", "ŉ ß ẞ\r\n\tx\x0b"]
    want = [np.asarray(own.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(own.of_batch(pa.array(texts))) == want
    monkeypatch.setattr(packing, "SEGMENT", 40)  # many blocks, and texts longer than one
    assert list(own.of_batch(pa.array(texts))) == want
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    assert list(own.of_batch(pa.array(texts))) == want and len(own.cores) <= 60


def test_very_long_and_repeated_texts_of_the_native_operators(spark):
    long = "the quick word " * 200_000
    got = quality_rules.quality_rules(frame(spark, [(1, long), (1, long), (2, "THE OF And " * 30 + "x y z q")])).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_repeat_words) for r in got[:2]] == [(600_000, 600_000)] * 2 and got[2].stop_ratio > 0.9


def test_an_archive_that_lost_a_record_fails(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u" * 120_000 if i == 1 else "u", "x" * 2000) for i in range(4)], "page_id long, url string, html string")
    assert warc.archive_and_read(pages).count() == 4
    real = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda a, **k: real(a, **k).where("record_type <> 'response'"))
    with pytest.raises(ValueError):
        warc.archive_and_read(pages).count()
    assert new_path(spark, "x") != new_path(spark, "x")


def test_the_second_hash_of_a_text_is_not_made_of_the_first(spark):
    """A hash that is seeded with the first one's value, as of (text, 1), says nothing of its own."""
    from pyspark.sql import functions as F

    from planweave.llm.common import text_key

    rows = spark.range(200).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text_")).select("text_", *text_key())
    assert rows.where(F.col("t2") == F.expr("xxhash64(1, text_)")).count() == 200
    assert rows.where(F.col("t2") == F.expr("xxhash64(text_, 1)")).count() == 0
