"""The registered queries of the training-data operators and the pipeline: against their SQL, or a brute-force version."""

import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from planweave.llm import queries, toxicity
from planweave.llm.common import table
from tests.llm.test_operators import brute_classes, brute_lines
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for f in os.listdir(SF):
        own.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return own


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    own = QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in own.select(columns).collect()), key=repr) == want


def test_op3_returns_every_page_without_markup(spark, duck):
    pages = dict(duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    got = QUERIES["op3_html_extraction"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.text == " ".join(r.text.split())
        article = re.search(r"(?s)<article.*?</article>", pages[r.page_id])
        if article:  # every word of the article's paragraphs is there
            inside = " ".join(re.findall(r"(?s)<p>([^<&]*)</p>", re.sub(r"(?s)<(aside|nav|form|header|footer|script|style).*?</\1>|<div[^>]*class.*?</div>", "", article[0])))
            assert set(inside.split()) <= set(r.text.split())


def test_op6_held_out_rows(spark, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op6_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(held) >= 0.95 * len(held)


def test_op7_packs_every_token_once(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = QUERIES["op7_best_fit_packing"](spark, SF).toPandas()
    for doc, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc].sort_values("piece")
        assert [(r.start, r.length, r.ids_crc32) for r in own.itertuples()] == [(k, len(p := ids[k : k + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))) for k in range(0, len(ids), 2048)]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and (own.offset == own.length.cumsum() - own.length).all()
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1


def test_op8_scores_every_document(spark, duck):
    labels = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    clean = [got[i].predicted for i, y in labels.items() if y == 0 and i in got]
    assert sum(clean) <= 0.05 * len(clean)


def test_op9_is_brute_force(spark, docs):
    got = QUERIES["op9_minhash_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op10_is_brute_force(spark, docs):
    got = QUERIES["op10_line_dedup"](spark, SF).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, zip([d for d, _ in docs], brute_lines(docs, 51))))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items):
    own, hit = words(text), set()
    at = {}
    for n in {n for n, _ in items}:
        for p in range(len(own) - n + 1):
            at.setdefault(tuple(own[p : p + n]), []).append((p, n))
    for _, window in items:
        for p, n in at.get(window, ()):
            hit |= set(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_the_pipeline_is_its_stages_by_brute_force(spark, duck):
    pytest.importorskip("public_tokenizers")
    source = table(spark, SF, "documents")
    model = toxicity.fit(source, table(spark, SF, "labels").where(~queries.held_out(5, 0)))
    toxic = {r.doc_id for r in toxicity.score(source, model).where("score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in source.collect() if r.doc_id not in toxic]
    cut = brute_lines(rows, 51)
    rows = [(d, new) for (d, old), new in zip(rows, cut) if new == old or (new or "").split()]
    classes = brute_classes(rows, corpus_pipeline.NEAR_PERCENT)
    rows = [(d, t) for (d, t), (_, n, comp) in zip(rows, classes) if d == comp or not n]
    bench = [words(t) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    items = {(n := min(13, len(v)), tuple(v[s : s + n])) for v in bench if v for s in range(len(v) - min(13, len(v)) + 1)}
    want = sorted(d for d, t in rows if not contaminated(t, items))
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(set(got.doc_id)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and (own.offset == own.length.cumsum() - own.length).all()
    for _, own in got.sort_values("piece").groupby("doc_id"):
        assert own.piece.tolist() == list(range(len(own))) and (own.start == own.length.cumsum() - own.length).all()
