import random
import zlib
from collections import defaultdict

import pytest

from planweave.llm import chat_format, decontamination, html_extract, language_id, line_dedup, near_dedup, packing, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string"
VOWELS, STEMS = "aeiou", {"en": "the of and to".split(), "de": "der die und zu".split()}


def frame(spark, texts):
    """Documents with columns of clashing names; (id, text) or text."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", None, None, "x", None) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_classes(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_dedup_is_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "  \t ", "one two", "One  TWO", "one two three four five"]
    for _ in range(8):
        words = prose(rng, 160).split()
        texts.append(" ".join(words))
        for k in (0, 1, 1, 2, 3, 4):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(len(own))] = "edit%d" % rng.randrange(10**6)
            texts.append(" ".join(own).upper() if k == 0 else " ".join(own))
    texts += [prose(rng, 3000)] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes(rows))
    assert all(r.kept == (r.doc_id == r.component_id) == r.first for r in got)


def test_near_dedup_rows_of_one_id_and_none(spark):
    text = prose(random.Random(1), 40)
    got = near_dedup.near_dedup(frame(spark, [(None, text), (4, text), (4, text), (None, None)])).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(map(str, [(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True)]))
    assert sum(r.first for r in got if r.n_shingles) == 1
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def brute_lines(rows, least):
    """Lines in spans of at least ``least`` words that stand at an earlier place."""
    first, gone = {}, defaultdict(set)
    own = {i: [(k, x.strip(), len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for i, (_, t) in enumerate(rows)}
    for i in sorted(own, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        for a in range(len(own[i])):
            for b in range(a, len(own[i])):
                n = [x[2] for x in own[i][a : b + 1]]
                if sum(n) >= least and (sum(n) - n[0] < least or sum(n) - n[-1] < least):
                    f = first.setdefault(tuple(x[1] for x in own[i][a : b + 1]), (i, a, b))
                    if f != (i, a, b) and (f[0] != i or a > f[2]):
                        gone[i] |= set(range(own[i][a][0], own[i][b][0] + 1))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, (_, t) in enumerate(rows)]


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(rng, n) for n in (3, 8, 12, 20, 55, 60, 2, 30)] + ["", " "]
    rows = [(k // 2 if k % 7 else None, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for k in range(40)] + [(900, None), (901, ""), (902, "\n".join(["same words here"] * 80)), (903, prose(rng, 5000))]
    got = line_dedup.line_dedup(frame(spark, rows).coalesce(1), ["doc_id", "size"])
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, zip([d for d, _ in rows], brute_lines(rows, 51))))
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_packing_fits_and_is_close_to_the_bound(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(7)
    texts = [None, "", "  ", "It's <|endoftext|> naïve café №5 ﬁ ẞ İstanbul é 日本語!!?", "a\x1cb c d\te", prose(rng, 9000)] + [prose(rng, rng.randint(1, 350)) for _ in range(200)] + ["same words"] * 5
    got = packing.pack(packing.tokenize(frame(spark, texts), with_ids=True), bucket=50).toPandas()
    want = []
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
        own = got[got.doc_id == i].sort_values("piece")
        assert [x for part in own.ids for x in part] == ids
        assert own.ids_crc32.tolist() == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length)) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and (own.offset == own.length.cumsum() - own.length).all()
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1
    assert packing.best_fit_packing(frame(spark, [])).count() == 0


def test_two_fit_replaces_the_smallest():
    bins = packing.fill([60, 25, 20, 18], 100)  # greedy takes 60, 25 and leaves 15; 20 + 18 fit the gap of 40 better
    assert sorted(sorted(b) for b in bins) == [[0, 2, 3], [1]]


def test_decontamination_is_brute_force_in_blocks_too(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 13, 14, 5, 1, 40))] + [(10, None), (11, "..."), (2, prose(rng, 13)), (None, "zzz qqq")]
    texts = [None, "", "Zzz, QQQ!"]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            parts += [" ".join(own[a : a + rng.choice((5, 13, 40))]).title(), prose(rng, rng.randint(0, 30))]
        texts.append(" - ".join(parts))
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in enumerate(texts):
        w, hit, who = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        who.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 300):
        got = decontamination.find_contamination(frame(spark, texts), bench, ["doc_id", "size"], block_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
    assert decontamination.find_contamination(frame(spark, texts), bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    near = decontamination.find_contamination(frame(spark, [items[1][1].replace(" ", " extra ", 1)]), bench, slop=1).first()
    assert near.n_hit == sum(1 for w in words(items[1][1]) if w == items[4][1]) and "1" in near.near_items


def test_toxicity_learns_and_handles_bad_rows(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(400)]
    bad = [rng.random() < 0.3 for _ in texts]
    texts = [t + " " + rng.choice(["you idiot", "total m0ron scum", "IDIOT!!! scum"]) if b else t for t, b in zip(texts, bad)] + [None, "", "x " * 50_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad) if i % 5] + [(9999, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.5) == b for i, b in enumerate(bad) if i % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert max(got[400], got[401], got[402]) < 0.5
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score <> 0").count() == 0


def test_language_of_texts_and_of_spans(spark):
    rng = random.Random(13)
    make = lambda k, n: " ".join(rng.choice(STEMS[k]) if rng.random() < 0.4 else prose(rng, 1) + {"en": "ing", "de": "keit"}[k] for _ in range(n))
    rows = [(i, make(k := "en" if i % 2 else "de", rng.randint(5, 80)), k) for i in range(160)]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34 ...", None), (902, "", "de")], "doc_id long, text string, lang string")
    field = language_id.fit(docs.where("doc_id % 4 <> 2 or doc_id >= 900"))
    got = {r.doc_id: r for r in language_id.identify(docs, field).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 0.98 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    (runs,) = language_id.spans([make("en", 40) + " " + make("de", 40)], language_id.Emitter(field))
    assert runs[0][0] == "en" and runs[-1][0] == "de" and abs(runs[0][2] - 39) <= 3
    assert language_id.identify(docs, language_id.fit(docs.where("lang is null"))).where("lang_pred <> 'und'").count() == 0


def test_quality_counts_repeats_and_fails_what_it_should(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x y z " * 40, " ".join(f"the w{i}" for i in range(60)), " ".join(f"the w{i}###" for i in range(60)), "p q\np q\n\n p q"]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert [got[i].n_repeat_words for i in range(6)] == [0, 0, 0, 6, 4, 120]
    assert [got[i].kept for i in range(9)] == [False] * 6 + [True, False, False]
    assert got[8].n_dup_lines == 1 and got[0].base_failed and got[7].failed_rules == ["symbol_ratio > 0.1"]
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_chats_read_back_whatever_they_hold(spark):
    odd = ["<|turn|>", "&lt;|end|>", "&amp;", "a<|also|>b<|", None, "", "&&lt;||", "\n"]
    rows = [(c, t, r, x) for c in (1, None, 3) for t, (r, x) in enumerate(zip(["user", "user", "assistant", None, "a<|says|>", "assistant", "assistant", "user"], odd))] + [(3, 2, "assistant", "tie"), (3, 2, "assistant", "tie")]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.loss_spans(chat_format.parse_chats(chat_format.format_chats(frame_))).collect()
    assert len(got) == 3
    for r in got:
        want = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id)
        assert [(b.role, t) for b in r.blocks for t in b.texts] == [(role, x) for _, role, x in want]
        assert all(a.role != b.role for a, b in zip(r.blocks, r.blocks[1:]))
        assert list(r.loss_texts) == [x for _, role, x in want if role == "assistant"]
    assert chat_format.format_chats(frame_.limit(0)).count() == 0


def test_html_keeps_the_article_alone(spark):
    page = """<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu one</a></ul></nav>
    <div class="ad">buy things</div><article><h1>Head &amp; line</h1><p><b>Bold start.<br>and &eacute;t&eacute;<p>Second   paragraph
    here.<ul><li>one<li>two</ul><form><input value=q><button>send</button></form></article><div id="comments"><p>a long reader comment that goes on and on</p></div>
    <footer>&copy; site</footer>"""
    assert html_extract.extract(page) == "Head & line Bold start. and été Second paragraph here. one two"
    bare = "<div class=sidebar>" + "<a href=x>link</a> " * 20 + "</div><div><p>" + "Long running text of the page. " * 20 + "</p></div>"
    assert html_extract.extract(bare) == ("Long running text of the page. " * 20).strip()
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text <i>here"), (2, "u", "<<<>>&#xZZ; &am"), (3, "u", "<p>" * 3000 + "deep")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got][:3] == ["", "", "unclosed text here"] and len(got) == 5
