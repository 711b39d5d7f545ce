from planweave.llm import html_extract

TEXT = "Long running text of the page. " * 13


def paragraphs(n):
    return "".join(f"<p>{k} {TEXT}</p>" for k in range(n))


def said(n):
    return [f"{k} {TEXT}".strip() for k in range(n)]


def test_an_article_in_a_layout_class_is_kept():
    for box in ("content has-sidebar", "page header", "site with-menu"):
        assert html_extract.extract(f"<div class='{box}'><article>{paragraphs(2)}</article></div>") == " ".join(said(2)), box
    assert html_extract.extract(f"<div class='content has-sidebar'>{paragraphs(2)}</div>") == " ".join(said(2))
    assert html_extract.extract(f"<div class='related'><main>{paragraphs(2)}</main></div><p>end") == " ".join(said(2))
    assert html_extract.extract(f"<article>{paragraphs(1)}</article><div id=comments><article class=comment-body>{paragraphs(3)}</article></div>") == said(1)[0]
    assert html_extract.extract(f"<footer>f</footer><div class=widget>{paragraphs(2)}</div>") == " ".join(said(2))


def test_a_head_without_its_end_tag():
    for head in ("<head><title>t</title>", "<head><title>t</title><script>var a='<p>';</script><meta x=y><noscript><img src=x></noscript>", "<head><meta x=y>"):
        for body in ("<body>", ""):
            assert html_extract.extract(f"<!doctype html><html>{head}{body}<p>{TEXT}</p>") == TEXT.strip(), (head, body)
    assert html_extract.extract(f"<head><title>t</title> {TEXT}") == TEXT.strip()


def test_short_lines_among_content_of_one_container():
    items = [f"item {k} " + "x" * 12 for k in range(8)]
    ul = "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    want = " ".join([*said(6), *items])
    assert html_extract.extract(f"<div>{paragraphs(6)}{ul}</div>") == want
    assert html_extract.extract(f"<body>{paragraphs(3)}{ul}{paragraphs(3)}") == " ".join([*said(3), *items, *said(3)])
    rows = "".join(f"<tr><td>{k}<td>{k + 1}" for k in range(9))
    assert html_extract.extract(f"<div>{paragraphs(4)}<table>{rows}</table></div>") == " ".join([*said(4), *(f"{k} {k + 1}" for k in range(9))])
    menu = "<ul>" + "<li><a href=x>home</a>" * 9 + "</ul>"
    assert html_extract.extract(f"<body>{menu}<h1>Head</h1>{paragraphs(6)}") == " ".join(["Head", *said(6)])


def test_headlines_open_headers_and_named_paragraphs():
    head = "<header><h1>Head</h1><p>By somebody</p></header>"
    assert html_extract.extract(f"<article>{head}{paragraphs(2)}</article>") == " ".join(["Head", *said(2)])
    assert html_extract.extract(f"<header><h1>Site</h1><nav><a href=x>home</a></nav></header><article>{head}{paragraphs(2)}</article>") == " ".join(["Head", *said(2)])
    assert html_extract.extract(f"<header><h1>Site</h1><article>{paragraphs(2)}</article>") == " ".join(said(2))
    assert html_extract.extract(f"<header><h1>Site</h1><div class=ad>x</div><main>{paragraphs(2)}</main>") == " ".join(said(2))
    assert html_extract.extract(f"<header><article>teaser</article></header><article>{paragraphs(2)}</article>") == " ".join(said(2))
    assert html_extract.extract(f"<nav><header><h1>Menu</h1></header></nav><article>{paragraphs(1)}</article>") == said(1)[0]
    assert html_extract.extract(f"<article><p class='tags'>0 {TEXT}</p><p>1 {TEXT}</p></article>") == " ".join(said(2))
    assert html_extract.extract(f"<article>{paragraphs(1)}<ul class='tags'><li><a href=x>one</a></ul><p class=ad>buy</p></article>") == said(1)[0]
