"""Main texts of hand-made pages, and time on badly nested ones."""

import time

import pytest

from strandflow.llm.html_extraction import extract, main_text

P = "This is a sentence of the article, with a comma, and some more words to make it long enough to be read as prose."
Q = P.replace("sentence", "second sentence")
PAGES = {
    "state of a wrapper": (f'<div class="has-sidebar comments-open"><div class="content"><h1>T</h1><p>{P}</p><p>{Q}</p></div><div class="sidebar"><p>{P}</p></div></div>', f"T {P} {Q}"),
    "page in a form": (f'<form><input><div class="menu"><a href=a>A</a></div><div id=content><h1>T</h1><p>{P}</p><p>{Q}</p></div><button>go</button></form>', f"T {P} {Q}"),
    "form in an article": (f"<article><p>{P}</p><form><p>Your name <input></p><p>Write to us.</p></form><p>{Q}</p></article>", f"{P} {Q}"),
    "headings and lists beside the best container": (f"<div><h2>One</h2><div><p>{P}</p><p>{Q}</p></div><h3>Two</h3><ul><li>a<li>b</ul><p>{P}</p></div>", f"One {P} {Q} Two a b {P}"),
    "flat page": (f'<h1>T</h1><p>{P}</p><h4>Two</h4><ul><li>a<li>b</ul><p>short</p><p>{Q}</p><div class="related"><a href=x>more</a></div>', f"T {P} Two a b short {Q}"),
    "words of two meanings": (f'<main><h1>T</h1><section id="discussion"><h2 id="related-work">R</h2><p class="follow-up">{P}</p><p>{Q}</p></section></main>', f"T R {P} {Q}"),
    "notices, alerts, sharing": (f'<div class="cookie-notice"><p>Cookies, ok?</p></div><article><p>{P}</p><div class="alert">Note.</div><div class="share"><a href=1>x</a></div><p>{Q}</p></article>', f"{P} {Q}"),
    "more comments than article": (f'<div id=main><h1>T</h1><div class="entry"><p>{P}</p></div><div id="comments">' + f'<div class="comment"><p>{Q}</p></div>' * 9 + "</div></div>", f"T {P}"),
    "comments as articles": (f'<article><p>{P}</p></article><section class="comments"><article class="comment"><p>{Q}</p></article></section>', P),
    "headers and footers": (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{P}</p></article><footer>f</footer>", f"T {P}"),
    "two articles": (f"<main><article><h2>A</h2><p>{P}</p></article><article><h2>B</h2><p>{Q}</p></article></main>", f"A {P} B {Q}"),
    "heading in a block of its own": (f"<div><div class=title><h1>T</h1></div><div class=body><p>{P}</p><p>{Q}</p></div><div class=foot><a href=x>y</a></div></div>", f"T {P} {Q}"),
    "layout table": (f"<table><tr><td><a href=a>n</a><td><p>{P}<p>{Q}<td><a href=b>m</a></table>", f"{P} {Q}"),
    "references, stray quotes, white space": (f'<a title="it"s">x</a><p>{P}</p><p>a &amp;\n b&nbsp;&lt;b&gt;</p><script>var t="</p>"</script>', f"x {P} a & b <b>"),
    "prose with a menu's class": (f'<article><p>{P}</p><p class="menu">{Q}</p><p class="menu"><a href=a>one</a> <a href=b>two</a></p><p class="advert">{Q}</p></article>', f"{P} {Q}"),
    "formulas": (f"<article><p>{P} Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is.</p><p>{Q}</p></article>", f"{P} Energy E=m is. {Q}"),
    "text for want of a picture": (f"<article><p>{P}</p><object data=x>A map of the town.</object><p>{Q}</p></article>", f"{P} A map of the town. {Q}"),
    "text alone": ("just text", "just text"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    source, want = PAGES[name]
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<ul><li>x " * 50000, "<div>" * 50000 + P, "<b>x" * 50000, "<div>" * 50000 + "</span>" * 50000, '<div class="related sidebar">' * 20000 + P, '<a x="' * 20000])
def test_badly_nested_pages_take_time_in_proportion(source):
    start = time.process_time()
    main_text(source)
    assert time.process_time() - start < 20


def test_pages_as_a_table(spark):
    """Null and empty pages, repeated rows, a very long text, columns with the names of the result; an empty table."""
    kinds = "page_id long, url string, html string, text int, n_chars string"
    long = "wörter, und mehr davon. " * 40000
    rows = [(1, "u", None, 1, "x"), (2, None, "", 2, "x"), (3, "u", f"<p>{P}</p>", 3, None), (3, "u", f"<p>{P}</p>", 3, None), (None, "u", f"<p>{long}</p>", 4, "x")]
    got = extract(spark.createDataFrame(rows, kinds)).select("page_id", "text", "n_chars").collect()
    want = [(1, "", 0), (2, "", 0), (3, P, len(P)), (3, P, len(P)), (None, long.strip(), len(long) - 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert extract(spark.createDataFrame([], kinds)).count() == 0
