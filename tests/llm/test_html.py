"""Main text of pages: what stays, what goes, and that the ratios decide it."""

import duckdb
import numpy as np
import pytest

from codemap_spark.llm import html

A = "A first paragraph of the article that is long enough to look like running text on a page, with some more words."
B = "The second paragraph goes on about the same matter and is about as long as the first one, or a little longer."
C = "A reader says that this was a long and interesting read, and writes many words of praise below the article itself."
LINKS = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12))


@pytest.mark.parametrize(
    "page, want",
    [
        # headlines in an article's header
        (f"<body><article><header class='entry-header'><h1>Head</h1></header><p>{A}</p><p>{B}</p></article>", f"Head {A} {B}"),
        (f"<body><main><div class='article-header'><h1>Head</h1></div><p>{A}</p><p>{B}</p></main>", f"Head {A} {B}"),
        (f"<body><div id='page'><div class='page-head'><h1>Head</h1></div><div class='body'><p>{A}</p><p>{B}</p></div></div>", f"Head {A} {B}"),
        # names that only contain a hint
        (f"<body><div class='content has-sidebar'><p>{A}</p><p>{B}</p></div>", f"{A} {B}"),
        (f"<body class='layout no-sidebar'><div class='layout no-sidebar'><p>{A}</p><p>{B}</p></div>", f"{A} {B}"),
        (f"<body><article><p>{A}</p><section id='search-engines'><h2>Search engines</h2><p>{B}</p></section></article>", f"{A} Search engines {B}"),
        # a plain body keeps its headline and short lines
        (f"<body><nav><ul>{LINKS}</ul></nav><h1>Head</h1><p>{A}</p><p>Yes.</p><p>{B}</p></body>", f"Head {A} Yes. {B}"),
        # an element that is never closed hides nothing
        (f"<body><nav><ul>{LINKS}</ul><article><h1>Head</h1><p>{A}</p><p>{B}</p></article>", f"Head {A} {B}"),
        (f"<body><div><p>{A}</p><p>{B}</p></div><footer>(c) the site", f"{A} {B}"),
        # hidden elements
        (f"<body><article><p>{A}</p><p style='color:red; display: none'>{C}</p><div hidden><p>{C}</p></div><p>{B}</p></article>", f"{A} {B}"),
        # site furniture by name only
        (f"<body><div class='site-header'>The Site</div><div id='topNav'><ul>{LINKS}</ul></div><div class='text'><h1>Head</h1><p>{A}</p><p>{B}</p></div><div class='comments-area'><p>{C}</p><p>{C}</p></div></body>", f"Head {A} {B}"),
        (f"<body><article><h1>Head</h1><p>{A}</p><div class='ad-slot'>Buy this now, it is cheap and good.</div><p>{B}</p><section class='comments'><article class='comment'><p>{C}</p></article></section></article></body>", f"Head {A} {B}"),
        (f"<body><div role='banner'>The Site</div><div><p>{A}</p><p>{B}</p></div><div role='contentinfo'>Imprint</div></body>", f"{A} {B}"),
        # a form around the whole page is no form to leave out; one in it is
        (f"<body><form action='/p'><nav><ul>{LINKS}</ul></nav><div><h1>Head</h1><p>{A}</p><p>{B}</p></div><div>Mail <input name='m'> <button>Send</button></div></form></body>", f"Head {A} {B}"),
        (f"<body><div><h1>Head</h1><p>{A}</p><p>{B}</p><form><p>{C}</p><label>Name</label><input></form></div></body>", f"Head {A} {B}"),
        # links inside an article are its own matter, outside they aren't
        (f"<body><nav><ul>{LINKS}</ul></nav><article><h1>Head</h1><p>{A}</p><p><a href='/x'>{B}</a></p><h2>Sources</h2><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></article></body>", f"Head {A} {B} Sources One Two"),
        (f"<body><div><ul>{LINKS}</ul></div><div><h1>Head</h1><p>{A}</p><p>{B}</p></div></body>", f"Head {A} {B}"),
        # names that may mean an article's own matter, and elements whose names say nothing
        (f"<body><article><p>{A}</p><blockquote class='reply'><p>{C}</p></blockquote><section id='search'><h2>Search</h2><p>{B}</p></section></article></body>", f"{A} {C} Search {B}"),
        # names of two words written as one
        (f"<body><div class='text'><h1>Head</h1><p>{A}</p><p>{B}</p></div><ol class='commentlist'><li><p>{C}</p></li><li><p>{C}</p></li></ol></body>", f"Head {A} {B}"),
        # short article beside an advert
        ("<body><div class='ad'>An advert that is longer than the article.</div><article><h1>Head</h1><p>Short.</p></article></body>", "Head Short."),
        # markup, character references and white space
        (f"<html><head><title>T</title><body><script>var x = '<p>no</p>'</script><p>{A} x &lt; y &amp; z&nbsp;q&#x41;\n\t w</p><!-- c --><p>{B}", f"{A} x < y & z qA w {B}"),
        ("<p>only</p>", "only"),
        ("text alone", "text alone"),
    ],
)
def test_what_stays(page, want):
    assert html.extract(page) == want


def test_ratios_decide(monkeypatch):
    """Without article or main, and without names, ratios alone tell links and
    stubs from running text; a constant ratio doesn't."""
    page = f"<body><div><ul>{LINKS}</ul></div>{''.join(f"<div><span>Row {i}</span><br><b>{i}</b></div>" for i in range(40))}<div><h1>Head</h1><p>{A}</p><p>{B}</p><p>{A}</p></div><div><p>Imprint</p><p><b>Terms</b></p></div></body>"
    assert html.extract(page) == f"Head {A} {B} {A}"
    monkeypatch.setattr(html, "smooth", lambda ratio, radius, sigma: np.ones_like(ratio))
    assert html.extract(page) != f"Head {A} {B} {A}"


def test_levels_decide_on_given_pages(monkeypatch):
    """On the test tables' own pages: with one ratio for all lines others stay."""
    found = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    want = [html.extract(page) for (page,) in found]
    real = html.Lines._end_line

    def one_ratio(self):
        before = len(self.text)
        real(self)
        if len(self.text) > before:
            self.tags[-1] = len(self.text[-1])

    monkeypatch.setattr(html.Lines, "_end_line", one_ratio)
    assert sum(html.extract(page) != w for (page,), w in zip(found, want, strict=True)) > 0


def test_deep_and_long_pages():
    assert html.extract("<div>" * 50_000 + f"<p>{A}</p>") == A
    long = "".join(f"<p>{A} {i}</p>" for i in range(20_000))
    assert html.extract(f"<body><nav>{LINKS}</nav><article>{long}</article>") == " ".join(f"{A} {i}" for i in range(20_000))


def test_edges(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; all</h1><p><b>One<br>two<p>three  four</article><footer>&copy; x</footer>"
    assert html.extract(page) == "Head & all One two three four"
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == ""
    rows = spark.createDataFrame([(1, "u", None, 0), (1, "u", page, 0), (1, "u", page, 0), (None, None, page, 0)], "page_id long, url string, html string, text int")
    want = ("Head & all One two three four", 29)
    assert sorted((r.text, r.n_chars) for r in html.extract_text(rows).collect()) == [("", 0), want, want, want]
    assert html.extract_text(rows.limit(0)).count() == 0
