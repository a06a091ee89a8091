"""Main text of small pages."""

import pytest

from exonloom.llm import extract

LONG = "Words of a paragraph, with commas, that goes on for long enough to count as text of the page, surely."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a &amp; b&nbsp;c</p>", "a & b c"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.<br>end</article><footer>foot</footer>", f"Title {LONG} Short. end"),
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='ad big'>{LONG}</div><div id=main><p>{LONG}</p><p>x</p></div>"
         f"<div class=sidebar><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div></body></html>", f"{LONG} x"),
        (f"<article><p><b>{LONG}<br><p>more<script>var t='</p>';</script> text<!-- <p>no</p> --></p><form><p>{LONG}</p></form></article>", f"{LONG} more text"),
        (f"<div><ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a></ul></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        ("<article><p>tiny</p></article><footer>much longer words in the footer</footer>", "tiny"),
        (f"<article><section><p>{LONG}</p></section><section><p>small</p></section></article>", f"{LONG} small"),
        (f"<p title='a > b'>{LONG}</p><p>next &lt;b&gt;</p", f"{LONG} next <b>"),
        (f"<div><div style='display:none'><p>{LONG}</p></div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, text):
    assert extract.main_text(page) == text


def test_deep_and_long_pages():
    assert extract.main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(3000))
    assert extract.main_text(f"<article>{many}</article>") == " ".join(f"{LONG} {i}" for i in range(3000))


def test_over_spark(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "old"), (None, None, None, "x"), (1, "u", f"<article><p>{LONG}</p></article>", "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted([str((1, "u", LONG, len(LONG)))] * 2 + [str((None, None, "", 0))])
    assert extract.extract(pages.limit(0)).count() == 0


def test_custom_elements_open_ones_and_unlikely_names_keep_the_text():
    long = "This is the text of the article, long enough, and with commas in it."
    for tag in ("<svg-icon></svg-icon>", "<button-row>", "<svg/>", "<svg class='a' />", "<button>"):
        assert extract.main_text(f"<p>{long}</p>{tag}<p>{long}</p>") == f"{long} {long}"
    for name in ("has-sidebar", "no-comments", "elementor-widget", "page-header-fixed"):
        assert extract.main_text(f"<div class='{name}'><p>{long}</p></div>") == long
