import html
import re
import time

import pytest

from lumenflow.llm import extract

LONG = "The committee met on Tuesday and heard the report of the board about the new bridge, which opens in spring."
ARTICLE = f"<article><p>{LONG}</p></article>"
PAGES = {
    f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>": LONG,
    f"<article><p>{LONG}</p><div class=comments><p>{LONG}</p></div></article>": LONG,
    f'<div class="layout has-sidebar">{ARTICLE}</div>': LONG,
    f"<div class='site no-comments'>{ARTICLE}</div>": LONG,
    f"<div class='content sidebar-left'>{ARTICLE}</div>": LONG,
    "<p>One two three.</p><p>Four five.</p>": "One two three. Four five.",
    f"<form id=f>{ARTICLE}</form>": LONG,
    f"<p data-x=it's>{LONG}</p><p>{LONG}</p>": f"{LONG} {LONG}",
    f"<article><div class=post-header><h1>Title</h1></div><p>{LONG}</p></article>": f"Title {LONG}",
    f"{ARTICLE}<div id=siteFooter><p>{LONG}</p></div>": LONG,
    f"{ARTICLE}<section id=comments><article class=comment><p>{LONG}</p></article></section>": LONG,
    f"<aside><article><p>{LONG}</p></article></aside>{ARTICLE}": LONG,
    f"<article hidden><p>{LONG}</p></article><main>a<b>b</b>c &lt;d&gt; &eacute;<script>1<2</script></main>": "abc <d> é",
}


@pytest.fixture(scope="module")
def tree():
    return extract.grow(extract.labelled_table())


@pytest.mark.parametrize("page", PAGES)
def test_pages(tree, page):
    assert extract.main_text(page, tree) == PAGES[page]


def test_the_tree_agrees_with_its_table(tree):
    table = extract.labelled_table()
    assert len(table) >= 50 and all(extract.decide(tree, x) == y for x, y in table)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</span>" * 20_000, "<span>" * 20_000 + "<div>" * 20_000 + "</span>" * 20_000, "<p " * 50_000, "<a b='" * 30_000, "<li><ul>" * 20_000, "</p>" * 100_000, f"<div class='{'a-' * 100_000}'>x", "<!--" * 50_000])
def test_time_is_linear(tree, page):
    began = time.process_time()
    extract.main_text(page, tree)
    assert time.process_time() - began < 3


def test_whole_pages(spark):
    """The articles of the synthetic pages, cut out by their tags alone."""
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract.op8_main_text(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    for r in rows:
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("<!--.*?-->|</?b>", "", body, flags=re.S))).split())
        assert got[r["page_id"]] == (r["url"], text, len(text))
    assert len(got) == len(rows)


def test_repeated_and_empty_rows(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (5, "u", "<b>" * 3000 + "x", "x"), (6, "u", f"<p>{'word ' * 300_000}", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:5]) for r in extract.extracted(pages).collect())
    assert got == [(0, 0, ""), (1, len(LONG), LONG[:5]), (1, len(LONG), LONG[:5]), (2, 0, ""), (3, 0, ""), (5, 1, "x"), (6, 1_499_999, "word ")]
    assert extract.extracted(pages.limit(0)).count() == 0
