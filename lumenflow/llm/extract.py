"""Main text of web pages: flat blocks, shallow features, a decision tree.

A page is cut into blocks at block-level tags. A block's features are its number of words and link density, those of
the blocks before and after, and what encloses it: an article, an element for boilerplate, or an element whose class, id
or role names a kind of boilerplate. A decision tree is trained on the blocks of SAMPLES, a few pages each of whose
blocks is labelled, and says which blocks of other pages are main text. A page is read once, in linear time.

Defined results: null or empty html, and pages without a main block, give empty text; unclosed elements end with the
page or with an enclosing element, end tags without an element are passed over; pages that repeat give one row each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: Elements that end a block.
BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "iframe", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
#: Elements whose content is no text of the page, and those of them whose content is no markup either.
SILENT = frozenset(("script", "style", "head", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "title", "button"))
RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BOILER = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
MAIN = frozenset(("article", "main"))
#: Tags that an opening tag of the same name closes.
SOLE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: Parts of a class, id or role that name boilerplate wherever it is; that name it unless an article begins inside; and
#: that name it outside of articles only.
ALWAYS = re.compile(r"(?:ads?|advert\w*|comments?|commentlist|replies|reply|disqus|related|promo\w*|sponsor\w*|newsletter|cookies?|consent|popup|modal|notices?|notification|subscribe|signup|login)")
AROUND = re.compile(r"(?:sidebar|nav\w*|menu|breadcrumbs?|pager|pagination|share|sharing|social|search|tags?|toolbar|widget|footer|complementary|contentinfo)")
OUTSIDE = re.compile(r"(?:header|masthead|banner|topbar)")
#: Beginnings of names that tell of a layout, not of what an element holds.
_LAYOUT = re.compile(r"(?:has|no|not|with|without|hide|is)[-_]")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?)*+)>?", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "named", "page_has_main")
_LONG = "The committee met on Tuesday and heard the report of the board about the new bridge, which is to be opened in spring if the weather allows."
_MID = "Both sides agreed to meet again next month, and nobody objected."
#: The labelled pages: fragments in page order, each one block, and whether it is main text.
SAMPLES = (
    (("<nav><ul><li><a href=/>Home</a></ul></nav>", 0), ("<article><h1>Bridge opens</h1>", 1), (f"<p>{_LONG}</p>", 1), (f"<p>{_MID}</p>", 1), ("<p>So be it.</p></article>", 1), ("<footer>All about us</footer>", 0)),
    (("<header><h1>The Courier</h1></header>", 0), (f"<div class=ad>{_MID}</div>", 0), ("<main><h2>Weather</h2>", 1), (f"<p>{_LONG}", 1), ("<ul><li><a href=a>Full</a> forecast for the whole of the week</ul>", 1), (f"<aside>{_MID}</aside>", 0), ("<p>Rain.</p></main>", 1), (f"<div>{_MID}</div>", 0)),
    (("<ul><li><a href=a>Sports</a></li>", 0), ("<li><a href=b>World news</a></li></ul>", 0), ("<h1>A walk in the hills</h1>", 1), (f"<p>{_LONG}</p>", 1), (f"<p>{_MID} {_LONG}</p>", 1), ("<p><a href=c>More walks like this one here</a></p>", 0), (f"<div id=footer>{_MID}</div>", 0)),
    (("<p>First note.</p>", 1), ("<p>Second note here.</p>", 1)),
    (("<div>Only one line.</div>", 1),),
    (("<div><a href=a>One</a> <a href=b>Two</a></div>", 0), (f"<div>{_LONG}</div>", 1), ("<div>Yes.</div>", 1), ("<div><a href=a>Next page of it</a></div>", 0)),
    ((f"<article><p>{_MID}</p>", 1), (f"<section id=comments><p>{_LONG}</p></section>", 0), ("<div class=share-buttons>Share it</div></article>", 0), ("<div class=cookie-notice>We use cookies</div>", 0)),
    ((f"<article><p>{_LONG}</p>", 1), ("<p><a href=a>A line that is one link</a></p>", 1), ("<pre>x = 1</pre>", 1), ("<table><tr><td>Total</td>", 1), ("<td>12</td></tr></table></article>", 1), (f"<section><p>{_LONG}</p></section>", 0), ("<p>Subscribe now</p>", 0)),
    ((f"<div class=sidebar><p>{_LONG}</p></div>", 0), (f"<div class=post><p>{_LONG}</p>", 1), ("<blockquote>Never again.</blockquote>", 1), (f"<p>{_MID}</p></div>", 1), (f"<form><p>{_MID}</p></form>", 0), (f"<nav>{_LONG}</nav>", 0), ("<footer>Us</footer>", 0)),
    ((f"<main><p>{_LONG}</p></main>", 1), ("<p>Terms</p>", 0), ("<p><a href=a>Terms</a></p>", 0), (f"<div class=promo>{_LONG}</div>", 0)),
    (("<main><p>Short.</p>", 1), ("<p><a href=a>Go</a></p>", 1), ("<aside>Note</aside>", 0), ("<div class=related><a href=b>See this</a></div></main>", 0), ("<footer><a href=a>Imprint</a></footer>", 0)),
    ((f"<footer>{_LONG}</footer>", 0), ("<p>Just a line of text.</p>", 1), ("<p>And one more of them.</p>", 1), ("<menu><li>Cut</menu>", 0), ("<div class=comment>I like it</div>", 0)),
)


def labelled_table() -> list[tuple[tuple, int]]:
    """Features and label of each block of the labelled pages."""
    rows = []
    for page in SAMPLES:
        found = features(blocks("".join(fragment for fragment, _ in page)))
        rows += zip(found, (label for _, label in page), strict=True)
    return rows


def grow(rows, depth: int = 8):
    """A binary tree as nested (feature, threshold, at most, more) or a leaf's label, split by Gini impurity."""
    labels = [y for _, y in rows]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) >= len(labels))

    def impurity(part):
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for k in range(len(FEATURES)):
        values = sorted({x[k] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [r for r in rows if r[0][k] <= cut], [r for r in rows if r[0][k] > cut]
            cost = sum(map(impurity, sides))
            if best is None or cost < best[0] - 1e-12:
                best = cost, k, cut, sides
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    _, k, cut, (left, right) = best
    return k, cut, grow(left, depth - 1), grow(right, depth - 1)


def decide(tree, x) -> int:
    while not isinstance(tree, int):
        k, cut, low, high = tree
        tree = low if x[k] <= cut else high
    return tree


def named(attributes: str) -> int:
    """What class, id and role say: 0 nothing, 1 boilerplate outside of articles, 2 unless an article begins inside, 3 always."""
    found = 0
    for groups in _NAMES.findall(attributes):
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(groups)).lower().split():
            if not _LAYOUT.match(token):
                for part in re.split("[-_]+", token):
                    found = max(found, 3 if ALWAYS.fullmatch(part) else 2 if AROUND.fullmatch(part) else 1 if OUTSIDE.fullmatch(part) else 0)
    return found


class Open:
    """Open elements; any is found by its name, and the last block among them, without a search."""

    def __init__(self):
        self.flags: list[tuple[bool, int, int, bool]] = []  # main; boilerplate: 0, 1 unless an article begins, 2; named; silent
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def state(self) -> tuple[bool, int, int, bool]:
        return self.flags[-1] if self.flags else (False, 0, 0, False)

    def push(self, name: str, flags: tuple[bool, int, int, bool]) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.flags.append(flags)

    def pop(self, k: int) -> None:
        """Close element k and all in it."""
        while len(self.names) > k:
            name = self.names.pop()
            self.flags.pop()
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """What an end tag closes; one of an inline element closes no block."""
        places = self.at.get(name)
        if places and (name in BLOCK or name in SILENT or not self.blocks or self.blocks[-1] < places[-1]):
            self.pop(places[-1])


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in article or main, in boilerplate, named as boilerplate) of each block."""
    out, text, linked, link = [], [], 0, False
    tags = Open()

    def end():
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            main, boiler, name, _ = tags.state()
            out.append((joined, joined.count(" ") + 1, linked, main, boiler > 0, name > (1 if main else 0)))
        text, linked = [], 0

    def say(raw: str):
        nonlocal linked
        if raw and not tags.state()[3]:
            x = html.unescape(raw) if "&" in raw else raw
            text.append(x)
            if link:
                linked += len(x.split())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name, more = (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if m[1]:
            if name == "a":
                link = False
            if name in BLOCK:
                end()
            tags.close(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            end()
            if name in SOLE and tags.names and tags.names[-1] == name:
                tags.pop(len(tags.names) - 1)
        if name in VOID or more.rstrip().endswith("/") and name not in BLOCK and name not in SILENT:
            continue
        if name in RAW and not more.rstrip().endswith("/"):  # raw text up to the end tag
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name == "a":
            link = True
        main, boiler, hint, silent = tags.state()
        if name == "body":
            silent = False
        says = named(more) if "=" in more and name not in ("html", "body") else 0
        hidden = bool(more) and bool(_HIDDEN.search(more))
        if name in MAIN:  # an article or the page's main part begins
            main, boiler, hint = True, 0 if boiler == 1 else boiler, hint if hint == 3 else 0
            says = says if says == 3 and name == "article" else 0
        elif name in BOILER:
            boiler = max(boiler, 1 if name == "form" else 2)
        elif name == "header" and not main:
            boiler = max(boiler, 1)
        if name in BLOCK or name in SILENT or says or hidden:
            tags.push(name, (main, boiler, max(hint, says), silent or name in SILENT or hidden))
    end()
    return out


def features(found: list[tuple[str, int, int, bool, bool, bool]]) -> list[tuple]:
    """FEATURES of each block."""
    edge, shape, has_main = (0, 0.0), [(w, min(1.0, k / w)) for _, w, k, *_ in found], int(any(b[3] and not b[4] and not b[5] for b in found))
    around = [edge, *shape, edge]
    return [(*shape[i], *around[i], *around[i + 2], *map(int, flags), has_main) for i, (_, _, _, *flags) in enumerate(found)]


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, x in zip(found, features(found)) if decide(tree, x))


def extracted(pages: DataFrame) -> DataFrame:
    ship(pages.sparkSession)
    tree = grow(labelled_table())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h or "", tree) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES, SQL = {"op8_main_text": op8_main_text}, {}
