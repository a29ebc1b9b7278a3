"""Main text of web pages by a maximum-scoring contiguous region.

A page is read as a sequence of tags and runs of words. Tags score negative, by how often their kind stands
outside main text; words score the log-odds that a word with the same enclosing elements, and the same hints
in their class, id and role, is main text. Both are learnt from labelled pages (``train``; the default pages
are written out below). One linear scan finds the contiguous region with the largest sum; the words in it
that score positive are the text, so that a notice inside an article does not end it and does not count.

Defined cases: null, empty and tag-only pages give an empty text; unclosed elements end with their parent or
the page; a tag that is cut off at the end is dropped; repeated rows get equal results; null ids and urls are
carried; very long pages and attribute values are read whole; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENT = {"script", "style", "iframe", "canvas", "audio", "video", "textarea", "select", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
#: Elements that an opening tag of these kinds ends when they are still open.
ENDS = {k: {"p"} for k in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "main", "figure", "hr")}
ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head"}}
SCOPE = {"table", "ul", "ol", "dl", "div", "section", "article", "aside", "nav", "main", "body", "form", "blockquote", "header", "footer"}
NAMES = {"nav", "footer", "header", "aside", "form", "article", "main", "section", "p", "li", "a", "table", "blockquote", "pre", "button", "head", "figure", "dialog", "menu", "div",
         "h1", "h2", "h3", "h4", "h5", "h6", "label", "address", "details"}
#: Fixed value: hints by the words of class, id and role attributes.
HINTS = {
    "advert": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion promoted adsense outbrain taboola",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "side": "sidebar side aside widget widgets rail related recommended more trending popular",
    "comments": "comment comments disqus reply replies discussion respond reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner subscribe newsletter signup login paywall",
    "footing": "footer foot copyright legal colophon bottom",
    "heading": "header masthead head site-header hero logo",
    "sharing": "share sharing social follow tags tag byline meta author",
    "content": "content article post story entry text body main articlebody post-body maincontent",
}
HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A tag to its end: quoted values may hold any character; a quote that never closes is an ordinary one.
_TAG = re.compile(r"""<[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """Features an open element gives to all words inside it."""
    out = {name} if name in NAMES else set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "hidden" or key.lower() == "aria-hidden" and value == "true":
            out.add("hidden")
        out |= {"@" + HINT[w.lower()] for w in _WORDS.findall(value) if w.lower() in HINT}
    return tuple(sorted(out))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ("text", "", characters), ("open", name, attributes) or ("close", name, "")."""
    at, n, lower = 0, len(page), None
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "text", "", page[at:]
            return
        head = page[i + 1 : i + 2]
        if not (head.isalpha() or head in "/!?" and head):  # a bare "<" is text
            if i == n - 1:
                if i > at:
                    yield "text", "", page[at:i]
                return
            yield "text", "", page[at : i + 1]
            at = i + 1
            continue
        if i > at:
            yield "text", "", page[at:i]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(page, i) if head not in "!?" else None
        end = tag.end() - 1 if tag else page.find(">", i)
        if end < 0:
            return
        body = page[i + 1 : end]
        at = end + 1
        if head in "!?":
            continue
        closing = head == "/"
        m = re.match(r"/?\s*([a-zA-Z][^\s/>]*)", body)
        if not m:
            continue
        name = m[1].lower()
        yield "close" if closing else "open", name, "" if closing else body[m.end() :]
        if not closing and name in SILENT and not body.endswith("/"):
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{name}", at) if len(lower) == n else page.find(f"</{name}", at)
            if stop < 0 and name in ("script", "style", "textarea"):
                return
            at = at if stop < 0 else stop


def runs(page: str) -> Iterator[tuple[str, str, frozenset[str]]]:
    """(tag, "", marks) for tags and ("", characters, marks) for text, in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    active: Counter[str] = Counter()
    silent = 0

    def pop() -> str:
        nonlocal silent
        name, marks = stack.pop()
        for m in marks:
            active[m] -= 1
            if not active[m]:
                del active[m]
        silent -= name in SILENT
        return name

    for kind, name, rest in tokens(page):
        if kind == "text":
            if not silent:
                yield "", rest, frozenset(active)
            continue
        if kind == "open":
            ends = ENDS.get(name)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                    elif stack[k][0] in SCOPE:
                        break
            if name not in VOID and not (name in SILENT and rest.endswith("/")):
                marks = _marks(name, rest)
                stack.append((name, marks))
                active.update(marks)
                silent += name in SILENT
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            while at >= 0 and len(stack) > at:
                pop()
        yield name, "", frozenset()


class Scorer:
    """Word weights by feature, tag weights by name."""

    def __init__(self, features: dict[str, float], bias: float, tags: dict[str, float]):
        self.features, self.bias, self.tags = features, bias, tags

    def word(self, marks: frozenset[str]) -> float:
        return max(-6.0, min(6.0, self.bias + sum(self.features.get(m, 0.0) for m in marks)))


def _page(page: str) -> list[tuple[str, str, frozenset[str]]]:
    """The runs of a page, with marks for words outside the elements that hold its main text, if it has any."""
    found = list(runs(page))
    for name, mark in (("article", "outside_article"), ("main", "outside_main"), ("@content", "outside_content")):
        if any(name in marks for _, text, marks in found if text and not text.isspace()):
            found = [(tag, text, marks if not text or name in marks else marks | {mark}) for tag, text, marks in found]
    return found


def region(scores: list[float]) -> tuple[int, int]:
    """(first, last + 1) of the contiguous run with the largest positive sum, the earliest of equal ones; (0, 0) if there is none."""
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, scorer: Scorer) -> str:
    """The text of the best region."""
    if not page:
        return ""
    seen: dict[frozenset[str], float] = {}
    units: list[tuple[str, str, float]] = []
    scores: list[float] = []
    for tag, text, marks in _page(page):
        if text:
            weight = seen.get(marks)
            if weight is None:
                weight = seen[marks] = scorer.word(marks)
            text = entities.unescape(text) if "&" in text else text
            score = weight * len(text.split())
        else:
            weight = score = scorer.tags.get(tag, scorer.tags[""])
        units.append((tag, text, weight))
        scores.append(score)
    begin, end = region(scores)
    out = []
    for tag, text, weight in units[begin:end]:
        if text:
            if weight > 0:
                out.append(text)
        elif tag not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def train(pages: list[tuple[str, str]], rounds: int = 800, rate: float = 0.5, ridge: float = 1e-3) -> Scorer:
    """Weights from (html, main text) pairs: logistic regression over the marks of text runs, weighted by words.

    A run is main text if its words follow in the main text after those of the last such run.
    """
    rows: Counter[tuple[frozenset[str], bool]] = Counter()
    tags: dict[str, list[int]] = {}
    for page, truth in pages:
        want, at = " ".join(truth.split()), 0
        inside = False
        for tag, text, marks in _page(page):
            words = " ".join(entities.unescape(text).split())
            if words:
                found = want.find(words, at)
                inside = found >= 0 and not want[at:found].strip()
                at = found + len(words) if inside else at
                rows[marks, inside] += len(words.split())
            elif tag:
                tags.setdefault(tag, [0, 0])[inside] += 1
    names = sorted({m for marks, _ in rows for m in marks})
    w, bias, total = dict.fromkeys(names, 0.0), 0.0, sum(math.sqrt(n) for n in rows.values()) or 1.0
    for _ in range(rounds):
        grad, grad_bias = {m: ridge * v for m, v in w.items()}, 0.0
        for (marks, y), n in rows.items():
            z = bias + sum(w[m] for m in marks)
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * math.sqrt(n) / total
            grad_bias += d
            for m in marks:
                grad[m] += d
        bias -= 4 * rate * grad_bias
        w = {m: v - 4 * rate * grad[m] for m, v in w.items()}
    costs = {t: -0.02 - 0.3 * out / (out + into) for t, (out, into) in tags.items()}
    return Scorer(w, bias, costs | {"": -0.1})


def labelled_pages() -> list[tuple[str, str]]:
    """Pages written for this library, of common layouts, with their main text."""
    out = []
    prose = [f"This is sentence {i} of the story and it runs on for a while, as they do." for i in range(12)]
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav>'
    menu = '<div class="menu"><a href="/">Home</a> <a href="/x">Sport</a></div>'
    ad = '<div class="ad">Buy two pay for one, only today in our shop.</div>'
    side = '<aside><h3>Related</h3><p>Ten things you did not know.</p></aside>'
    sidebar = '<div id="sidebar"><p>Popular posts of the week are listed here.</p><ul><li><a href="/1">One</a></li></ul></div>'
    foot = "<footer><p>&copy; 2020 Example. All rights reserved.</p></footer>"
    footing = '<div class="footer">Copyright Example, imprint and legal notes.</div>'
    cookie = '<div class="cookie-notice"><p>We use cookies, please agree to them all.</p><button>Accept</button></div>'
    comments = '<section class="comments"><h2>Comments</h2><div class="comment"><p>First, nice read, thank you all.</p></div></section>'
    form = '<form><label>Your mail</label><input name="m"><p>Subscribe to our letter.</p><button>Send</button></form>'
    share = '<div class="share">Share on all networks</div>'
    header = '<header><p>The Daily Example, since 1900</p></header>'
    heads = ["<html><head><title>Story - Site</title><style>p{}</style></head><body>", "<head><title>A page</title></head><body>"]
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ("<main><article>", "</article></main>"), ("", ""), ("<section>", "</section>")]
    for k, (begin, end) in enumerate(wraps):
        for j in range(3):
            some = prose[k % 4 : k % 4 + 3 + j]
            body = [f"<h1>Title of story {k}</h1>", *(f"<p>{x}</p>" for x in some), "<ul><li>first point</li><li>second point</li></ul>", "<blockquote>Said a person.</blockquote>", "<h2>Part two</h2>",
                    '<p>Closing words with <a href="/l">a link</a> and <b>weight</b>.</p>', "<p>End.</p>", "<table><tr><td>cell one</td><td>cell two</td></tr></table>", "<pre>code line</pre>"]
            truth = " ".join(re.sub("<[^>]*>", "", re.sub("</t[dh]>|</li>", " ", x)) for x in body)
            inner = list(body)
            if j == 1:
                inner[3:3] = [ad]
                inner[5:5] = [share]
            if j == 2:
                inner[4:4] = [side, form]
                inner += [comments]
            before = [[header, nav, ad], [cookie, menu, header], [nav, ad, form]][j]
            after = [[side, foot], [comments, sidebar, footing], [sidebar, cookie, foot]][j]
            out.append((heads[j % 2] + "".join(before) + begin + "".join(inner) + end + "".join(after) + "</body></html>", truth))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scorer: Scorer | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    scorer = scorer or train(labelled_pages())
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(p, scorer) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
