"""Main text of web pages: site templates removed by counting element subtrees.

Every element subtree is hashed from its tag, texts and children. Spark counts
on how many pages of a host each hash stands; subtrees that recur across many
pages of the host are its template and are deleted. What the markup itself
declares (navigation, forms, adverts, comments) goes as well, also where it is
new on every page."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_slices, written

#: Template: found on this many pages of the host and on this part of them. A
#: host so has at most 1 / MIN_SHARE times as many template subtrees as a page has elements.
MIN_PAGES, MIN_SHARE = 5, 0.05
#: Hosts with at least one page in so many are joined by broadcast; so many such hosts exist at most.
LARGE_HOSTS = 512

# Fixed values of HTML: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
HIDDEN = frozenset("head script style title noscript iframe xmp template svg math canvas object audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr caption ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption ol ul li dl dt dd figure figcaption".split())
#: A start tag on the left closes open elements on the right, up to the nearest boundary.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
          "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
          "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements that an open paragraph is not closed across.
SCOPE = frozenset("td th table caption button object template html".split())

#: Never part of the main text, by tag, role or a word of class or id.
BOILERPLATE = frozenset("nav aside footer form button select input textarea label fieldset dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar widget cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup login comment comments "
    "disqus respond replies share sharing social related recommended recommendations pagination pager toolbar skip".split())
#: The same, but inside an article these hold its title.
PAGE_MARKS = frozenset("header masthead".split())
CONTENT_MARKS = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    start: int  # pieces[start:end] lie inside
    parent: int  # number of the parent, -1 at the top
    attributes: dict[str, str]
    end: int = -1
    chars: int = 0
    hash: int = 0


@dataclass
class Page:
    """Elements in page order; ``pieces``: texts, " " and "\\n" for soft and hard breaks."""

    elements: list[Element]
    pieces: list[str]


def parse(html: str | None) -> Page:
    """Elements and texts of a page, however broken; open elements end where
    the rules of HTML, their parents or the page end."""
    html = html or ""
    elements: list[Element] = []
    pieces: list[str] = []
    stack: list[int] = []
    sums: list = []  # running hashes of the open elements
    open_tags: dict[str, int] = {}

    def close() -> None:
        number = stack.pop()
        e = elements[number]
        open_tags[e.tag] -= 1
        if e.tag in BLOCK:
            pieces.append("\n")
        elif e.tag in ("td", "th"):
            pieces.append(" ")
        e.end = len(pieces)
        e.hash = int.from_bytes(sums.pop().digest(), "little", signed=True)
        if stack:
            sums[-1].update(b"\x01%d" % e.hash)
            elements[stack[-1]].chars += e.chars

    def close_until(tags: frozenset, bounds: frozenset) -> None:
        """Close from the top through the outermost of ``tags`` above a bound."""
        if not any(open_tags.get(t) for t in tags):
            return
        depth = len(stack)
        while depth and elements[stack[depth - 1]].tag not in bounds:
            depth -= 1
        for i in range(depth, len(stack)):
            if elements[stack[i]].tag in tags:
                while len(stack) > i:
                    close()
                return

    def add(text: str) -> None:
        if text:
            text = unescape(text)
            pieces.append(text)
            if stack:
                bare = "".join(text.split())
                elements[stack[-1]].chars += len(bare)
                if bare:
                    sums[-1].update(b"\x02" + bare.encode("utf-8", "surrogatepass"))

    at, last = 0, html.rfind(">")
    while True:
        lt = html.find("<", at) if at <= last else -1
        m = _TOKEN.match(html, lt) or _LOOSE.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:
            lt = html.find("<", lt + 1)
            m = _TOKEN.match(html, lt) or _LOOSE.match(html, lt) if lt >= 0 else None
        add(html[at:lt] if lt >= 0 else html[at:])
        if lt < 0:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                while elements[stack[-1]].tag != tag:
                    close()
                close()
            elif tag == "p":
                pieces.append("\n")
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                pieces.append("\n")
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag in BLOCK and open_tags.get("p"):
            close_until(frozenset(("p",)), SCOPE)
        if tag in CLOSES:
            close_until(*CLOSES[tag])
        if tag in BLOCK:
            pieces.append("\n")
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])}
        elements.append(Element(tag, len(pieces), stack[-1] if stack else -1, attributes))
        stack.append(len(elements) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        sums.append(hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if tag not in HIDDEN:
                add(html[at:stop])
            close()
            at = end.end() if end else stop
        elif m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
            close()
    while stack:
        close()
    return Page(elements, pieces)


def _marks(e: Element) -> set[str]:
    names = f"{e.attributes.get('class', '')} {e.attributes.get('id', '')}"
    return {w.lower() for w in _WORD.findall(names)} if names != " " else set()


def _declared(e: Element, in_article: bool) -> bool:
    """Whether the element's own markup says that it is no main text."""
    if e.tag in HIDDEN or e.tag in BOILERPLATE or "hidden" in e.attributes or e.attributes.get("role", "").lower() in ROLES:
        return True
    if e.tag in ("html", "body", "article", "main") or e.attributes.get("itemprop", "").lower() == "articlebody":
        return False
    marks = _marks(e)
    return bool(marks & MARKS) or not in_article and (e.tag == "header" or bool(marks & PAGE_MARKS))


def layout(page: Page) -> tuple[list[bool], list[bool], int]:
    """Per element: whether declared markup removes it (or a parent), and
    whether it lies in an article; last, the number of the element that holds the
    main text: the article, main element or marked container with most text (-1:
    the whole page)."""
    gone, inside = [], []
    for e in page.elements:
        up = e.parent
        held = up >= 0 and inside[up]
        gone.append(up >= 0 and gone[up] or _declared(e, held))
        inside.append(held or e.tag in ("article", "main") or e.attributes.get("itemprop", "").lower() == "articlebody")

    def largest(test) -> int:
        return max((i for i, e in enumerate(page.elements) if not gone[i] and test(e)), key=lambda i: (page.elements[i].chars, -i), default=-1)

    for test in (lambda e: e.tag == "article", lambda e: e.attributes.get("itemprop", "").lower() == "articlebody",
                 lambda e: e.tag == "main" or e.attributes.get("role", "").lower() == "main",
                 lambda e: e.tag in ("div", "section", "td") and bool(_marks(e) & CONTENT_MARKS)):
        root = largest(test)
        if root >= 0 and page.elements[root].chars:
            return gone, inside, root
    return gone, inside, -1


def candidates(page: Page) -> set[int]:
    """Hashes of the subtrees that may be a template: all with text but what
    holds the main text or most of it, and the prose inside an article, which
    recurs where articles are copied or quote the same passage."""
    gone, inside, root = layout(page)
    above = set()
    at = root
    while at >= 0:
        above.add(at)
        at = page.elements[at].parent
    first, last = (page.elements[root].start, page.elements[root].end) if root >= 0 else (0, len(page.pieces))
    most = page.elements[root].chars if root >= 0 else sum(e.chars for e in page.elements if e.parent < 0)
    most -= sum(e.chars for i, e in enumerate(page.elements) if gone[i] and first <= e.start and e.end <= last and not (e.parent >= 0 and gone[e.parent]))
    return {e.hash for i, e in enumerate(page.elements)
            if e.chars and i not in above and e.tag not in ("html", "body", "article", "main")
            and not (inside[i] and e.tag in PROSE) and not ((inside[i] or root < 0) and 2 * e.chars > most)}


def main_text(page: Page, template: set[int]) -> str:
    """Blocks of the main text, one a line, without template subtrees."""
    gone, _, root = layout(page)
    allowed = candidates(page) & template if template else set()
    first, last = (page.elements[root].start, page.elements[root].end) if root >= 0 else (0, len(page.pieces))
    kept = bytearray(b"\x01") * len(page.pieces)
    end = 0
    for i, e in enumerate(page.elements):
        if e.start >= end and (gone[i] or e.hash in allowed):
            end = e.end
            kept[e.start:end] = bytes(end - e.start)
            if end > e.start and page.pieces[end - 1] == "\n":
                kept[end - 1] = 1  # the break stays
    blocks = "".join(p if p == "\n" or p == " " else p.replace("\n", " ") for p, k in zip(page.pieces[first:last], kept[first:last]) if k).split("\n")
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Each host with enough pages, their number and ``hashes`` of the host's
    template subtrees. A page counts once for each of its subtrees, copies of a
    page count each; counts are added up before the shuffle, so a host with most
    of the pages is no hot key. Pages without a host take no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(h, x) for h, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()) for x in {*candidates(parse(html)), 0}]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int64())], names=["host", "hash"])

    seen = pages.select(_host().alias("host"), "html").filter("host <> ''").mapInArrow(run, "host string, hash long")
    # written, as it is used twice and the pages shall be parsed once
    counts = written(seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages), "template-counts")
    whole = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("hash <> 0").join(whole, "host").filter(F.col("n") >= min_share * F.col("pages"))
    rows = often.select("host", "pages", "hash").unionByName(whole.select("host", "pages", F.lit(None).cast("long").alias("hash")))
    return rows.groupBy("host", "pages").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page row.

    ``found``: the output of :func:`templates`, by default of these pages. A
    host's list is bounded. Pages of large hosts get it by broadcast and are not
    shuffled; the others are joined by host. Null, empty and
    text-free pages give an empty text; pages of any length are taken whole.
    Repeated rows stay apart and give equal texts. A page without a host, or of a
    host with fewer than ``MIN_PAGES`` pages, has declared markup removed only.
    Where two elements hold equally much text, the first is the main one. Other
    columns are not read. An empty table gives an empty one."""
    found = written(templates(pages) if found is None else found, "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[tuple, set] = {}
        texts = []
        for html, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist()):
            key = tuple(hashes or ())
            if key not in sets:
                sets[key] = set(key)
            texts.append(main_text(parse(html), sets[key]))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    least = pages.count() / LARGE_HOSTS
    large = F.broadcast(found.filter(F.col("pages") >= least).select("host", "hashes", F.lit(True).alias("large")))
    first = pages.select("page_id", "url", "html", _host().alias("host")).join(large, "host", "left")
    rest = first.filter("large is null and host <> ''").select("page_id", "url", "html", "host")
    rest = rest.join(found.filter(F.col("pages") < least).select("host", "hashes"), "host", "left")
    direct = first.filter("large or host = ''")
    joined = direct.select("page_id", "url", "html", "hashes").unionByName(rest.select("page_id", "url", "html", "hashes"))
    return joined.mapInArrow(by_slices(run), f"page_id {kind}, url string, text string, n_chars long")
