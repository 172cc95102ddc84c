"""Main text of web pages with site templates removed.

Every element's subtree is hashed twice: as it stands (tags, classes, text; not addresses) and by its shape (tags and
classes alone, runs of equal children as one). Spark counts on how many different pages of its host each hash stands and what
share of their text it makes. Subtrees whose text recurs on many pages, and named ones whose shape stands on nearly all
pages and makes a small share of them, are deleted as the site's template. Pages whose article (or body, without one)
has the same text are one page, however often it was fetched. Never taken for template are
subtrees that hold an article, prose inside an article (paragraphs, headings, lists, tables) and what holds it, as
passages may be quoted on many pages, and what makes half or more of an article's text; by shape, nothing inside an article
and nothing that holds paragraphs.

On a host with enough different pages for counts, what they leave of the whole page (less what no browser shows:
scripts, styles, the head) is the text, one line a block. Counts can't tell what a host shows on few pages. So beside it
stands the reading by markup: the article, or the body of pages that have none, without what markup names as no text
(menus, headers, footers, sidebars, forms, adverts, notices, comments). It is the text of pages of small hosts, and where
the counts leave something that it does not have; the column `source` says which one a page's text is: counts or markup.

Templates meet their pages by host and one of SALTS shares of its pages, so no task has a large host whole.

Defined cases: a null or empty page has an empty text; rows are judged one by one, repeated ones alike; a null URL
belongs to the empty host; broken markup is read as far as its tags go; an empty table gives an empty result; columns
other than page_id, url, html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize, rows_of

#: A subtree is template from so many pages of its host, and from this share of them, on.
MIN_PAGES, MIN_SHARE = 10, 0.1
#: By its shape: from this share of the pages on, if it makes at most this share of their text on average.
SHAPE_SHARE, SHAPE_TEXT = 0.9, 0.2
#: Shares of a host's pages that meet its templates apart.
SALTS = 64

# Element names and name parts of the HTML standard and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead table ul ol dl pre blockquote figcaption caption".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table dl".split())
BARE = frozenset("div section span center tbody tr td th ul ol li".split())
DROPPED = frozenset("script style noscript template iframe svg math textarea head title nav header footer aside form button select option input dialog menu object audio video canvas map noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|foot|header|masthead|cookies?|consent|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|comments?|replies|reply|disqus|related|recommend\w*|pagination|pager|widget|toolbar|skip|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|related|teaser|sponsor\w*|ads?)(?:$|[\s_-])", re.IGNORECASE)
UNSEEN = frozenset("head script style noscript template noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = PROSE - {"tr", "tbody", "thead", "td", "th", "caption", "figcaption"} | frozenset("address article aside div fieldset figure footer form header hr main menu nav section details summary".split())
SCOPES = frozenset("table ul ol dl div section article main aside nav body td th".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+(?:"[^"]*"|'[^']*'|[^>"'])*|/)?)>|<[!?/][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "name", "dropped", "article", "holds", "parts", "parent", "hash", "shape", "text", "size", "shown", "prose")

    def __init__(self, tag: str, name: str, dropped: bool, parent: Element | None) -> None:
        self.tag, self.name, self.dropped, self.parent = tag, name, dropped, parent
        self.article: Element | None = self if tag in ("article", "main") else parent and parent.article
        self.holds = False  # an article, or prose of an article
        self.parts: list[str | Element] = []
        self.hash, self.shape, self.text = 0, 0, False
        self.size, self.shown = 0, 0  # characters without dropped elements, and with them
        self.prose = tag in PARAGRAPHS


def parse(html: str) -> Element:
    """The tree of a page, with the hash of every subtree."""
    root = top = Element("", "", False, None)
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            top.parts.append(html[at:])
            break
        if m.start() > at:
            top.parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            top = _closed(top, tag)
            continue
        if tag in ENDS_P:
            top = _implied(top, ("p",))
        if tag in CLOSES:
            top = _implied(top, CLOSES[tag])
        if tag in VOID:
            top.parts.append(" ") if tag == "br" else None
            if tag == "hr":
                top.parts.append(Element("hr", "", False, top))
            continue
        name, dropped = _named(tag, m[3])
        element = Element(tag, name, dropped or top.dropped, top)
        if not element.dropped and element.article and (element.article is element or tag in PROSE):
            above = top
            while above is not None and not above.holds and (element.article is element or above.article is not None):
                above.holds = True
                above = above.parent
        top.parts.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            element.parts.append(html[at : close.start() if close else end])
            at = close.end() if close else end
            _finish(element)
        elif not m[3].rstrip().endswith("/") or tag in SCOPES:
            top = element
    while top is not root:
        _finish(top)
        top = top.parent
    _finish(root)
    return root


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """(class and id, whether the markup names it as no text)."""
    if not attributes or attributes.isspace():
        return "", tag in DROPPED
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)]
    name = " ".join(v for k, v in found if k in ("class", "id"))
    off = tag in DROPPED or any(k == "hidden" and not v or k == "role" and v.lower() in ROLES or k == "aria-hidden" and v.lower() == "true" for k, v in found)
    known = ARTICLE_NAMES if tag == "article" else NAMES
    return name, off or tag not in ("html", "body", "main", "a") and bool(known.search(name))


def _closed(top: Element, tag: str) -> Element:
    """After an end tag: the parent of the element it closes; unknown ones are passed over."""
    at: Element | None = top
    while at.parent is not None and at.tag != tag:
        if at.tag in SCOPES and tag not in SCOPES and tag not in DROPPED:
            return top
        at = at.parent
    if at.parent is None:
        return top
    while top is not at:
        _finish(top)
        top = top.parent
    _finish(at)
    return at.parent


def _implied(top: Element, tags: tuple[str, ...]) -> Element:
    """After a start tag that ends an open element of one of these tags within its scope."""
    at = top
    while at.parent is not None and at.tag not in SCOPES or at.tag in tags:
        if at.tag in tags:
            while top is not at:
                _finish(top)
                top = top.parent
            _finish(at)
            return _implied(at.parent, tags)
        at = at.parent
    return top


def _finish(element: Element) -> None:
    digest, shape, last = xxhash.xxh3_64(), xxhash.xxh3_64(seed=1), None
    head = f"{element.tag}\t{element.name}\n"
    digest.update(head)
    shape.update(head)
    for part in element.parts:
        if isinstance(part, str):
            words = " ".join(part.split())
            if not words:
                continue
            element.text = True
            element.size += len(words)
            element.shown += 0 if element.tag in RAW else len(words)
            digest.update(words)
            mark = b"text"
        else:
            element.text |= part.text
            element.size += 0 if part.dropped else part.size
            element.shown += part.shown
            element.prose |= part.prose
            digest.update(part.hash.to_bytes(8))
            mark = part.shape.to_bytes(8)
        if mark != last:
            shape.update(mark)
        last = mark
    element.hash, element.shape = digest.intdigest(), shape.intdigest()


def elements(root: Element) -> Iterator[Element]:
    stack = [root]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(p for p in at.parts if not isinstance(p, str))


def candidate(element: Element) -> bool:
    """Whether the subtree may be template: no inline markup, no holder of an article, and no content of one."""
    if not element.text or element.holds or element.tag in INLINE or element.tag in ("", "html", "body", "article", "main"):
        return False
    return element.article is None or element.tag not in PROSE and 2 * element.size < element.article.size


def shaped(element: Element) -> bool:
    """Whether the subtree may be template by its shape: named by tag or class, outside of articles, without paragraphs."""
    if element.article is not None or element.prose or not candidate(element):
        return False
    return bool(element.name) or element.tag not in BARE


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def recurs(element: Element, template: set[int]) -> bool:
    """Whether a counted template matches the subtree."""
    if not template or not candidate(element):
        return False
    return signed(element.hash) in template or signed(element.shape) in template and shaped(element)


def removed(root: Element, template: set[int]) -> tuple[int, int]:
    """Characters that counted templates delete, and characters that go by their markup's names alone."""
    by_count = by_name = 0
    stack = [root]
    while stack:
        at = stack.pop()
        if recurs(at, template):
            by_count += at.shown
        elif at.dropped:
            by_name += 0 if at.tag == "head" else at.shown
        else:
            stack.extend(p for p in at.parts if not isinstance(p, str))
    return by_count, by_name


def main_text(html: str | None, template: Iterable[int] = ()) -> str:
    """Blocks of the article (of the body, if the page has none), one a line, without template and dropped elements."""
    if not html:
        return ""
    return text_of(parse(html), set(template))


def text_of(root: Element, template: set[int], frame: bool = True) -> str:
    """One line a block of what templates leave: of the article without what markup names as no text, or, without the frame,
    of all that a browser shows."""
    if frame:
        gone = lambda e: recurs(e, template) or e.dropped
        roots = _outermost(root, "article", gone) or _outermost(root, "main", gone) or [root]
    else:
        gone = lambda e: e.tag in UNSEEN or recurs(e, template)
        roots = [root]
    blocks: list[str] = []
    for top in roots:
        line: list[str] = []
        stack: list[str | Element | None] = [top]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                line.append(at)
            elif at is None or at.tag not in INLINE:  # a block begins or ends
                blocks.append("".join(line))
                line.clear()
                if at is not None and not gone(at):
                    stack.append(None)
                    stack.extend(reversed(at.parts))
            elif not gone(at):
                stack.extend(reversed(at.parts))
        blocks.append("".join(line))
    texts = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def read(root: Element, template: set[int], counted: bool) -> tuple[str, str]:
    """(text, source): what counts leave on hosts that were counted, unless markup knows more of it to be no text."""
    by_markup = text_of(root, template)
    return (by_markup, "counts") if counted and text_of(root, template, frame=False) == by_markup else (by_markup, "markup")


def _outermost(root: Element, tag: str, gone) -> list[Element]:
    found, stack = [], [root]
    while stack:
        at = stack.pop()
        if at.tag == tag and not at.dropped:
            found.append(at)
        elif not gone(at):
            stack.extend(p for p in reversed(at.parts) if not isinstance(p, str))
    return found


HOST = r"(?s)^.*?://([^/?#]*)"


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, source, template_chars, markup_chars) of pages (page_id, url, html).

    The last two: characters deleted as counted template, and by their markup's names alone."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    templates = materialize(site_templates(pages, min_pages, min_share), "templates")
    by_host = templates.groupBy("host").agg(F.collect_set("hash").alias("template"))  # at most 1 / min_share times the elements of a page
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("source", pa.string()), ("template_chars", pa.int64()), ("markup_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged() -> Iterator[tuple]:
            for page_id, url, html, found in rows_of(batches):
                root, template = parse(html or ""), set(found or ())
                yield page_id, url, *read(root, template, found is not None), *removed(root, template)

        yield from batches_of(judged(), schema, 500)

    joined = pages.join(by_host, ["host", "salt"], "left").select("page_id", "url", "html", "template")
    out = joined.mapInArrow(run, "page_id long, url string, text string, source string, template_chars long, markup_chars long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "source", "template_chars", "markup_chars")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur, as they stand or by shape, on many different pages of their host.

    A host with enough pages for counts but without any such subtree has one row, whose hash is null."""
    schema = pa.schema([("host", pa.string()), ("hash", pa.int64()), ("shape", pa.bool_()), ("page", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for host, html in rows_of(batches):
                root = parse(html or "")
                page = signed(xxhash.xxh3_64_intdigest(text_of(root, set())))
                yield host, None, False, page, None  # the page itself
                shares: dict[tuple[int, bool], float] = {}
                for e in elements(root):
                    if candidate(e):
                        shares[e.hash, False] = 0.0
                        if shaped(e):
                            shares[e.shape, True] = shares.get((e.shape, True), 0.0) + e.shown / max(root.shown, 1)
                for (h, shape), share in shares.items():
                    yield host, signed(h), shape, page, share

        yield from batches_of(found(), schema, 20_000)

    rows = pages.select("host", "html").mapInArrow(run, "host string, hash long, shape boolean, page long, share double")
    counts = rows.groupBy("host", "hash", "shape").agg(F.count_distinct("page").alias("n"), F.avg("share").alias("share"))
    counts = materialize(counts.where((F.col("n") >= min_pages) | F.col("hash").isNull()), "subtrees")
    of_host = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    often = F.when(F.col("shape"), (F.col("n") >= F.col("pages") * SHAPE_SHARE) & (F.col("share") <= SHAPE_TEXT)).otherwise(F.col("n") >= F.col("pages") * min_share)
    found = counts.where("hash is not null").join(of_host, "host").where(often).select("host", "hash").distinct()
    return found.unionByName(of_host.where(F.col("pages") >= min_pages).select("host", F.lit(None).cast("long").alias("hash")))
