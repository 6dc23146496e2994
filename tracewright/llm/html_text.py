"""Main text of web pages: elements by their role, and site templates removed by subtree counts.

Every block element's subtree is hashed with its position, the tags above it. Spark counts per
host on how many different pages a subtree occurs there, and those that recur on
``LEAST_PAGES`` of them are deleted, however many pages the host has. Within a marked
article, whose own lines recur too, they must be on a share of the pages as well. Elements
whose tag, role or class names a menu, a notice and the like go without a count. What is
left of the article, or of the body where no article is marked, is the text.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.joins import lookup
from tracewright.session import materialize

# A template recurs on this many different pages of its host at least.
LEAST_PAGES = 6
# On a host with fewer different pages than this, and within a marked article, it is on more than this share of them as well.
SMALL_HOST = 20
SHARE = 0.5

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption address nav header footer aside form fieldset details summary hr center".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# Elements that hold no article text.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea input "
    "iframe object svg canvas audio video menu dialog noembed noframes".split()
)
# Words of class, id and role that name such parts.
PARTS = frozenset(
    "nav navbar navigation menu menubar header masthead footer contentinfo sidebar aside complementary ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal dialog overlay newsletter subscribe signup login search comment comments disqus reply replies respond share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget form".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_MARKED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    """A parsed element; ``items`` holds its elements and strings in page order."""

    __slots__ = ("tag", "attributes", "items", "digest", "length")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.items = tag, attributes, []
        self.digest = self.length = 0

    def named(self) -> dict[str, str]:
        found = _ATTRIBUTE.findall(self.attributes) if self.attributes.strip() else ()
        return {k.lower(): references.unescape(v.strip("\"'")) for k, v in found}


def parsed(page: str) -> Element:
    """A tree of any page, also of one with unclosed or crossed tags. Raw elements keep no text."""
    root = Element("")
    open_ = [root]
    at = 0
    while match := _TOKEN.search(page, at):
        if match.start() > at:
            open_[-1].items.append(references.unescape(page[at : match.start()]))
        at = match.end()
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag), 0)
            if depth:
                del open_[depth:]
            continue
        if tag in BLOCK:  # a block ends an open paragraph, with what is open in it
            depth = len(open_) - 1
            while open_[depth].tag not in BLOCK and depth:
                depth -= 1
            if open_[depth].tag == "p":
                del open_[depth:]
        if tag in CLOSED_BY:
            depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag in CLOSED_BY[tag]), 0)
            if depth and not any(e.tag in ("ul", "ol", "dl", "table") for e in open_[depth:]):
                del open_[depth:]
        element = Element(tag, attributes)
        open_[-1].items.append(element)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            open_.append(element)
    if at < len(page):
        open_[-1].items.append(references.unescape(page[at:]))
    return root


def _walk(root: Element, unless=None) -> Iterator[Element]:
    """Elements in page order, without what is below those that ``unless`` names."""
    stack = [root]
    while stack:
        element = stack.pop()
        yield element
        if unless is None or not unless(element):
            stack += [x for x in reversed(element.items) if isinstance(x, Element)]


def _sign(root: Element) -> None:
    """Text length of every subtree and a digest of its tags and words, leaves first, and of the tags above it."""
    for element in reversed(list(_walk(root))):
        state = xxhash.xxh64(element.tag.encode())
        for x in element.items:
            if isinstance(x, str):
                words = " ".join(x.split())
                element.length += len(words)
                state.update(b"\0" + words.encode(errors="replace"))
            else:
                element.length += x.length
                state.update(b"\1" + x.digest.to_bytes(8, "big"))
        element.digest = state.intdigest()
    # Then the position goes into the digests, from the top.
    stack = [(root, 0)]
    while stack:
        element, above = stack.pop()
        place = xxhash.xxh64_intdigest((_role(element) or "").encode(errors="replace"), above)
        stack += [(x, place) for x in element.items if isinstance(x, Element)]
        element.digest = xxhash.xxh64_intdigest(element.digest.to_bytes(8, "big"), place)


def subtrees(page: str | None) -> set[tuple[int, bool]]:
    """Signed digests of the block subtrees with text, and whether they are in a marked article."""
    if not page:
        return set()
    root = parsed(page)
    _sign(root)
    found = set()
    stack = [(root, False)]
    while stack:
        e, marked = stack.pop()
        marked = marked or _role(e) == "article"
        if e.length and e.tag in BLOCK and e.tag not in ("html", "body"):
            found.add((e.digest - (1 << 64) if e.digest >> 63 else e.digest, marked))
        stack += [(x, marked) for x in e.items if isinstance(x, Element)]
    return found


def _role(element: Element) -> str | None:
    """The tag or, where one is given, the role."""
    return element.named().get("role", element.tag) if "role" in element.attributes.lower() else element.tag


def _is_part(element: Element) -> bool:
    if element.tag in DROPPED:
        return True
    if not _MARKED.search(element.attributes) or element.tag in ("", "html", "body", "main"):
        return False
    named = element.named()
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return True
    words = re.findall(r"[a-z]+", " ".join(named.get(k, "") for k in ("class", "id", "role")).lower())
    return not PARTS.isdisjoint(words)


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The article's blocks, one a line. Without a marked article the body's, without a body all."""
    if not page:
        return ""
    root = parsed(page)
    if templates:
        _sign(root)

    def dropped(e: Element) -> bool:
        signed = e.digest - (1 << 64) if e.digest >> 63 else e.digest
        return bool(templates) and signed in templates or _is_part(e)

    def blocks(start: Element) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            if text := _SPACE.sub(" ", "".join(line)).strip():
                out.append(text)
            line.clear()

        stack: list = [start]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                line.append(x)
            elif x is None:
                end()
            elif x is start or not dropped(x):
                block = x.tag in BLOCK
                if block:
                    end()
                    stack.append(None)
                elif x.tag in ("br", "td", "th"):
                    line.append(" ")
                stack += reversed(x.items)
        end()
        return out

    # All outermost articles outside every part of the page, else any; main elements where there is no article.
    for free in (True, False):
        for role in ("article", "main"):

            def wanted(e: Element) -> bool:
                return _role(e) == role and not _is_part(e)

            choice = [e for e in _walk(root, lambda e: wanted(e) or free and _is_part(e)) if wanted(e)]
            if choice:
                return "\n".join(x for e in [e for e in choice if not dropped(e)] or choice for x in blocks(e))
    body = next((e for e in _walk(root) if e.tag == "body"), root)
    return "\n".join(blocks(body))


def host(url: Column) -> Column:
    """Lower-case host name of a URL; empty for null and for anything else."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _page_parts(pages: DataFrame) -> DataFrame:
    """``host``, ``page``, and ``subtree`` digests with ``marked`` of every row, equal pages of a host once."""
    given = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [subtrees(x) for x in batch["html"]]
            repeated = batch.index.repeat([len(f) for f in found])
            out = batch.loc[repeated, ["host", "page"]]
            out["subtree"] = [d for f in found for d, _ in f]
            out["marked"] = [m for f in found for _, m in f]
            yield out

    return given.mapInPandas(parts, "host string, page bigint, subtree bigint, marked boolean").distinct()


def site_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, small: int = SMALL_HOST) -> DataFrame:
    """``host``, ``page`` (hash of its HTML) and the digests of the ``templates`` on it.

    Equal pages of a host count once. A page gets only its own templates, so that a host
    may have any number of them.
    """
    rows = materialize(_page_parts(pages), "subtrees")
    counts = rows.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("marked").alias("marked")).filter(F.col("n") >= least)
    given = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page")).distinct()
    sizes = given.groupBy("host").agg(F.count("*").alias("pages"))
    enough = (F.col("pages") >= small) & ~F.col("marked") | (F.col("n") > share * F.col("pages"))
    many = lookup(counts, sizes, ["host"], ["subtree"], "inner").filter(enough).select("host", "subtree")
    many = materialize(many, "many")
    found = lookup(rows, many, ["host", "subtree"], ["page"], "inner", force_salt=True)
    return found.groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))


def extracted(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, small: int = SMALL_HOST) -> DataFrame:
    """Per input row ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    Null and empty pages have an empty text. Pages without a host share the empty one.
    Repeated rows get equal texts.
    """
    templates = materialize(site_templates(pages, least, share, small), "templates")
    given = pages.select("page_id", "url", "html").withColumns({"host": host(F.col("url")), "page": F.xxhash64("html")})
    # By shuffle at any size, for templates grow with the pages: what small runs cost says what large ones do.
    joined = lookup(given, templates, ["host", "page"], ["page_id", "url"], force_salt=True).select("page_id", "url", "html", "templates")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(() if t is None else t.tolist())) for h, t in zip(htmls, found)], dtype=object)

    out = joined.select("page_id", "url", text("html", "templates").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
