"""Main text of web pages: site templates are found by hashing element subtrees and counting them for each host.

A page is parsed into a tree. The hash of a block element covers its tag and everything below it. Spark counts, for each
host, on how many different pages a subtree occurs; subtrees on PAGE_LEAST of them are template on a host of any size, on
small hosts those on a large part of the pages. A sentence may be repeated in articles too: paragraphs and headings inside an
article or main element are never template, elsewhere those amid others need the large part on any host. Template is deleted, along with the elements that hold no article text by their kind (menus, footers, forms, scripts and so on).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import discard, materialize

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
RAW = re.compile(r"</(script|style|noscript|template|textarea|title|iframe|svg|select)\b[^>]*>", re.I)
RAW_TAGS = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "audio", "video", "object", "canvas"} | RAW_TAGS
#: A name in class, id or role that is made of such words only.
BOILERPLATE = re.compile(r"(?:(?:ads?|advert[a-z0-9]*|banner|sponsor[a-z0-9]*|promo[a-z0-9]*|cookies?|consent|gdpr|notices?|newsletter|subscribe|popup|modal|"
                         r"nav|navigation|navbar|menu|breadcrumbs?|sidebar|footer|header|masthead|comments?|disqus|replies|respond|"
                         r"related|share|sharing|social|widget|toolbar)(?:[_-]+|$))+", re.I)
COMMENT = re.compile(r"(?:^|\s)comment(?:$|[\s_-])", re.I)
KEPT = {"html", "body", "main", "article"}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WHITE = re.compile(r"\s+")
#: An open element of the first kind ends where one of the others begins.
ENDED_BY = {"p": {"p", "div", "ul", "ol", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "nav", "aside", "header", "form", "pre",
                  "blockquote", "main", "figure", "dl", "hr"},
            "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Different pages that make a subtree template; or else a share of the host's pages, and at least so many.
PAGE_LEAST, PAGE_SHARE, PAGE_FEW = 10, 0.5, 3
#: Template subtrees of all hosts that are sent to every task: 16 MB.
SENT_KEYS = 1 << 21
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre"} | HEADINGS


@lru_cache(1 << 14)
def is_boilerplate(names: str) -> bool:
    return any(BOILERPLATE.fullmatch(name) for name in names.split())


class Element:
    __slots__ = ("tag", "dropped", "parts", "key")

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.dropped, self.parts, self.key = tag, dropped, [], 0


def keep_above(open_: list[Element]) -> None:
    """An article or main element begins: what is around it isn't boilerplate by its name. Not if an article is around it,
    which is kept as a whole, or a kind of element that is always dropped."""
    for k in range(len(open_) - 1, -1, -1):
        if open_[k].tag == "article" or open_[k].tag in DROPPED:
            return
        if open_[k].tag == "main":
            break
    for e in open_[k:]:
        e.dropped = False


def parse(page: str) -> Element:
    """Tree of a page; unclosed, misnested and truncated markup is closed where HTML would."""
    root = Element("")
    open_ = [root]
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!][^>]*$", rest)      # a tag that the page breaks off in
            open_[-1].parts.append(rest[:cut.start()] if cut else rest)
            break
        if m.start() > at:
            open_[-1].parts.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if tag in INLINE and open_[k].tag not in INLINE:
                    break
            continue
        for kind, enders in ENDED_BY.items():
            if tag in enders:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == kind:
                        del open_[k:]
                        break
                    if open_[k].tag not in INLINE and open_[k].tag != "p":
                        break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3])) if "=" in m[3] else ""
        element = Element(tag, tag in DROPPED or tag not in KEPT and is_boilerplate(names))
        if tag == "main" or tag == "article" and not COMMENT.search(names):
            keep_above(open_)
        open_[-1].parts.append(element)
        if tag in RAW_TAGS:
            end = next((e for e in RAW.finditer(page, at) if e[1].lower() == tag), None)
            element.parts.append(page[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(element)
    return root


def walk(element: Element) -> Iterator[Element]:
    stack = [element]
    while stack:
        e = stack.pop()
        yield e
        stack += [x for x in e.parts if isinstance(x, Element)]


def hash_subtrees(root: Element) -> None:
    """Sets key of every element: tag, text and the keys of what is below. No recursion, for any depth."""
    for e in reversed(list(walk(root))):
        digest = blake2b(e.tag.encode(), digest_size=8)
        for x in e.parts:
            digest.update(x.key.to_bytes(8, "big", signed=True) if isinstance(x, Element) else b"\0" + " ".join(x.split()).encode())
        e.key = int.from_bytes(digest.digest(), "big", signed=True)


def main_parts(root: Element) -> list[Element]:
    """The outermost articles, else the outermost main elements, else the whole page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if e.tag == wanted and not e.dropped:
                found.append(e)
            elif not e.dropped:
                stack += [x for x in reversed(e.parts) if isinstance(x, Element)]
        if found:
            return found
    return [root]


def text_of(root: Element, template: frozenset[int]) -> str:
    blocks, buffer = [], []

    def flush():
        text = WHITE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            blocks.append(text)
        buffer.clear()

    for part in main_parts(root):
        stack: list = [part]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                buffer.append(x)
            elif not x.dropped and (x is part or x.key not in template or x.tag in INLINE):
                if x.tag == "br" or x.tag == "hr":
                    buffer.append(" ")
                elif x.tag in INLINE:
                    stack += reversed(x.parts)
                else:
                    flush()
                    stack.append(None)
                    stack += reversed(x.parts)
            elif x.tag not in INLINE:
                flush()
        flush()
    return " ".join(blocks)


def _rows(columns: str, one):
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for row in batch.itertuples(index=False, name=None) for r in one(*row)]
            yield pd.DataFrame(out, columns=names)

    return run


def amid_others(root: Element) -> set[int]:
    """Keys of the paragraphs and headings that are never the first or last block around them, headings not counted."""
    inner, edge = set(), set()
    for e in walk(root):
        blocks = [x for x in e.parts if isinstance(x, Element) and x.tag not in INLINE and x.tag not in VOID and not x.dropped]
        inner.update(x.key for x in blocks if x.tag in PROSE)
        bodies = [x.key for x in blocks if x.tag not in HEADINGS]
        edge.update(bodies[:1] + bodies[-1:])
    return inner - edge


def _subtrees(page, host, text):
    root = parse(text)
    hash_subtrees(root)
    main = main_parts(root)
    content = blake2b(b"".join(e.key.to_bytes(8, "big", signed=True) for e in main), digest_size=8).digest()
    prose = {e.key for part in main if part.tag in ("article", "main") for e in walk(part) if e.tag in PROSE}
    seen = {e.key for e in walk(root) if e.tag and e.tag not in INLINE and e.tag not in VOID and e not in main} - prose
    inner = amid_others(root)
    return [(page, host, int.from_bytes(content, "big", signed=True), key, int(key in inner)) for key in seen]


def templates(pages: DataFrame, share: float = PAGE_SHARE, least: int = PAGE_LEAST, few: int = PAGE_FEW) -> tuple[DataFrame, DataFrame]:
    """Two tables: (host, key), the subtrees that are template on their host, and (page, host, key), all subtrees of all pages.

    Copies of an article count as one page, so an article that is repeated does not become a template."""
    columns = "page long, host long, content long, key long, inner int"
    found = pages.select("page", "host", "html").mapInPandas(_rows(columns, _subtrees), columns).distinct()
    found = materialize(found, "subtrees")
    size = found.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    once = found.groupBy("host", "key", "content").agg(F.min("inner").alias("inner"))
    counted = once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("inner").alias("inner")).where(F.col("n") >= min(few, least))
    many = (F.col("n") >= least) & (2 * F.col("inner") <= F.col("n"))
    common = counted.join(size, "host").where(many | (F.col("n") >= few) & (F.col("n") >= share * F.col("pages"))).select("host", "key")
    return materialize(common, "template-subtrees"), found


def own_parts(common: DataFrame, found: DataFrame) -> DataFrame:
    """(page, template): for the pages with parts of their host's template, the hashes of these."""
    own = found.select("page", "host", "key").join(common, ["host", "key"], "left_semi").groupBy("page").agg(F.collect_set("key").alias("template"))
    return materialize(own, "templates")


def extract(pages: DataFrame, share: float = PAGE_SHARE, least: int = PAGE_LEAST, few: int = PAGE_FEW, sent: int = SENT_KEYS) -> DataFrame:
    """Columns page_id, url, text, n_chars: one row for every row of `pages` (page_id, url, html).

    A null or empty page has the text "". Pages without a url, or with one that has no host, form a host of their own
    and are parsed like others. Repeated rows stay, equal pages count once for the template, extra columns are ignored,
    an empty table gives an empty result. The template of all hosts is sent to every task if it has at most `sent` subtrees
    (8 bytes each); beyond that every page is joined with its own part of it, with the same result. Broken markup never fails; text after a tag that is cut off is kept up to it.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host).alias("host"),
                        F.xxhash64(host, text).alias("page"), text.alias("html"))
    columns = "page_id long, url string, text string, n_chars long"
    common, found = templates(base, share, least, few)

    def result(page_id, url, root, template):
        text = text_of(root, template)
        return [(page_id, url, text, len(text))]

    if common.count() <= sent:
        discard(found)
        pairs = common.select(F.col("host").bitwiseXOR(F.col("key")).alias("pair")).toArrow()["pair"]
        shared = pages.sparkSession.sparkContext.broadcast(np.unique(pairs.to_numpy()))

        def one(page_id, url, page, host):
            root = parse(page)
            hash_subtrees(root)
            keys = np.array([e.key for e in walk(root)], np.int64)
            known, wanted = shared.value, keys ^ host
            at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            return result(page_id, url, root, frozenset(keys[known[at] == wanted].tolist()) if len(known) else frozenset())

        return base.select("page_id", "url", "html", "host").mapInPandas(_rows(columns, one), columns)

    def joined(page_id, url, page, template):
        root = parse(page)
        hash_subtrees(root)
        return result(page_id, url, root, frozenset(template if template is not None else ()))

    own = own_parts(common, found)
    discard(found)
    return base.join(own, "page", "left").select("page_id", "url", "html", "template").mapInPandas(_rows(columns, joined), columns)
