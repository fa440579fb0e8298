"""Main text of web pages with site templates removed (operator 7).

A page is parsed to its element tree.  Every element's subtree is hashed (tag, class, texts and the hashes of its children), the hashes are counted per
host in Spark, and subtrees that recur on MANY pages of the host with different main texts are its template and go.  Copies
of one page count once, so a copied article is no template; paragraphs and headings inside an ``article`` or ``main``
element are never taken for one.  Elements whose tag, class, id or role says that they are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments go as well.  Where a page has an ``article`` or
``main`` element, the text is what is left of that; else it is what is left of the page.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

MANY = 5  # pages of different main texts
SMALL = 1 << 19  # template hashes that are broadcast at most: 4 MB and their hosts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")

RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "math", "object", "canvas", "video", "audio", "select"}
_ENDS = {x: re.compile(f"</{x}", re.I | re.A) for x in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
DROP = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label"}
BLOCK = {
    "html", "head", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
    "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address",
    "details", "summary", "hr", "center",
} | DROP
ROOTS = {"article", "main"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dt", "dd", "td", "th", "tr", "tbody", "figure", "figcaption", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th", "blockquote"} | DROP
#: parts of class, id and role names that mark what is not main text (fixed values)
MARKS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices alert sidebar comment comments respond replies disqus menu menubar navbar nav navigation breadcrumb
breadcrumbs footer header masthead share sharing social related newsletter subscribe subscription signup popup modal overlay
pagination pager toolbar widget complementary contentinfo search""".split())
COMMENTS = {"comment", "comments", "respond", "replies", "disqus"}


def _marks(attrs: str) -> tuple[set[str], str]:
    found, name = set(), ""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("hidden",) or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("hidden")
        elif key in ("class", "id", "role"):
            name += f" {key}={value}" if key != "id" else ""
            found |= {x.lower() for x in _PART.split(value) if x.lower() in MARKS}
    return found, name


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    """``drop``: 2 where tag or comment marks say that it is no main text, 1 where another name does; ``start``: an element
    that only a 2 above it hides; ``root``: it is, or lies in, an article or main element; ``digest``: hash of its subtree."""

    __slots__ = ("tag", "name", "drop", "start", "root", "up", "digest", "items")

    def __init__(self, tag, name, drop, start, root, up):
        self.tag, self.name, self.drop, self.start, self.root, self.up, self.digest, self.items = tag, name, drop, start, root, up, None, []


def parse(page: str) -> tuple[list[tuple[str, Element]], list[Element], list[Element]]:
    """(text, innermost element) of each block in page order, all elements whose subtrees are hashed, and all elements with
    parents before children.  Time and memory grow with the page, whatever is left unclosed in it."""
    stack, blocks, done = [Element("html", "", 0, True, False, None)], [], []
    made, opened = [stack[0]], Counter()
    text: list[str] = []
    at, n = 0, len(page)
    tags_end = page.rfind(">")

    def flush():
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t:
                blocks.append((t, stack[-1]))
                stack[-1].items.append(_hash(t))

    def pop():
        flush()
        e = stack.pop()
        opened[e.tag] -= 1
        digest = _hash(f"{e.tag}{e.name}\0" + "\0".join(map(str, e.items)))
        e.items = None
        stack[-1].items.append(digest)
        if e.tag not in ("html", "body", "head") and e.tag not in ROOTS:
            e.digest = digest
            done.append(e)

    while at < n:
        if at > tags_end:  # no tag can end any more
            end = page.find("<!--", at)
            text.append(page[at:] if end < 0 else page[at:end])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if not s.startswith(("<!", "<?")) or s == "<":
                text.append(s)
            continue
        tag = tag.lower()
        if not (m[1] or m[4]):
            attrs = m[3] if m[2] else m[6]
            if tag in RAW:
                if not attrs.endswith("/"):
                    end = _ENDS[tag].search(page, at)
                    at = page.find(">", end.end()) + 1 if end else 0
                    at = at or n
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag not in BLOCK:
                continue
            flush()
            if tag in ("html", "hr"):
                continue
            if tag == "body" or tag in ROOTS:
                while stack[-1].tag in ("head", "p"):
                    pop()
            # an open paragraph ends where a block begins; items end where the next one begins
            ends = {"p"} | CLOSES.get(tag, set())
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in HOLDERS:
                    break
            up = stack[-1]
            marks, name = _marks(attrs) if attrs.strip() else (set(), "")
            root = tag in ROOTS and not marks & COMMENTS
            strong = tag in DROP or bool(marks & COMMENTS)
            start = tag == "body" or root
            drop = 0 if start else 2 if strong else 1 if marks else 0
            stack.append(Element(tag, name, drop, start, up.root or root, up))
            made.append(stack[-1])
            opened[tag] += 1
        else:
            if tag == "br":
                text.append(" ")
            if tag not in BLOCK:
                continue
            if not opened[tag]:
                flush()
                continue
            while stack[-1].tag != tag:
                pop()
            pop()
    while len(stack) > 1:
        pop()
    flush()
    return blocks, done, made


def _candidate(e: Element) -> bool:
    return not (e.root and e.tag in TEXT_BLOCKS)


def main_text(blocks, made, template=frozenset()) -> str:
    """What is left of the blocks.  A name alone does not hide an element with more than half of the page's text."""
    size = dict.fromkeys(made, 0)
    for t, e in blocks:
        size[e] += len(t)
    total = sum(size.values())
    for e in reversed(made):
        if e.up is not None:
            size[e.up] += size[e]
    state: dict[Element, int] = {}
    for e in made:
        above = state[e.up] if e.up is not None else 0
        own = e.drop if e.drop == 2 or 2 * size[e] <= total else 0
        if e.digest in template and _candidate(e):
            own = 2
        state[e] = max(own, above if above == 2 or not e.start else 0)
    left = [(t, e.root) for t, e in blocks if not state[e]]
    rooted = any(r for _, r in left)
    return " ".join(t for t, r in left if r or not rooted)


def host_of(url: str = "url"):
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages(page_id, url, html)`` but html, with text and n_chars (columns of these names are replaced).

    Null html is an empty page.  Pages without a host are one site.  Rows with equal page_id are judged apart.
    """
    spark = pages.sparkSession
    carried = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    source = pages.select(*carried, F.coalesce("html", F.lit("")).alias("html"), host_of().alias("__host"))

    def count(batches):
        for b in C.pieces(batches, "html"):
            rows = set()
            for host, page in zip(b.column("__host").to_pylist(), b.column("html").to_pylist()):
                blocks, done, made = parse(page)
                body = _hash(main_text(blocks, made))
                rows |= {(host, e.digest, body) for e in done if _candidate(e)}
            if rows:
                host, digest, body = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(digest, pa.int64()), pa.array(body, pa.int64())], ["host", "digest", "body"])

    seen = source.select("__host", "html").mapInArrow(count, "host string, digest long, body long")
    often = seen.distinct().groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    template = C.save(often.groupBy("host").agg(F.collect_list("digest").alias("__template")), "op7-templates")
    total = template.agg(F.coalesce(F.sum(F.size("__template") + 4), F.lit(0))).first()[0]
    per_host = template.withColumnRenamed("host", "__host")
    joined = source.join(F.broadcast(per_host) if total <= SMALL else per_host, "__host", "left")
    schema = StructType([*pages.select(*carried).schema, *StructType.fromDDL("text string, n_chars long")])

    def cut(batches):
        last, template = None, frozenset()
        for b in C.pieces(batches, "html"):
            out = []
            for host, page, t in zip(b.column("__host").to_pylist(), b.column("html").to_pylist(), b.column("__template").to_pylist()):
                if host != last:
                    last, template = host, frozenset(t or ())
                blocks, _, made = parse(page)
                out.append(main_text(blocks, made, template))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*carried, "text", "n_chars"])

    return joined.mapInArrow(cut, schema)
