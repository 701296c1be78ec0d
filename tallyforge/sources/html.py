"""HTML pages to title, date, URL and text, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of site chrome, of blocks, and where a body is looked for, in order.
NOISE = frozenset("script style nav header footer aside form noscript".split())
BLOCKS = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article blockquote dt dd hr pre figure figcaption header footer".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BODY_CLASSES = ("rw-report__content", "report__content", "rw-article__content")
DENSE = frozenset("div section article main td".split())


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs or ()), [], parent

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))


class _Tree(HTMLParser):
    """A forgiving tree: unknown end tags are dropped, open paragraphs close at a new block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root")

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "p" and tag in BLOCKS and tag != "br":
            self.at = self.at.parent
        node = _Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def block_text(node: _Node, skip=NOISE) -> str:
    """Text with line breaks at blocks and inline text kept together."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag not in skip:
            if item.tag == "br":
                out.append("\n")
                continue
            if item.tag in BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(item.children))
    text = re.sub(r"[ \t\r\f\v]+", " ", "".join(out).replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def _plain(node: _Node) -> str:
    return "".join(c if isinstance(c, str) else _plain(c) for c in node.children)


def _outside_noise(root: _Node) -> list[_Node]:
    """The nodes in document order that are in no element of site chrome, in one walk."""
    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag not in NOISE:
            kept.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    return kept


def _body(nodes: list[_Node], root: _Node) -> _Node:
    tests = [lambda n: n.tag == "article"]
    tests += [lambda n, c=c: c in (n.attrs.get("class") or "") for c in BODY_CLASSES]
    tests += [lambda n: n.tag == "main", lambda n: n.attrs.get("id") == "main-content", lambda n: n.attrs.get("role") == "main"]
    for test in tests:
        for node in nodes:
            if test(node):
                return node
    best, most = None, 0
    for node in nodes:
        if node.tag in DENSE:
            size = sum(len(_plain(c)) for c in node.children if isinstance(c, _Node) and c.tag == "p")
            if size > most:
                best, most = node, size
    return best or next((n for n in nodes if n.tag == "body"), root)


def extract(html: str | None) -> dict:
    """title, date (as written), url and text of a page."""
    if not html:
        return {"title": None, "date": None, "url": None, "text": ""}
    root = parse(html)
    every = list(root.walk())
    meta = {}
    for n in every:
        if n.tag == "meta" and n.attrs.get("property") and n.attrs.get("content"):
            meta.setdefault(n.attrs["property"], n.attrs["content"].strip())
    kept = _outside_noise(root)
    first = lambda tag: next((_plain(n).strip() for n in kept if n.tag == tag and _plain(n).strip()), None)
    link = next((n.attrs.get("href") for n in every if n.tag == "link" and (n.attrs.get("rel") or "").lower() == "canonical" and n.attrs.get("href")), None)
    time = next((n.attrs.get("datetime") for n in kept if n.tag == "time" and n.attrs.get("datetime")), None)
    found = {
        "title": meta.get("og:title") or first("title") or first("h1"),
        "date": meta.get("article:published_time") or time,
        "url": meta.get("og:url") or link,
        "text": block_text(_body(kept, root)),
    }
    for node in every:  # a cycle would keep the tree of a page until the collector comes by
        node.parent = None
    return found


def page(html) -> Column:
    """struct<title, date, url, text> of an HTML column."""

    @F.arrow_udf("title string, date string, url string, text string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array((extract(h.as_py()) for h in s), kind)

    kind = pa.struct([(name, pa.string()) for name in ("title", "date", "url", "text")])
    return run(html)


def html_text(html) -> Column:
    """All of a fragment's text, scripts and styles left out."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: block_text(parse(h), frozenset(("script", "style"))) if h else "")

    return run(html)
