"""HTML as a table: one Arrow stage builds the tree, everything after it is native.

A page becomes ``struct<text, nodes>``. ``nodes`` is in document order and a node's
``id`` is its position, so its descendants are exactly the slice ``id+1 .. last``.
Deep text is the span ``[t0, t1)`` of ``text``; ``[n0, n1)`` is the span of the next
sibling (element or non-blank text), -1 when there is none. ``text`` holds the body
only, without scripts and styles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPE = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in ("id", "parent", "last", "depth")]
    + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(name, T.IntegerType()) for name in ("t0", "t1", "n0", "n1")]
)
DOM_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE_TYPE))])

# Element classes of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD_ONLY = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
SILENT = {"head", "script", "style", "title", "template"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "span", "strike", "strong", "tt", "u"}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
# tag -> (open elements it ends, elements that stop the search)
ENDS_PEERS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
PARAGRAPH_SCOPE = {"button", "caption", "object", "table", "td", "th", "template"}


class _Tree(HTMLParser):
    """Tolerant tree builder: void elements, implied ends, unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.chunks: list[str] = []
        self.length = 0
        self.open: list[int] = []
        self.children: dict[int, list] = {}
        self.silent = 0
        self.body: int | None = None
        self._push("html", {})

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _tag(self, position: int) -> str:
        return self.nodes[self.open[position]][4]

    def _push(self, tag: str, attrs: dict) -> None:
        node_id = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        self.nodes.append([node_id, parent, node_id, len(self.open), tag, attrs, self.length, self.length, -1, -1])
        if parent >= 0:
            self.children[parent].append(node_id)
        self.children[node_id] = []
        self.open.append(node_id)
        self.silent += tag in SILENT

    def _pop(self) -> None:
        node = self.nodes[self.open.pop()]
        node[2], node[7] = len(self.nodes) - 1, self.length
        self.silent -= node[4] in SILENT
        items = self.children.pop(node[0])
        for item, following in zip(items, items[1:]) if len(items) > 1 else ():
            if isinstance(item, int):
                span = self.nodes[following][6:8] if isinstance(following, int) else following
                self.nodes[item][8:10] = span

    def _pop_to(self, position: int) -> None:
        for _ in range(len(self.open) - position):
            self._pop()

    def _ensure_body(self) -> None:
        if self.body is None:
            self._pop_to(1)
            self._push("body", {})
            self.body = self.open[-1]

    def _end_open(self, tags: set, stop: set) -> None:
        for position in range(len(self.open) - 1, 1, -1):
            tag = self._tag(position)
            if tag in tags:
                self._pop_to(position)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._ensure_body()
                target = self.nodes[self.body][5]
            elif tag == "head" and self.body is None and len(self.open) == 1:
                self._push("head", values)
                return
            else:
                target = self.nodes[0][5]
            for name, value in values.items():
                target.setdefault(name, value)
            return
        if self.body is None:
            if tag not in HEAD_ONLY:
                self._ensure_body()
            elif len(self.open) == 1:
                self._push("head", {})
        if tag in ENDS_PEERS:
            self._end_open(*ENDS_PEERS[tag])
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, PARAGRAPH_SCOPE)
        self._push(tag, values)
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        # "/" means nothing on an HTML element; only void ones close at once.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head" and self.body is None:
            self._pop_to(1)
            return
        if tag in ("html", "body"):
            return
        for position in range(len(self.open) - 1, 0, -1):
            found = self._tag(position)
            if found == tag and self.open[position] != self.body:
                self._pop_to(position)
                return
            if tag in FORMATTING and found not in FORMATTING:
                return

    def handle_data(self, data):
        if self.silent and self._tag(-1) != "head":
            return
        filled = not data.isspace() and data != ""
        if not filled:
            if self.body is None:
                return
        elif self.body is None:
            self._ensure_body()
        if self.silent:
            return
        start = self.length
        self.chunks.append(data)
        self.length += len(data)
        if filled:
            items = self.children[self.open[-1]]
            if items and isinstance(items[-1], list):
                items[-1][1] = self.length
            else:
                items.append([start, self.length])


_ATTR = r"""[A-Za-z][A-Za-z0-9_:.-]*(?:="[^"&<>]*"|='[^'&<>]*')?"""
#: A text, an end tag, a start tag with quoted or no values, a comment or document type that every parser ends alike.
_TOKEN = re.compile(
    r"([^<]+)|</([A-Za-z][A-Za-z0-9-]*)>"
    rf"|<([A-Za-z][A-Za-z0-9-]*)((?:[ \t\r\n\f]+{_ATTR})*)[ \t\r\n\f]*/?>"
    r"|<!--[^<>-]+(?:-[^<>-]+)*-->|<!(?:DOCTYPE|doctype)[ \t\r\n]+[^<>\[\]]*>"
)
_VALUE = re.compile(r"""([A-Za-z][A-Za-z0-9_:.-]*)(?:="([^"]*)"|='([^']*)')?""")
# Elements whose content is no markup. That of the first three never counts as text.
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_RAW_END = {tag: re.compile(rf"(?:[^<]++|<(?!!|/[\s/]*{tag}))*+(?=</{tag}>)", re.IGNORECASE) for tag in ("script", "style")}
_RAW_END["title"] = re.compile(r"[^<]*(?=</title>)", re.IGNORECASE)


def _feed_plain(tree: _Tree, html: str) -> bool:
    """Feed a page of plain tokens only; false if anything else is met, whose reading is left to the parser."""
    at = 0
    token, start, end, data = _TOKEN.match, tree.handle_starttag, tree.handle_endtag, tree.handle_data
    while at < len(html):
        found = token(html, at)
        if not found:
            return False
        at, kind = found.end(), found.lastindex
        if kind == 1:
            text = found[1]
            data(unescape(text) if "&" in text else text)
        elif kind == 2:
            end(found[2].lower())
        elif kind:
            tag, attrs = found[3].lower(), found[4]
            start(tag, [(name.lower(), one or other) for name, one, other in _VALUE.findall(attrs)] if attrs else ())
            if tag in _RAW:
                content = _RAW_END[tag].match(html, at) if tag in _RAW_END else None
                if not content:
                    return False
                at = content.end()
    return True


def build_tree(html: str | None) -> tuple[str, list[list]]:
    """Body text and node rows of one page."""
    tree = _Tree()
    if not _feed_plain(tree, html or ""):
        tree = _Tree()
        tree.feed(html or "")
        tree.close()
    tree._ensure_body()
    tree._pop_to(0)
    return "".join(tree.chunks), tree.nodes


#: What is parsed before its nodes become columns: so many pages, or characters of HTML (one page at least).
PART_PAGES, PART_CHARS = 64, 1 << 20


def dom_array(pages: pa.Array) -> pa.Array:
    """Trees of a batch of pages, as columns."""
    texts, ends, rows = [], [0], []
    for page in pages:
        text, nodes = build_tree(page.as_py())
        texts.append(text)
        rows += nodes
        ends.append(len(rows))
    fields = list(zip(*rows)) or [()] * 10
    keys = list(chain.from_iterable(fields[5]))
    values = list(chain.from_iterable(map(dict.values, fields[5])))
    attrs = pa.MapArray.from_arrays(
        pa.array([0, *accumulate(map(len, fields[5]))], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    nodes = pa.StructArray.from_arrays(
        [*[pa.array(f, pa.int32()) for f in fields[:4]], pa.array(fields[4], pa.string()), attrs,
         *[pa.array(f, pa.int32()) for f in fields[6:]]],
        ["id", "parent", "last", "depth", "tag", "attrs", "t0", "t1", "n0", "n1"],
    )
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)],
        ["text", "nodes"],
    )


def parts(pages: pa.Array) -> Iterator[pa.Array]:
    """A batch in runs of at most ``PART_PAGES`` pages and, unless one page is longer, ``PART_CHARS`` characters."""
    start = chars = 0
    for k, n in enumerate(pc.utf8_length(pages).to_pylist()):
        if k > start and (k - start == PART_PAGES or chars + (n or 0) > PART_CHARS):
            yield pages.slice(start, k - start)
            start, chars = k, 0
        chars += n or 0
    if start < len(pages):
        yield pages.slice(start)


@F.arrow_udf(DOM_TYPE)
def _page_dom(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # A batch is as many rows as the session says; trees take many times the memory of their pages, so few are held at once.
    for pages in batches:
        for part in parts(pages):
            yield dom_array(part)


def page_dom(html: Column | str) -> Column:
    """The page tree; the only Python stage on the extraction path, sent just the HTML column."""
    return _page_dom(F.col(html) if isinstance(html, str) else html)
