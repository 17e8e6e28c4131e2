"""HTML to markdown with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements that are noise by tag, id or class, words in ids and classes that mark noise, and what stands on lines of its own.
NOISE_TAGS = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "form", "button", "input", "nav", "footer", "aside"}
NOISE_IDS = {"top", "side-nav", "nav-tree", "nav-path", "MSearchSelectWindow", "MSearchResultsWindow"}
NOISE_CLASSES = {"navpath", "footer", "tabs", "tablist", "summary", "memnav", "memitem", "directory", "lineno", "ui-resizable-handle"}
NOISE_WORDS = ("nav", "search", "footer", "lineno")
LINES = {"address", "blockquote", "div", "dl", "dt", "dd", "figure", "figcaption", "p", "section"}
#: Elements that end a word in running text.
BLOCKS = LINES | {"html", "body", "article", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "hr", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "fieldset", "details"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: What a start tag closes if it is open nearer than the elements behind it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.children = tag, []
        self.id, self.classes, self.attrs = attrs.get("id", ""), attrs.get("class", "").split(), attrs

    @property
    def noise(self) -> bool:
        return self.tag in NOISE_TAGS or self.id in NOISE_IDS or not NOISE_CLASSES.isdisjoint(self.classes) or self.tag == "header" and "header" not in self.classes

    @property
    def marked(self) -> bool:
        names = f"{self.id} {' '.join(self.classes)}".lower()
        return any(w in names for w in NOISE_WORDS)

    def elements(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.elements()


class Tree(HTMLParser):
    """Builds the tree without its noise."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("root", {})]
        self.root = self.open[0]

    def end(self, tags: set[str], behind: set[str]) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in tags | behind), 0)
        if at and self.open[at].tag in tags:
            del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for t in sorted(CLOSES[tag][0]):
                self.end({t}, CLOSES[tag][1])
        elif tag in BLOCKS:
            self.end({"p"}, BLOCKS - {"p"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def pruned(node: Node) -> Node:
    node.children = [c if isinstance(c, str) else pruned(c) for c in node.children if isinstance(c, str) or not c.noise]
    return node


def words(node: Node, skip: tuple[str, ...] = (), raw: bool = False) -> str:
    """Running text of an element: single spaces, words apart where a block begins or ends. In `pre` blanks stay."""
    out: list[str] = []

    def gap() -> None:
        if out and not out[-1][-1:].isspace():
            out.append(" ")

    def walk(n: Node, raw: bool) -> None:
        for child in n.children:
            if isinstance(child, str):
                text = child if raw else re.sub(r"[\s\xa0]+", " ", child)
                if not raw and (not out or out[-1][-1:].isspace()):
                    text = text.removeprefix(" ")
                if text:
                    out.append(text)
            elif child.tag == "br":
                out.append("\n") if raw else gap()
            elif child.tag not in skip:
                block = child.tag in BLOCKS
                if block and not raw:
                    gap()
                walk(child, raw or child.tag == "pre")
                if block and not raw:
                    gap()

    walk(node, raw)
    return "".join(out).strip()


class Writer:
    def __init__(self):
        self.out = ""

    def line(self) -> None:
        if not self.out.endswith("\n"):
            self.out += "\n"

    def block(self, text: str) -> None:
        self.line()
        self.out += text.strip()
        self.line()

    def text(self, data: str) -> None:
        data = re.sub(r"[\s\xa0]+", " ", data).strip()
        if data:
            self.out += data if not self.out or self.out[-1].isspace() else f" {data}"

    def items(self, node: Node) -> None:
        for item in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
            self.block(("1. " if node.tag == "ol" else "- ") + words(item, ("ul", "ol")))
            for child in item.children:
                if isinstance(child, Node) and child.tag in ("ul", "ol"):
                    self.node(child)

    def table(self, node: Node) -> None:
        first = True
        for row in (e for e in node.elements() if e.tag == "tr"):
            cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if not cells:
                continue
            self.block("| " + " | ".join(map(words, cells)) + " |")
            if first and any(c.tag == "th" for c in cells):
                self.block("| " + "--- | " * len(cells))
            first = False

    def node(self, node: Node | str) -> None:
        if isinstance(node, str):
            self.text(node)
        elif node.marked or node.tag in ("head", "title"):
            return
        elif node.tag == "img":
            if alt := node.attrs.get("alt", "").strip():
                self.block(f"[图片: {alt}]")
        elif node.tag == "br":
            self.line()
        elif re.fullmatch("h[1-6]", node.tag):
            self.block("#" * int(node.tag[1]) + " " + words(node))
        elif node.tag == "pre":
            if code := words(node, raw=True):
                self.block(f"```\n{code}\n```")
        elif node.tag == "table":
            self.table(node)
        elif node.tag in ("ul", "ol"):
            self.items(node)
        elif node.tag == "li":
            self.block("- " + words(node, ("ul", "ol")))
        else:
            if node.tag in LINES:
                self.line()
            for child in node.children:
                self.node(child)
            if node.tag in LINES:
                self.line()


def tidy(text: str) -> str:
    """No blanks at line ends, two line ends in a row at most."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n"))).strip()


def to_markdown(html: str | None) -> str:
    """The main content of a page: the first non-empty element of class contents (behind the title of an element of class header), else of main, article or the
    role main, else the body. Noise goes first."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    page = pruned(tree.root)
    full = lambda test: next((e for e in page.elements() if test(e) and words(e)), None)
    writer = Writer()
    root = full(lambda e: "contents" in e.classes)
    if root is not None:
        header = next((t for h in page.elements() if "header" in h.classes for t in h.elements() if "title" in t.classes), None)
        if header is not None and words(header):
            writer.block(f"# {words(header)}")
    else:
        root = full(lambda e: e.tag in ("main", "article") or e.attrs.get("role") == "main")
    if root is None:
        root = next((e for e in page.elements() if e.tag == "body"), page)
    writer.node(root)
    return tidy(writer.out)


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and markdown of each page, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "markdown": pdf[html_col].map(to_markdown)})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, markdown string")
