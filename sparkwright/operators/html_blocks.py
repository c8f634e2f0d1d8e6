"""Paragraphs of raw pages: innermost blocks, without hidden parts and noise."""

from __future__ import annotations

import html
import re
from html.entities import html5
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# Which elements are blocks, which are no text, and which never close.
BLOCKS = frozenset(("div", "p", "td", "li", "h1", "h2", "h3", "h4", "h5", "h6"))
NOISE = frozenset(("script", "style"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: What a start tag closes if it is open: a paragraph by any block, list items and cells by their like.
ENDS = {"li": {"li", "p"}, "td": {"td", "p"}, "tr": {"td", "tr", "p"}} | {t: {"p"} for t in (*BLOCKS, "ul", "ol", "table", "article", "section", "footer", "nav", "header", "aside", "main", "form") if t not in ("li", "td")}


_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Where a tag can end, or a quoted value can begin.
_TURN = re.compile(r"=\s*[\"']|>")
_STYLE = re.compile(r"\bstyle\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", re.I)
#: Numbers, and names with their semicolon: a name without one is text, as the reference's parser has it.
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([a-zA-Z][a-zA-Z0-9]*;))")
_ENDED = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in NOISE}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") of a page, in order.

    Time is linear in the page's length, however broken it is: each search starts where the one before
    it ended, and one that finds nothing is not made again (a quote without its end, a ``<`` without a
    ``>``).  What follows the last ``>`` is text; a comment or script that does not end is the page's end."""
    at = text_from = 0
    last, quotes = page.rfind(">"), True
    while True:
        sign = page.find("<", at)
        if sign < 0 or sign > last and not page.startswith("<!--", sign):
            break
        name = None
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 2)
            after = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), sign):
            after = page.find(">", sign) + 1
        elif name := _NAME.match(page, sign + 1):
            after = name.end()
            while (turn := _TURN.search(page, after)) and turn[0] != ">":
                close = page.find(turn[0][-1], turn.end()) if quotes else -1
                quotes = quotes and close >= 0
                after = close + 1 if close >= 0 else turn.end()
            after = turn.end() if turn else page.find(">", name.end()) + 1  # where quotes hide every end, the next one counts
        else:
            at = sign + 1
            continue
        if sign > text_from:
            yield "text", page[text_from:sign], ""
        at = text_from = after
        if name:
            tag, attributes = name[2].lower(), page[name.end() : after - 1]
            yield "end" if name[1] else "start", tag, attributes
            if tag in NOISE and not name[1] and not attributes.endswith("/"):
                ended = _ENDED[tag].search(page, at)
                at = text_from = ended.start() if ended else len(page)
    if text_from < len(page):
        yield "text", page[text_from:], ""


def decoded(text: str) -> str:
    """Text with its character references decoded; what is no whole reference stays as it is."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1] is None or m[1] in html5 else m[0], text) if "&" in text else text


def _is_hidden(attributes: str) -> bool:
    found = _STYLE.search(attributes) if "style" in attributes.lower() else None
    return found is not None and "display:none" in "".join(x or "" for x in found.groups()).replace(" ", "").lower()


class _Walker:
    """Collects (tag, text) of innermost blocks; text is pieces between tags joined by spaces."""

    def __init__(self):
        self.stack: list[list] = []  # [tag, hidden, pieces or None, has inner blocks, position, place of the block it stands in]
        self.open: dict[str, int] = {}
        self.out: list[tuple[int, str, str]] = []
        self.count = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            return
        while self.stack and self.stack[-1][0] in ENDS.get(tag, ()):
            self.close()
        hidden = (self.stack[-1][1] if self.stack else False) or tag in NOISE or _is_hidden(attributes)
        if tag in BLOCKS and not hidden:
            for above in reversed(self.stack):
                if above[3]:  # then so are those around it
                    break
                above[3] = True
        block = tag in BLOCKS and not hidden
        within = len(self.stack) if block else self.stack[-1][5] if self.stack else -1
        self.stack.append([tag, hidden, [] if block else None, False, self.count, within])
        self.open[tag] = self.open.get(tag, 0) + 1
        self.count += 1
        if attributes.endswith("/"):
            self.end(tag)

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            while self.close() != tag:
                pass

    def close(self) -> str:
        tag, _, pieces, inner, at, _ = self.stack.pop()
        self.open[tag] -= 1
        if pieces is not None and not inner:
            self.out.append((at, tag, " ".join(pieces)))
        return tag

    def text(self, data: str) -> None:
        if self.stack and not self.stack[-1][1]:
            within = self.stack[-1][5]
            if within >= 0:
                self.stack[within][2].append(decoded(data))


def leaf_blocks(page: str | None) -> list[tuple[str, str]]:
    """(tag, text) of a page's innermost blocks, in page order."""
    walker = _Walker()
    for kind, what, attributes in tokens(page or ""):
        if kind == "text":
            walker.text(what)
        elif kind == "start":
            walker.start(what, attributes)
        else:
            walker.end(what)
    while walker.stack:
        walker.close()
    return [(tag, text) for _, tag, text in sorted(walker.out)]


def block_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, tag, text) of all pages' innermost blocks."""
    kind = pages.schema[id_col].dataType.simpleString()

    def walk(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # so that few pages' blocks are held at a time
                part = batch.slice(lo, 256)
                row, pos, tag, text = [], [], [], []
                for i, page in enumerate(part.column(1)):
                    found = leaf_blocks(page.as_py())
                    row += [i] * len(found)
                    pos += range(len(found))
                    tag += [t for t, _ in found]
                    text += [x for _, x in found]
                yield pa.record_batch([part.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(tag, pa.string()), pa.array(text, pa.string())], names=[id_col, "pos", "tag", "text"])

    return pages.select(id_col, F.col(html_col).cast("string").alias("html")).mapInArrow(walk, f"{id_col} {kind}, pos int, tag string, text string")


def is_noise(text: Column) -> Column:
    """Navigation text and bare page numbers."""
    return (F.lower(text) == "table of contents") | (text.rlike("(?U)^\\d+$") & (F.length(text) <= 5))


def paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, text): blocks with white space collapsed, without empty ones and noise."""
    rows = block_table(pages, id_col, html_col).withColumn("text", collapse(F.col("text")))
    return rows.filter((F.col("text") != "") & ~is_noise(F.col("text"))).select(id_col, "pos", "text")
