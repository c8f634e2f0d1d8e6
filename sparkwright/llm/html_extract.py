"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A scanner walks the markup once (comments, raw-text elements, character
references, unclosed and misnested tags) and yields leaf blocks: maximal runs of
text between block-level boundaries, each with its chain of ancestors.  Features
are the ancestors' tags and their class/id words, the block's own tag, and what
the text looks like (length, share of linked text, marks such as a copyright
sign).  The CRF has two labels (main text or not) with transition weights, is
trained by maximum likelihood on labelled pages (:mod:`html_pages` makes them) and
decoded by Viterbi.  Text outside the document's body (title, script, style and
so on) is no block; an element that shows something else than its content (svg,
video, object, ...) hides it until it ends, at the latest with its parent.

Inside a block white space is one space and the ends are trimmed; the chosen
blocks are joined in page order by one space; no text is capped or dropped.  Null
and empty pages give an empty text; a page without markup is one block.
Repeated rows give repeated results; an empty table an empty one.  Work and memory
are linear in a page's length, for broken pages too: elements know their parent and the
marks that they add to its, open elements are found by name, a quote that never closes
is looked for once (from there on a tag ends at the next ``>``), and a ``<`` behind the
last ``>`` is text.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements that never have content, those whose content is not markup, those that start a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript iframe noframes noembed xmp title textarea".split())
MUTE = frozenset("template svg math object audio video canvas".split())
IN_HEAD = frozenset("title base basefont bgsound link meta style script noscript template head html noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split())
#: A start tag of the key closes an open element of the value (nearest first).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: An implied close does not look past these.
SCOPE = frozenset("ul ol dl table html body article section div nav select aside main".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"'])")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/>]|$)", re.S)
_WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=20_000)
def marks_of(tag: str, attributes: str) -> frozenset[str]:
    """A start tag's name, the words of its class, id and role, and whether it is hidden."""
    marks = {f"tag={tag}"}
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = (m[1] or m[5]).lower(), next((x for x in (m[2], m[3], m[4]) if x is not None), "")
        if name in ("class", "id", "role"):
            marks.update(f"word={w}" for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            marks.add("hidden")
    return frozenset(marks)


class Element:
    """An open or closed element: its tag and marks, what it adds to its ancestors' marks, and whether it is in a link, the article, or hidden."""

    __slots__ = ("tag", "marks", "parent", "fresh", "link", "inside", "mute", "score")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent, self.score = tag, parent, None
        self.marks = self.fresh = marks_of(tag, attributes) if len(attributes) < 1000 else marks_of.__wrapped__(tag, attributes)
        self.link = tag == "a" or parent is not None and parent.link
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.mute = tag in MUTE or parent is not None and parent.mute


class Open:
    """The stack of open elements, by place, by tag and by mark."""

    def __init__(self):
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.marks: dict[str, int] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def top(self) -> Element | None:
        return self.stack[-1] if self.stack else None

    def block(self) -> Element | None:
        return self.stack[self.blocks[-1]] if self.blocks else None

    def push(self, element: Element) -> None:
        place, marks = len(self.stack), self.marks
        element.fresh = [m for m in element.marks if not marks.get(m)]
        for m in element.marks:
            marks[m] = marks.get(m, 0) + 1
        self.stack.append(element)
        self.at.setdefault(element.tag, []).append(place)
        if element.tag in BLOCK:
            self.blocks.append(place)
        if element.tag in SCOPE:
            self.scopes.append(place)

    def cut(self, place: int) -> None:
        """Closes everything from a place on."""
        while len(self.stack) > place:
            element = self.stack.pop()
            self.at[element.tag].pop()
            for m in element.marks:
                self.marks[m] -= 1
            for places in (self.blocks, self.scopes):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def last(self, tags) -> int:
        """The innermost open element of some tags, or -1."""
        place = -1
        for t in tags:
            places = self.at.get(t)
            if places and places[-1] > place:
                place = places[-1]
        return place

    def close(self, tags, beyond: int) -> None:
        """Closes the innermost element of the tags, unless it is further out than ``beyond``."""
        place = self.last(tags)
        if place >= 0 and place >= beyond:
            self.cut(place)


class Tags:
    """Finds a page's tags; what could cost a look at the whole rest is looked for once."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``; a quoted value may hold one."""
        page, start = self.page, at
        while self.quotes:
            stop = _STOP.search(page, at)
            if not stop:
                break
            if stop[0] == ">":
                return stop.start()
            value = _VALUE.match(page, stop.end())
            if not value:
                at = stop.end()
                continue
            at = page.find(value[1], value.end()) + 1
            if not at:
                break
        self.quotes = False
        return page.find(">", start)


def leaf_blocks(page: str) -> list[tuple["Element | None", str, float]]:
    """(innermost block element, text, share of linked characters) of a page's blocks, in page order."""
    out: list[tuple[Element | None, str, float]] = []
    open_, tags, parts = Open(), Tags(page), []
    linked, where = 0, None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((where, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked, where
        top = open_.top()
        if top and top.mute:
            return
        if not parts:
            if text.isspace():
                return
            if top and top.tag == "head":  # text cannot stand there
                open_.cut(len(open_.stack) - 1)
                top = open_.top()
            where = open_.block()
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if top and top.link:
            linked += len(text)

    def start(tag: str, attributes: str):
        top = open_.top()
        if top and top.mute:
            if tag not in VOID and not attributes.endswith("/"):
                open_.push(Element(tag, attributes, top))
            return
        if tag not in IN_HEAD and open_.at.get("head"):
            open_.close(("head",), 0)
        if tag in BLOCK:
            flush()
            scope = open_.scopes[-1] if open_.scopes else -1
            open_.close(("p",), max(scope, open_.last(("td", "th", "li", "button"))))
            if tag in CLOSES:
                mine = open_.last((tag,)) if tag in SCOPE else -1
                scope = next((k for k in reversed(open_.scopes) if k != mine), -1) if tag != "body" else -1
                open_.close(CLOSES[tag], scope)
        elif tag in ("br", "hr"):
            if parts:
                parts.append(" ")
            return
        if tag not in VOID and not (tag in MUTE and attributes.endswith("/")):
            open_.push(Element(tag, attributes, open_.top()))

    def stop(tag: str):
        top = open_.top()
        if top and top.mute:
            place = open_.last((tag,))
            if place < 0:
                return
            if open_.stack[place].mute:
                open_.cut(place)
                return
            while open_.top() and open_.top().mute:  # the end of something around it
                open_.cut(len(open_.stack) - 1)
        if tag in BLOCK:
            flush()
            open_.close((tag,), open_.last(("html",)) if tag != "html" else -1)
        elif tag == "br":
            parts.append(" ")
        else:
            open_.close((tag,), open_.blocks[-1] if open_.blocks else -1)

    at, text_from, n = 0, 0, len(page)
    while at < n:
        sign = page.find("<", at)
        if sign < 0 or sign > tags.last and not page.startswith("<!--", sign):
            break
        if page.startswith("<!--", sign):
            end, name = page.find("-->", sign + 4), None
            after = end + 3 if end >= 0 else n
        elif page[sign + 1 : sign + 2] in ("!", "?"):
            name, after = None, page.find(">", sign) + 1
        else:
            name = _NAME.match(page, sign + 1)
            if not name:
                at = sign + 1
                continue
            end = tags.end(name.end())
            if end < 0:
                break
            after = end + 1
        if sign > text_from:
            add(page[text_from:sign])
        at = text_from = after
        if not name:
            continue
        tag, attributes = name[2].lower(), page[name.end() : after - 1]
        if name[1]:
            stop(tag)
        elif tag in RAW and not attributes.endswith("/"):
            if open_.at.get("head") and tag not in IN_HEAD:
                open_.close(("head",), 0)
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = text_from = found.end() if found else n
        else:
            start(tag, attributes)
    if text_from < n:
        add(page[text_from:])
    flush()
    return out


def own_features(element: "Element | None") -> list[str]:
    """What a block's own element says."""
    if element is None:
        return ["out-of-article"]
    return [*(f"own:{m}" for m in element.marks), "in-article" if element.inside else "out-of-article"]


def fresh_features(element: Element) -> list[str]:
    """What an element says about everything within it, beyond what its ancestors say."""
    return [m if m == "hidden" else f"up:{m}" for m in element.fresh]


def path_features(element: "Element | None") -> list[str]:
    """What a block's element and its ancestors say."""
    out = own_features(element)
    while element is not None:
        out += fresh_features(element)
        element = element.parent
    return sorted(out)


def text_features(text: str, share: float) -> list[str]:
    size = len(text)
    out = [f"len={min(6, size.bit_length() // 2)}", "linked" if share > 0.6 else "unlinked"]
    if text[-1] in ".!?:;\"')":
        out.append("sentence-end")
    if "©" in text[:200]:
        out.append("copyright")
    if text.count("|") > 3 or text.count("·") > 2:
        out.append("bars")
    return out


class Crf:
    """Two labels; scores are sums of feature weights plus transitions."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)
        self._own: dict = {}  # what blocks' own elements add up to

    def emission(self, features) -> np.ndarray:
        got = [self.weights[f] for f in features if f in self.weights]
        return np.sum(got, axis=0) if got else np.zeros(2)

    def total(self, features) -> tuple[float, float]:
        a = b = 0.0
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                a, b = a + float(w[0]), b + float(w[1])
        return a, b

    def element_score(self, element: "Element | None") -> tuple[float, float]:
        """What the ancestors' marks add up to; each element knows it once it was asked."""
        todo = []
        while element is not None and (element.score is None or element.score[0] is not self):
            todo.append(element)
            element = element.parent
        a, b = element.score[1] if element is not None else (0.0, 0.0)
        for e in reversed(todo):
            if e.fresh:
                x, y = self.total(fresh_features(e))
                a, b = a + x, b + y
            e.score = self, (a, b)
        return a, b

    def block_score(self, block) -> tuple[float, float]:
        element, text, share = block
        a, b = self.element_score(element)
        key = (element.marks, element.inside) if element is not None else None
        own = self._own.get(key)
        if own is None:
            if len(self._own) > 20_000:
                self._own.clear()
            own = self._own[key] = self.total(own_features(element))
        x, y = self.total(text_features(text, share))
        return a + own[0] + x, b + own[1] + y

    def decode(self, blocks) -> list[int]:
        """Viterbi; of equal paths the one with more text."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = (x + y for x, y in zip(self.block_score(blocks[0]), self.start.tolist(), strict=True))
        for block in blocks[1:]:
            e0, e1 = self.block_score(block)
            f0, f1 = (1 if s1 + m10 >= s0 + m00 else 0), (1 if s1 + m11 >= s0 + m01 else 0)
            s0, s1 = e0 + (s1 + m10 if f0 else s0 + m00), e1 + (s1 + m11 if f1 else s0 + m01)
            back.append((f0, f1))
        label = 1 if s1 >= s0 else 0
        out = [label]
        for f in reversed(back):
            label = f[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages, rounds: int = 8, rate: float = 0.5, ridge: float = 1e-4, seed: int = 0) -> "Crf":
        """Maximum likelihood by AdaGrad; pages: lists of (features, label)."""
        order, square = list(range(len(pages))), {}
        move_sq, start_sq = np.full((2, 2), 1e-3), np.full(2, 1e-3)
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                page = pages[k]
                if not page:
                    continue
                e = np.array([self.emission(f) for f, _ in page])
                n = len(page)
                fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
                fwd[0] = e[0] + self.start
                for i in range(1, n):
                    fwd[i] = e[i] + np.logaddexp(*(fwd[i - 1][:, None] + self.move))
                for i in range(n - 2, -1, -1):
                    bwd[i] = np.logaddexp.reduce(self.move + (e[i + 1] + bwd[i + 1])[None, :], axis=1)
                z = np.logaddexp(*fwd[-1])
                p = np.exp(fwd + bwd - z)
                y = np.eye(2)[[label for _, label in page]]
                d = y - p
                g = np.zeros((2, 2))
                for i in range(1, n):
                    g[page[i - 1][1], page[i][1]] += 1
                    g -= np.exp(fwd[i - 1][:, None] + self.move + (e[i] + bwd[i])[None, :] - z)
                move_sq += g * g
                self.move += rate * g / np.sqrt(move_sq)
                start_sq += d[0] ** 2
                self.start += rate * d[0] / np.sqrt(start_sq)
                for (features, _), di in zip(page, d, strict=True):
                    if abs(di[0]) < 1e-4:
                        continue
                    for f in features:
                        w = self.weights.setdefault(f, np.zeros(2))
                        s = square.setdefault(f, np.full(2, 1e-3))
                        s += di * di
                        w += rate * (di - ridge * w) / np.sqrt(s)
        self._own.clear()
        return self


def extract(page: str | None, crf: Crf) -> str:
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return " ".join([b[1] for b, label in zip(blocks, crf.decode(blocks), strict=True) if label])


@lru_cache(maxsize=4)
def trained(pages: int = 400, seed: int = 11) -> Crf:
    """A CRF fitted to ``pages`` labelled pages."""
    from .html_pages import labelled_pages

    data = []
    for markup, labels in labelled_pages(pages, seed):
        found = leaf_blocks(markup)
        data.append([([*path_features(p), *text_features(t, s)], labels[t]) for p, t, s in found if t in labels])
    return Crf().fit(data)


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = 400) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    crf = trained(training_pages)
    weights = ({k: w.copy() for k, w in crf.weights.items()}, crf.move, crf.start)  # a few kB, sent with the function
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        local = Crf()
        local.weights, local.move, local.start = weights
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(x.as_py(), local) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
