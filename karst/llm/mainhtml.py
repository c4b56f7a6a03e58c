"""Main text of web pages by a maximum-scoring run of tokens.

A page is read as a run of tokens.  Words score above zero and tags below it; a
word's weight depends on where it stands (in a link, in a marked container, beside
one) and comes, like a tag's, from labelled pages as a log-odds.  One pass finds
the contiguous run with the largest sum (Kadane).

What is page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments) is also learnt from the labelled pages: each element has the features of
its tag, the words of its class, id and role, whether it is hidden, full of links or
long, and whether a container is around it; a logistic regression weighs them.  An
element on the furniture side is one token below zero, wherever it stands, and its
words are left out.  The main text is what the smallest container around the best run
holds, so that short last paragraphs are not lost to their tags.

A page takes time in proportion to its length, whatever its markup.

Defined results: a null or empty page gives an empty text; white space is what
Unicode calls so, a line break element is white space; unclosed and stray tags are
tolerated; a page without words outside its furniture gives an empty text;
repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: The rest of a tag; only a quote after an equals sign opens a value, and nothing is tried twice.
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_ATTRIBUTE = re.compile(r"([^\s/=>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NONE = re.compile(r"display\s*:\s*none", re.I)

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
CONTAINERS = frozenset("article main".split())
CONTAINER_NAMES = frozenset("article articlebody post entry story main content".split())
#: Non-link words from which an element counts as long.
LONG = 25


@dataclass(slots=True)
class Element:
    name: str
    up: Element | None
    #: The nearest element at or above this one that is a block.
    block: Element | None
    link: bool
    first: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    last: int = 0
    furniture: bool = False
    container: bool = False


@dataclass
class Page:
    """Tokens: words with their element and block; or tags (word None). elements: in page order, each with its first token and the end of its last."""

    words: list[str | None] = field(default_factory=list)
    where: list[Element] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names += [x.lower() for x in _PART.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NONE.search(value):
            hidden = True
    return tuple(names), hidden


def parse(text: str) -> Page:
    page, top = Page(), Element("", None, None, False, 0)
    page.elements.append(top)
    here, block, at, n = top, 0, 0, len(text)
    open_names: Counter[str] = Counter()
    joined: dict[int, list[str]] = {}
    last_word, last_end, quotes, glue, ends = -1, text.rfind(">"), True, False, {}

    def tag(e: Element) -> None:
        page.words.append(None)
        page.where.append(e)
        page.block.append(-1)

    def close(e: Element) -> None:
        """Close all elements up to e."""
        nonlocal here
        while True:
            here.last = len(page.words)
            open_names[here.name] -= 1
            if here is e:
                break
            here = here.up
        here = e.up

    while at < n:
        i = at
        if text[i] == "<":
            if text.startswith("<!--", i):
                at = text.find("-->", i + 2)
                at = n if at < 0 else at + 3
                continue
            if text.startswith("<![CDATA[", i):
                at = text.find("]]>", i)
                at = n if at < 0 else at + 3
                continue
            if i < last_end and text[i + 1] in "!?":
                at = text.index(">", i) + 1
                continue
            m = _NAME.match(text, i) if i < last_end else None
            if m:
                p, name = m.end(), m[1].lower()
                rest = _REST.match(text, p) if quotes else None
                if rest is None:  # a quote that swallows the rest of the page is no quote, here and after
                    quotes = False
                    at = text.find(">", p) + 1
                else:
                    at = rest.end()
                attributes = text[p : at - 1]
                blocky = name in BLOCKS
                if text[i + 1] == "/":
                    if open_names[name] > 0:
                        e = here
                        while e.name != name:
                            e = e.up
                        close(e)
                    if blocky:
                        block += 1
                        glue = False
                    tag(here)
                    continue
                while here.name in ENDS and name in ENDS[here.name]:
                    close(here)
                if blocky and here.block is not None and here.block.name == "p":
                    close(here.block)
                if name in RAW:
                    if name not in ends or ends[name] is not None:
                        ends[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
                    at = ends[name].end() if ends[name] else n
                    tag(here)
                    if blocky:
                        block += 1
                    glue = False
                    continue
                if blocky or name == "br":
                    glue = False
                    block += blocky
                if name in VOID or attributes.endswith("/") and not blocky and name not in ("a", "b", "i", "span"):
                    tag(here)
                    continue
                here = Element(name, here, here.block, here.link or name == "a", len(page.words))
                if blocky:
                    here.block = here
                if attributes:
                    here.names, here.hidden = _attributes(attributes)
                open_names[name] += 1
                page.elements.append(here)
                tag(here)
                continue
        at = text.find("<", i + 1)
        at = n if at < 0 else at
        piece = text[i:at]
        if "&" in piece:
            piece = entities.unescape(piece)
        found = piece.split()
        if glue and found and not piece[0].isspace() and last_word >= 0 and page.block[last_word] == block:
            # an inline tag inside a word: no white space stood there
            joined.setdefault(last_word, [page.words[last_word]]).append(found.pop(0))
        if found:
            page.words += found
            page.where += [here] * len(found)
            page.block += [block] * len(found)
            last_word = len(page.words) - 1
        if piece:
            glue = not piece[-1].isspace()
    while here is not None:
        here.last = len(page.words)
        here = here.up
    for k, parts in joined.items():
        page.words[k] = "".join(parts)
    return page


def _features(e: Element, inside: bool, links: int, words: int) -> list[str]:
    out = [f"t:{e.name}", f"t:{e.name}/{inside}", *(f"n:{x}" for x in set(e.names))]
    if e.hidden:
        out.append("hidden")
    if words - links >= LONG:
        out.append("long")
    if 2 * links > words:
        out.append("links")
    return out


def _sums(page: Page) -> tuple[list[int], list[int]]:
    """Words, and words in links, before each token."""
    words, links, a, b = [0], [0], 0, 0
    for w, e in zip(page.words, page.where, strict=True):
        if w is not None:
            a += 1
            b += e.link
        words.append(a)
        links.append(b)
    return words, links


def mark(page: Page, furniture: dict[str, float]) -> None:
    """Say of each element whether it is furniture and whether a container holds it."""
    words, links = _sums(page)
    for e in page.elements[1:]:
        up = e.up
        e.furniture, e.container = up.furniture, up.container
        if e.furniture or e.name in ("html", "body"):
            continue
        z = furniture["bias"]
        for f in _features(e, up.container, links[e.last] - links[e.first], words[e.last] - words[e.first]):
            z += furniture.get(f, 0.0)
        e.furniture = z > 0
        if not e.furniture and (e.name in CONTAINERS or e.name in ("div", "section", "td") and not CONTAINER_NAMES.isdisjoint(e.names)):
            e.container = True


def _kind(page: Page, i: int, marked: bool) -> str:
    """What a token's weight hangs on."""
    e = page.where[i]
    if page.words[i] is None:
        return "tag"
    if e.container:
        return "inside"
    if marked:
        return "beside"
    return "link" if e.link else "plain"


@dataclass(frozen=True)
class Weights:
    """of: score of each kind of token; furniture: weight of each feature of an element."""

    of: dict[str, float]
    furniture: dict[str, float]


def learn_furniture(pages: list[tuple[Page, list[bool]]]) -> dict[str, float]:
    """Logistic regression: elements that hold no main text, in one that does, against elements that hold some."""
    number: dict[str, int] = {}
    rows, wanted = [], []
    for page, main in pages:
        words, links = _sums(page)
        before = np.concatenate([[0], np.cumsum(main)])
        held = {id(page.elements[0]): False}
        for e in page.elements[1:]:
            own = before[e.last] - before[e.first]
            above = held[id(e.up)]
            held[id(e)] = above or e.name in CONTAINERS or not CONTAINER_NAMES.isdisjoint(e.names)
            if e.name in ("html", "body") or words[e.last] == words[e.first] or not own and before[e.up.last] == before[e.up.first]:
                continue
            rows.append([number.setdefault(f, len(number)) for f in _features(e, above, links[e.last] - links[e.first], words[e.last] - words[e.first])])
            wanted.append(not own)
    x = np.zeros((len(rows), len(number) + 1))
    x[:, -1] = 1
    for r, some in enumerate(rows):
        x[r, some] = 1
    y, w = np.array(wanted, float), np.zeros(x.shape[1])
    ridge = np.append(np.full(len(number), 0.02), 1e-4)
    for _ in range(12):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return {**{f: float(w[i]) for f, i in number.items()}, "bias": float(w[-1])}


def learn(pages: Iterable[tuple[str, Iterable[str]]]) -> Weights:
    """From pages with the words of their main text: the furniture's features, and log-odds of each kind of token inside and outside of it; tags stay below zero, and words inside a container above."""
    read = []
    for source, text in pages:
        page, wanted = parse(source), set(text)
        read.append((page, [w is not None and w in wanted for w in page.words]))
    furniture = learn_furniture(read)
    main, other = Counter(), Counter()
    for page, hit in read:
        mark(page, furniture)
        marked = any(e.container for e in page.elements)
        for i, h in enumerate(hit):
            if not page.where[i].furniture:
                (main if h else other)[_kind(page, i, marked)] += 1
    odds = {k: math.log((main[k] + 0.5) / (other[k] + 0.5)) for k in ("tag", "inside", "beside", "link", "plain")}
    top = max(odds["inside"], odds["plain"], 0.1)
    scale = {k: v / top for k, v in odds.items()}
    return Weights({**scale, "tag": min(scale["tag"], -0.05) / 4, "inside": max(scale["inside"], 0.5), "plain": max(scale["plain"], 0.25)}, furniture)


#: Names that page furniture has in the labelled pages.
FURNITURE_NAMES = """ad ads ad-slot adsbygoogle advert advertisement adv-box adsense banner promo promos promotion sponsor sponsored sponsors cookie cookies cookie-notice cookie-banner
consent gdpr-notice notice notices notification alert alerts popup modal overlay newsletter newsletter-signup subscribe subscribe-box subscription signup login login-form
share-buttons sharing social-share social-links social related related-posts recommended recommendations sidebar sidebars left-sidebar sidebar-right widget widgets widget-area menu
menus main-menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer footers site-footer page-footer masthead site-header page-header comment comments commentlist comment-list
comments-area user-comment reply replies respond reply-form disqus_thread discussion feedback pagination pager paywall disclaimer skip-link complementary contentinfo
search search-form search-box header headers""".split()
#: Names of elements that hold main text there, some with words of the others.
CONTENT_NAMES = """article article-body post post-content entry entry-content story story-body main main-content content page-content text body-text section chapter lead intro summary caption
quote table figure gallery footnotes advice address social-security share-price|share price notice-period menu-of-the-day no-sidebar with-sidebar without-comments has-footer not-ad header-image
comment-on-politics hidden-gem search-results-explained cookie-recipe banner-headline widget-factory-story alert-level login-history social-history related-work subscribe-model review wrapper container row col inner""".replace("\n", " ").split()
TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "header", "search", "button")


def labelled_pages() -> Iterator[tuple[str, list[str]]]:
    """Pages built by rule, with the words of their main text (m and a number; others f and a number)."""
    count = 0

    def text(kind: str, n: int) -> str:
        nonlocal count
        count += n
        return " ".join(f"{kind}{k}" for k in range(count - n, count))

    def furniture(i: int, opening: str, closing: str) -> str:
        shape = i % 4
        if shape == 0:
            return f"<{opening}>{text('f', 6)}</{closing}>"
        if shape == 1:
            return f"<{opening}><ul>{''.join(f'<li><a href=x>{text("f", 2)}</a></li>' for _ in range(5))}</ul></{closing}>"
        return f"<{opening}><h3>{text('f', 2)}</h3>" + "".join(f"<p>{text('f', 9 + 4 * shape)}</p>" for _ in range(2)) + f"</{closing}>"

    def content(i: int) -> str:
        head = f"<h{1 + i % 3}>{text('m', 4)}</h{1 + i % 3}>"
        body = "".join(f"<p>{text('m', 12 + 9 * k)} <a href=y>{text('m', 2)}</a> <b>{text('m', 2)}</b></p>" for k in range(1 + i % 3))
        return head + body + (f"<ul><li>{text('m', 3)}<li>{text('m', 4)}</ul>", f"<blockquote>{text('m', 9)}</blockquote>", f"<fieldset><legend>{text('m', 1)}</legend><p>{text('m', 15)}</p></fieldset>", f"<table><tr><td>{text('m', 2)}<td>{text('m', 2)}</table>")[i % 4]

    kinds = [(f'div {("class", "id")[k % 2]}="{x}"', "div") for k, x in enumerate(FURNITURE_NAMES)] + [(f'section class="{x}"', "section") for x in FURNITURE_NAMES[::3]] + [(f'ul class="{x}"', "ul") for x in FURNITURE_NAMES[1::3]] + [(x, x) for x in TAGS for _ in range(6)] + [("div hidden", "div"), ('section style="display:none"', "section"), ('div aria-hidden="true"', "div")] * 3
    plain_names = [x for x in CONTENT_NAMES if CONTAINER_NAMES.isdisjoint(_PART.findall(x))]
    for i, (opening, closing) in enumerate(kinds):
        before = count
        extra = [furniture(i + k, opening, closing) for k in range(3)]
        names = CONTENT_NAMES if i % 4 < 2 else plain_names
        name = names[i // 2 % len(names)].replace("|", " ")
        inner = (f'<div class="{name}">', "</div>") if i % 2 else (f'<section id="{name}">', "</section>")
        outer = [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("", "")][i % 4]
        mine = f"{outer[0]}{'<header>' + content(1) + '</header>' if i % 4 < 2 else ''}{content(i)}{extra[1] if closing != 'header' or i % 4 > 1 else ''}{inner[0]}{content(i + 1)}{inner[1]}<p>{text('m', 3)}</p>{outer[1]}"
        page = f"<html><head><title>{text('f', 3)}</title></head><body><nav>{text('f', 4)}</nav>{extra[0]}{mine}{extra[2]}{f"<p>{text('f', 8)}</p>" if i % 4 < 2 else ""}<footer>{text('f', 5)}</footer></body></html>"
        yield page, [f"m{k}" for k in range(before, count)]


@cache
def weights() -> Weights:
    return learn(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run with the largest sum, end exclusive; (0, 0) if no score is above zero."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(source: str | None, learnt: Weights | None = None) -> str:
    """The main text, a line for each block."""
    page = parse(source or "")
    learnt = learnt or weights()
    mark(page, learnt.furniture)
    marked = any(e.container for e in page.elements)
    own = [i for i, e in enumerate(page.where) if not e.furniture or i == e.first and not e.up.furniture]
    begin, end = best_run([learnt.of["tag"] if page.where[i].furniture else learnt.of[_kind(page, i, marked)] for i in own])
    run = [i for i in own[begin:end] if page.words[i] is not None]
    if not run:
        return ""
    around = page.where[run[0]]
    while around.up is not None and (around.last <= run[-1] or around.name not in ("article", "main", "section", "div", "td", "body", "html")):
        around = around.up
    lines: dict[int, list[str]] = {}
    for i in range(around.first, around.last):
        if page.words[i] is not None and not page.where[i].furniture:
            lines.setdefault(page.block[i], []).append(page.words[i])
    return "\n".join(" ".join(x) for x in lines.values())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(work, "page_id long, url string, text string, n_chars long")
