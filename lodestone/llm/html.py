"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element's run of text.  What is no content by its
element, class, id or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) becomes a gap; gaps and runs of link lines cut the page into stretches.  A line's
charge is its text length, of links nothing, and a tenth where the page marks an article or main part and
the line is outside.  The charges of ``WINDOW`` neighbouring lines of a stretch are summed.  Text surges
where a sum reaches the page's threshold: a quarter of the sum that half of all its text reaches, ``SURGE``
characters at most.  Kept is all from the first surge to the last dive; with it what stands in the
same container as the long lines of the stretch with the greatest charge (in the whole article, if
that is marked), however short; and what only an insert (advert, aside, notice, form) parts from it.
Before the first surge only headings that lead to it are kept, and short lines (byline, date) between them and it.  Link lines are text where the ``WINDOW``
lines on each side outweigh them, else they are dropped and cut.

A class or id marks no content if it is such a word or is built from one in a known form (site-header,
ad-slot-2), not if it only holds one (has-sidebar, content-share).  An element that is named like a part
of a layout stays, on a page with no article elsewhere, if it holds twice the text that is kept without
it, or more than that text and an article.  Texts of their own kind (adverts, comments, teasers, cookie
notices, what is hidden) stay dropped however long they are, with any articles in them.

Defined results: null and empty pages give the empty text; white space inside a block becomes one
space, blocks are joined by one newline in page order; unclosed or cut markup is read as far as it
goes; rows repeat as they come; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW, SURGE = 3, 200
#: what a character outside the marked article counts
OUTSIDE = 0.1
NESTED = 8
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_NO_CONTENT = frozenset("nav header footer aside form menu dialog button head label".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KEPT = frozenset("html body main article".split())
#: words in a class or id that mark no content
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments discussion discussions replies respond disqus side notice notices cookie cookies consent popup modal newsletter subscribe share sharing social related recommended widget widgets toolbar pagination pager".split()
)
#: what may stand before and after such a word in one class or id (site-header, ad-slot-2), and no other word may (has-sidebar, no-banner)
_BEFORE = frozenset("col column site page global main top bottom left right primary secondary inner mobile desktop google gpt div js inline mid native sub skip post entry article blog user".split())
_AFTER = frozenset("left right top bottom primary secondary inner box block area container wrapper wrap list item items link links bar slot unit iframe form signup icon icons toggle button buttons section content media body title label author text message overlay post posts articles stories".split())
_SIZE = re.compile(r"\d+(?:x\d+)?\Z")
#: words that layouts bear too: such an element stays if it holds two thirds of the text, or half and an article
_LAYOUT = frozenset("side sidebar sidebars widget widgets banner share sharing social modal popup toolbar subscribe complementary dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: words by which a paragraph or headline inside a marked article is still no content
_PAID = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
_LINES = _HEADINGS | {"p"}
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_UNSHOWN = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.I)

#: what parts page and article; all else that is no content may be an insert in the article's middle
_PARTS = frozenset("head nav header footer menu menubar sidebar sidebars navbar navigation breadcrumb breadcrumbs masthead comment comments discussion discussions replies respond disqus side related recommended toolbar pagination pager banner contentinfo search".split())
#: elements that may hold an article's blocks
_BOXES = frozenset("div section article main td center details".split())


#: what an article may follow while it is still open: lost end tags; an article in comments or teasers is no main text
_BEFORE_MAIN = frozenset("nav header menu button head ad ads advert banner".split())


def _marking(token: str) -> str:
    """The word by which a class or id marks no content, or nothing."""
    if token in _WORDS:
        return token
    parts = [p for p in re.split("[_-]+", token) if p and not _SIZE.match(p)]
    at = [n for n, p in enumerate(parts) if p in _WORDS]
    if at and _BEFORE.issuperset(parts[: at[0]]) and all(p in _AFTER or p in _WORDS for p in parts[at[0] :]):
        return parts[at[0]]
    return ""


def _unshown(attributes: str) -> bool:
    """Whether a browser shows nothing of the element: ``hidden``, or a style of its own."""
    lower = attributes.lower()
    return "hidden" in lower and "hidden" in _QUOTED.sub(" ", lower).split() or "display" in lower and bool(_UNSHOWN.search(attributes))


def _no_content(tag: str, attributes: str, article: bool = False) -> str:
    """The word by which an element is no content, or nothing.

    An article's header holds its headline, whether it is the element or a class, and a class drops none of its paragraphs but adverts.
    """
    if tag in _NO_CONTENT and not (article and tag == "header"):
        return tag
    if tag != "body" and _unshown(attributes):
        return "hidden"
    if tag in _KEPT or "=" not in attributes:
        return ""
    for name, *values in _MARKS.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role" and value.strip() in _ROLES:
            return value.strip()
        words = value.split()
        if name.lower() != "role" and (found := [w for w in map(_marking, words) if w and not (article and (w == "header" or tag in _LINES and w not in _PAID))]):
            # in an article a layout's word beside a word of another kind ("social history") speaks of content
            if article and _LAYOUT.issuperset(found) and not all(_marking(w) or _BEFORE.union(_AFTER).issuperset(re.split("[_-]+", w)) for w in words):
                continue
            return min(found)
    return ""


def lines(html: str, spared: frozenset[int] | None = frozenset()) -> tuple[list[tuple[str, bool, bool, int, bool]], list[int], list[int], set[int], list[list[int]]]:
    """(text, in an article, of links, container, heading) line by line, each container's parent and the last one opened in it, which are articles, and what layouts it dropped.

    Containers are numbered as they open, the page is 0.  A gap is an empty line, of links if it parts page and article.
    A dropped layout is its place, its characters of text and its articles; what stands at a place in ``spared`` is content (None: every layout).
    """
    layouts: list[list[int]] = []
    dropped = [0, 0, 0]
    out: list[tuple[str, bool, bool, int, bool]] = []
    marked: set[int] = set()
    parent, last, boxes = [0], [0], [("", 0)]
    opened: dict[str, int] = {}
    run: list[str] = []
    linked = total = 0
    skipped, depth, reason = "", 0, ""
    article = anchor = 0
    seen = heading = False

    def close() -> None:
        nonlocal linked, total
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append((text, article > 0, linked > 0.7 * total, boxes[-1][1], heading))
        linked = total = 0

    def say(text: str) -> None:
        nonlocal linked, total
        if skipped:
            dropped[1] += len(text.strip())
        elif text:
            run.append(text)
            n = len(text.strip())
            total += n
            linked += n if anchor else 0

    at = 0
    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if skipped:
            if tag in ("article", "main") and not closing and not seen and (reason in _BEFORE_MAIN or tag == "main"):
                skipped = ""
            else:
                dropped[2] += tag == "article" and not closing
                if tag == skipped:
                    depth += -1 if closing else 1
                    if not depth:
                        skipped = ""
                continue
        if not closing and tag not in _VOID and not m[4].rstrip().endswith("/") and (why := _no_content(tag, m[4], article > 0)) and not (tag not in _NO_CONTENT and why in _LAYOUT and (spared is None or m.start() in spared)):
            close()
            dropped = [m.start(), 0, 0]
            if tag not in _NO_CONTENT and why in _LAYOUT:
                layouts.append(dropped)
            out.append(("", False, why in _PARTS, boxes[-1][1], False))
            skipped, depth, reason = tag, 1, why
            anchor = 0
            continue
        if tag in ("article", "main"):
            close()
            article = max(0, article + (-1 if closing else 1))
            seen = True
        elif tag in _BLOCKS:
            close()
            anchor = 0
            heading = tag in _HEADINGS and not closing
        elif tag == "a":
            anchor = 0 if closing else 1
        elif tag in ("br", "td", "th"):
            say(" ")
        if tag not in _BOXES:
            continue
        if not closing:
            boxes.append((tag, len(parent)))
            if tag in ("article", "main"):
                marked.add(len(parent))
            opened[tag] = opened.get(tag, 0) + 1
            parent.append(boxes[-2][1])
            last.append(0)
        while closing and opened.get(tag):
            name, box = boxes.pop()
            opened[name] -= 1
            last[box] = len(parent) - 1
            closing = name != tag
    say(html[at:])
    close()
    for _, box in boxes:
        last[box] = len(parent) - 1
    return out, parent, last, marked, layouts


def main_text(html: str | None) -> str:
    """The page's main text, its blocks joined by newlines."""
    html, spared = html or "", frozenset()
    found, parent, last, marked, layouts = lines(html)
    while layouts and not any(inside for _, inside, *_ in found):
        kept = sum(len(text) for text, _, of_links, *_ in found if not of_links)
        place, size, articles = max(layouts, key=lambda x: x[1])
        if size <= kept * (1 if articles else 2):
            break
        # each turn reads the page again: layouts nested deeper than NESTED all stay
        spared = spared | {place} if len(spared) < NESTED else None
        found, parent, last, marked, layouts = lines(html, spared)
    return "\n".join(found[i][0] for i in surging(found, parent, last, marked))


def windows(charge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of WINDOW charges from each line on and up to each line."""
    total = np.concatenate([[0], np.cumsum(charge)])
    at = np.arange(len(charge))
    return total[np.minimum(at + WINDOW, len(charge))] - total[at], total[at + 1] - total[np.maximum(at + 1 - WINDOW, 0)]


def threshold(sums: np.ndarray, charge: np.ndarray) -> float:
    """A quarter of the window sum that half of all charge reaches, SURGE at most."""
    order = np.argsort(-sums, kind="stable")
    half = np.searchsorted(np.cumsum(charge[order]), charge.sum() / 2)
    return min(SURGE, float(sums[order][min(half, len(order) - 1)]) / 4)


def surging(found: list[tuple[str, bool, bool, int, bool]], parent: list[int], last: list[int], marked: set[int]) -> list[int]:
    """The lines of the main text."""
    runs = [(kind, list(run)) for kind, run in groupby(range(len(found)), lambda i: (found[i][0] > "", found[i][2]))]
    size = [len(text) for text, *_ in found]
    stretches: list[list[int]] = [[]]
    parted = [True]  # whether more than an insert stands before the stretch
    for at, ((text, apart), run) in enumerate(runs):
        if text and apart:
            sides = [side for (words, links), side in (runs[max(0, at - 1)], runs[min(at + 1, len(runs) - 1)]) if words and not links]
            inside = all(found[i][1] for i in run)
            apart = not inside and (len(sides) < 2 or min(sum(size[i] for i in sides[0][-WINDOW:]), sum(size[i] for i in sides[1][:WINDOW])) <= sum(size[i] for i in run))
        if text and not apart:
            stretches[-1].extend(run)
        elif stretches[-1]:
            stretches.append([])
            parted.append(apart)
        else:
            parted[-1] |= apart
    if not stretches[-1]:
        stretches.pop()
    if not stretches:
        return []
    outside = OUTSIDE if any(inside for _, inside, *_ in found) else 1.0
    charge = [np.array([0.0 if found[i][2] and not found[i][1] else size[i] * (1.0 if found[i][1] else outside) for i in s]) for s in stretches]
    sums = [windows(c) for c in charge]
    surge = threshold(np.concatenate([ahead for ahead, _ in sums]), np.concatenate(charge))
    dense = [at for at, (ahead, _) in enumerate(sums) if ahead.max() >= surge]
    core = max(range(len(stretches)), key=lambda at: charge[at].sum())
    long = [found[i][3] for i, c in zip(stretches[core], charge[core], strict=True) if c >= surge / 2] or [found[i][3] for i in stretches[core]]
    home = long[0]
    while home and not home <= min(long) <= max(long) <= last[home]:
        home = parent[home]
    box = home
    while box:
        home = box if box in marked else home
        box = parent[box]
    at_home = lambda i: home > 0 and home <= found[i][3] <= last[home]
    a, b = (f([*dense, *(at for at, s in enumerate(stretches) if any(map(at_home, s)))]) for f in (min, max))
    while a and not parted[a]:
        a -= 1
    while b + 1 < len(stretches) and not parted[b + 1]:
        b += 1
    # the first line that surges and the last before the dive; headings lead to what follows them
    lines_ = [(i, ahead, behind) for s, (x, y) in zip(stretches[a : b + 1], sums[a : b + 1], strict=True) for i, ahead, behind in zip(s, x, y, strict=True)]
    first = next(n for n, (i, ahead, behind) in enumerate(lines_) if at_home(i) or behind >= surge or n == len(lines_) - 1)
    end = next(n for n, (i, ahead, behind) in reversed(list(enumerate(lines_))) if at_home(i) or ahead >= surge or n == first)
    # a byline or date may stand between a headline and what it leads to
    while back := next((n for n in range(1, min(WINDOW, first) + 1) if found[lines_[first - n][0]][4]), 0):
        first -= back
    return [i for i, _, _ in lines_[first : end + 1]]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(html)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(run, schema)
