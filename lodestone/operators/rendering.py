"""Markdown of answers and articles as HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the lines of each kind of block begin; the first that fits counts.
KINDS = {
    "blank": re.compile(r"\Z"),
    "heading": re.compile(r"(#{1,4})\s+(.+)\Z"),
    "rule": re.compile(r"---+\Z"),
    "table": re.compile(r"\|.*\|\Z"),
    "quote": re.compile(r">\s?"),
    "list": re.compile(r"(\d+\.|-|\*)\s+"),
}
#: Marks inside a line and what they become, in this order.
INLINE = (
    (re.compile(r"\*\*([^*\n]+?)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"\\\[(\d+)\]"), r"[\1]"),
    (re.compile(r"\[([^\]]+)\]\(([^)]+)\)"), r'<a href="\2" target="_blank" rel="noopener">\1</a>'),
    (re.compile(r"《([^》\n]+)》"), r'<span class="cite" data-title="\1">《\1》</span>'),
)


def inline(text: str) -> str:
    out = html.escape(text).replace("&#x27;", "&#39;")
    for mark, shown in INLINE:
        out = mark.sub(shown, out)
    return out


def _kind(line: str) -> str:
    return next((k for k, begins in KINDS.items() if begins.match(line)), "text")


def _table(lines: list[str]) -> Iterator[str]:
    """The first line is the head, the second the rule under it; a single line is no table."""
    if len(lines) < 2:
        return
    cells = [[inline(c.strip()) for c in re.sub(r"\A\||\|\Z", "", line).split("|")] for line in lines]
    yield "<table><thead><tr>"
    yield from (f"<th>{c}</th>" for c in cells[0])
    yield "</tr></thead><tbody>"
    for row in cells[2:]:
        yield "<tr>"
        yield from (f"<td>{c}</td>" for c in row)
        yield "</tr>"
    yield "</tbody></table>"


def _block(kind: str, lines: list[str]) -> Iterator[str]:
    if kind == "heading":
        for m in map(KINDS[kind].match, lines):
            level = min(len(m[1]) + 1, 4)
            yield f"<h{level}>{inline(m[2])}</h{level}>"
    elif kind == "rule":
        yield from ["<hr>"] * len(lines)
    elif kind == "table":
        yield from _table(lines)
    elif kind == "quote":
        yield from (f"<p>{inline(t)}</p>" for t in (KINDS[kind].sub("", line, count=1) for line in lines) if t)
    elif kind == "list":
        tag = "ol" if lines[0][0].isdigit() else "ul"
        yield f"<{tag}>"
        yield from (f"<li>{inline(KINDS[kind].sub('', line, count=1))}</li>" for line in lines)
        yield f"</{tag}>"
    elif kind == "text":
        yield f"<p>{inline(' '.join(lines))}</p>"


def to_html(markdown: str) -> str:
    """Neighbouring lines of a kind are one block.  A quotation goes on over a table that follows at once."""
    out, quoting = [], False
    lines = [line.strip() for line in markdown.replace("\r\n", "\n").split("\n")]
    for kind, block in groupby(lines, _kind):
        if kind == "quote" and not quoting:
            out.append("<blockquote>")
        elif quoting and kind not in ("quote", "table"):
            out.append("</blockquote>")
        quoting = kind == "quote" or quoting and kind == "table"
        out += _block(kind, list(block))
    return "\n".join([*out, "</blockquote>"] if quoting else out)


def rendered(markdown: Column) -> Column:
    """HTML of a markdown column; null stays null."""

    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else to_html(t))

    return render(markdown)
