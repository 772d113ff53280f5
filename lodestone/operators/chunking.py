"""Articles to overlapping chunks that keep to sections and whole sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as fx
from lodestone.sources.layout import slices, spread


@dataclass(frozen=True)
class Sizes:
    low: int = 300
    enough: int = 450
    high: int = 900
    overlap: int = 80
    drop_overlap_only: bool = False


#: The footnote heading, heading levels, footnote marks, and the names given to them.
NOTES_TITLE = "注释"
_NOTES = re.compile(r"(\n---\n+)?\s*\*\*注释\*\*\s*\n")
_HEADING = re.compile(r"^(#{2,4})\s+(.+?)\s*$", re.M)
_NOTE = re.compile(r"\\\[(\d+)\]")
_FRONT = re.compile(r"\A---\n.*?\n---\n", re.S)
_RULE = re.compile(r"\A\s*---\s*\n")
_SENTENCE = re.compile(fx.SENTENCE.replace(r"\z", r"\Z"))
CHUNK = "article_id string, seq int, chunk_id string, section_title string, footnote_ref string, is_footnote boolean, text string, char_count int, char_offset_start int, char_offset_end int"


def body_of(markdown: str) -> str:
    return _RULE.sub("", _FRONT.sub("", markdown, count=1), count=1)


def sections(main: str) -> Iterator[tuple[str | None, int, str]]:
    """(title, offset, text) of every section that is not blank."""
    title, at = None, 0
    for m in [*_HEADING.finditer(main), None]:
        part = main[at : m.start() if m else len(main)]
        if part.strip():
            yield title, at, part.strip("\n")
        if m:
            title, at = m[2], m.end()


def split_sentences(text: str) -> list[tuple[str, int]]:
    out = []
    for m in _SENTENCE.finditer(text):
        whole = m[0]
        if kept := whole.strip():
            out.append((kept, m.start() + len(whole) - len(whole.lstrip())))
    return out


def pack(found: list[tuple[str, int]], sizes: Sizes = Sizes()) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of greedy packs of sentences; each begins with the last whole sentences of the one before."""
    held: list[tuple[str, int]] = []
    size, fresh = 0, False

    def tail() -> list[tuple[str, int]]:
        out, n = [], 0
        for s in reversed(held):
            if n >= sizes.overlap:
                break
            out.insert(0, s)
            n += len(s[0])
        return out

    def made() -> tuple[str, int, int]:
        return "".join(s for s, _ in held), held[0][1], held[-1][1] + len(held[-1][0])

    for sentence in found:
        n = len(sentence[0])
        if held and size + n > sizes.high and size >= sizes.low:
            yield made()
            held = tail()
            size = sum(len(s) for s, _ in held)
        if n > sizes.high and not held:
            yield sentence[0], sentence[1], sentence[1] + n
            continue
        held.append(sentence)
        size, fresh = size + n, True
        if size >= sizes.enough:
            yield made()
            held = tail()
            size, fresh = sum(len(s) for s, _ in held), False
    if held and (fresh or not sizes.drop_overlap_only):
        yield made()


def chunk_article(markdown: str, sizes: Sizes = Sizes()) -> Iterator[tuple[str | None, str | None, bool, str, int, int]]:
    """(section title, footnote number, is footnote, text, start, end) in order."""
    body = body_of(markdown)
    # the pattern may begin with any white space, so it is slow where its heading does not occur
    cut = _NOTES.search(body) if f"**{NOTES_TITLE}**" in body else None
    main, notes = (body[: cut.start()], body[cut.end() :]) if cut else (body, "")
    for title, at, text in sections(main):
        for t, a, b in pack(split_sentences(text), sizes):
            yield title, None, False, t, at + a, at + b
    marks = list(_NOTE.finditer(notes))
    for m, following in zip(marks, [*marks[1:], None][: len(marks)], strict=True):
        text = notes[m.start() : following.start() if following else len(notes)].strip()
        start = (cut.end() if cut else 0) + m.start()
        yield NOTES_TITLE, m[1], True, text, start, start + len(text)


def chunk_articles(articles: DataFrame, key: str, text: str, sizes: Sizes = Sizes(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of every article, with the article's ``keep`` columns after them; numbering restarts in each."""
    names = [f.split()[0] for f in CHUNK.split(", ")]
    schema = StructType.fromDDL(CHUNK)
    for c in keep:
        schema = schema.add(articles.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in slices(whole, "t")):
            rows, of = [], []
            for i, (article, body) in enumerate(zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                for n, (title, ref, note, t, a, b) in enumerate(chunk_article(body or "", sizes), 1):
                    rows.append((article, n, f"{article}-{n:04d}", title, ref, note, t, len(t), a, b))
                    of.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            kept = [batch.column(f"keep{i}").take(pa.array(of, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *kept], [*names, *keep])

    kept = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    return spread(articles.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), *kept)).mapInArrow(run, schema)


def stats(chunks: DataFrame) -> DataFrame:
    """Totals, and the least, greatest and mean number of chunks of an article."""
    per = chunks.groupBy("article_id").agg(F.count("*").alias("n"), F.count_if("is_footnote").alias("notes"))
    return per.agg(F.sum("n").alias("chunks"), F.sum("notes").alias("footnotes"), F.count("*").alias("articles"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def histogram(lengths: DataFrame, column: str = "char_count") -> DataFrame:
    """Rows by hundreds of characters, the last bucket open."""
    return lengths.groupBy(F.least(F.floor(F.col(column) / 100), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
