"""Table functions for SQL: rows of one text, beside the row that holds it.

    tables.register(spark)
    spark.sql("SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.text) c")

Batches travel by Arrow.  Null and empty texts have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestone.operators import chunking, cleaning


@udtf(returnType="seq int, section_title string, footnote_ref string, is_footnote boolean, text string, char_count int, char_offset_start int, char_offset_end int", useArrow=True)
class ChunkText:
    """The chunks of an article's markdown, in order."""

    def eval(self, markdown: str) -> Iterator[tuple]:
        for n, (title, ref, note, text, start, end) in enumerate(chunking.chunk_article(markdown or ""), 1):
            yield n, title, ref, note, text, len(text), start, end


@udtf(returnType="marker string, place int, decision string", useArrow=True)
class TrimAudit:
    """Every place of a trailing marker, and whether the page would be cut there."""

    def __init__(self) -> None:
        self.places = cleaning.marker_places()

    def eval(self, page: str) -> Iterator[tuple]:
        yield from self.places(page or "")


def register(spark: SparkSession) -> None:
    """Makes ``chunk_text(markdown)`` and ``trim_audit(page)`` known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("trim_audit", TrimAudit)
