"""Many terms in one pass over a text: an automaton over all of them, built once in a task.

Terms may be a table: they are dealt into parts of at most about ``PART_TERMS`` by hash, each part is one pass with one automaton, and no
text meets a term that it does not hold.  Null and empty texts hold nothing, null and empty terms are held by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.layout import slices, spread

#: terms of one automaton, which every task holds
PART_TERMS = 200_000


def automaton(terms: list[str]) -> ahocorasick.Automaton | None:
    """Reports the numbers of the terms that end at a place; none without terms."""
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            found.add_word(t, i)
    if not len(found):
        return None
    found.make_automaton()
    return found


def contained(texts: DataFrame, terms: DataFrame, most: int = PART_TERMS) -> DataFrame:
    """texts (id, t), terms (term) -> (id, term), each term once for each row of texts that holds it."""
    spark, wanted = texts.sparkSession, terms.where("term <> ''").select("term").distinct()
    parts = max(1, -(-wanted.count() // most))
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("term", T.StringType())])
    rows = spread(texts.select("id", "t"))

    def one(part: int) -> DataFrame:
        listed = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([r.term for r in listed.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(sent.value, pa.string())
            held = automaton(sent.value)
            for batch in (p for whole in batches for p in slices(whole, "t")):
                hits = [np.fromiter({i for _, i in held.iter(t)}, np.int64) if held and t else np.empty(0, np.int64) for t in batch.column("t").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), names.take(pa.array(np.concatenate([*hits, np.empty(0, np.int64)]), pa.int64()))], ["id", "term"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(one, range(parts)))


def own_places(held: ahocorasick.Automaton | None, terms: list[str], text: str) -> Iterator[tuple[int, int]]:
    """(number of the term, place) of the terms in a text; a term's own places do not overlap."""
    after = [0] * len(terms)
    for end, k in held.iter(text) if held and text else ():
        start = end + 1 - len(terms[k])
        if start >= after[k]:
            after[k] = end + 1
            yield k, start


def places(texts: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(key, t, term, at): a row for each place of a term in a text, counted in characters; a term's own places do not overlap."""
    schema = T.StructType([texts.schema[key], T.StructField("t", T.StringType()), T.StructField("term", T.StringType()), T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = automaton(terms), pa.array(terms, pa.string())
        for batch in (p for whole in batches for p in slices(whole, "t")):
            of, which, at = [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                for k, start in own_places(held, terms, t):
                    of.append(i)
                    which.append(k)
                    at.append(start)
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(rows), batch.column("t").take(rows), names.take(pa.array(which, pa.int64())), pa.array(at, pa.int32())], schema.names)

    return spread(texts.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, schema)
