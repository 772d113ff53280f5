"""Sliding-window rate limit that counts accepted requests only, in batch and as a stream.

Whether a request passes depends on which ones before it passed, so no window aggregate can say it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


def decide(times: list[float], kept: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Accepted or not, in order, and the accepted times that still count."""
    out = []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def stretches(plain: DataFrame, seconds: float) -> DataFrame:
    """plain (k, t, o) with ``stretch``: a number that grows where a key's events pause for a whole window, after which nothing counts any more.

    A pause of a whole window lies between two window-long buckets of time, so a row for each bucket of a key shows all pauses.
    """
    placed = plain.withColumn("slot", F.floor(F.col("t") / seconds))
    ends = placed.groupBy("k", "slot").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = W.partitionBy("k").orderBy("slot")
    cut = F.coalesce(F.col("first") - F.lag("last").over(order) >= seconds, F.lit(True))
    numbered = ends.withColumn("cut", cut.cast("int")).withColumn("stretch", F.sum("cut").over(order)).select(F.col("k").alias("of"), F.col("slot").alias("in"), "stretch")
    return placed.join(numbered, F.col("k").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("in"))).select("k", "t", "o", "stretch")


def rate_limit(events: DataFrame, key: str, time: str, order: str, limit: int = 10, seconds: float = 600) -> DataFrame:
    """(key, order, accepted): a key's events are cut at pauses of a whole window, dealt by key and stretch, and each stretch is walked once.

    So one key's events are many tasks' work unless they go on without a pause.  An event without a time is not accepted and does not count.
    """
    plain = events.select(F.col(key).alias("k"), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(order).alias("o"))
    dealt = stretches(plain.where("t is not null"), seconds).repartition("k", "stretch").sortWithinPartitions("k", "stretch", "t", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), []
        for b in batches:
            out = []
            for k, n, t in zip(b.column("k").to_pylist(), b.column("stretch").to_pylist(), b.column("t").to_pylist(), strict=True):
                if (k, n) != now:
                    now, kept = (k, n), []
                ok, kept = decide([t], kept, limit, seconds)
                out += ok
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("o"), pa.array(out, pa.bool_())], [key, order, "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in events.select(key, order).schema.fields}
    timeless = plain.where("t is null").select(F.col("k").alias(key), F.col("o").alias(order), F.lit(False).alias("accepted"))
    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean").unionByName(timeless)


class RateLimiter(StatefulProcessor):
    """The same walk with the accepted times in keyed state; rows (k, t, o) -> (k, o, accepted).

    With ``idle``, a key's state goes when it was not written for the window and so many seconds more, by the clock: so late may events come.
    """

    def __init__(self, limit: int = 10, seconds: float = 600, idle: float | None = None):
        self.limit, self.seconds, self.idle = limit, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", StructType([StructField("t", DoubleType())]), ttlDurationMs=None if self.idle is None else int(1000 * (self.seconds + self.idle)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["t", "o"])
        accepted, kept = decide(data["t"].tolist(), [r[0] for r in self.kept.get()], self.limit, self.seconds)
        if kept:
            self.kept.put([(k,) for k in kept])
        else:
            self.kept.clear()
        yield pd.DataFrame({"k": data["k"], "o": data["o"], "accepted": accepted})

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int = 10, seconds: float = 600, idle: float | None = None) -> DataFrame:
    """A streaming frame (k, t double seconds, o) -> (k, o, accepted).

    Give ``idle`` where keys come without end.  The engine then runs a batch at every trigger, with or without
    events, so the trigger should have an interval.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.groupBy("k").transformWithStateInPandas(RateLimiter(limit, seconds, idle), f"k {kinds['k']}, o {kinds['o']}, accepted boolean", "Append", "None" if idle is None else "ProcessingTime")
