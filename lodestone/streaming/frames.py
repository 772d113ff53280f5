"""Server-sent events put together from network reads that cut them anywhere, also inside a character.

Reads come as rows (conn, seq, piece): the bytes of read number ``seq`` of a connection, numbers from 0 without gaps.  They may arrive in any order
and in different micro-batches.  Keyed state holds what is cut and what came too early; an event goes out as soon as its last byte is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

END, FIELD = b"\n\n", b"data: "
OUT = "n long, event string, whole boolean"


def events_of(held: bytes) -> tuple[list[str], bytes]:
    """The payloads of all whole events, and the rest; events without a data line are left out."""
    *whole, rest = held.split(END)
    lines = (next((x for x in event.split(b"\n") if x.startswith(FIELD)), None) for event in whole)
    return [x[len(FIELD) :].decode("utf-8", "replace") for x in lines if x is not None], rest


def rows_of(conn: object, n: int, events: list[str], whole: bool) -> pd.DataFrame:
    # plain objects: the engine takes no chunked string arrays here
    return pd.DataFrame({"conn": pd.Series([conn] * len(events), dtype=object), "n": np.arange(n, n + len(events)), "event": pd.Series(events, dtype=object), "whole": np.full(len(events), whole)})


class Frames(StatefulProcessor):
    """After ``idle`` milliseconds without a read, what is left of a connection goes out as one row that is not whole, and its state is dropped."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rest binary, seq long, n long")
        self.early = handle.getMapState("early", "seq long", "piece binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, seq, n = self.held.get() if self.held.exists() else (b"", 0, 0)
        rest = bytes(rest)
        for frame in rows:
            for number, piece in zip(frame["seq"], frame["piece"]):
                # a read that comes again changes nothing
                if number >= seq:
                    self.early.updateValue((int(number),), (bytes(piece or b""),))
        joined = [rest]
        while self.early.exists() and self.early.containsKey((seq,)):
            joined.append(bytes(self.early.getValue((seq,))[0]))
            self.early.removeKey((seq,))
            seq += 1
        out, rest = events_of(b"".join(joined))
        self.held.update((rest, seq, n + len(out)))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield rows_of(key[0], n, out, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            rest, _, n = self.held.get()
            left = [bytes(rest).decode("utf-8", "replace")] if rest else []
            self.held.clear()
            self.early.clear()
            yield rows_of(key[0], n, left, False)

    def close(self) -> None:
        pass


def frames(reads: DataFrame, idle: int | None = None) -> DataFrame:
    """A streaming frame (conn, seq, piece) -> (conn, n, event, whole): the events of each connection, numbered in their order."""
    kind = reads.schema["conn"].dataType.simpleString()
    return reads.groupBy("conn").transformWithStateInPandas(Frames(idle), f"conn {kind}, {OUT}", "Append", "None" if idle is None else "ProcessingTime")
