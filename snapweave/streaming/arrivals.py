"""Streams of arriving chunks: progress per session, and ingestion into a store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..schema import REORDER_WINDOW

PROGRESS = "session string, high_water long, pending long, duplicates long, refused long, complete boolean"


class Tracker:
    """The contiguous prefix of a plan's positions, and those ahead of it within a window."""

    def __init__(self, plan: int, base: int = 0, ahead: set[int] | None = None, window: int = REORDER_WINDOW):
        self.plan, self.base, self.ahead, self.window = plan, base, ahead if ahead is not None else set(), window

    def mark(self, start: int, count: int) -> str:
        """`ok`, `duplicate` where nothing of it is new, or `protocol` where it lies beyond the plan or the window."""
        if count < 1 or start < 0 or start + count > self.plan or start + count > self.base + self.window:
            return "protocol"
        new = [s for s in range(max(start, self.base), start + count) if s not in self.ahead]
        self.ahead.update(new)
        while self.base in self.ahead:
            self.ahead.discard(self.base)
            self.base += 1
        return "ok" if new else "duplicate"

    def pack(self) -> bytes:
        """The positions ahead as a bitmap from the base on."""
        bits = bytearray(-(-(max(self.ahead, default=self.base - 1) - self.base + 1) // 8))
        for s in self.ahead:
            bits[(s - self.base) // 8] |= 1 << ((s - self.base) % 8)
        return bytes(bits)

    @staticmethod
    def unpack(base: int, bits: bytes) -> set[int]:
        return {base + 8 * i + k for i, b in enumerate(bits) if b for k in range(8) if b >> k & 1}


class HighWater(StatefulProcessor):
    """State per session: the prefix's end and a bitmap of at most the window's positions beyond it."""

    def __init__(self, window: int = REORDER_WINDOW):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("base", LongType()), StructField("bits", BinaryType()), StructField("duplicates", LongType()), StructField("refused", LongType())]
        self.state = handle.getValueState("progress", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        base, bits, duplicates, refused = self.state.get() if self.state.exists() else (0, b"", 0, 0)
        t, plan = Tracker(0, base, Tracker.unpack(base, bytes(bits)), self.window), 0
        for pdf in rows:
            for start, count, size in zip(pdf["seq"], pdf["count"], pdf["plan_size"], strict=True):
                t.plan = plan = int(size)
                said = t.mark(int(start), int(count))
                duplicates += said == "duplicate"
                refused += said == "protocol"
        self.state.update((t.base, t.pack(), duplicates, refused))
        yield pd.DataFrame([(key[0], t.base, len(t.ahead), duplicates, refused, t.base == plan)], columns=[x.split()[0] for x in PROGRESS.split(", ")])

    def close(self) -> None:
        pass


def high_water_stream(arrivals: DataFrame, window: int = REORDER_WINDOW) -> DataFrame:
    """A stream of (session, seq, count, plan_size) as progress per session, in update mode. Needs the RocksDB state store.

    Late and repeated ranges count as duplicates and change nothing; ranges beyond the plan or the window are refused.
    """
    return arrivals.groupBy("session").transformWithStateInPandas(HighWater(window), PROGRESS, "Update", "None")


def ingest_stream(chunks: DataFrame, store, checkpoint: str):
    """A stream of (fp, payload) into a store: each micro-batch is an idempotent insert, so one that is repeated does no harm."""
    return chunks.writeStream.foreachBatch(lambda batch, _: store.put(batch)).option("checkpointLocation", checkpoint)
