"""Folds of ordered rows by key: one rule, run over a sorted batch or over a stream with state that ends.

A fold is made from its records, a dict of (kind, id) to JSON text, and has ``step(position, kind, text)``,
which gives the (kind, id, record) rows that a message makes, ``changes()``, the records to keep (None: dropped)
since it was made, and ``over``, whether its game has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.workers import carried

carried(__name__)

#: What a fold takes and gives; ``at`` (a timestamp with the stream's watermark) is needed on streams only.
TAKES = ["match", "position", "kind", "text"]
GIVES = "match string, position long, kind string, id long, record string"
#: State of a match goes so long (ms of event time) after its last message, sooner after its game has ended.
IDLE, ENDED = 6 * 3_600_000, 600_000


def given(match: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(match, *r) for r in rows], columns=["match", "position", "kind", "id", "record"]).astype({"position": "int64", "id": "int64"})


class KeyedFold(StatefulProcessor):
    """One map of records for each match, read once and written once a batch, dropped by an event-time timer."""

    def __init__(self, make: Callable, idle: int):
        self.make, self.idle = make, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "kind string, id long", "record string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("position", kind="stable")
        fold, out = self.make({tuple(k): v[0] for k, v in self.records.iterator()}), []
        for position, kind, text in zip(frame["position"], frame["kind"], frame["text"], strict=True):
            out += [(position, *r) for r in fold.step(position, kind, text)]
        for k, record in fold.changes().items():
            if record is None:
                self.records.removeKey(k)
            else:
                self.records.updateValue(k, (record,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A fold that keeps nothing needs no timer: its state is empty.
        if fold.keeps():
            self.handle.registerTimer(int(frame["at"].max().timestamp() * 1000) + (ENDED if fold.over else self.idle))
        yield given(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.records.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded(rows: DataFrame, make: Callable, idle: int = IDLE) -> DataFrame:
    """GIVES of rows with TAKES (match as text).  A batch is sorted by match and position and folded as it streams by, so that a task holds one match's state at a time; a stream keeps it between micro-batches."""
    if rows.isStreaming:
        return rows.select(*TAKES, "at").groupBy("match").transformWithStateInPandas(KeyedFold(make, idle), GIVES, "append", "EventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, fold = None, None
        for frame in frames:
            for own, part in frame.groupby("match", sort=False):
                if fold is None or own != match:
                    match, fold = own, make({})
                yield given(match, [(p, *r) for p, k, t in zip(part["position"], part["kind"], part["text"], strict=True) for r in fold.step(p, k, t)])

    return rows.select(*TAKES).where("match is not null").repartition("match").sortWithinPartitions("match", "position").mapInPandas(run, GIVES)


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which keyed folds need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
