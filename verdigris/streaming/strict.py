"""Strict event streams as they come: each event is checked against the state that its item had."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators import strict

#: Arbitrary state needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Previous(StatefulProcessor):
    """Hands on each event of an item with the one before it, and whether the item had its id already. Ids are a map in the state store, not in memory."""

    def __init__(self, schema: StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event string")
        self.ids = handle.getMapState("ids", "event_id string", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        names = self.schema.fieldNames()
        prev = json.loads(self.last.get()[0]) if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r["seq"]):
            event, told = row.asDict(recursive=True), (row["event_id"] or "",)
            again = row["event_id"] is not None and self.ids.containsKey(told)
            self.ids.updateValue(told, (row["seq"],))
            yield Row(**{n: event[n] for n in names}, again=again, prev=prev)
            prev = event
        self.last.update((json.dumps(prev),))

    def close(self) -> None:
        pass


def with_previous(stream: DataFrame) -> DataFrame:
    """As ``strict.with_previous`` gives it, for a stream of events in which an item's events come in order. The session's state store must be ``STATE_STORE``."""
    out = StructType([*stream.schema.fields, StructField("again", BooleanType()), StructField("prev", stream.schema)])
    return stream.groupBy("item").transformWithState(statefulProcessor=Previous(stream.schema), outputStructType=out, outputMode="Append", timeMode="None")


def checked(stream: DataFrame, kind: str) -> DataFrame:
    """The events with what is wrong with each; ``strict.folded`` makes states of what was written."""
    return strict.checked(with_previous(stream), kind)
