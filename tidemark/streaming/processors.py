"""Orderers as stateful operators: the rules of ``tidemark.operators.ordering`` with state kept by Spark and processing-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ordering import SequenceOrderer, TimeOrderer

#: How long a gap is waited for, in milliseconds.
SEQUENCE_GAP_MS = 10_000
TIME_GAP_MS = 250


class SequenceProcessor(StatefulProcessor):
    """By key: rows (key, seq_id, payload) in sequence; a gap is flushed after ``SEQUENCE_GAP_MS``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")
        self.held = handle.getMapState("held", "seq long", "payload string")

    def load(self) -> SequenceOrderer:
        last = int(self.last.get()[0]) if self.last.exists() else None
        held = {int(k[0]): v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        return SequenceOrderer(last, held)

    def rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(out), "seq_id": [s for s, _ in out], "payload": [p for _, p in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        orderer = self.load()
        waited = bool(orderer.held)
        out: list = []
        for pdf in rows:
            for seq, payload in zip(pdf["seq_id"], pdf["payload"], strict=True):
                out += orderer.offer(int(seq), payload)
        self.last.update((orderer.last,))
        for seq, payload in orderer.held.items():
            self.held.updateValue((seq,), (payload,))
        if orderer.held and not waited:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + SEQUENCE_GAP_MS)
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        orderer = self.load()
        out = orderer.flush()
        if self.held.exists():
            self.held.clear()
        if orderer.last is not None:
            self.last.update((orderer.last,))
        yield self.rows(key, out)

    def close(self) -> None:
        pass


class TimeProcessor(StatefulProcessor):
    """By key: rows (key, event_time_millis, payload) by time, collected for ``TIME_GAP_MS``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.held.exists()
        for pdf in rows:
            for time, payload in zip(pdf["event_time_millis"], pdf["payload"], strict=True):
                self.held.appendValue((json.dumps([int(time), payload]),))
        if first:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + TIME_GAP_MS)
        yield pd.DataFrame({"key": [], "event_time_millis": [], "payload": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        orderer = TimeOrderer()
        for item in self.held.get():
            time, payload = json.loads(item[0])
            orderer.offer(time, payload)
        self.held.clear()
        out = orderer.flush()
        yield pd.DataFrame({"key": [key[0]] * len(out), "event_time_millis": [t for t, _ in out], "payload": [p for _, p in out]})

    def close(self) -> None:
        pass


def in_sequence(rows: DataFrame) -> DataFrame:
    """Rows (key, seq_id, payload) of a stream in sequence. Needs the RocksDB state store."""
    return rows.groupBy("key").transformWithStateInPandas(SequenceProcessor(), "key string, seq_id long, payload string", "Append", "ProcessingTime")


def in_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(TimeProcessor(), "key string, event_time_millis long, payload string", "Append", "ProcessingTime")
