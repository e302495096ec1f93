import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans.windows import chosen
from tidemark.schemas import TICK
from tidemark.sources import sinks
from tidemark.streaming import jobs, processors


def tick_rows(n, start=0):
    return [("x", "c", "AB"[i % 2], start + 700 * i, 10.0 + i % 5, 1.0, 10.0 + i % 5, 10.0 + i % 5, 10.0, 15.0, i) for i in range(n)]


def test_second_write_adds_nothing(spark, tmp_path):
    rows = metrics.flush_rows(spark.createDataFrame(tick_rows(40), TICK.ddl), chosen("5s")).persist()
    path = str(tmp_path / "agg")
    assert sinks.write_aggregates(rows, path) == rows.count()
    n = spark.read.parquet(path).count()
    assert sinks.write_aggregates(rows, path) == 0
    assert spark.read.parquet(path).count() == n == rows.count()


def test_books_without_time_go_aside(spark, tmp_path):
    head = spark.createDataFrame([("e", "s", 0, 1.0), ("e", "s", 5, 2.0)], "exchange string, symbol string, event_time_millis long, spread double").withColumn("event_time", F.timestamp_millis("event_time_millis"))
    level = head.select("exchange", "symbol", "event_time", F.lit(0).alias("level_index"), F.lit("B").alias("side"), F.lit(1.0).alias("price"), F.lit(1.0).alias("volume"))
    for _ in range(2):
        sinks.write_books(head, level, str(tmp_path / "b"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "b/orderbook_flushes")).count() == 1
    assert spark.read.parquet(str(tmp_path / "b/orderbook_flush_levels")).count() == 1
    assert spark.read.json(str(tmp_path / "bad")).first()["reason"] == "event_time_millis is 0"


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    windows = chosen("5s", "1m")
    rows = tick_rows(300)
    spark.createDataFrame(rows[:170], TICK.ddl).coalesce(1).write.json(source)
    stream = lambda: spark.readStream.schema(TICK.ddl).json(source)
    jobs.flush_job(stream(), windows, out, checkpoint, once=True).awaitTermination()
    spark.createDataFrame(rows[170:], TICK.ddl).coalesce(1).write.mode("append").json(source)
    # a last tick far ahead moves the watermark past every period
    spark.createDataFrame([("x", "c", "Z", 10_000_000, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0)], TICK.ddl).coalesce(1).write.mode("append").json(source)
    for _ in range(2):
        jobs.flush_job(stream(), windows, out, checkpoint, once=True).awaitTermination()
    have = spark.read.parquet(out).filter("symbol <> 'Z'").select("symbol", "window_id", "end_ts_ms", "open_price", "close_price", "volume", "vwap")
    want = metrics.period_metrics(spark.createDataFrame(rows, TICK.ddl), windows).select(*have.columns)
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))


class State(dict):
    """What the processors use of Spark's state handles, in memory."""

    def exists(self):
        return bool(self)

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value

    def iterator(self):
        return iter(self.items())

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return State()

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_sequence_processor_keeps_its_state():
    handle, p = Handle(), processors.SequenceProcessor()
    p.init(handle)
    offer = lambda *seqs: [int(s) for out in p.handleInputRows(("k",), iter([pd.DataFrame({"seq_id": seqs, "payload": [f"p{s}" for s in seqs]})]), Clock()) for s in out["seq_id"]]
    assert offer(1, 4) == [1, 4] and handle.timers == []
    assert offer(3) == [] and offer(2, 9) == []
    assert handle.timers == [1000 + processors.SEQUENCE_GAP_MS]
    assert [int(s) for out in p.handleExpiredTimer(("k",), Clock(), None) for s in out["seq_id"]] == [2, 3, 9]
    assert offer(9, 10) == [9, 10]
