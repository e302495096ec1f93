"""Streaming jobs on event time.

Metrics of a period: a watermark of ten seconds, the largest time that a gap is waited for, and one branch for each window, as every
window has a cadence of its own. Batches go to the idempotent sink, so a batch that is replayed after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.metrics import KEY, PERIOD_METRICS, flush_rows
from tidemark.plans.windows import WindowDef

WATERMARK = "10 seconds"
TRIGGER = "5 seconds"
#: Metrics that need no previous tick and can be added up as ticks come.
STREAMED = ["open_price", "close_price", "low_price", "high_price", "volume", "vwap", "twap", "sma", "ticks"]


def period_stream(ticks: DataFrame, windows: list[WindowDef], metrics: list[str] | None = None) -> DataFrame:
    """Appends a row for each key, window and period once the watermark has passed its end."""
    timed = ticks.withColumn("event_ts", F.timestamp_millis("event_ts_millis")).withWatermark("event_ts", WATERMARK)
    out = None
    for w in windows:
        spans = timed.groupBy(*KEY, F.window("event_ts", f"{w.cadence_ms} milliseconds").alias("w"))
        rows = spans.agg(*(PERIOD_METRICS[m]().alias(m) for m in metrics or STREAMED))
        end = F.unix_millis("w.end")
        rows = rows.select(*KEY, F.lit(w.id).alias("window_id"), (end - w.duration_ms).alias("start_ts_ms"), end.alias("end_ts_ms"), *(metrics or STREAMED))
        out = rows if out is None else out.unionByName(rows)
    return out


def start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, name: str | None = None) -> StreamingQuery:
    """Runs ``write`` on every micro-batch; ``once``: what is there now, in as many batches as needed, then stops."""
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def flush_job(ticks: DataFrame, windows: list[WindowDef], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Period metrics of a tick stream into a table that is appended to once for each key, window and period."""
    from tidemark.sources.sinks import append_new

    rows = period_stream(ticks, windows).withColumn("start_ts", F.timestamp_millis("start_ts_ms"))

    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, path, ["exchange", "channel", "symbol", "window_id", "start_ts"], "start_ts")

    return start(rows, write, checkpoint, once)


def rebuild(ticks: DataFrame, windows: list[WindowDef], path: str) -> int:
    """All 24 columns from stored ticks in batch: what a replay of the whole log gives. Returns how many rows were new."""
    from tidemark.sources.sinks import write_aggregates

    return write_aggregates(flush_rows(ticks, windows), path)
