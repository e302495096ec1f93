"""Restoring the order of streams, in batch form.

The streaming forms are in ``tidemark.streaming.processors``; both share the rules below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_key() -> Column:
    return F.lower(F.concat_ws(":", "exchange", "channel", "symbol"))


def by_sequence(rows: DataFrame, key: list[str], seq: str = "seq_id", arrival: str = "offset") -> DataFrame:
    """One row for each key and sequence number, its last arrival, with its rank in the key's sequence."""
    rest = [c for c in rows.columns if c not in (*key, seq)]
    last = rows.groupBy(*key, seq).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__r")).select(*key, seq, "__r.*")
    return last.withColumn("position", F.row_number().over(W.partitionBy(*key).orderBy(seq)))


def by_time(rows: DataFrame, key: list[str], time: str, arrival: str = "offset") -> DataFrame:
    """Rank by time, and by arrival within one time."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*key).orderBy(time, arrival)))


def drop_marker(headers: str = "headers") -> Column:
    """Whether a record's headers say that records before it were dropped: a dropped-count over 0."""
    return F.coalesce(F.exists(headers, lambda h: (h["key"] == "dropped-count") & (F.coalesce(h["value"].cast("string").try_cast("bigint"), F.lit(0)) > 0)), F.lit(False))


def after_resync(rows: DataFrame, key: list[str], arrival: str = "offset") -> tuple[DataFrame, DataFrame]:
    """Book messages to keep, and the requests for a new snapshot.

    From a record with a drop marker on, messages are discarded until the key's next snapshot, which passes itself.
    """
    w = W.partitionBy(*key).orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    marker = drop_marker() & (F.col("event_type") != "snapshot")
    event = F.when(F.col("event_type") == "snapshot", F.lit(False)).when(marker, F.lit(True))
    waiting = F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))
    marked = rows.withColumn("__wait", waiting)
    before = F.coalesce(F.lag("__wait").over(W.partitionBy(*key).orderBy(arrival)), F.lit(False))
    asked = marked.withColumn("__before", before).filter(F.col("__wait") & ~F.col("__before"))
    return marked.filter(~F.col("__wait")).drop("__wait"), asked.select(*key, arrival)


def spliced(deltas: DataFrame, snapshots: DataFrame, key: list[str], first: str = "first_id", last: str = "last_id") -> tuple[DataFrame, DataFrame]:
    """Deltas that follow their key's snapshot (last_update_id), and keys whose snapshot is too old.

    Deltas up to the snapshot are dropped. If the first one left begins after the snapshot's id + 1, something is missing between them.
    """
    joined = deltas.join(snapshots.select(*key, "last_update_id"), key).filter(F.col(last) > F.col("last_update_id"))
    heads = joined.groupBy(*key).agg(F.min_by(first, last).alias("__first"), F.first("last_update_id").alias("__id"))
    stale = heads.filter(F.col("__first") > F.col("__id") + 1).select(*key)
    return joined.join(stale, key, "left_anti").drop("last_update_id"), stale


class SequenceOrderer:
    """The rules of the sequence orderer, one key, one record at a time.

    A number at or over the last passes at once; so do duplicates and jumps ahead. A lower one opens a gap: it and all that follows are held, the
    last payload of a number winning, until ``flush`` gives them in order.
    """

    def __init__(self, last: int | None = None, held: dict | None = None):
        self.last, self.held = last, dict(held or {})

    def offer(self, seq: int, payload) -> list:
        if self.last is None:
            self.last = seq - 1
        if self.held:
            self.held[seq] = payload
            return []
        before, self.last = self.last, seq
        if seq < before:
            self.held[seq] = payload
            return []
        return [(seq, payload)]

    def flush(self) -> list:
        out = sorted(self.held.items(), key=lambda x: x[0])
        if out:
            self.last = out[-1][0]
        self.held = {}
        return out


class TimeOrderer:
    """Holds records until ``flush`` gives them by time, in order of arrival within one time."""

    def __init__(self, held: list | None = None):
        self.held = list(held or [])

    def offer(self, time: int, payload) -> list:
        self.held.append((time, len(self.held), payload))
        return []

    def flush(self) -> list:
        out = [(t, p) for t, _, p in sorted(self.held, key=lambda x: x[:2])]
        self.held = []
        return out
