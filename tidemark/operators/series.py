"""Serving queries over stored rows, and the set operations around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schemas import METRICS

#: Label, panel group, number format and whether the price chart overlays it: fixed values.
METRIC_META = [
    ("microprice", "Microprice", "price", "price", True),
    ("volume", "Volume", "volume", "volume", False),
    ("rolling_volume", "Rolling Volume", "volume", "volume", False),
    ("volume_acceleration", "Volume Acceleration", "flow", "number", False),
    ("volatility", "Volatility", "risk", "number", False),
    ("atr", "ATR", "risk", "price", False),
    ("ema", "EMA", "price", "price", True),
    ("sma", "SMA", "price", "price", True),
    ("log_return", "Log Return", "returns", "percent", False),
    ("simple_return", "Simple Return", "returns", "percent", False),
    ("twap", "TWAP", "price", "price", True),
    ("vwap", "VWAP", "price", "price", True),
    ("rolling_vwap", "Rolling VWAP", "price", "price", True),
]


def _range(rows: DataFrame, exchange: str, symbol: str, from_ms: int, to_ms: int) -> DataFrame:
    """Rows that lie within the range, not those that overlap it. Every predicate can reach the scan."""
    return rows.filter((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (F.col("start_ts_ms") >= from_ms) & (F.col("end_ts_ms") <= to_ms))


def candles(rows: DataFrame, exchange: str, symbol: str, window_id: str, from_ms: int, to_ms: int) -> DataFrame:
    found = _range(rows, exchange, symbol, from_ms, to_ms).filter(F.col("window_id") == window_id)
    return found.select("start_ts_ms", "end_ts_ms", "open_price", "close_price", "low_price", "high_price", "volume").orderBy("start_ts_ms")


def metrics(rows: DataFrame, exchange: str, symbol: str, window_ids: list[str], names: list[str], from_ms: int, to_ms: int) -> DataFrame:
    """(window_id, name, value, start_ts_ms, end_ts_ms), finite values only; a ValueError for unknown names."""
    if unknown := [n for n in names if n not in METRICS]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    found = _range(rows, exchange, symbol, from_ms, to_ms).filter(F.col("window_id").isin(window_ids))
    ids = ["window_id", "start_ts_ms", "end_ts_ms"]
    long = found.select(*ids, *names).unpivot(ids, list(names), "name", "value")
    return long.filter(finite("value")).select("window_id", "name", "value", "start_ts_ms", "end_ts_ms").orderBy("end_ts_ms", "start_ts_ms", "name")


def finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))


def grouped_metrics(long: DataFrame) -> DataFrame:
    """One row for each window with its points in order."""
    point = F.struct("end_ts_ms", "start_ts_ms", "name", "value")
    return long.groupBy("window_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def latest_book(headers: DataFrame, levels: DataFrame, exchange: str, symbol: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """The newest header and its first ``depth`` levels of each side."""
    mine = (F.col("exchange") == exchange) & (F.col("symbol") == symbol)
    header = headers.filter(mine).orderBy(F.desc("event_time_millis")).limit(1)
    w = W.partitionBy("side").orderBy("level_index")
    joined = levels.filter(mine).join(F.broadcast(header.select("event_time")), "event_time", "left_semi")  # one row
    return header, joined.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= depth).drop("__rank")


def merged(seed: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; a live row takes the place of a seed row of its key."""
    both = seed.withColumn("__live", F.lit(0)).unionByName(live.withColumn("__live", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.desc("__live"))
    return both.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1).drop("__rank", "__live")


def newest(rows: DataFrame, by: list[str], time: str, n: int = 1500) -> DataFrame:
    """The newest n rows of each series."""
    w = W.partitionBy(*by).orderBy(F.desc(time))
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def latest(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """The newest row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(time)).alias("__r")).select(*by, "__r.*")


def last_by_second(long: DataFrame, by: list[str], time_ms: str = "end_ts_ms") -> DataFrame:
    """The last value in each second."""
    return long.withColumn("time_sec", F.floor(F.col(time_ms) / 1000)).groupBy(*by, "time_sec").agg(F.max_by("value", F.col(time_ms)).alias("value"))


def drawable(candles_: DataFrame) -> DataFrame:
    """Candles with any price other than 0."""
    return candles_.filter((F.col("open_price") != 0) | (F.col("high_price") != 0) | (F.col("low_price") != 0) | (F.col("close_price") != 0))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1).drop("__rank")


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def new_rows(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key the target doesn't have; of equal keys in the batch the first."""
    return first_wins(batch, key, order).join(target.select(*key), key, "left_anti")


def orphans(levels: DataFrame, headers: DataFrame, key: list[str]) -> DataFrame:
    """Levels without their header: what a foreign key forbids."""
    return levels.join(headers.select(*key), key, "left_anti")


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the others; null counts as invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """lag by topic and partition: end - committed; a missing or negative commit counts as 0, a negative end gives 0."""
    joined = ends.join(committed, ["topic", "partition"], "left")
    start = F.greatest(F.coalesce(F.col("committed_offset"), F.lit(0)), F.lit(0))
    return joined.select("topic", "partition", F.when(F.col("end_offset") < 0, 0).otherwise(F.greatest(F.col("end_offset") - start, F.lit(0))).cast("long").alias("lag"))


def max_offsets(records: DataFrame) -> DataFrame:
    return records.groupBy("partition").agg(F.max("offset").alias("max_offset"))


def safe_offsets(records: DataFrame) -> DataFrame:
    """By partition, the least of the workers' greatest offsets: what can be committed."""
    return records.groupBy("worker", "partition").agg(F.max("offset").alias("m")).groupBy("partition").agg(F.min("m").alias("safe_offset"))


def violations(snapshot: DataFrame, committed: DataFrame) -> DataFrame:
    """Partitions whose snapshot offset isn't committed yet; none means the snapshot may be kept."""
    return snapshot.join(committed, "partition", "left").filter(F.col("committed_offset").isNull() | (F.col("offset") > F.col("committed_offset")))
