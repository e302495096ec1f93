"""Sinks: idempotent, day-partitioned tables, and the side table of invalid records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.series import new_rows, split_valid
from tidemark.schemas import AGG_KEY, BOOK_FLUSH_KEY, BOOK_LEVEL_KEY

DAY_COLUMN = "event_date"
#: Tasks that share a day of a batch.
FILES_A_DAY = 8


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        # nothing there yet, or a folder without a file; anything else is an error
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(batch: DataFrame, path: str, key: list[str], day_of: str) -> int:
    """Appends rows whose key isn't there yet; a batch that is written again adds nothing. Returns how many were new.

    Only the days of the batch are read of the target. A day is written by up to ``FILES_A_DAY`` tasks, each of which sorts its rows by key.
    """
    spark = batch.sparkSession
    rows = batch.withColumn(DAY_COLUMN, F.to_date(day_of)).persist()
    try:
        target = existing(spark, path)
        order = [c for c in rows.columns if c not in key]
        if target is None:
            from tidemark.operators.series import first_wins

            fresh = first_wins(rows, key, order[:1])
        else:
            days = rows.select(DAY_COLUMN).distinct()
            # distinct days of one batch: a handful of rows, read by dynamic partition pruning
            fresh = new_rows(rows, target.join(F.broadcast(days), DAY_COLUMN, "left_semi"), key, order[:1])
        fresh = fresh.persist()
        try:
            n = fresh.count()
            dealt = fresh.repartition(DAY_COLUMN, F.pmod(F.xxhash64(*key), F.lit(FILES_A_DAY)))
            dealt.sortWithinPartitions(DAY_COLUMN, *key).write.mode("append").partitionBy(DAY_COLUMN).parquet(path)
            return n
        finally:
            fresh.unpersist()
    finally:
        rows.unpersist()


def write_aggregates(batch: DataFrame, path: str) -> int:
    return append_new(batch, path, AGG_KEY, "start_ts")


def write_books(headers: DataFrame, levels: DataFrame, path: str, invalid_path: str | None = None) -> None:
    """Headers and their levels; headers without a time go to the side table with the reason."""
    good, bad = split_valid(headers, F.col("event_time_millis") != 0)
    append_new(good, f"{path}/orderbook_flushes", BOOK_FLUSH_KEY, "event_time")
    append_new(levels.join(good.select(*BOOK_FLUSH_KEY), BOOK_FLUSH_KEY, "left_semi"), f"{path}/orderbook_flush_levels", BOOK_LEVEL_KEY, "event_time")
    if invalid_path:
        dead_letters(bad, "orderbook", "event_time_millis is 0").write.mode("append").json(invalid_path)


def dead_letters(rows: DataFrame, topic: str, reason: str) -> DataFrame:
    return rows.select(F.lit(topic).alias("topic"), F.lit(reason).alias("reason"), F.to_json(F.struct(*rows.columns)).alias("payload"))
