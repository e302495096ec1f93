"""Readers: the generated tables, and what of them plays which part; raw records from files or message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.windows import epoch_ms
from tidemark.schemas import RAW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks: a symbol for each event type, the value as price, the JSON property k as volume."""
    e = table(spark, sf_dir, "events")
    price = F.col("value")
    return e.select(F.lit("events").alias("exchange"), F.lit("stream").alias("channel"), F.col("event_type").alias("symbol"), epoch_ms(F.col("ts")).alias("event_ts_millis"), price.alias("price"), F.get_json_object("props", "$.k").try_cast("double").alias("volume"), price.alias("open"), price.alias("close"), price.alias("low"), price.alias("high"), F.col("event_id").alias("seq_id"))


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its part's brand as ticks whose high and low differ; a tie-break over all keys orders a day's ticks."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    return rows.select(F.lit("store").alias("exchange"), F.lit("trade").alias("channel"), "symbol", epoch_ms(F.col("l_shipdate")).alias("event_ts_millis"), price.alias("price"), F.col("l_quantity").alias("volume"), (price * (1 - F.col("l_discount"))).alias("open"), price.alias("close"), (price * (1 - F.col("l_discount"))).alias("low"), (price * (1 + F.col("l_tax"))).alias("high"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq_id"))


def lineitem_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as level changes: returned lines bid or ask by brand; no discount cancels a level."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = li.filter(F.col("l_returnflag").isin("A", "R")).join(part, li.l_partkey == part.p_partkey)
    return rows.select(
        F.lit("store").alias("exchange"),
        "symbol",
        epoch_ms(F.col("l_shipdate")).alias("event_time_millis"),
        F.lit("update").alias("event_type"),
        F.when(F.col("l_returnflag") == "A", "B").otherwise("A").alias("side"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-9, 2).alias("price"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("sequence"),
    )


def raw_files(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Raw records kept as JSON lines with the columns of a message log."""
    reader = (spark.readStream if stream else spark.read).schema(RAW.ddl)
    if stream and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def raw_log(spark: SparkSession, servers: str, topics: list[str], stream: bool = True, per_trigger: int | None = None) -> DataFrame:
    """Raw records of Kafka topics, committed ones only; needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("kafka.isolation.level", "read_committed").option("includeHeaders", "true")
    if stream and per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp", "headers")


def mock_trades(spark: SparkSession, rows: int, symbols: list[str], start_ms: int = 0, step_ms: int = 100) -> DataFrame:
    """Deterministic raw Binance trades for tests and load."""
    names = F.array(*map(F.lit, symbols))
    base = spark.range(rows)
    price = 100 + F.pmod(F.xxhash64("id"), F.lit(20000)) / 100
    value = F.to_json(F.struct(F.lit("aggTrade").alias("e"), names[F.pmod("id", F.lit(len(symbols))).cast("int")].alias("s"), F.col("id").alias("a"), F.format_string("%.2f", price).alias("p"), F.format_string("%.3f", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("q"), (F.lit(start_ms) + F.col("id") * step_ms).alias("T")))
    # "e" and "E" can't both be fields of one struct: the time goes in by text
    value = F.concat(F.expr("'{\"E\":'"), (F.lit(start_ms) + F.col("id") * step_ms).cast("string"), F.lit(","), F.substring(value, 2, 1 << 30))
    return base.select(names[F.pmod("id", F.lit(len(symbols))).cast("int")].alias("key"), value.alias("value"), F.lit("binance.trades.raw").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.timestamp_millis(F.lit(start_ms) + F.col("id") * step_ms).alias("timestamp"), F.array().cast("array<struct<key string, value binary>>").alias("headers"), F.lit("binance").alias("exchange"), F.lit("aggTrade").alias("channel"))
