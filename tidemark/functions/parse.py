"""Six raw JSON payloads to two canonical schemas, as column expressions.

JSON paths are case-sensitive, which payloads with e and E need. Numbers that don't parse are 0, as are missing times; rows without a symbol
are dropped by ``known``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark import schemas as S


def text(path: str) -> Column:
    return F.get_json_object("value", path)


def number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def whole(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))


def rfc3339_ms(x: Column) -> Column:
    """Milliseconds of a timestamp with zone; 0 if it doesn't parse."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(x)), F.lit(0).cast("bigint"))


def symbol() -> Column:
    """$.s, else $.symbol, else $.product_id, else $.data[0].symbol."""
    return F.coalesce(text("$.s"), text("$.symbol"), text("$.product_id"), text("$.data[0].symbol"))


def is_control() -> Column:
    """Heartbeats and acknowledgements of subscriptions."""
    return F.coalesce(text("$.channel") == "heartbeat", F.lit(False)) | F.coalesce(text("$.method") == "subscribe", F.lit(False))


def known(records: DataFrame) -> DataFrame:
    """Records that are JSON objects with a symbol and no control frames; adds ``symbol``."""
    return records.withColumn("symbol", symbol()).filter(~is_control() & F.col("symbol").isNotNull() & (F.col("symbol") != ""))


def pairs(x: Column) -> Column:
    """[["price", "volume"], ...] as structs."""
    rows = F.coalesce(F.from_json(x, S.PAIRS), F.array().cast(S.PAIRS))
    return F.transform(rows, lambda p: F.struct(number(F.get(p, F.lit(0))).alias("price"), number(F.get(p, F.lit(1))).alias("volume")))


def _tick(records: DataFrame, exchange: str, channel: str, **c: Column) -> DataFrame:
    cols = {"exchange": F.lit(exchange), "channel": F.lit(channel), **c}
    return records.select(*(cols[n].cast(S.TICK[n]).alias(n) for n in S.TICK.names))


def binance_trade(records: DataFrame) -> DataFrame:
    p = number(text("$.p"))
    return _tick(records, "binance", "aggTrade", symbol=text("$.s"), event_ts_millis=whole(text("$.E")), price=p, volume=number(text("$.q")), open=p, close=p, low=p, high=p, seq_id=whole(text("$.a")))


def binance_depth(records: DataFrame) -> DataFrame:
    return _book(records, "binance", "depth", text("$.s"), pairs(text("$.b")), pairs(text("$.a")), whole(text("$.E")), text("$.e"))


def binance_depth_ids(records: DataFrame) -> DataFrame:
    """Depth updates with the ids of their first and last change, for splicing after a snapshot."""
    ids = records.withColumns({"first_id": whole(text("$.U")), "last_id": whole(text("$.u"))})
    return _book(ids, "binance", "depth", text("$.s"), pairs(text("$.b")), pairs(text("$.a")), whole(text("$.E")), text("$.e"), "first_id", "last_id")


def binance_snapshot(records: DataFrame, now_ms: Column) -> DataFrame:
    """The REST answer: lastUpdateId, bids and asks of the symbol in the record's key."""
    known_id = records.withColumn("last_update_id", whole(text("$.lastUpdateId")))
    return _book(known_id, "binance", "depth", F.col("key"), pairs(text("$.bids")), pairs(text("$.asks")), now_ms, F.lit("snapshot"), "last_update_id")


def coinbase_ticker(records: DataFrame) -> DataFrame:
    """Volume, low and high are those of 24 hours, as the feed sends no others."""
    j = records.withColumn("j", F.from_json("value", S.COINBASE_TICKER.ddl))
    c = lambda n: F.col(f"j.{n}")
    return _tick(j, "coinbase", "ticker", symbol=c("product_id"), event_ts_millis=rfc3339_ms(c("time")), price=number(c("price")), volume=number(c("volume_24h")), open=number(c("open_24h")), close=number(c("price")), low=number(c("low_24h")), high=number(c("high_24h")), seq_id=F.coalesce(c("sequence"), F.lit(0)))


def coinbase_level2(records: DataFrame) -> DataFrame:
    """Snapshots have bids and asks and no time; updates have changes, split by side."""
    j = records.withColumn("j", F.from_json("value", S.COINBASE_LEVEL2.ddl))
    none = F.array().cast(S.PAIRS)
    level = lambda at: lambda p: F.struct(number(F.get(p, F.lit(at))).alias("price"), number(F.get(p, F.lit(at + 1))).alias("volume"))
    changes = F.coalesce(F.col("j.changes"), none)
    update = F.col("j.type") == "l2update"
    bids = F.when(update, F.transform(F.filter(changes, lambda c: F.get(c, F.lit(0)) == "buy"), level(1))).otherwise(F.transform(F.coalesce(F.col("j.bids"), none), level(0)))
    asks = F.when(update, F.transform(F.filter(changes, lambda c: F.coalesce(F.get(c, F.lit(0)) != "buy", F.lit(True))), level(1))).otherwise(F.transform(F.coalesce(F.col("j.asks"), none), level(0)))
    return _book(j, "coinbase", "level2", F.col("j.product_id"), bids, asks, rfc3339_ms(F.col("j.time")), F.when(update, F.lit("l2update")).otherwise(F.lit("snapshot")))


def kraken_ticker(records: DataFrame) -> DataFrame:
    """The feed has no time: the record's own counts."""
    j = records.withColumn("j", F.get(F.from_json("value", S.KRAKEN_TICKER.ddl)["data"], F.lit(0)))
    c = lambda n: F.coalesce(F.col(f"j.{n}"), F.lit(0.0))
    return _tick(j, "kraken", "ticker", symbol=F.col("j.symbol"), event_ts_millis=F.unix_millis("timestamp"), price=c("last"), volume=c("volume"), open=c("last"), close=c("last"), low=c("low"), high=c("high"), seq_id=F.lit(0))


def kraken_book(records: DataFrame) -> DataFrame:
    """Only updates have a time; a snapshot's is 0."""
    j = records.withColumn("k", F.from_json("value", S.KRAKEN_BOOK.ddl)).withColumn("j", F.get("k.data", F.lit(0)))
    level = lambda n: F.transform(F.coalesce(F.col(f"j.{n}"), F.array().cast("array<struct<price double, qty double>>")), lambda p: F.struct(F.coalesce(p["price"], F.lit(0.0)).alias("price"), F.coalesce(p["qty"], F.lit(0.0)).alias("volume")))
    update = F.col("k.type") == "update"
    return _book(j, "kraken", "book", F.col("j.symbol"), level("bids"), level("asks"), F.when(update, rfc3339_ms(F.col("j.timestamp"))).otherwise(0), F.col("k.type"))


def _book(records: DataFrame, exchange: str, channel: str, sym: Column, bids: Column, asks: Column, ts: Column, kind: Column, *more: str) -> DataFrame:
    cols = {"exchange": F.lit(exchange), "channel": F.lit(channel), "symbol": sym, "bids": bids, "asks": asks, "event_time_millis": ts, "event_type": kind}
    return records.select(*(cols[n].cast(S.BOOK[n]).alias(n) for n in S.BOOK.names), *more)


#: Parsers by lower-case exchange:channel.
TICK_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"binance:aggtrade": binance_trade, "coinbase:ticker": coinbase_ticker, "kraken:ticker": kraken_ticker}
BOOK_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"binance:depth": binance_depth, "coinbase:level2": coinbase_level2, "kraken:book": kraken_book}


def parsed(records: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Canonical rows of all known records, dispatched by their columns exchange and channel; records of other pairs are dropped."""
    out = None
    route = F.lower(F.concat_ws(":", "exchange", "channel"))
    for name, parse in parsers.items():
        rows = parse(known(records.filter(route == name)))
        out = rows if out is None else out.unionByName(rows)
    return out


def channel_name(channel: Column) -> Column:
    """level2_batch is level2."""
    return F.when(channel == "level2_batch", F.lit("level2")).otherwise(channel)


def content_hash(*values: Column) -> Column:
    """SHA-256 of the values with eight decimals, joined by |."""
    return F.sha2(F.concat_ws("|", *(F.format_string("%.8f", v) for v in values)), 256)


def to_message(rows: DataFrame, kind: str, *columns: str) -> Column:
    """The JSON of a live push: message_type and the columns, zeros of numbers left out."""
    numbers = {f.name for f in rows.schema if isinstance(f.dataType, NumericType)}
    return F.to_json(F.struct(F.lit(kind).alias("message_type"), *(F.when(F.col(c) != 0, F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns)))
