import datetime
import json

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import ordering
from tidemark.sources.tables import mock_trades

WHEN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def raw(spark, exchange, channel, *values):
    return spark.createDataFrame([(exchange, channel, v if isinstance(v, str) else json.dumps(v), WHEN) for v in values], "exchange string, channel string, value string, timestamp timestamp")


def ticks(spark, exchange, channel, *values):
    return parse.parsed(raw(spark, exchange, channel, *values), parse.TICK_PARSERS).collect()


def books(spark, exchange, channel, *values):
    return parse.parsed(raw(spark, exchange, channel, *values), parse.BOOK_PARSERS).collect()


def test_binance_trade(spark):
    out = ticks(spark, "Binance", "aggTrade", {"e": "aggTrade", "E": 17, "s": "BTCUSDT", "a": 5, "p": "65000.5", "q": "0.5", "T": 1, "m": True}, {"E": 18, "s": "BTCUSDT", "a": 6, "p": "abc", "q": "1"}, "garbage", {"E": 1})
    assert [(r["symbol"], r["event_ts_millis"], r["price"], r["high"], r["volume"], r["seq_id"]) for r in out] == [("BTCUSDT", 17, 65000.5, 65000.5, 0.5, 5), ("BTCUSDT", 18, 0.0, 0.0, 1.0, 6)]


def test_binance_depth(spark):
    (r,) = books(spark, "binance", "depth", {"e": "depthUpdate", "E": 9, "s": "B", "U": 1, "u": 2, "b": [["1.5", "2"], ["1.4", "x"]], "a": []})
    assert [tuple(x) for x in r["bids"]] == [(1.5, 2.0), (1.4, 0.0)] and r["asks"] == [] and (r["event_time_millis"], r["event_type"]) == (9, "depthUpdate")


def test_depth_follows_its_snapshot(spark):
    """Raw depth updates and REST snapshots, parsed and spliced; one snapshot is too old."""
    rows = [("binance", "depth", json.dumps({"e": "depthUpdate", "E": 40 + i, "s": s, "U": u, "u": v, "b": [["1", "2"]], "a": []}), WHEN) for i, (s, u, v) in enumerate([("P", 10, 14), ("P", 15, 19), ("P", 20, 22), ("P", 23, 23), ("Q", 30, 35), ("Q", 36, 39)])]
    deltas = parse.binance_depth_ids(spark.createDataFrame(rows, "exchange string, channel string, value string, timestamp timestamp"))
    answers = [("P", json.dumps({"lastUpdateId": 17, "bids": [["3", "1"]], "asks": [["4", "1"]]})), ("Q", json.dumps({"lastUpdateId": 20, "bids": [], "asks": []}))]
    snapshots = parse.binance_snapshot(spark.createDataFrame(answers, "key string, value string"), F.lit(7))
    assert [(r["symbol"], r["last_update_id"], r["event_time_millis"], len(r["bids"])) for r in snapshots.orderBy("symbol").collect()] == [("P", 17, 7, 1), ("Q", 20, 7, 0)]
    kept, stale = ordering.spliced(deltas, snapshots, ["symbol"])
    assert sorted((r["symbol"], r["first_id"], r["last_id"]) for r in kept.collect()) == [("P", 15, 19), ("P", 20, 22), ("P", 23, 23)]
    assert [r["symbol"] for r in stale.collect()] == ["Q"]


def test_coinbase(spark):
    (r,) = ticks(spark, "coinbase", "ticker", {"type": "ticker", "product_id": "ETH-USD", "price": "2311.75", "open_24h": "1", "volume_24h": "30", "low_24h": "2", "high_24h": "3", "time": "2023-03-05T11:07:41.250500Z", "sequence": 7})
    assert (r["price"], r["open"], r["low"], r["high"], r["close"], r["volume"], r["event_ts_millis"], r["seq_id"]) == (2311.75, 1.0, 2.0, 3.0, 2311.75, 30.0, 1678014461250, 7)
    snap, update = books(spark, "coinbase", "level2", {"type": "snapshot", "product_id": "E", "bids": [["1", "2"]], "asks": [["3", "4"]]}, {"type": "l2update", "product_id": "E", "time": "2023-03-05T11:07:41Z", "changes": [["buy", "1", "0"], ["sell", "2", "5"]]})
    assert (snap["event_type"], snap["event_time_millis"]) == ("snapshot", 0) and tuple(snap["bids"][0]) == (1.0, 2.0)
    assert tuple(update["bids"][0]) == (1.0, 0.0) and tuple(update["asks"][0]) == (2.0, 5.0) and update["event_time_millis"] == 1678014461000


def test_kraken(spark):
    (r,) = ticks(spark, "kraken", "ticker", {"channel": "ticker", "type": "update", "data": [{"symbol": "X/USD", "last": 5.0, "volume": 2.0, "low": 1.0, "high": 9.0}]}, {"channel": "heartbeat"}, {"method": "subscribe", "result": {"symbol": "X/USD"}})
    assert (r["symbol"], r["price"], r["open"], r["low"], r["high"], r["event_ts_millis"]) == ("X/USD", 5.0, 5.0, 1.0, 9.0, 1704067200000)
    rows = books(spark, "kraken", "book", {"channel": "book", "type": "snapshot", "data": [{"symbol": "X", "bids": [{"price": 1.0, "qty": 2.0}], "asks": []}]}, {"channel": "book", "type": "update", "data": [{"symbol": "X", "bids": [], "asks": [{"price": 3.0, "qty": 0.0}], "timestamp": "2024-01-01T00:00:01Z"}]})
    assert [(r["event_type"], r["event_time_millis"], len(r["bids"]), len(r["asks"])) for r in rows] == [("snapshot", 0, 1, 0), ("update", 1704067201000, 0, 1)]


def test_mock_source_parses(spark):
    out = parse.parsed(mock_trades(spark, 20, ["A", "B"]), parse.TICK_PARSERS)
    assert out.count() == 20 and out.filter(F.col("price") < 100).count() == 0 and out.agg(F.max("event_ts_millis")).first()[0] == 1900


def test_small_functions(spark):
    df = spark.createDataFrame([("level2_batch", 1.0), ("ticker", 2.0)], "c string, x double")
    assert [r[0] for r in df.select(parse.channel_name(F.col("c"))).collect()] == ["level2", "ticker"]
    import hashlib

    assert df.select(parse.content_hash(F.col("x"), F.lit(0.5))).first()[0] == hashlib.sha256(b"1.00000000|0.50000000").hexdigest()
    push = spark.createDataFrame([("e", 0.0, 5, 0.0, 0)], "exchange string, vwap double, end_ts_ms long, ema double, ticks int")
    message = push.select(parse.to_message(push, "tick", *push.columns)).first()[0]
    assert json.loads(message) == {"message_type": "tick", "exchange": "e", "end_ts_ms": 5}


def test_bad_times_are_zero(spark):
    df = spark.createDataFrame([("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.rfc3339_ms(F.col("t"))).collect()] == [0, 0]
