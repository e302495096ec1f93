"""Queries over raw payloads made from the generated tables, splicing and resync, and stored rows; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import book, metrics, ordering, series
from tidemark.plans.catalog import CANDLES, DAILY, GOOD, OHLC, QUERIES, SQL, TICKED, TICKS, WINS, candle_rows, query, rounded  # noqa: F401
from tidemark.plans.windows import DAY, WINDOWS, chosen
from tidemark.sources.tables import event_ticks, lineitem_book, table

def stamp():
    """The events' time as RFC 3339 text."""
    return F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def raw(rows, exchange: str, channel: str, value, time=None):
    """Records of one feed; ``time`` is the record's own."""
    time = F.timestamp_millis(F.lit(0)) if time is None else time
    return rows.select(F.lit(exchange).alias("exchange"), F.lit(channel).alias("channel"), value.alias("value"), time.alias("timestamp"))


def cents(x):
    return F.round(x + 1e-9, 2)


@query("""WITH e AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS event_time_millis, round(value, 2) AS p, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT symbol, event_time_millis, side, CAST(level_index AS INTEGER) AS level_index, price, volume FROM (SELECT symbol, event_time_millis, 'B' AS side, 0 AS level_index, p AS price, k AS volume FROM e
UNION ALL SELECT symbol, event_time_millis, 'B', 1, 1.25, 0.0 FROM e UNION ALL SELECT symbol, event_time_millis, 'A', 0, p, 2.5 FROM e)""")
def parse_binance_depth(spark, sf_dir):
    """Every event as a depth update of two bids, one of them a deletion, and an ask."""
    value = F.format_string('{"e":"depthUpdate","E":%d,"s":"%s","U":%d,"u":%d,"b":[["%.2f","%s"],["1.25","0"]],"a":[["%.2f","2.5"]]}', "event_ts_millis", "symbol", "seq_id", F.col("seq_id") + 2, "price", F.col("volume").cast("string"), "price")
    levels = book.deltas(parse.parsed(raw(event_ticks(spark, sf_dir), "Binance", "depth", value), parse.BOOK_PARSERS))
    return levels.select("symbol", "event_time_millis", "side", "level_index", cents(F.col("price")).alias("price"), "volume")


@query("SELECT event_type AS symbol, epoch_us(ts) // 1000 AS event_ts_millis, round(value, 2) AS price, 30.5 AS volume, 1.5 AS open, round(value, 2) AS close, 0.0 AS low, 9.75 AS high, event_id AS seq_id FROM events")
def parse_coinbase_ticker(spark, sf_dir):
    """Every event as a ticker whose low doesn't parse; times with microseconds become milliseconds."""
    value = F.format_string('{"type":"ticker","product_id":"%s","price":"%.2f","open_24h":"1.5","volume_24h":"30.5","low_24h":"none","high_24h":"9.75","time":"%s","sequence":%d}', "event_type", "value", stamp(), "event_id")
    out = parse.parsed(raw(table(spark, sf_dir, "events"), "coinbase", "ticker", value), parse.TICK_PARSERS)
    return out.select("symbol", "event_ts_millis", cents(F.col("price")).alias("price"), "volume", "open", cents(F.col("close")).alias("close"), "low", "high", "seq_id")


@query("SELECT event_type AS symbol, epoch_us(ts) // 1000 AS event_ts_millis, round(value, 2) AS price, 2.5 AS volume, 0.0 AS low, round(value, 2) AS high, 0::BIGINT AS seq_id FROM events WHERE event_id % 5 <> 0")
def parse_kraken_ticker(spark, sf_dir):
    """Every event as a ticker without a low; every fifth is a heartbeat. The record's own time counts."""
    t = event_ticks(spark, sf_dir)
    value = F.when(F.col("seq_id") % 5 == 0, F.lit('{"channel":"heartbeat"}')).otherwise(F.format_string('{"channel":"ticker","type":"update","data":[{"symbol":"%s","last":%.2f,"volume":2.5,"high":%.2f}]}', "symbol", "price", "price"))
    out = parse.parsed(raw(t, "kraken", "ticker", value, F.timestamp_millis("event_ts_millis")), parse.TICK_PARSERS)
    return out.select("symbol", "event_ts_millis", cents(F.col("price")).alias("price"), "volume", "low", cents(F.col("high")).alias("high"), "seq_id")


@query("""SELECT event_type AS symbol, CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS event_time_millis, CASE WHEN event_id % 4 = 0 THEN 'snapshot' ELSE 'update' END AS event_type, 'A' AS side, round(value, 2) AS price, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events
UNION ALL SELECT event_type, 0, 'snapshot', 'B', 0.5, 1.5 FROM events WHERE event_id % 4 = 0""")
def parse_kraken_book(spark, sf_dir):
    """Every fourth event as a snapshot, whose time is 0, the others as updates of one ask."""
    is_snapshot = F.col("event_id") % 4 == 0
    asks = F.format_string('"asks":[{"price":%.2f,"qty":%s}]', "value", F.get_json_object("props", "$.k"))
    head = F.format_string('{"channel":"book","type":"%s","data":[{"symbol":"%s",', F.when(is_snapshot, "snapshot").otherwise("update"), "event_type")
    bids = F.when(is_snapshot, F.lit('"bids":[{"price":0.5,"qty":1.5}],')).otherwise(F.lit('"bids":[],'))
    value = F.concat(head, bids, asks, F.format_string(',"timestamp":"%s"}]}', stamp()))
    levels = book.deltas(parse.parsed(raw(table(spark, sf_dir, "events"), "kraken", "book", value), parse.BOOK_PARSERS))
    return levels.select("symbol", "event_time_millis", "event_type", "side", cents(F.col("price")).alias("price"), "volume")


@query("""WITH d AS (SELECT 'U' || user_id AS symbol, event_id AS first_id, event_id + 6 AS last_id FROM events), s AS (SELECT symbol, min(first_id) + (max(first_id) - min(first_id)) // 3 AS id FROM d GROUP BY symbol),
k AS (SELECT d.*, id FROM d JOIN s USING (symbol) WHERE last_id > id), h AS (SELECT symbol, arg_min(first_id, last_id) > any_value(id) + 1 AS stale FROM k GROUP BY symbol)
SELECT symbol, first_id, last_id, false AS stale FROM k JOIN h USING (symbol) WHERE NOT stale UNION ALL SELECT symbol, -1, -1, true FROM h WHERE stale""")
def depth_splice(spark, sf_dir):
    """Raw depth updates of every user spliced to raw REST snapshots; users whose snapshot is too old have one row that says so, with ids of -1."""
    e = table(spark, sf_dir, "events").select(F.format_string("U%d", "user_id").alias("symbol"), "event_id")
    value = F.format_string('{"e":"depthUpdate","E":5,"s":"%s","U":%d,"u":%d,"b":[],"a":[["1","2"]]}', "symbol", "event_id", F.col("event_id") + 6)
    deltas = parse.binance_depth_ids(parse.known(raw(e, "binance", "depth", value)))
    low, high = F.min("event_id"), F.max("event_id")
    answers = e.groupBy(F.col("symbol").alias("key")).agg(F.format_string('{"lastUpdateId":%d,"bids":[["3","1"]],"asks":[]}', low + F.floor((high - low) / 3)).alias("value"))
    kept, stale = ordering.spliced(deltas, parse.binance_snapshot(answers, F.lit(0)), ["symbol"])
    old = stale.select("symbol", F.lit(-1).cast("long").alias("first_id"), F.lit(-1).cast("long").alias("last_id"), F.lit(True).alias("stale"))
    return kept.select("symbol", "first_id", "last_id", F.lit(False).alias("stale")).unionByName(old)


@query("""WITH m AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN false WHEN event_id % 11 = 0 THEN true END AS event FROM events), w AS (SELECT user_id, event_id, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), false) AS waits FROM m),
b AS (SELECT *, coalesce(lag(waits) OVER (PARTITION BY user_id ORDER BY event_id), false) AS before FROM w) SELECT user_id, event_id, 'kept' AS kind FROM b WHERE NOT waits UNION ALL SELECT user_id, event_id, 'request' FROM b WHERE waits AND NOT before""")
def resync_after_drop(spark, sf_dir):
    """Every eleventh event carries a drop marker, every seventh is a snapshot: what passes, and which snapshots are asked for."""
    count = F.when(F.col("event_id") % 11 == 0, "2").otherwise("0")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, "snapshot").otherwise("update").alias("event_type"), F.array(F.struct(F.lit("dropped-count").alias("key"), count.cast("binary").alias("value"))).alias("headers"))
    kept, asked = ordering.after_resync(rows, ["user_id"], "event_id")
    return kept.select("user_id", "event_id", F.lit("kept").alias("kind")).unionByName(asked.select("user_id", "event_id", F.lit("request").alias("kind")))


HOURLY = f"WITH {TICKED}, {CANDLES}, h AS (SELECT * FROM candles WHERE window_id = '1h')"


@query(f"{HOURLY} SELECT exchange, symbol, window_id, start_ts_ms, end_ts_ms, CASE WHEN volume < 60 THEN 0.0 ELSE round(open_price, 6) END AS open_price, CASE WHEN volume < 60 THEN 0.0 ELSE round(close_price, 6) END AS close_price, volume, CASE WHEN volume % 2 = 0 THEN 0.0 ELSE vwap END AS vwap FROM h")
def applied_aggregates(spark, sf_dir):
    """Hourly rows as nested aggregates, some without prices and some without averages, made flat."""
    rows = candle_rows(spark, sf_dir, "1h")
    prices, averages = F.struct("open_price", "close_price"), F.struct("vwap")
    nested = rows.select("exchange", "symbol", "window_id", "start_ts_ms", "end_ts_ms", F.when(F.col("volume") >= 60, prices).alias("candle"), F.struct("volume").alias("flow"), F.when(F.col("volume") % 2 != 0, averages).alias("average"))
    return rounded(metrics.applied(nested).select("exchange", "symbol", "window_id", "start_ts_ms", "end_ts_ms", "open_price", "close_price", "volume", "vwap"))


@query(f"{HOURLY} SELECT symbol, start_ts_ms, CASE WHEN volume % 3 <> 0 THEN volume END AS volume, CASE WHEN volume % 2 = 0 THEN NULL ELSE volume / 2 END AS half, 'tick' AS message_type FROM h")
def live_message(spark, sf_dir):
    """Hourly rows as live messages and read again: metrics of zero aren't in the text."""
    rows = candle_rows(spark, sf_dir, "1h").select("symbol", "start_ts_ms", F.when(F.col("volume") % 3 != 0, F.col("volume")).otherwise(0.0).alias("volume"), F.when(F.col("volume") % 2 == 0, 0.0).otherwise(F.col("volume") / 2).alias("half"))
    sent = rows.select(parse.to_message(rows, "tick", *rows.columns).alias("value"))
    return sent.select(F.from_json("value", "symbol string, start_ts_ms long, volume double, half double, message_type string").alias("j")).select("j.*")


@query(f"{DAILY}, newest AS (SELECT symbol, p FROM hd WHERE symbol = 'Brand#11' ORDER BY event_time_millis DESC LIMIT 1), rk AS (SELECT side, price, volume, row_number() OVER (PARTITION BY side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS r FROM lv JOIN newest USING (symbol, p)) SELECT side, CAST(r - 1 AS INTEGER) AS level_index, price, volume FROM rk WHERE r <= 5")
def latest_book_levels(spark, sf_dir):
    headers, levels = book.flushes(lineitem_book(spark, sf_dir), 30 * DAY, 15, "sequence")
    return series.latest_book(headers, levels, "store", "Brand#11", 5)[1].select("side", "level_index", "price", "volume")


@query(f"WITH {TICKS}, {WINS}, lists AS (SELECT symbol, list(price ORDER BY ts, seq) AS p FROM ticks GROUP BY symbol) SELECT symbol, window_id, round(list_reduce(p, lambda e, x: (1 - exp(ln(0.5) / (dur // 1000))) * x + exp(ln(0.5) / (dur // 1000)) * e), 6) AS ema FROM lists CROSS JOIN wins")
def ema_all_windows(spark, sf_dir):
    rows = metrics.ema(event_ticks(spark, sf_dir), WINDOWS).select("symbol", "window_id", "period", "ema")
    return rounded(series.latest(rows, ["symbol", "window_id"], "period").select("symbol", "window_id", "ema"))


FLUSHED = f"""WITH {TICKS}, {WINS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS tr FROM ticks),
t AS (SELECT n.*, w.*, ts // cad AS period, ts // buck AS bucket, dur // buck AS nb FROM n CROSS JOIN wins w WHERE window_id = '24h'),
g AS (SELECT symbol, period, price / lag(price) OVER (PARTITION BY symbol, period ORDER BY ts, seq) AS ratio FROM t WHERE isfinite(price) AND price > 0),
r AS (SELECT symbol, period, sum(ln(ratio)) AS log_return, sum(ratio - 1) AS simple_return, stddev_samp(ln(ratio)) AS volatility FROM g GROUP BY ALL),
lists AS (SELECT symbol, list(price ORDER BY i) AS ps, list(coalesce(tr, 0.0) ORDER BY i) AS trs FROM n GROUP BY symbol),
a AS (SELECT exchange, symbol, window_id, dur, cad, nb, period, max(bucket) AS last, max(i) AS upto, {OHLC}, sum(volume) AS volume, coalesce(sum(price * volume) FILTER ({GOOD}) / nullif(sum(volume) FILTER ({GOOD}), 0), 0.0) AS vwap, avg(price) AS twap FROM t GROUP BY ALL),
roll AS (SELECT a.symbol, a.period, sum(s.v) AS rv, sum(s.pv) AS rpv FROM a JOIN (SELECT symbol, period, bucket, sum(volume) AS v, sum(price * volume) AS pv FROM t GROUP BY ALL) s ON s.symbol = a.symbol AND s.period <= a.period AND s.bucket > a.last - a.nb GROUP BY ALL),
f AS (SELECT a.*, rv, rpv, log_return, simple_return, volatility, lag(rv) OVER (PARTITION BY a.symbol ORDER BY a.period) AS before, list_reduce(ps[1:upto], lambda e, x: (1 - exp(ln(0.5) / 86400)) * x + exp(ln(0.5) / 86400) * e) AS ema, list_reduce(trs[1:upto], lambda v, x: x / 14 + v * 13 / 14) AS atr
 FROM a JOIN roll USING (symbol, period) JOIN lists USING (symbol) LEFT JOIN r USING (symbol, period))"""


@query(f"""{FLUSHED} SELECT exchange, symbol, window_id, (period + 1) * cad - dur AS start_ts_ms, (period + 1) * cad AS end_ts_ms, round(open_price, 6) AS open_price, round(close_price, 6) AS close_price, round(low_price, 6) AS low_price, round(high_price, 6) AS high_price, round(vwap, 6) AS vwap, round(CASE WHEN rv > 0 THEN rpv / rv ELSE 0.0 END, 6) AS rolling_vwap, round(twap, 6) AS twap, 0.0 AS microprice,
round(volume, 6) AS volume, round(rv, 6) AS rolling_volume, round(CASE WHEN before > 0 THEN (rv - before) / (cad // 1000) ELSE 0.0 END, 6) AS volume_acceleration, round(coalesce(volatility, 0.0), 6) AS volatility, round(atr, 6) AS atr, round(ema, 6) AS ema, round(twap, 6) AS sma, round(coalesce(log_return, 0.0), 6) AS log_return, round(coalesce(simple_return, 0.0), 6) AS simple_return FROM f""")
def flush_all_columns_24h(spark, sf_dir):
    """All columns of stored rows at the flushes of the 24-hour window that have ticks."""
    return rounded(metrics.flush_rows(event_ticks(spark, sf_dir), chosen("24h"), is_dense=False).drop("start_ts", "end_ts"))
