"""Every operator as a query over the generated tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import book, metrics, ordering, series
from tidemark.plans.windows import DAY, WINDOWS, chosen, frame, lookback_ms, period
from tidemark.schemas import METRICS
from tidemark.sources.tables import event_ticks, lineitem_book, lineitem_ticks, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TICKS = "ticks AS (SELECT 'events' AS exchange, 'stream' AS channel, event_type AS symbol, epoch_us(ts) // 1000 AS ts, value AS price, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq FROM events)"
WINS = "wins(window_id, dur, cad, buck) AS (VALUES " + ", ".join(f"('{w.id}', {w.duration_ms}::BIGINT, {w.cadence_ms}::BIGINT, {w.bucket_ms}::BIGINT)" for w in WINDOWS) + ")"
TICKED = f"{TICKS}, {WINS}, t AS (SELECT *, ts // cad AS period FROM ticks CROSS JOIN wins)"
LABEL = "(period + 1) * cad - dur AS start_ts_ms, (period + 1) * cad AS end_ts_ms"
BOOK = """changes AS (SELECT 'store' AS exchange, p_brand AS symbol, epoch_us(l_shipdate) // 1000 AS ts, CASE l_returnflag WHEN 'A' THEN 'B' ELSE 'A' END AS side,
 round(l_extendedprice / l_quantity, 2) AS price, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS volume,
 {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity} AS seq
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R')),
levels AS (SELECT * FROM (SELECT exchange, symbol, side, price, arg_max(volume, {'t': ts, 's': seq}) AS volume, max(ts) AS ts FROM changes GROUP BY ALL) WHERE volume > 0)"""


def nudged(sql: str) -> str:
    """Every round(x, n) as round(x + 1e-9, n): halves go up whatever an engine's way to round them."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += (sql[j] in "([{") - (sql[j] in ")]}")
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        out += sql[at:i] + f"round({nudged(sql[i + 6 : comma])} + 1e-9{sql[comma:j]}"
        at = j
    return out + sql[at:]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = nudged(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals, halves up: sums associate differently in either engine."""
    return df.select(*(F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def by_window(name: str, sql_value: str, where: str = "") -> None:
    """A period metric over all windows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(metrics.period_metrics(event_ticks(spark, sf_dir), WINDOWS, [name]).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", name))

    QUERIES[name] = run
    SQL[name] = nudged(f"WITH {TICKED} SELECT symbol, window_id, {LABEL}, round({sql_value}, 6) AS {name} FROM t GROUP BY symbol, window_id, dur, cad, period")


GOOD = "isfinite(price) AND isfinite(volume) AND volume > 0"
by_window("vwap", f"coalesce(sum(price * volume) FILTER ({GOOD}) / nullif(sum(volume) FILTER ({GOOD}), 0), 0.0)")
by_window("volume", "sum(volume)")


@query(f"WITH {TICKED} SELECT symbol, window_id, {LABEL}, round(avg(price), 6) AS twap, round(avg(price), 6) AS sma FROM t GROUP BY symbol, window_id, dur, cad, period")
def twap_sma(spark, sf_dir):
    return rounded(metrics.period_metrics(event_ticks(spark, sf_dir), WINDOWS, ["twap", "sma"]).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "twap", "sma"))


LAGGED = f"{TICKED}, good AS (SELECT *, lag(price) OVER (PARTITION BY symbol, window_id, period ORDER BY ts, seq) AS prev FROM t WHERE isfinite(price) AND price > 0), every AS (SELECT DISTINCT symbol, window_id, dur, cad, period FROM t)"


@query(f"WITH {LAGGED} SELECT e.symbol, e.window_id, (e.period + 1) * e.cad - e.dur AS start_ts_ms, (e.period + 1) * e.cad AS end_ts_ms, round(coalesce(sum(ln(price / prev)), 0.0), 6) AS log_return, round(coalesce(sum((price - prev) / prev), 0.0), 6) AS simple_return FROM every e LEFT JOIN good g ON e.symbol = g.symbol AND e.window_id = g.window_id AND e.period = g.period GROUP BY e.symbol, e.window_id, e.dur, e.cad, e.period")
def returns(spark, sf_dir):
    return rounded(metrics.period_metrics(event_ticks(spark, sf_dir), WINDOWS, ["log_return", "simple_return"]).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "log_return", "simple_return"))


@query(f"WITH {LAGGED} SELECT e.symbol, e.window_id, (e.period + 1) * e.cad - e.dur AS start_ts_ms, (e.period + 1) * e.cad AS end_ts_ms, round(coalesce(stddev_samp(ln(price / prev)), 0.0), 6) AS volatility FROM every e LEFT JOIN good g ON e.symbol = g.symbol AND e.window_id = g.window_id AND e.period = g.period GROUP BY e.symbol, e.window_id, e.dur, e.cad, e.period")
def volatility(spark, sf_dir):
    return rounded(metrics.period_metrics(event_ticks(spark, sf_dir), WINDOWS, ["volatility"]).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "volatility"))


OHLC = "arg_min(price, {'t': ts, 's': seq}) AS open_price, arg_max(price, {'t': ts, 's': seq}) AS close_price, min(price) AS low_price, max(price) AS high_price"
CANDLES = f"candles AS (SELECT exchange, symbol, window_id, {LABEL}, {OHLC}, round(sum(volume), 6) AS volume, round(coalesce(sum(price * volume) FILTER ({GOOD}) / nullif(sum(volume) FILTER ({GOOD}), 0), 0.0), 6) AS vwap, round(avg(price), 6) AS twap FROM t GROUP BY exchange, symbol, window_id, dur, cad, period)"


def candle_rows(spark, sf_dir, *ids):
    names = ["open_price", "close_price", "low_price", "high_price", "volume", "vwap", "twap"]
    return metrics.period_metrics(event_ticks(spark, sf_dir), chosen(*ids), names).select("exchange", "symbol", "window_id", "start_ts_ms", "end_ts_ms", *names)


@query(f"WITH {TICKED}, {CANDLES} SELECT exchange, symbol, window_id, start_ts_ms, end_ts_ms, round(open_price, 6) AS open_price, round(close_price, 6) AS close_price, round(low_price, 6) AS low_price, round(high_price, 6) AS high_price, volume, vwap FROM candles WHERE window_id = '1h'")
def ohlc_candles(spark, sf_dir):
    return rounded(candle_rows(spark, sf_dir, "1h").drop("twap"))


@query(f"WITH {TICKED} SELECT symbol, window_id, {LABEL}, count(*) AS ticks FROM t GROUP BY symbol, window_id, dur, cad, period")
def all_windows_counts(spark, sf_dir):
    return metrics.period_metrics(event_ticks(spark, sf_dir), WINDOWS, ["ticks"]).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "ticks")


ROLLING_IDS = ("5m", "1h", "6h", "24h")
IDS = ", ".join(f"'{i}'" for i in ROLLING_IDS)
ROLLED = f"""{TICKS}, {WINS}, w AS (SELECT *, ts // cad AS period, ts // buck AS bucket, dur // buck AS n FROM ticks CROSS JOIN wins WHERE window_id IN ({IDS})),
sums AS (SELECT symbol, window_id, dur, cad, n, bucket, period, sum(volume) AS v, sum(price * volume) AS pv FROM w GROUP BY ALL),
ends AS (SELECT symbol, window_id, period, max(bucket) AS bucket FROM w GROUP BY ALL),
rolled AS (SELECT s.symbol, s.window_id, s.dur, s.cad, e.period, sum(s.v) AS rv, sum(s.pv) AS rpv FROM ends e JOIN sums s ON s.symbol = e.symbol AND s.window_id = e.window_id AND s.period <= e.period AND s.bucket > e.bucket - s.n AND s.bucket <= e.bucket GROUP BY ALL)"""


@query(f"WITH {ROLLED} SELECT symbol, window_id, {LABEL}, round(rv, 6) AS rolling_volume FROM rolled")
def rolling_volume(spark, sf_dir):
    return rounded(metrics.rolling_at_flush(event_ticks(spark, sf_dir), chosen(*ROLLING_IDS)).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "rolling_volume"))


@query(f"WITH {ROLLED} SELECT symbol, window_id, {LABEL}, round(CASE WHEN rv > 0 THEN rpv / rv ELSE 0.0 END, 6) AS rolling_vwap FROM rolled")
def rolling_vwap(spark, sf_dir):
    return rounded(metrics.rolling_at_flush(event_ticks(spark, sf_dir), chosen(*ROLLING_IDS)).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "rolling_vwap"))


@query(f"WITH {ROLLED}, l AS (SELECT *, lag(rv) OVER (PARTITION BY symbol, window_id ORDER BY period) AS before FROM rolled) SELECT symbol, window_id, {LABEL}, round(CASE WHEN before > 0 THEN (rv - before) / (cad // 1000) ELSE 0.0 END, 6) AS volume_acceleration FROM l")
def volume_acceleration(spark, sf_dir):
    return rounded(metrics.acceleration(metrics.rolling_at_flush(event_ticks(spark, sf_dir), chosen(*ROLLING_IDS))).select("symbol", "window_id", "start_ts_ms", "end_ts_ms", "volume_acceleration"))


EMA_WINDOWS = [w for w in WINDOWS if w.id in ("10m", "1h", "24h")]


@query(f"WITH {TICKS}, {WINS}, lists AS (SELECT symbol, list(price ORDER BY ts, seq) AS p FROM ticks GROUP BY symbol) SELECT symbol, window_id, round(list_reduce(p, lambda e, x: (1 - exp(ln(0.5) / (dur // 1000))) * x + exp(ln(0.5) / (dur // 1000)) * e), 6) AS ema FROM lists CROSS JOIN wins WHERE window_id IN ('10m', '1h', '24h')")
def ema(spark, sf_dir):
    return rounded(series.latest(metrics.ema(event_ticks(spark, sf_dir), EMA_WINDOWS).select("symbol", "window_id", "period", "ema"), ["symbol", "window_id"], "period").select("symbol", "window_id", "ema"))


@query("""WITH t AS (SELECT p_brand AS symbol, epoch_us(l_shipdate) // 1000 AS ts, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice} AS seq, l_extendedprice / l_quantity AS c, l_extendedprice / l_quantity * (1 + l_tax) AS h, l_extendedprice / l_quantity * (1 - l_discount) AS l FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pc FROM t),
r AS (SELECT symbol, list(CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END ORDER BY ts, seq) AS tr FROM p GROUP BY symbol)
SELECT symbol, round(list_reduce(tr, lambda v, x: x / 14 + v * 13 / 14), 6) AS atr FROM r""")
def atr(spark, sf_dir):
    rows = metrics.atr(lineitem_ticks(spark, sf_dir), chosen("24h"))
    return rounded(series.latest(rows.select("symbol", "period", "atr"), ["symbol"], "period").select("symbol", "atr"))


@query(f"WITH {TICKS}, {WINS}, ends AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM ticks GROUP BY symbol), spine AS (SELECT symbol, dur, cad, unnest(generate_series(lo // cad, hi // cad)) AS period FROM ends CROSS JOIN wins WHERE window_id = '24h'), agg AS (SELECT symbol, ts // 3600000 AS period, {OHLC}, sum(volume) AS volume, avg(price) AS twap FROM ticks GROUP BY ALL), roll AS (SELECT s.symbol, s.period, sum(k.volume) AS rolling_volume FROM spine s JOIN (SELECT symbol, ts, ts // 900000 AS bucket, volume FROM ticks) k ON k.symbol = s.symbol JOIN (SELECT s.symbol, s.period, max(k.ts // 900000) AS last FROM spine s JOIN ticks k ON k.symbol = s.symbol AND k.ts < (s.period + 1) * s.cad GROUP BY ALL) m ON m.symbol = s.symbol AND m.period = s.period WHERE k.ts < (s.period + 1) * s.cad AND k.bucket > m.last - 96 GROUP BY ALL) SELECT s.symbol, {LABEL.replace('period', 's.period').replace('cad', 's.cad').replace('dur', 's.dur')}, round(coalesce(open_price, 0.0), 6) AS open_price, round(coalesce(close_price, 0.0), 6) AS close_price, round(coalesce(low_price, 0.0), 6) AS low_price, round(coalesce(high_price, 0.0), 6) AS high_price, round(coalesce(volume, 0.0), 6) AS volume, round(coalesce(twap, 0.0), 6) AS twap, round(rolling_volume, 6) AS rolling_volume FROM spine s LEFT JOIN agg a ON a.symbol = s.symbol AND a.period = s.period JOIN roll r ON r.symbol = s.symbol AND r.period = s.period")
def flush_dense_24h(spark, sf_dir):
    rows = metrics.flush_rows(event_ticks(spark, sf_dir), chosen("24h"))
    return rounded(rows.select("symbol", "start_ts_ms", "end_ts_ms", "open_price", "close_price", "low_price", "high_price", "volume", "twap", "rolling_volume"))


@query()
def flush_rows_all_metrics(spark, sf_dir):
    """All 24 columns for the windows of two hours and more."""
    return rounded(metrics.flush_rows(event_ticks(spark, sf_dir), chosen("2h", "12h", "24h"), is_dense=False).drop("start_ts", "end_ts"))


LO, HI = 1704067200000, 1704067200000 + 20 * DAY


@query(f"WITH {TICKED}, {CANDLES} SELECT start_ts_ms, end_ts_ms, round(open_price, 6) AS open_price, round(close_price, 6) AS close_price, round(low_price, 6) AS low_price, round(high_price, 6) AS high_price, volume FROM candles WHERE window_id = '1h' AND symbol = 'click' AND exchange = 'events' AND start_ts_ms >= {LO} AND end_ts_ms <= {HI} ORDER BY start_ts_ms")
def candles_range(spark, sf_dir):
    return rounded(series.candles(candle_rows(spark, sf_dir, "1h"), "events", "click", "1h", LO, HI))


@query(f"WITH {TICKED}, {CANDLES}, f AS (SELECT window_id, start_ts_ms, end_ts_ms, vwap, volume, twap FROM candles WHERE window_id = '1h' AND symbol = 'click' AND start_ts_ms >= {LO} AND end_ts_ms <= {HI}) SELECT window_id, name, value, start_ts_ms, end_ts_ms FROM (UNPIVOT f ON vwap, volume, twap INTO NAME name VALUE value)")
def metrics_unpivot(spark, sf_dir):
    return rounded(series.metrics(candle_rows(spark, sf_dir, "1h"), "events", "click", ["1h"], ["vwap", "volume", "twap"], LO, HI))


@query(f"WITH {TICKED}, {CANDLES} SELECT window_id, 'vwap' AS name, vwap AS value, start_ts_ms, end_ts_ms FROM candles WHERE window_id IN ('2h', '6h', '24h') AND symbol = 'view' AND start_ts_ms >= {LO} AND end_ts_ms <= {HI}")
def metrics_membership(spark, sf_dir):
    return rounded(series.metrics(candle_rows(spark, sf_dir), "events", "view", ["2h", "6h", "24h"], ["vwap"], LO, HI))


@query(f"WITH {BOOK}, tops AS (SELECT symbol, side, price, volume, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS r FROM levels) SELECT symbol, side, price, volume, CAST(r - 1 AS INTEGER) AS level_index FROM tops WHERE r <= 15")
def book_topn(spark, sf_dir):
    return book.top_levels(book.latest_levels(lineitem_book(spark, sf_dir), sequence="sequence")).select("symbol", "side", "price", "volume", "level_index")


BEST = f"""WITH {BOOK}, b AS (SELECT symbol, max(price) FILTER (side = 'B') AS bp, arg_max(volume, price) FILTER (side = 'B') AS bv, min(price) FILTER (side = 'A') AS ap, arg_min(volume, price) FILTER (side = 'A') AS av, count(*) FILTER (side = 'B') AS bd, count(*) FILTER (side = 'A') AS ad FROM levels GROUP BY symbol)"""


@query(f"{BEST} SELECT symbol, bp AS best_bid_price, bv AS best_bid_volume, ap AS best_ask_price, av AS best_ask_volume, round(ap - bp, 6) AS spread, bd AS bid_depth, ad AS ask_depth, ap < bp AS crossed, round((bp * av + ap * bv) / (bv + av), 6) AS microprice FROM b WHERE bp IS NOT NULL AND ap IS NOT NULL")
def book_best_spread(spark, sf_dir):
    rows = book.best(book.latest_levels(lineitem_book(spark, sf_dir), sequence="sequence"))
    return rounded(rows.select("symbol", "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume", "spread", "bid_depth", "ask_depth", (F.col("spread") < 0).alias("crossed"), book.microprice().alias("microprice")))


@query(f"WITH {BOOK} SELECT symbol, side, count(*) AS levels, round(sum(volume), 6) AS volume FROM levels GROUP BY symbol, side")
def book_delete_zero(spark, sf_dir):
    return rounded(book.latest_levels(lineitem_book(spark, sf_dir), sequence="sequence").groupBy("symbol", "side").agg(F.count("*").alias("levels"), F.sum("volume").alias("volume")))


DAILY = f"""WITH {BOOK.split('levels AS')[0].rstrip().rstrip(',')}, grid AS (SELECT DISTINCT symbol, ts // 2592000000 AS p FROM changes),
seen AS (SELECT g.symbol, g.p, c.side, c.price, arg_max(c.volume, {{'t': c.ts, 's': c.seq}}) AS volume, max(c.ts) AS ts FROM grid g JOIN changes c ON c.symbol = g.symbol AND c.ts // 2592000000 <= g.p GROUP BY ALL),
lv AS (SELECT * FROM seen WHERE volume > 0),
hd AS (SELECT symbol, p, max(ts) AS event_time_millis, max(price) FILTER (side = 'B') AS bp, min(price) FILTER (side = 'A') AS ap FROM lv GROUP BY ALL HAVING bp IS NOT NULL AND ap IS NOT NULL)"""


@query(f"{DAILY} SELECT symbol, event_time_millis, bp AS best_bid_price, ap AS best_ask_price, round(ap - bp, 6) AS spread FROM hd")
def book_flush_headers(spark, sf_dir):
    headers, _ = book.flushes(lineitem_book(spark, sf_dir), 30 * DAY, 15, "sequence")
    return rounded(headers.select("symbol", "event_time_millis", "best_bid_price", "best_ask_price", "spread"))


@query(f"{DAILY}, rk AS (SELECT lv.symbol, hd.event_time_millis, side, price, volume, row_number() OVER (PARTITION BY lv.symbol, lv.p, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS r FROM lv JOIN hd ON hd.symbol = lv.symbol AND hd.p = lv.p) SELECT symbol, event_time_millis, side, CAST(r - 1 AS INTEGER) AS level_index, price, volume FROM rk WHERE r <= 15")
def book_level_explode(spark, sf_dir):
    _, levels = book.flushes(lineitem_book(spark, sf_dir), 30 * DAY, 15, "sequence")
    return levels.select("symbol", F.unix_millis("event_time").alias("event_time_millis"), "side", "level_index", "price", "volume")


@query(f"{DAILY} SELECT symbol, event_time_millis, bp AS best_bid_price, ap AS best_ask_price FROM hd WHERE symbol = 'Brand#11' ORDER BY event_time_millis DESC LIMIT 1")
def latest_book_header(spark, sf_dir):
    headers, levels = book.flushes(lineitem_book(spark, sf_dir), 30 * DAY, 15, "sequence")
    header, _ = series.latest_book(headers, levels, "store", "Brand#11", 5)
    return header.select("symbol", "event_time_millis", "best_bid_price", "best_ask_price")


@query(f"WITH {BOOK} SELECT symbol, side, price, round(least(100.0, volume / greatest(max(volume) OVER (PARTITION BY symbol, side), 1.0) * 100), 6) AS bar_width FROM levels")
def book_depth_bars(spark, sf_dir):
    return rounded(book.depth_bars(book.latest_levels(lineitem_book(spark, sf_dir), sequence="sequence")).select("symbol", "side", "price", "bar_width"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    rows = series.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1")
def dedupe_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return series.last_wins(rows, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_suppkey", "l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"WITH {TICKS}, d AS (SELECT symbol, seq // 7 AS seq_id, arg_max(price, seq) AS price FROM ticks GROUP BY ALL) SELECT symbol, seq_id, round(price, 6) AS price, row_number() OVER (PARTITION BY symbol ORDER BY seq_id) AS position FROM d")
def sequence_sort(spark, sf_dir):
    """Seven neighbouring numbers share a slot, so the last payload of a number must win."""
    rows = event_ticks(spark, sf_dir).select("symbol", F.floor(F.col("seq_id") / 7).alias("seq_id"), F.col("seq_id").alias("offset"), "price")
    return rounded(ordering.by_sequence(rows, ["symbol"]).select("symbol", "seq_id", "price", F.col("position").cast("long").alias("position")))


@query("SELECT symbol, event_ts_millis, seq_id, row_number() OVER (PARTITION BY symbol ORDER BY event_ts_millis, seq_id) AS position FROM (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS event_ts_millis, event_id AS seq_id FROM events)")
def time_sort(spark, sf_dir):
    rows = event_ticks(spark, sf_dir).select("symbol", F.floor(F.col("event_ts_millis") / 3_600_000).alias("event_ts_millis"), "seq_id")
    return ordering.by_time(rows, ["symbol"], "event_ts_millis", "seq_id").select("symbol", "event_ts_millis", "seq_id", F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def upsert_anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return series.new_rows(orders, orders.filter(F.col("o_orderstatus") == "F"), ["o_orderkey"], ["o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {TICKED}, {CANDLES}, s AS (SELECT symbol, end_ts_ms // 1000 AS time_sec, vwap AS value FROM candles WHERE window_id = '1h'), l AS (SELECT symbol, end_ts_ms // 1000 AS time_sec, twap AS value FROM candles WHERE window_id = '24h') SELECT symbol, time_sec, value FROM l UNION ALL SELECT symbol, time_sec, value FROM s ANTI JOIN l USING (symbol, time_sec)")
def merge_series_live_wins(spark, sf_dir):
    rows = candle_rows(spark, sf_dir, "1h", "24h").withColumn("time_sec", F.floor(F.col("end_ts_ms") / 1000))
    seed = rows.filter(F.col("window_id") == "1h").select("symbol", "time_sec", F.col("vwap").alias("value"))
    live = rows.filter(F.col("window_id") == "24h").select("symbol", "time_sec", F.col("twap").alias("value"))
    return rounded(series.merged(seed, live, ["symbol", "time_sec"]))


@query(f"WITH {TICKS} SELECT symbol, ts AS event_ts_millis, seq AS seq_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS r FROM ticks) WHERE r <= 1500")
def last_1500(spark, sf_dir):
    rows = event_ticks(spark, sf_dir).withColumn("o", F.struct("event_ts_millis", "seq_id"))
    return series.newest(rows, ["symbol"], "o").select("symbol", "event_ts_millis", "seq_id")


@query("SELECT event_id, CASE WHEN value > 100 AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN 'valid' ELSE 'invalid' END AS branch FROM events")
def invalid_split(spark, sf_dir):
    good, bad = series.split_valid(event_ticks(spark, sf_dir), (F.col("price") > 100) & (F.col("volume") > 0))
    return good.select(F.col("seq_id").alias("event_id"), F.lit("valid").alias("branch")).unionByName(bad.select(F.col("seq_id").alias("event_id"), F.lit("invalid").alias("branch")))


@query("WITH e AS (SELECT event_type AS topic, user_id % 8 AS partition, max(event_id) - 3 AS end_offset FROM events GROUP BY ALL), c AS (SELECT event_type AS topic, user_id % 8 AS partition, min(event_id) - 5 AS committed_offset FROM events WHERE user_id % 8 <> 3 GROUP BY ALL) SELECT e.topic, e.partition, CAST(CASE WHEN end_offset < 0 THEN 0 ELSE greatest(end_offset - greatest(coalesce(committed_offset, 0), 0), 0) END AS BIGINT) AS lag FROM e LEFT JOIN c USING (topic, partition)")
def consumer_lag(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition"), "event_id")
    ends = rows.groupBy("topic", "partition").agg((F.max("event_id") - 3).alias("end_offset"))
    committed = rows.filter(F.col("partition") != 3).groupBy("topic", "partition").agg((F.min("event_id") - 5).alias("committed_offset"))
    return series.consumer_lag(ends, committed)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (parse.whole(k) * 2).alias("twice"))


@query("SELECT DISTINCT lower(concat_ws(':', 'EVENTS', 'Stream', event_type)) AS stream_key FROM events")
def key_concat_lower(spark, sf_dir):
    rows = event_ticks(spark, sf_dir).withColumns({"exchange": F.lit("EVENTS"), "channel": F.lit("Stream")})
    return rows.select(ordering.stream_key().alias("stream_key")).distinct()


@query("SELECT event_id, sha256(printf('%.8f|%.8f', value, CAST(event_id AS DOUBLE) / 8)) AS content_id FROM events")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", parse.content_hash(F.col("value"), F.col("event_id").cast("double") / 8).alias("content_id"))


@query("SELECT event_id FROM events WHERE event_id % 5 IN (1, 3)")
def drop_marker_filter(spark, sf_dir):
    """Headers by the id's remainder: none, 3, x, 12, 0."""
    value = F.element_at(F.array(F.lit("9"), F.lit("3"), F.lit("x"), F.lit("12"), F.lit("0")), (F.col("event_id") % 5 + 1).cast("int"))
    key = F.when(F.col("event_id") % 5 == 0, "other").otherwise("dropped-count")
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.struct(key.alias("key"), value.cast("binary").alias("value"))).alias("headers"))
    return rows.filter(ordering.drop_marker()).select("event_id")


@query(f"WITH {TICKED} SELECT DISTINCT window_id, period, {LABEL} FROM t")
def period_label(spark, sf_dir):
    from tidemark.plans.windows import expanded, labelled

    rows = expanded(event_ticks(spark, sf_dir).select("event_ts_millis"), WINDOWS)
    return labelled(rows.select("window_id", "duration_ms", "cadence_ms", period(F.col("event_ts_millis"), F.col("cadence_ms")).alias("period")).distinct()).select("window_id", "period", "start_ts_ms", "end_ts_ms")


@query("SELECT user_id % 16 AS partition, max(event_id) AS max_offset FROM events GROUP BY ALL")
def max_offset_per_partition(spark, sf_dir):
    return series.max_offsets(table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("partition"), F.col("event_id").alias("offset")))


@query("SELECT partition, min(m) AS safe_offset FROM (SELECT event_type, user_id % 16 AS partition, max(event_id) AS m FROM events GROUP BY ALL) GROUP BY partition")
def min_of_max_offsets(spark, sf_dir):
    return series.safe_offsets(table(spark, sf_dir, "events").select(F.col("event_type").alias("worker"), (F.col("user_id") % 16).alias("partition"), F.col("event_id").alias("offset")))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(max(value) FILTER (i = CAST(floor(0.5 * n) AS BIGINT)), 6) AS p50, round(max(value) FILTER (i = CAST(floor(0.95 * n) AS BIGINT)), 6) AS p95, round(max(value) FILTER (i = CAST(floor(0.99 * n) AS BIGINT)), 6) AS p99 FROM r GROUP BY event_type, n")
def latency_percentiles(spark, sf_dir):
    return rounded(metrics.percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "value", [0.5, 0.95, 0.99], ["event_type"]))


@query("WITH b AS (SELECT CASE WHEN i = 18 THEN CAST('inf' AS DOUBLE) ELSE pow(2.0, i) END AS le FROM range(19) r(i)) SELECT le, count(*) AS n FROM events, b WHERE value <= le GROUP BY le")
def histogram_buckets(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events").select("value"), "value")


@query("SELECT CAST(event_type AS VARCHAR) AS symbol, epoch_us(ts) // 1000 AS event_ts_millis, round(value, 4) AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq_id FROM events")
def parse_binance_trade(spark, sf_dir):
    """Events written as raw trades, with e and E in one object, and parsed again."""
    t = event_ticks(spark, sf_dir)
    value = F.format_string('{"e":"aggTrade","E":%d,"s":"%s","a":%d,"p":"%.4f","q":"%s","T":1,"m":true}', "event_ts_millis", "symbol", "seq_id", "price", F.col("volume").cast("string"))
    raw = t.select(F.lit("binance").alias("exchange"), F.lit("aggTrade").alias("channel"), value.alias("value"))
    return parse.parsed(raw, {"binance:aggtrade": parse.binance_trade}).select("symbol", "event_ts_millis", F.round(F.col("price") + 1e-9, 4).alias("price"), "volume", "seq_id")


@query("SELECT symbol, side, price, volume, count(*) AS n FROM (SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'A' THEN 'B' ELSE 'A' END AS side, round(l_extendedprice, 2) AS price, l_quantity AS volume FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY ALL")
def parse_coinbase_changes(spark, sf_dir):
    """Line items as level-2 changes by order; buys are bids, all others asks."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    change = F.format_string('["%s","%.2f","%.4f"]', F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell"), "l_extendedprice", "l_quantity")
    raw = li.select(F.lit("coinbase").alias("exchange"), F.lit("level2").alias("channel"), F.concat(F.format_string('{"type":"l2update","product_id":"S%d","time":"2024-01-01T00:00:00.123456Z","changes":[', "l_suppkey"), change, F.lit("]}")).alias("value"))
    levels = book.deltas(parse.parsed(raw, {"coinbase:level2": parse.coinbase_level2}))
    return levels.groupBy("symbol", "side", F.round(F.col("price") + 1e-9, 2).alias("price"), "volume").agg(F.count("*").alias("n"))


@query("SELECT window_id, dur AS duration_ms, cad AS cadence_ms, buck AS bucket_ms, CAST(CASE window_id WHEN '5m' THEN 60 WHEN '10m' THEN 60 WHEN '30m' THEN 90 WHEN '1h' THEN 120 ELSE 45 END AS BIGINT) * 86400000 AS lookback_ms FROM (VALUES " + WINS.split("VALUES ")[1] + " w(window_id, dur, cad, buck)")
def window_definitions(spark, sf_dir):
    back = F.lit(None)
    for w in WINDOWS:
        back = F.when(F.col("window_id") == w.id, F.lit(lookback_ms(w.id))).otherwise(back)
    return frame(spark).withColumn("lookback_ms", back.cast("long"))


@query(f"WITH {TICKED}, {CANDLES} SELECT symbol, end_ts_ms // 1000 AS time_sec, arg_max(vwap, end_ts_ms) AS value FROM candles WHERE window_id IN ('5s') GROUP BY ALL")
def last_by_second(spark, sf_dir):
    rows = candle_rows(spark, sf_dir, "5s").select("symbol", "end_ts_ms", F.col("vwap").alias("value"))
    return rounded(series.last_by_second(rows, ["symbol"]))


@query(f"WITH {TICKS} SELECT symbol, arg_max(price, {{'t': ts, 's': seq}}) AS price, max(ts) AS event_ts_millis FROM ticks GROUP BY symbol")
def latest_tick(spark, sf_dir):
    rows = event_ticks(spark, sf_dir).withColumn("o", F.struct("event_ts_millis", "seq_id"))
    return series.latest(rows, ["symbol"], "o").select("symbol", "price", "event_ts_millis")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def integrity_orphans(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return series.orphans(table(spark, sf_dir, "lineitem"), headers, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


assert set(METRICS) == {m[0] for m in series.METRIC_META}
