import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, ordering, series
from tidemark.schemas import BOOK


def books(spark, *rows):
    return spark.createDataFrame([("x", "c", s, b, a, ts, kind) for s, b, a, ts, kind in rows], BOOK.ddl)


def state(spark, *rows, **options):
    return book.latest_levels(book.deltas(books(spark, *rows)), **options)


def test_deletes_move_the_best(spark):
    out = book.best(state(spark, ("S", [(100.0, 1.0), (101.0, 2.0), (99.0, 3.0)], [(200.0, 1.0), (199.0, 2.0), (205.0, 3.0)], 1, "u"), ("S", [(101.0, 0.0)], [(199.0, 0.0)], 2, "u"))).first()
    assert (out["best_bid_price"], out["best_ask_price"], out["spread"], out["bid_depth"]) == (100.0, 200.0, 100.0, 2)


def test_top_levels_and_sides(spark):
    levels = state(spark, ("S", [(100.0, 1.0), (101.0, 1.0), (102.0, 1.0)], [(200.0, 1.0), (199.0, 1.0), (201.0, 1.0)], 1, "u"))
    top = {(r["side"], r["level_index"]): r["price"] for r in book.top_levels(levels, 2).collect()}
    assert top == {("B", 0): 102.0, ("B", 1): 101.0, ("A", 0): 199.0, ("A", 1): 200.0}
    assert {r["side"]: len(r["levels"]) for r in book.grouped_sides(book.top_levels(levels, 2)).collect()} == {"A": 2, "B": 2}


def test_empty_side_gives_no_best(spark):
    assert book.best(state(spark, ("S", [(1.0, 1.0)], None, 1, "u"))).count() == 0


def test_snapshots_merge_or_replace(spark):
    rows = [("S", [(1.0, 1.0)], [(9.0, 1.0)], 1, "u"), ("S", [(2.0, 1.0)], [(8.0, 1.0)], 2, "snapshot")]
    assert state(spark, *rows).count() == 4
    assert state(spark, *rows, snapshot_replaces=True).count() == 2


def test_flushes_see_what_was_before(spark):
    rows = [("S", [(1.0, 1.0)], [(9.0, 1.0)], 5_000, "u"), ("S", [(2.0, 5.0)], [], 15_000, "u"), ("S", [(2.0, 0.0)], [], 25_000, "u")]
    header, levels = book.flushes(book.deltas(books(spark, *rows)))
    # the last flush's newest standing level is from the first message
    assert [(r["best_bid_price"], r["spread"]) for r in header.orderBy(F.desc("best_bid_price")).collect()] == [(2.0, 7.0), (1.0, 8.0), (1.0, 8.0)]
    assert levels.count() == 2 + 3 + 2


def test_microprice_and_bars(spark):
    df = spark.createDataFrame([(10.0, 1.0, 12.0, 3.0)], "best_bid_price double, best_bid_volume double, best_ask_price double, best_ask_volume double")
    assert df.select(book.microprice()).first()[0] == pytest.approx(10.5)


def test_sequence_orderer():
    o = ordering.SequenceOrderer()
    assert o.offer(1, "a") == [(1, "a")]
    assert o.offer(4, "d") == [(4, "d")] and o.offer(3, "c") == [] and o.offer(2, "b") == [] and o.offer(2, "B") == []
    assert o.flush() == [(2, "B"), (3, "c")]
    assert o.offer(3, "again") == [(3, "again")]


def test_time_orderer():
    o = ordering.TimeOrderer()
    for t, p in ((5, "a"), (3, "b"), (5, "c"), (1, "d")):
        o.offer(t, p)
    assert o.flush() == [(1, "d"), (3, "b"), (5, "a"), (5, "c")]


def test_splice(spark):
    d = spark.createDataFrame([("S", 1, 5), ("S", 6, 9), ("S", 10, 12), ("T", 8, 9), ("U", 1, 3)], "symbol string, first_id long, last_id long")
    s = spark.createDataFrame([("S", 7), ("T", 5), ("U", 7)], "symbol string, last_update_id long")
    kept, stale = ordering.spliced(d, s, ["symbol"])
    assert sorted((r["symbol"], r["last_id"]) for r in kept.collect()) == [("S", 9), ("S", 12)]
    assert [r["symbol"] for r in stale.collect()] == ["T"]


def test_resync_discards_until_a_snapshot(spark):
    h = lambda v: [("dropped-count", bytearray(v, "utf8"))]
    rows = [("S", 1, "u", []), ("S", 2, "u", h("3")), ("S", 3, "u", []), ("S", 4, "snapshot", []), ("S", 5, "u", h("0")), ("S", 6, "u", h("x"))]
    df = spark.createDataFrame(rows, "symbol string, offset long, event_type string, headers array<struct<key string, value binary>>")
    kept, asked = ordering.after_resync(df, ["symbol"])
    assert sorted(r["offset"] for r in kept.collect()) == [1, 4, 5, 6]
    assert [r["offset"] for r in asked.collect()] == [2]


def test_metrics_query(spark):
    df = spark.createDataFrame([("e", "s", "1m", 0, 60, 1.0, float("nan")), ("e", "s", "1m", 60, 120, 2.0, 5.0), ("e", "t", "1m", 0, 60, 9.0, 9.0)], "exchange string, symbol string, window_id string, start_ts_ms long, end_ts_ms long, vwap double, ema double")
    out = series.metrics(df, "e", "s", ["1m"], ["vwap", "ema"], 0, 200)
    assert [(r["name"], r["value"]) for r in out.collect()] == [("vwap", 1.0), ("ema", 5.0), ("vwap", 2.0)]
    assert len(series.grouped_metrics(out).first()["points"]) == 3
    with pytest.raises(ValueError):
        series.metrics(df, "e", "s", ["1m"], ["price"], 0, 1)


def test_lag_cases(spark):
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, -1), ("t", 2, 7), ("t", 3, 7)], "topic string, partition int, end_offset long")
    done = spark.createDataFrame([("t", 0, 4), ("t", 1, 4), ("t", 2, -1)], "topic string, partition int, committed_offset long")
    assert {r["partition"]: r["lag"] for r in series.consumer_lag(ends, done).collect()} == {0: 6, 1: 0, 2: 7, 3: 7}


def test_zero_candles_are_not_drawn(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)], "open_price double, high_price double, low_price double, close_price double")
    assert series.drawable(df).count() == 1


def test_snapshot_gate(spark):
    snap = spark.createDataFrame([(0, 10), (1, 5), (2, 1)], "partition int, offset long")
    done = spark.createDataFrame([(0, 10), (1, 4)], "partition int, committed_offset long")
    assert sorted(r["partition"] for r in series.violations(snap, done).collect()) == [1, 2]
