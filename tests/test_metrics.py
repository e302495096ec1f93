"""The metrics against a plain fold over ticks."""

import math
import random
import statistics

import pytest

from tidemark.operators import metrics
from tidemark.plans.windows import WINDOWS, WindowDef, chosen
from tidemark.schemas import AGG_TICK, TICK


def frame(spark, rows):
    return spark.createDataFrame(rows, TICK.ddl)


def tick(ts, price, volume, seq, o=None, c=None, low=None, h=None, symbol="S"):
    return ("x", "c", symbol, ts, price, volume, o or price, c or price, low or price, h or price, seq)


def fold(ticks, w):
    """period -> metrics, for one key, in order."""
    out, ema, atr, close, before, values = {}, None, None, None, None, None
    ordered = sorted(ticks, key=lambda t: (t[3], t[10]))
    alpha = 1 - math.exp(math.log(0.5) / (w.duration_ms // 1000))
    for t in ordered:
        k = t[3] // w.cadence_ms
        m = out.setdefault(k, {"ticks": []})
        m["ticks"].append(t)
        ema = t[4] if ema is None else alpha * t[4] + (1 - alpha) * ema
        tr = t[9] - t[8] if close is None else max(t[9] - t[8], abs(t[9] - close), abs(t[8] - close))
        atr = tr if atr is None else tr / 14 + 13 / 14 * atr
        close = t[7]
        bucket = t[3] // w.bucket_ms
        upto = [u for u in ordered if (u[3], u[10]) <= (t[3], t[10]) and u[3] // w.bucket_ms > bucket - w.n_buckets]
        m |= {"ema": ema, "atr": atr, "rv": sum(u[5] for u in upto), "rp": sum(u[4] * u[5] for u in upto)}
    for k in sorted(out):
        m = out[k]
        ts = m["ticks"]
        good = [t[4] for t in ts if math.isfinite(t[4]) and t[4] > 0]
        logs = [math.log(b / a) for a, b in zip(good, good[1:], strict=False)]
        m["log"], m["simple"] = sum(logs), sum((b - a) / a for a, b in zip(good, good[1:], strict=False))
        m["vol"] = statistics.stdev(logs) if len(logs) > 1 else 0.0
        traded = [t for t in ts if t[5] > 0 and math.isfinite(t[4])]
        m["vwap"] = sum(t[4] * t[5] for t in traded) / sum(t[5] for t in traded) if traded else 0.0
    return out


@pytest.mark.parametrize("window", ["5s", "1m", "6h", "24h"])
def test_all_metrics_against_a_fold(spark, window):
    random.seed(window)
    w = chosen(window)[0]
    ticks = [tick(random.randrange(0, 40 * w.cadence_ms), round(random.uniform(50, 60), 2), float(random.randrange(0, 4)), i, low=49.0, h=61.0 + random.random()) for i in range(300)]
    ticks[7] = tick(ticks[7][3], -1.0, 2.0, 7, low=-1.0, h=61.0)
    ticks[8] = tick(ticks[8][3], 0.0001, 0.0, 8, low=0.0001, h=61.0)
    want = fold(ticks, w)
    rows = {r["end_ts_ms"] // w.cadence_ms - 1: r for r in metrics.flush_rows(frame(spark, ticks), [w]).collect()}
    first, last = min(want), max(want)
    assert sorted(rows) == list(range(first, last + 1))
    before = None
    held = None
    for k in range(first, last + 1):
        r, m = rows[k], want.get(k)
        assert r["start_ts_ms"] == r["end_ts_ms"] - w.duration_ms
        if m:
            ts = m["ticks"]
            assert (r["open_price"], r["close_price"]) == (ts[0][6], ts[-1][7])
            assert (r["low_price"], r["high_price"]) == (min(t[8] for t in ts), max(t[9] for t in ts))
            for have, value in ((r["volume"], sum(t[5] for t in ts)), (r["twap"], sum(t[4] for t in ts) / len(ts)), (r["vwap"], m["vwap"]), (r["log_return"], m["log"]), (r["simple_return"], m["simple"]), (r["volatility"], m["vol"])):
                assert have == pytest.approx(value, rel=1e-9, abs=1e-9)
            held = m
        else:
            assert r["volume"] == r["open_price"] == r["vwap"] == r["volatility"] == 0
        assert r["ema"] == pytest.approx(held["ema"], rel=1e-9)
        assert r["atr"] == pytest.approx(held["atr"], rel=1e-9)
        assert r["rolling_volume"] == pytest.approx(held["rv"], rel=1e-9)
        assert r["rolling_vwap"] == pytest.approx(held["rp"] / held["rv"] if held["rv"] > 0 else 0.0, rel=1e-9)
        assert r["volume_acceleration"] == pytest.approx((held["rv"] - before) / (w.cadence_ms // 1000) if before and before > 0 else 0.0, rel=1e-9)
        before = held["rv"]


def test_two_ticks_and_reset(spark):
    rows = [tick(1010032331, 144.22, 30.0, 3566310, 136.09, 140.65, 136.05, 140.92), tick(1010032334, 145.22, 31.0, 3566313, 138.09, 144.65, 134.05, 146.23)]
    out = metrics.period_metrics(frame(spark, rows), WINDOWS).collect()
    assert len(out) == 13
    assert {(r["open_price"], r["high_price"], r["low_price"], r["close_price"]) for r in out} == {(136.09, 146.23, 134.05, 144.65)}


def test_rolling_evicts_the_oldest_bucket(spark):
    w = WindowDef("5x1", 5000, 5000, 1000)
    rows = [tick(10_000, 1.0, 10.0, 1), tick(11_000, 1.0, 15.0, 2), tick(15_000, 1.0, 5.0, 3)]
    assert [r["rolling_volume"] for r in metrics.rolling(frame(spark, rows), [w]).orderBy("slot").collect()] == [10.0, 25.0, 20.0]


def test_blocks_compose_like_one_run(spark):
    rows = [(0, i, 0.0 if i == 0 else 0.9, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, p long, a double, b double")
    out = [r["y"] for r in metrics.composed(df, ["g"], "p", "a", "b", "y", block=16).orderBy("p").collect()]
    y = 0.0
    for (_, _, a, b), have in zip(rows, out, strict=True):
        y = a * y + b
        assert have == pytest.approx(y)


def test_never_computed_averages_and_empty_input(spark):
    out = metrics.flush_rows(frame(spark, [tick(5000, 2.0, 1.0, 1)]), chosen("5s"), twap=False).first()
    assert (out["twap"], out["sma"], out["microprice"]) == (0.0, 0.0, 0.0)
    empty = metrics.flush_rows(frame(spark, []), chosen("5s"))
    assert empty.columns == AGG_TICK.names and empty.count() == 0


def test_unknown_metric():
    with pytest.raises(ValueError):
        metrics.period_metrics(None, WINDOWS, ["nope"])


def test_absent_parts_are_zeros(spark):
    df = spark.createDataFrame([("e", "s", "1m", 0, 60000, (1.0, 2.0, 0.5, 3.0), None)], "exchange string, symbol string, window_id string, start_ts_ms long, end_ts_ms long, price struct<open_price double, close_price double, low_price double, high_price double>, flow struct<volume double, rolling_volume double>")
    r = metrics.applied(df).first()
    assert (r["open_price"], r["high_price"], r["volume"], r["rolling_volume"]) == (1.0, 3.0, 0.0, 0.0)
