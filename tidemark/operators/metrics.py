"""Windowed metrics of a tick stream.

A metric that is reset at every flush covers the ticks of one period: the flush cadence of its window, aligned to the epoch. Ordered by
(event_ts_millis, seq_id). Guarded metrics leave out prices that aren't positive and finite, VWAP also volumes that aren't positive.

Layout: previous prices are found once, in partitions of (key, span) where no period crosses a span; then one aggregation by
(key, window, period), with partial sums before its only shuffle. Rolling metrics work on buckets, in blocks of bounded size that carry
the buckets before them. Recurrences (EMA, ATR) are composed block by block, so no task holds a key's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.windows import WindowDef, common_span, expanded, labelled, period

KEY = ["exchange", "channel", "symbol"]
#: Periods or buckets that one task looks at together.
BLOCK = 4096
ATR_ALPHA = 1 / 14


def order() -> Column:
    return F.struct("event_ts_millis", "seq_id")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def good_price() -> Column:
    return finite(F.col("price")) & (F.col("price") > 0)


def good_trade() -> Column:
    return finite(F.col("price")) & finite(F.col("volume")) & (F.col("volume") > 0)


def with_previous(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    """Adds __ok, and __prev and __prev_ts of the last good price before, within a span that no period crosses."""
    span = common_span(windows)
    good = ticks.withColumn("__ok", good_price()).withColumn("__span", F.floor(F.col("event_ts_millis") / F.lit(span)))
    w = W.partitionBy(*KEY, "__span").orderBy("event_ts_millis", "seq_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__ok"), F.struct(F.col("price").alias("p"), F.col("event_ts_millis").alias("t"))), ignorenulls=True).over(w)
    return good.withColumn("__last", last).select("*", F.col("__last.p").alias("__prev"), F.col("__last.t").alias("__prev_ts")).drop("__last", "__span")


#: Metric name: its aggregate over the ticks of a period. A registry that callers may extend.
PERIOD_METRICS: dict[str, Callable[[], Column]] = {
    "open_price": lambda: F.min_by("open", order()),
    "close_price": lambda: F.max_by("close", order()),
    "low_price": lambda: F.min(F.when(finite(F.col("low")), F.col("low"))),
    "high_price": lambda: F.max(F.when(finite(F.col("high")), F.col("high"))),
    "volume": lambda: F.sum("volume"),
    "vwap": lambda: F.coalesce(F.try_divide(F.sum(F.when(good_trade(), F.col("price") * F.col("volume"))), F.sum(F.when(good_trade(), F.col("volume")))), F.lit(0.0)),
    "twap": lambda: F.avg("price"),
    "sma": lambda: F.avg("price"),
    "log_return": lambda: F.coalesce(F.sum("__log"), F.lit(0.0)),
    "simple_return": lambda: F.coalesce(F.sum("__simple"), F.lit(0.0)),
    "volatility": lambda: F.coalesce(F.stddev_samp("__log"), F.lit(0.0)),
    "ticks": lambda: F.count("*"),
}
NEEDS_PREVIOUS = {"log_return", "simple_return", "volatility"}


def period_metrics(ticks: DataFrame, windows: list[WindowDef], metrics: list[str] | None = None) -> DataFrame:
    """One row for each key, window and period with ticks: the metrics, period, start_ts_ms and end_ts_ms."""
    names = metrics or list(PERIOD_METRICS)
    if unknown := set(names) - set(PERIOD_METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    returns = bool(NEEDS_PREVIOUS & set(names))
    rows = expanded(with_previous(ticks, windows) if returns else ticks, windows).withColumn("period", period(F.col("event_ts_millis"), F.col("cadence_ms")))
    if returns:
        follows = F.col("__ok") & F.col("__prev").isNotNull() & (period(F.col("__prev_ts"), F.col("cadence_ms")) == F.col("period"))
        rows = rows.withColumns({"__log": F.when(follows, F.ln(F.col("price") / F.col("__prev"))), "__simple": F.when(follows, (F.col("price") - F.col("__prev")) / F.col("__prev"))})
    grouped = rows.groupBy(*KEY, "window_id", "duration_ms", "cadence_ms", "bucket_ms", "period")
    return labelled(grouped.agg(*(PERIOD_METRICS[n]().alias(n) for n in names)))


def rolling(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    """rolling_volume and rolling_vwap by slot with ticks: over its bucket up to it and the buckets before, as many as the duration holds.

    A slot is the largest span that divides bucket and cadence, so a flush never falls inside one. A block of slots is one task's
    work. Slots that reach into the next block are sent to it, too.
    """
    out = None
    shapes: dict[tuple[int, int], list[WindowDef]] = {}
    for w in windows:
        shapes.setdefault((w.n_buckets, w.bucket_ms // gcd(w.bucket_ms, w.cadence_ms)), []).append(w)
    for (n, m), some in shapes.items():  # a frame's bounds are constants
        rows = expanded(ticks, some).withColumn("slot", F.floor(F.col("event_ts_millis") * m / F.col("bucket_ms")))
        base = rows.groupBy(*KEY, "window_id", "duration_ms", "cadence_ms", "bucket_ms", "slot").agg(F.sum(F.col("price") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
        block = F.floor(F.col("slot") / F.lit(BLOCK))
        spread = base.select("*", F.explode(F.sequence(block, F.floor((F.col("slot") + n * m - 1) / F.lit(BLOCK)))).alias("__block"))
        w = W.partitionBy(*KEY, "window_id", "__block").orderBy("slot")
        frames = [w.rangeBetween(-(m * (n - 1) + r), 0) for r in range(m)]
        pick = lambda c: F.coalesce(*(F.when(F.pmod("slot", F.lit(m)) == r, F.sum(c).over(f)) for r, f in enumerate(frames)))
        part = spread.withColumns({"rolling_volume": pick("v"), "__pv": pick("pv")}).filter(F.col("__block") == block)
        out = part if out is None else out.unionByName(part)
    vwap = F.when(F.col("rolling_volume") > 0, F.try_divide(F.col("__pv"), F.col("rolling_volume"))).otherwise(0.0)
    slot_ms = F.lit(None)
    for w in windows:
        slot_ms = F.when(F.col("window_id") == w.id, F.lit(gcd(w.bucket_ms, w.cadence_ms))).otherwise(slot_ms)
    return out.withColumns({"rolling_vwap": vwap, "period": F.floor(F.col("slot") * slot_ms / F.col("cadence_ms"))}).drop("__pv", "__block", "pv", "v")


def rolling_at_flush(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    """The rolling values at the last tick of each period with ticks."""
    w = ["window_id", "duration_ms", "cadence_ms", "bucket_ms"]
    return labelled(rolling(ticks, windows).groupBy(*KEY, *w, "period").agg(F.max_by("rolling_volume", "slot").alias("rolling_volume"), F.max_by("rolling_vwap", "slot").alias("rolling_vwap")))


def running(rows: DataFrame, by: list[str], along: str, a: str, b: str, out: str, start: str | None = None, before: bool = False) -> DataFrame:
    """Adds ``out``: y = a * y_before + b along ``along`` in each group, from ``start`` (else 0); with ``before`` the value before the row.

    One pass over sorted partitions, whatever the number of groups; a task holds one batch.
    """
    names, types = rows.columns, dict(rows.dtypes)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, value = None, 0.0
        for pdf in frames:
            values = []
            starts = pdf[start] if start else np.zeros(len(pdf))
            for *g, x, y, first in zip(*(pdf[c] for c in by), pdf[a], pdf[b], starts, strict=True):
                if g != group:
                    group, value = g, first
                after = x * value + y
                values.append(value if before else after)
                value = after
            yield pdf.assign(**{out: np.array(values, float)})

    schema = ", ".join(f"{c} {types[c]}" for c in names)
    return rows.repartition(*by).sortWithinPartitions(*by, along).mapInPandas(walk, f"{schema}, {out} double")


def composed(rows: DataFrame, by: list[str], position: str, a: str, b: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: y = a * y_before + b along ``position``; a row with a = 0 starts anew.

    Blocks of positions are composed on their own; a block's composition is one small row, and only those rows of a key are folded in
    order. Then each block runs from what came before it.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(position) / F.lit(block)))
    key = [*by, "__block"]
    step = F.struct(F.col(position), F.col(a).alias("a"), F.col(b).alias("b"))
    blocks = blocked.groupBy(*key).agg(chained(F.array_sort(F.collect_list(step))).alias("__s"))
    carried = running(blocks.select(*key, F.col("__s.a").alias("__ba"), F.col("__s.b").alias("__bb")), by, "__block", "__ba", "__bb", "__in", before=True)
    return running(blocked.join(carried.select(*key, "__in"), key), key, position, a, b, out, start="__in").select(*rows.columns, out)


def folded(values: Column, alpha: Column) -> Column:
    """(a, b) of y -> a * y + b after the values of an array, in order: b = alpha * x + (1 - alpha) * b."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["a"] * (1 - alpha)).alias("a"), (s["b"] * (1 - alpha) + alpha * x).alias("b")))


def chained(steps: Column) -> Column:
    """(a, b) of an array of steps (a, b), one after the other."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(steps, start, lambda s, x: F.struct((s["a"] * x["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b")))


def recurrences(ticks: DataFrame, value: Column, alpha: Callable[[WindowDef], float], windows: list[WindowDef], out: str) -> DataFrame:
    """``out`` at the end of each period with ticks: y = alpha * x + (1 - alpha) * y_before; the first value is x itself.

    All windows in one plan. Ticks meet once, in slots that divide every cadence; a slot gives one linear step a window, a period chains
    the steps of its slots, and ``composed`` the periods. No list is longer than a slot's ticks or a period's slots.
    """
    slot_ms = gcd(*(w.cadence_ms for w in windows))
    slots = ticks.select(*KEY, F.floor(F.col("event_ts_millis") / F.lit(slot_ms)).alias("slot"), F.struct(order().alias("o"), value.alias("x")).alias("t"))
    lists = slots.groupBy(*KEY, "slot").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]).alias("xs"))
    firsts = lists.groupBy(*KEY).agg(F.min("slot").alias("__first"))
    smoothing = F.lit(None)
    for w in windows:
        smoothing = F.when(F.col("window_id") == w.id, F.lit(alpha(w))).otherwise(smoothing)
    rows = expanded(lists.join(firsts, KEY).withColumn("__begins", F.col("slot") == F.col("__first")), windows)
    shape = ["window_id", "duration_ms", "cadence_ms", "bucket_ms"]
    step = rows.withColumn("__s", folded(F.when(F.col("__begins"), F.slice("xs", 2, 1 << 30)).otherwise(F.col("xs")), smoothing.cast("double")))
    a = F.when(F.col("__begins"), F.lit(0.0)).otherwise(F.col("__s.a"))
    b = F.when(F.col("__begins"), F.col("__s.a") * F.col("xs")[0] + F.col("__s.b")).otherwise(F.col("__s.b"))
    steps = step.select(*KEY, *shape, period(F.col("slot") * F.lit(slot_ms), F.col("cadence_ms")).alias("period"), F.struct("slot", a.alias("a"), b.alias("b")).alias("s"))
    periods = steps.groupBy(*KEY, *shape, "period").agg(chained(F.array_sort(F.collect_list("s"))).alias("__s"))
    return labelled(composed(periods.select(*KEY, *shape, "period", F.col("__s.a").alias("__a"), F.col("__s.b").alias("__b")), [*KEY, *shape], "period", "__a", "__b", out).drop("__a", "__b"))


def ema(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    return recurrences(ticks, F.col("price"), lambda w: w.ema_alpha, windows, "ema")


def true_range(ticks: DataFrame) -> DataFrame:
    """Adds __tr: high - low for a key's first tick, else the greatest of it and the distances from the close before.

    Ticks are looked at in hours; the first of an hour takes the last close of the hours before.
    """
    hourly = ticks.withColumn("__hour", F.floor(F.col("event_ts_millis") / F.lit(3_600_000)))
    ends = hourly.groupBy(*KEY, "__hour").agg(F.max_by("close", order()).alias("__end"))
    carried = ends.withColumn("__carry", F.lag("__end").over(W.partitionBy(*KEY).orderBy("__hour"))).drop("__end")
    w = W.partitionBy(*KEY, "__hour").orderBy("event_ts_millis", "seq_id")
    before = F.when(F.row_number().over(w) == 1, F.col("__carry")).otherwise(F.lag("close").over(w))
    plain = F.col("high") - F.col("low")
    ranges = F.when(F.col("__before").isNull(), plain).otherwise(F.greatest(plain, F.abs(F.col("high") - F.col("__before")), F.abs(F.col("low") - F.col("__before"))))
    return hourly.join(carried, [*KEY, "__hour"]).withColumn("__before", before).withColumn("__tr", ranges).drop("__before", "__carry", "__hour")


def atr(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    """ATR by tick; the same for every window up to where the flush falls."""
    return recurrences(true_range(ticks), F.col("__tr"), lambda w: ATR_ALPHA, windows, "atr")


def acceleration(flushes: DataFrame) -> DataFrame:
    """Adds volume_acceleration: the change of rolling_volume since the flush before, by the cadence in whole seconds; 0 unless that was positive."""
    w = W.partitionBy(*KEY, "window_id").orderBy("period")
    before = F.lag("rolling_volume").over(w)
    seconds = F.floor(F.col("cadence_ms") / 1000).cast("double")
    return flushes.withColumn("volume_acceleration", F.when(before > 0, F.try_divide(F.col("rolling_volume") - before, seconds)).otherwise(0.0))


def dense(ticks: DataFrame, windows: list[WindowDef], until_ms: int | None = None) -> DataFrame:
    """A row for each key, window and period from the key's first to the last of all, with ticks or without."""
    ends = ticks.groupBy(*KEY).agg(F.min("event_ts_millis").alias("__lo"), F.max("event_ts_millis").alias("__hi"))
    last = F.lit(until_ms) if until_ms is not None else F.col("__hi")
    rows = expanded(ends, windows)
    grid = rows.select(*KEY, "window_id", "duration_ms", "cadence_ms", "bucket_ms", F.explode(F.sequence(period(F.col("__lo"), F.col("cadence_ms")), period(last, F.col("cadence_ms")))).alias("period"))
    return labelled(grid)


def flush_rows(ticks: DataFrame, windows: list[WindowDef], is_dense: bool = True, twap: bool = True) -> DataFrame:
    """All 24 columns of a stored aggregate row for each key, window and flush.

    Metrics of a period without ticks are 0; rolling values, EMA and ATR stay at their last. ``twap`` False gives 0 for TWAP and SMA, as
    streams that never computed them have it. Microprice is 0: ticks carry no quotes.
    """
    join = [*KEY, "window_id", "period"]
    ticked = period_metrics(ticks, windows).drop("start_ts_ms", "end_ts_ms", "duration_ms", "cadence_ms", "bucket_ms")
    kept = rolling_at_flush(ticks, windows).select(*join, "rolling_volume", "rolling_vwap")
    smooth = ema(ticks, windows).select(*join, "ema").join(atr(ticks, windows).select(*join, "atr"), join)
    grid = dense(ticks, windows) if is_dense else labelled(period_metrics(ticks, windows, ["ticks"]).drop("ticks", "start_ts_ms", "end_ts_ms"))
    rows = grid.join(ticked, join, "left").join(kept, join, "left").join(smooth, join, "left")
    w = W.partitionBy(*KEY, "window_id").orderBy("period")
    carried = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in ("rolling_volume", "rolling_vwap", "ema", "atr")}
    rows = acceleration(rows.withColumns(carried))
    zero = ["open_price", "close_price", "low_price", "high_price", "vwap", "twap", "sma", "volume", "volatility", "log_return", "simple_return"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if twap or c not in ("twap", "sma") else F.lit(0.0) for c in zero} | {"microprice": F.lit(0.0)})
    stamps = {"start_ts": F.timestamp_millis("start_ts_ms"), "end_ts": F.timestamp_millis("end_ts_ms")}
    from tidemark.schemas import AGG_TICK

    return rows.withColumns(stamps).select(*AGG_TICK.names)


def applied(aggregates: DataFrame) -> DataFrame:
    """Flat rows from nested aggregates whose parts may be absent: absent parts are zeros."""
    from tidemark.schemas import AGG_TICK

    parts = {f.name: f.dataType.names for f in aggregates.schema if hasattr(f.dataType, "names")}
    where = {c: f"{part}.{c}" for part, names in parts.items() for c in names}
    flat = [F.coalesce(F.col(where[c]) if c in where else F.col(c), F.lit(0.0)).alias(c) for c in AGG_TICK.names[7:] if c in where or c in aggregates.columns]
    return aggregates.select("exchange", "symbol", "window_id", "start_ts_ms", "end_ts_ms", F.timestamp_millis("start_ts_ms").alias("start_ts"), F.timestamp_millis("end_ts_ms").alias("end_ts"), *flat)


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Average, maximum and nearest-rank percentiles: the value at index floor(p * n) of the sorted values."""
    by = by or []
    w = W.partitionBy(*by).orderBy(value)
    total = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w) - 1)
    joined = ranked.join(F.broadcast(total), by) if by else ranked.crossJoin(F.broadcast(total))  # one row
    at = {f"p{round(100 * p)}": F.max(F.when(F.col("__i") == F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col(value))) for p in shares}
    return joined.groupBy(*by, "n", "avg", "max").agg(*(c.alias(k) for k, c in at.items()))


def histogram(df: DataFrame, value: str, start: float = 1.0, factor: float = 2.0, count: int = 18) -> DataFrame:
    """Cumulative counts under exponential upper bounds (le), the last of them infinite."""
    bounds = [start * factor**i for i in range(count)]
    le = F.array(*(F.lit(float(x)) for x in bounds), F.lit(float("inf")))
    return df.select(F.explode(F.filter(le, lambda x: F.col(value) <= x)).alias("le")).groupBy("le").agg(F.count("*").alias("n"))


def batches(frames: Iterator[DataFrame]) -> DataFrame:
    """Bag union of several sources."""
    rows = None
    for f in frames:
        rows = f if rows is None else rows.unionByName(f)
    return rows
