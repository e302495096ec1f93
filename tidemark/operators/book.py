"""Order books from streams of level changes.

The state of a book is the latest change of each (exchange, symbol, side, price), by (event_time_millis, sequence); a volume of 0
or less deletes the level. The state of a price is one row, so folding a book is one aggregation with partial maxima, and no task holds a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOOK_KEY = ["exchange", "symbol"]


def deltas(books: DataFrame) -> DataFrame:
    """One row for each level of a book message, in the message's order: side B or A, price, volume, level_index."""
    common = [*BOOK_KEY, "event_time_millis", "event_type"]
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(F.col(c), F.array().cast("array<struct<price double, volume double>>")).alias("levels")) for s, c in (("B", "bids"), ("A", "asks"))))
    one = books.select(*common, F.explode(sides).alias("s"))
    return one.select(*common, F.col("s.side").alias("side"), F.posexplode("s.levels").alias("level_index", "l")).select(*common, "side", "level_index", "l.price", "l.volume")


def latest_levels(changes: DataFrame, at_ms: int | None = None, sequence: str = "level_index", snapshot_replaces: bool = False, by: list[str] | None = None) -> DataFrame:
    """Levels that stand (at ``at_ms``): the last volume of each price if positive.

    Snapshots are merged like any message; with ``snapshot_replaces`` they void what was before them.
    """
    by = by or BOOK_KEY
    rows = changes if at_ms is None else changes.filter(F.col("event_time_millis") <= at_ms)
    if snapshot_replaces:
        last = rows.filter(F.col("event_type") == "snapshot").groupBy(*by).agg(F.max("event_time_millis").alias("__from"))
        rows = rows.join(last, by, "left").filter(F.col("__from").isNull() | (F.col("event_time_millis") >= F.col("__from"))).drop("__from")
    ordered = F.struct("event_time_millis", sequence)
    state = rows.groupBy(*by, "side", "price").agg(F.max_by("volume", ordered).alias("volume"), F.max("event_time_millis").alias("event_time_millis"))
    return state.filter(F.col("volume") > 0)


def side_order() -> Column:
    """Best first: bids by falling price, asks by rising."""
    return F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))


def top_levels(levels: DataFrame, n: int = 15, by: list[str] | None = None) -> DataFrame:
    """The best n levels of each side, level_index from 0."""
    w = W.partitionBy(*(by or BOOK_KEY), "side").orderBy(side_order())
    ranked = levels.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)  # on the rank itself: limits each group before the exchange
    return ranked.withColumn("level_index", (F.col("__rank") - 1).cast("int")).drop("__rank")


def best(levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best bid and ask, spread (negative if crossed) and depth of each side; books with an empty side are left out."""
    bid, ask = F.col("side") == "B", F.col("side") == "A"
    out = levels.groupBy(*(by or BOOK_KEY)).agg(
        F.max(F.when(bid, F.struct("price", "volume"))).alias("b"),
        F.min(F.when(ask, F.struct("price", "volume"))).alias("a"),
        F.count(F.when(bid, 1)).alias("bid_depth"),
        F.count(F.when(ask, 1)).alias("ask_depth"),
        F.max("event_time_millis").alias("event_time_millis"),
    )
    out = out.filter(F.col("b").isNotNull() & F.col("a").isNotNull())
    return out.select(*(by or BOOK_KEY), "event_time_millis", F.col("b.price").alias("best_bid_price"), F.col("b.volume").alias("best_bid_volume"), F.col("a.price").alias("best_ask_price"), F.col("a.volume").alias("best_ask_volume"), (F.col("a.price") - F.col("b.price")).alias("spread"), "bid_depth", "ask_depth")


def microprice() -> Column:
    """Of a best bid and ask: each price weighted by the other side's volume."""
    return F.try_divide(F.col("best_bid_price") * F.col("best_ask_volume") + F.col("best_ask_price") * F.col("best_bid_volume"), F.col("best_bid_volume") + F.col("best_ask_volume"))


def dyadic(start: str, end: str) -> Column:
    """The fewest nodes (size, at) that cover start up to before end: node (k, a) is a * 2^k up to before (a + 1) * 2^k."""
    left, right = f"shiftright({start} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    pick = lambda odd, at: f"if({left} < {right} AND {odd} % 2 = 1, named_struct('size', k, 'at', {at}), NULL)"
    return F.expr(f"filter(flatten(transform(sequence(0, cast(floor(log2({end} - {start})) AS int)), k -> array({pick(left, left)}, {pick(right, right + ' - 1')}))), x -> x IS NOT NULL)")


def flushes(changes: DataFrame, cadence_ms: int = 10_000, n: int = 15, sequence: str = "level_index") -> tuple[DataFrame, DataFrame]:
    """Header and level rows of every book at each flush of a grid on which it changed.

    A flush sees every price's last change up to it. A price holds from its change's period until the period of its next change. Such a
    span is cut into at most two dyadic nodes a size, each node keeps the best n levels of a side that hold throughout it (a level with n
    better ones there is in no top n inside it), and a flush picks from the nodes above it. Rows grow with the logarithm of the number of
    flushes, not with levels times flushes.
    """
    period = F.floor(F.col("event_time_millis") / F.lit(cadence_ms))
    last = changes.withColumn("period", period).groupBy(*BOOK_KEY, "side", "price", "period").agg(F.max_by("volume", F.struct("event_time_millis", sequence)).alias("volume"), F.max("event_time_millis").alias("event_time_millis"))
    until = F.lead("period").over(W.partitionBy(*BOOK_KEY, "side", "price").orderBy("period"))
    held = last.withColumn("__until", until).filter(F.col("volume") > 0)
    grid = changes.select(*BOOK_KEY, period.alias("period")).distinct()
    ends = grid.groupBy(*BOOK_KEY).agg(F.min("period").alias("__lo"), (F.max("period") + 1).alias("__hi"))
    spans = held.join(ends, BOOK_KEY).withColumn("__until", F.coalesce("__until", "__hi"))
    nodes = spans.select(*BOOK_KEY, "side", "price", "volume", "event_time_millis", F.explode(dyadic("period", "__until")).alias("__n")).select("*", "__n.size", "__n.at").drop("__n")
    node = [*BOOK_KEY, "size", "at"]
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.col("__hi") - F.col("__lo"))).cast("int"))
    above = grid.join(ends, BOOK_KEY).select(*BOOK_KEY, "period", F.explode(sizes).alias("size")).withColumn("at", F.expr("shiftright(period, size)"))
    by = [*BOOK_KEY, "period"]
    levels = above.join(top_levels(nodes, n, node).drop("level_index", "event_time_millis"), node).drop("size", "at")
    times = above.join(nodes.groupBy(*node).agg(F.max("event_time_millis").alias("event_time_millis")), node).groupBy(*by).agg(F.max("event_time_millis").alias("event_time_millis"))
    tops = top_levels(levels, n, by)
    headers = best(tops.filter(F.col("level_index") == 0).withColumn("event_time_millis", F.lit(None).cast("long")), by).drop("event_time_millis").join(times, by)
    kept = tops.join(headers.select(*by, "event_time_millis"), by)
    stamp = F.timestamp_millis("event_time_millis")
    header = headers.select(*BOOK_KEY, "event_time_millis", stamp.alias("event_time"), "best_bid_price", "best_bid_volume", "best_ask_price", "best_ask_volume", "spread")
    level = kept.select(*BOOK_KEY, stamp.alias("event_time"), "level_index", "side", "price", "volume")
    return header, level


def depth_bars(levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds bar_width: volume as a share of the side's largest (at least 1), in percent, at most 100."""
    w = W.partitionBy(*(by or BOOK_KEY), "side")
    return levels.withColumn("bar_width", F.least(F.lit(100.0), F.col("volume") / F.greatest(F.max("volume").over(w), F.lit(1.0)) * 100))


def grouped_sides(levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Levels of each side as a sorted array; a side is at most as long as the depth asked for."""
    return levels.groupBy(*(by or BOOK_KEY), "side").agg(F.array_sort(F.collect_list(F.struct("level_index", "price", "volume"))).alias("levels"))
