"""Canonical schemas. Nothing is inferred."""

from __future__ import annotations

import re


class Schema(dict):
    """Column types by name, in order; ``ddl`` is what Spark's readers take."""

    def __init__(self, ddl: str):
        # commas inside <...> don't separate columns
        parts, depth, at = [], 0, 0
        for i, c in enumerate(ddl):
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                parts.append(ddl[at:i])
                at = i + 1
        super().__init__(re.split(r"\s+", p.strip(), maxsplit=1) for p in [*parts, ddl[at:]])
        self.ddl = ddl

    @property
    def names(self) -> list[str]:
        return list(self)


def _struct(text: str) -> Schema:
    return Schema(text)


LEVELS = "array<struct<price double, volume double>>"

TICK = _struct("exchange string, channel string, symbol string, event_ts_millis long, price double, volume double, open double, close double, low double, high double, seq_id long")
BOOK = _struct(f"exchange string, channel string, symbol string, bids {LEVELS}, asks {LEVELS}, event_time_millis long, event_type string")
#: Raw records as a message log hands them over.
RAW = _struct("key string, value string, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key string, value binary>>")

PRICE_METRICS = ["open_price", "close_price", "low_price", "high_price", "vwap", "rolling_vwap", "twap", "microprice"]
OTHER_METRICS = ["volume", "rolling_volume", "volume_acceleration", "volatility", "atr", "ema", "sma", "log_return", "simple_return"]
#: The 24 columns of a stored aggregate row, in order, with the two label columns after the timestamps.
AGG_TICK = _struct("exchange string, symbol string, window_id string, start_ts_ms long, end_ts_ms long, start_ts timestamp, end_ts timestamp, " + ", ".join(f"{c} double" for c in PRICE_METRICS + OTHER_METRICS))
AGG_KEY = ["exchange", "symbol", "window_id", "start_ts"]

BOOK_FLUSH = _struct("exchange string, symbol string, event_time_millis long, event_time timestamp, best_bid_price double, best_bid_volume double, best_ask_price double, best_ask_volume double, spread double")
BOOK_LEVEL = _struct("exchange string, symbol string, event_time timestamp, level_index int, side string, price double, volume double")
BOOK_FLUSH_KEY = ["exchange", "symbol", "event_time"]
BOOK_LEVEL_KEY = ["exchange", "symbol", "event_time", "side", "level_index"]

#: Metric names that can be asked for.
METRICS = ["microprice", "volume", "rolling_volume", "volume_acceleration", "volatility", "atr", "ema", "sma", "log_return", "simple_return", "twap", "vwap", "rolling_vwap"]

#: Raw payloads of the six feeds. Keys that differ in case only are read with case-sensitive JSON paths.
COINBASE_TICKER = _struct("type string, product_id string, price string, open_24h string, volume_24h string, low_24h string, high_24h string, time string, sequence long")
COINBASE_LEVEL2 = _struct("type string, product_id string, time string, bids array<array<string>>, asks array<array<string>>, changes array<array<string>>")
KRAKEN_TICKER = _struct("channel string, type string, data array<struct<symbol string, last double, volume double, low double, high double>>")
KRAKEN_BOOK = _struct("channel string, type string, data array<struct<symbol string, bids array<struct<price double, qty double>>, asks array<struct<price double, qty double>>, timestamp string>>")
PAIRS = "array<array<string>>"
