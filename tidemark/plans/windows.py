"""The window definitions, their validation, and the grid of periods."""

from __future__ import annotations

from dataclasses import dataclass
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowDef:
    id: str
    duration_ms: int
    cadence_ms: int
    bucket_ms: int

    @property
    def n_buckets(self) -> int:
        return max(1, self.duration_ms // self.bucket_ms)

    @property
    def ema_alpha(self) -> float:
        """Half-life of as many ticks as the window has seconds."""
        from math import exp, log

        return 1 - exp(log(0.5) / max(1, self.duration_ms // 1000))


#: Id, duration, flush cadence and bucket in milliseconds.
WINDOWS = [
    WindowDef("5s", 5000, 1000, 500),
    WindowDef("10s", 10000, 2000, 1000),
    WindowDef("30s", 30000, 5000, 2500),
    WindowDef("1m", 60000, 10000, 5000),
    WindowDef("2m", 120000, 20000, 10000),
    WindowDef("5m", 300000, 60000, 10000),
    WindowDef("10m", 600000, 120000, 30000),
    WindowDef("30m", 1800000, 300000, 60000),
    WindowDef("1h", 3600000, 600000, 120000),
    WindowDef("2h", 7200000, 1200000, 240000),
    WindowDef("6h", 21600000, 6000000, 360000),
    WindowDef("12h", 43200000, 1200000, 600000),
    WindowDef("24h", 86400000, 3600000, 900000),
]

DAY = 86_400_000
#: Default look-back of a chart in days by window; others have 45.
LOOKBACK_DAYS = {"5m": 60, "10m": 60, "30m": 90, "1h": 120}


def lookback_ms(window_id: str) -> int:
    return LOOKBACK_DAYS.get(window_id, 45) * DAY


def validate(windows: list[WindowDef]) -> list[WindowDef]:
    """The windows, or a ValueError that names what is wrong."""
    seen: set[str] = set()
    for w in windows:
        name = w.id.strip() if w.id else ""
        if not name:
            raise ValueError("a window has a blank id")
        if name in seen:
            raise ValueError(f"window {name} is defined twice")
        seen.add(name)
        if w.duration_ms <= 0:
            raise ValueError(f"window {name}: the duration must be positive")
        if not 0 < w.cadence_ms <= w.duration_ms:
            raise ValueError(f"window {name}: the cadence must be positive and at most the duration")
        if not 0 < w.bucket_ms <= w.duration_ms:
            raise ValueError(f"window {name}: the bucket must be positive and at most the duration")
    return windows


def chosen(*ids: str) -> list[WindowDef]:
    return [w for w in WINDOWS if w.id in ids] if ids else list(WINDOWS)


def epoch_ms(ntz: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.date_part(F.lit("SECONDS"), ntz)
    return F.unix_date(F.to_date(ntz)).cast("long") * DAY + F.hour(ntz).cast("long") * 3_600_000 + F.minute(ntz).cast("long") * 60_000 + F.floor(seconds * 1000).cast("long")


def frame(spark: SparkSession, windows: list[WindowDef] | None = None) -> DataFrame:
    """The definitions as a table of at most a few dozen rows."""
    rows = [(w.id, w.duration_ms, w.cadence_ms, w.bucket_ms) for w in validate(windows or WINDOWS)]
    return spark.createDataFrame(rows, "window_id string, duration_ms long, cadence_ms long, bucket_ms long")


def expanded(ticks: DataFrame, windows: list[WindowDef]) -> DataFrame:
    """Every row once for each window, without a join: the definitions are a literal array."""
    defs = F.array(*(F.struct(F.lit(w.id).alias("window_id"), F.lit(w.duration_ms).cast("long").alias("duration_ms"), F.lit(w.cadence_ms).cast("long").alias("cadence_ms"), F.lit(w.bucket_ms).cast("long").alias("bucket_ms")) for w in validate(windows)))
    return ticks.select("*", F.explode(defs).alias("__w")).select("*", "__w.*").drop("__w")


def period(ts: Column, cadence: Column) -> Column:
    return F.floor(ts / cadence)


def labelled(df: DataFrame) -> DataFrame:
    """start_ts_ms and end_ts_ms of a flush: the end of its period, and the window's duration before."""
    end = ((F.col("period") + 1) * F.col("cadence_ms")).cast("long")
    return df.withColumns({"end_ts_ms": end, "start_ts_ms": (end - F.col("duration_ms")).cast("long")})


def common_span(windows: list[WindowDef]) -> int:
    """A span that every cadence divides: no period crosses its borders, so they can split a key's history."""
    return lcm(*(w.cadence_ms for w in windows))
