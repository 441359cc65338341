"""Demand features of live series, one state of fixed size for each.

Arriving amounts are summed to one row per (series, day) by a watermarked window, so a row reaches the state only
when its day is closed, and late input within the watermark is still in its sum.  The state of a series is a ring
of its last 30 daily totals.  An event-time timer wakes a series whose next day has closed without input, so
empty days get their rows too.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.constants import DEMAND_LAGS
from tidewater.session import scratch_path
from tidewater.streaming.live import run_to_end, utc_day

RING = max(30, *DEMAND_LAGS)
DAY_MS = 86_400_000
FEATURES = ["rolling_7d_mean", "rolling_30d_mean", "rolling_7d_std", *[f"lag_{n}" for n in DEMAND_LAGS]]
STATE = "next_day int, ring array<double>"

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# workers need numpy and pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def state_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Streams started inside keep their state with ``provider``; the setting before comes back at the end."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, provider)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def day_row(ring: list[float], day: int, demand: float) -> tuple:
    """(day, demand, features) from the totals of the days before, oldest first; null until enough days exist."""
    last7 = ring[-7:] if len(ring) >= 7 else None
    mean7 = math.fsum(last7) / 7 if last7 else None
    std7 = math.sqrt(math.fsum((x - mean7) ** 2 for x in last7) / 6) if last7 else None
    mean30 = math.fsum(ring[-30:]) / 30 if len(ring) >= 30 else None
    return (day, demand, mean7, mean30, std7, *[ring[-n] if len(ring) >= n else None for n in DEMAND_LAGS])


def advance(ring: list[float], next_day: int, totals: dict[int, float], closed: int) -> tuple[list[float], int, list[tuple]]:
    """The ring and its next day after all days up to ``closed``, and the rows of those days."""
    rows = []
    for day in range(next_day, closed + 1):
        demand = totals.get(day, 0.0)
        rows.append(day_row(ring, day, demand))
        ring = [*ring, demand][-RING:]
    return ring, max(next_day, closed + 1), rows


class LiveSeries(StatefulProcessor):
    """One series: its ring, the first day not yet given out, and a timer for the end of that day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        totals: dict[int, float] = {}
        for batch in rows:
            for day, demand in zip(batch["epoch_day"], batch["demand"]):
                totals[int(day)] = float(demand)
        return self._advance(key, totals, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, {}, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, totals: dict[int, float], timers) -> Iterator[pd.DataFrame]:
        # every day the watermark has passed is closed, and the window has handed on all it will hold
        closed = max(timers.getCurrentWatermarkInMs() // DAY_MS - 1, max(totals, default=-DAY_MS))
        if self.series.exists():
            next_day, ring = self.series.get()
            next_day, ring = int(next_day), [float(x) for x in ring]
            self.handle.deleteTimer((next_day + 1) * DAY_MS)
        else:
            next_day, ring = min(totals), []
        ring, next_day, rows = advance(ring, next_day, totals, closed)
        self.series.update((next_day, ring))
        self.handle.registerTimer((next_day + 1) * DAY_MS)
        if rows:
            out = pd.DataFrame(rows, columns=["epoch_day", "demand", *FEATURES])
            for i, part in enumerate(key):
                out.insert(i, f"k{i}", part)
            yield out


def live_demand_features(spark: SparkSession, amounts: DataFrame, by: list[str], watermark: str = "2 days",
                         sink: str | None = None) -> DataFrame:
    """Rows (by, day, demand, rolling and lag features) of every closed day of each series, the first sale's day first.

    ``amounts`` is a stream of by, ts and value.  Days are UTC days.  A day is closed once the watermark has passed
    its end; amounts later than that are dropped.  Features without enough days before them are null.  Amounts
    without a series key are left out; null values add nothing.
    """
    sink = sink or scratch_path(spark, "stream-demand-features")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    daily = (amounts.dropna(subset=by).select(*keys, "ts", "value").withWatermark("ts", watermark)
             .groupBy(*names, F.window("ts", "1 day")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("double").alias("demand")))
    daily = daily.select(*names, F.window_time("window").alias("ts"), "demand").withColumn(
        "epoch_day", F.unix_date(utc_day(F.col("ts"))))
    types = ", ".join(f"k{i} {amounts.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    schema = f"{types}, epoch_day int, demand double, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = daily.groupBy(*names).transformWithStateInPandas(LiveSeries(), schema, "append", "EventTime")
    with state_store(spark, ROCKS):
        run_to_end(rows, sink, sink + "-checkpoint")
    out = spark.read.schema(schema).parquet(sink)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], F.date_from_unix_date("epoch_day").alias("day"), "demand", *FEATURES)
