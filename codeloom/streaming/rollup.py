"""Day sums of telemetry, kept by each append.

A row has the sums of a day, client, event type and status.  They add up, so a
window's totals come from the days in it; of the events only those of a day
that the window cuts are read again.  Each batch of a source is added once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round_half_away, usd
from ..operators import telemetry
from ..sources.tables import DAY_MS
from .buckets import MergeTable

KEYS = ["day", "client_id", "event_type", "status"]
SUMS = ["events", "raw_tokens", "sliced_tokens", "tokens_saved", "latency_us", "timed"]
SCHEMA = "day BIGINT, client_id STRING, event_type STRING, status STRING, " + ", ".join(f"{c} BIGINT" for c in SUMS)


def day_sums(events: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: one for each group, and partial sums before the
    shuffle.  Null names are kept."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    day = F.floor(F.col("timestamp") / F.lit(DAY_MS)).cast("long").alias("day")
    return events.groupBy(day, "client_id", "event_type", "status").agg(F.count(F.lit(1)).alias("events"), *[total(c) for c in SUMS[1:-1]], F.count("latency_us").alias("timed"))


def added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class DaySums:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = MergeTable(spark, path, SCHEMA, ["day", "client_id", "event_type", "status"], buckets)

    def add(self, events: DataFrame, batch: int, source: str = "appends") -> None:
        self.table.merge(day_sums(events), lambda old, new: added(old.unionByName(new)), source, batch)

    def since(self, events: DataFrame, start_ms: int) -> DataFrame:
        """Day sums of the events from a time on: the whole days from the table,
        and the day that it falls into from ``events``, whose filter on the
        time reaches the scan."""
        first = -(-start_ms // DAY_MS)
        whole = self.table.read().filter(F.col("day") >= first)
        if start_ms % DAY_MS == 0:
            return whole
        return whole.unionByName(day_sums(events.filter((F.col("timestamp") >= start_ms) & (F.col("timestamp") < first * DAY_MS))))

    def _window(self, events: DataFrame, window: telemetry.TimeWindow, now_ms: int) -> DataFrame:
        return self.table.read() if window is telemetry.TimeWindow.LIFETIME else self.since(events, window.start_ms(now_ms))

    def summary(self, events: DataFrame, window: telemetry.TimeWindow = telemetry.TimeWindow.LIFETIME, now_ms: int = 0) -> DataFrame:
        """As ``telemetry.summary``."""
        total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0)).cast("long")
        kind = F.col("event_type")
        sums = self._window(events, window, now_ms).agg(
            total("events").alias("total_events"),
            total("events", kind == "slice").alias("total_slices"),
            *[total(c).alias(f"total_{c}") for c in ("raw_tokens", "sliced_tokens", "tokens_saved")],
            F.coalesce(F.try_divide(F.sum("latency_us").cast("double"), F.sum("timed")), F.lit(0.0)).alias("avg_latency_us"),
            total("events", (kind == "guard_check") & (F.col("status") == "violation")).alias("boundary_violations_caught"),
            total("events", kind == "sandbox_run").alias("sandboxed_runs"),
        )
        return telemetry.with_rates(sums)

    def client_breakdown(self, events: DataFrame, window: telemetry.TimeWindow = telemetry.TimeWindow.LIFETIME, now_ms: int = 0) -> DataFrame:
        """(client_id, events_count, tokens_saved, percentage)."""
        sums = self._window(events, window, now_ms)
        # The clients and their sum from one pass.
        both = sums.rollup("client_id").agg(F.grouping("client_id").alias("g"), F.sum("events").alias("events_count"), F.sum("tokens_saved").alias("tokens_saved"))
        total = both.filter("g = 1").select(F.col("tokens_saved").alias("total"), F.lit(0).alias("g"))
        by = both.filter("g = 0").join(F.broadcast(total), "g")
        share = F.when(F.col("total") > 0, round_half_away(F.try_divide(F.col("tokens_saved").cast("double"), F.col("total").cast("double")) * 100.0, 1)).otherwise(0.0)
        return by.select("client_id", "events_count", "tokens_saved", share.alias("percentage"))

    def daily_velocity(self, events: DataFrame, days: int, now_ms: int) -> DataFrame:
        """As ``telemetry.daily_velocity``."""
        sums = self.since(events, max(now_ms - days * DAY_MS, 0))
        date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("string")
        by = sums.groupBy(date.alias("date")).agg(F.sum("tokens_saved").alias("tokens_saved"), F.sum("events").alias("events_count"))
        return by.withColumn("usd_saved", usd(F.col("tokens_saved"))).orderBy("date")
