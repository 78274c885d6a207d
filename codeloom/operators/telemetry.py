"""Telemetry: summaries, shares, daily trends, recent events, exports, sync.

Every aggregate is a partial and a final hash aggregate; top-n is
TakeOrderedAndProject.  Nothing is collected.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_away, usd
from ..sources.tables import DAY_MS
from .ordered import numbered, write_parts


class TimeWindow(Enum):
    LAST_24H, LAST_7D, LAST_30D, LIFETIME = 1, 7, 30, 0

    def start_ms(self, now_ms: int) -> int:
        return max(now_ms - self.value * DAY_MS, 0) if self.value else 0


def in_window(events: DataFrame, window: TimeWindow, now_ms: int) -> DataFrame:
    """A filter on the raw epoch column, which Parquet statistics can prune."""
    return events if window is TimeWindow.LIFETIME else events.filter(F.col("timestamp") >= window.start_ms(now_ms))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def summary(events: DataFrame, window: TimeWindow = TimeWindow.LIFETIME, now_ms: int = 0) -> DataFrame:
    """One row, of zeros for an empty table.  The ratio is that of the sums and
    may be negative."""
    kind = F.col("event_type")
    sums = in_window(events, window, now_ms).agg(
        F.count(F.lit(1)).alias("total_events"),
        _count(kind == "slice").alias("total_slices"),
        _total("raw_tokens").alias("total_raw_tokens"),
        _total("sliced_tokens").alias("total_sliced_tokens"),
        _total("tokens_saved").alias("total_tokens_saved"),
        F.coalesce(F.avg("latency_us"), F.lit(0.0)).alias("avg_latency_us"),
        _count((kind == "guard_check") & (F.col("status") == "violation")).alias("boundary_violations_caught"),
        _count(kind == "sandbox_run").alias("sandboxed_runs"),
    )
    return with_rates(sums)


def with_rates(sums: DataFrame) -> DataFrame:
    """Totals with the ratio of the sums and what was saved."""
    ratio = F.when(F.col("total_raw_tokens") > 0, F.lit(1.0) - F.try_divide(F.col("total_sliced_tokens").cast("double"), F.col("total_raw_tokens").cast("double"))).otherwise(0.0)
    return sums.select("*", ratio.alias("compression_ratio"), usd(F.col("total_tokens_saved")).alias("estimated_usd_saved"))


def client_breakdown(events: DataFrame) -> DataFrame:
    """Events and saved tokens of each client with its share of all saved."""
    by = events.groupBy("client_id").agg(F.count(F.lit(1)).alias("events_count"), _total("tokens_saved").alias("tokens_saved"))
    # The sum of all, one row, goes to the clients wherever they are.
    all_of_them = by.agg(F.sum("tokens_saved").alias("total")).withColumn("one", F.lit(1))
    total = F.col("total")
    share = F.when(total > 0, round_half_away(F.try_divide(F.col("tokens_saved").cast("double"), total.cast("double")) * 100.0, 1)).otherwise(0.0)
    both = by.withColumn("one", F.lit(1)).join(F.broadcast(all_of_them), "one")
    return both.select("client_id", "events_count", "tokens_saved", share.alias("percentage")).orderBy(F.desc("tokens_saved"), "client_id")


def utc_date(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(DAY_MS)).cast("int")).cast("string")


def daily_velocity(events: DataFrame, days: int, now_ms: int) -> DataFrame:
    """Sums by UTC date of the last ``days``; days without events have no row."""
    recent = events.filter(F.col("timestamp") >= max(now_ms - days * DAY_MS, 0))
    by = recent.groupBy(utc_date(F.col("timestamp")).alias("date")).agg(_total("tokens_saved").alias("tokens_saved"), F.count(F.lit(1)).alias("events_count"))
    return by.withColumn("usd_saved", usd(F.col("tokens_saved"))).orderBy("date")


def sync_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), _count(F.col("synced") == 0).alias("unsynced"))


def recent(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def unsynced(events: DataFrame, limit: int = 500) -> DataFrame:
    return events.filter("synced = 0").orderBy("timestamp", "id").limit(limit)


def zero_pii(events: DataFrame) -> DataFrame:
    """Without paths, symbols and free-form data."""
    return events.select(F.col("id").alias("event_id"), "timestamp", "client_id", "event_type", "raw_tokens", "sliced_tokens", "tokens_saved", "latency_us", "status")


def mark_synced(events: DataFrame, ids: DataFrame) -> DataFrame:
    """``events`` with synced = 1 where ``ids`` (id) has the event."""
    acked = ids.select(F.col("id").alias("acked")).distinct()
    joined = events.join(acked, F.col("id") == F.col("acked"), "left")
    return joined.withColumn("synced", F.when(F.col("acked").isNotNull(), 1).otherwise(F.col("synced"))).drop("acked")


def sync_batch(events: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The oldest unsynced packets without personal data, and the table after."""
    batch = unsynced(events, limit)
    return zero_pii(batch), mark_synced(events, batch.select("id"))


def sync_report(events: DataFrame, org_id: str, limit: int = 500) -> DataFrame:
    """What syncing one batch does: events sent, events still waiting."""
    n = F.sum(F.when(F.col("synced") == 0, 1).otherwise(0)).cast("long")
    sent = F.least(F.coalesce(n, F.lit(0).cast("long")), F.lit(limit).cast("long"))
    message = F.when(F.col("total_synced") == 0, "nothing to sync").otherwise(F.concat(F.col("total_synced").cast("string"), F.lit(" events synced")))
    return events.agg(sent.alias("total_synced"), (F.coalesce(n, F.lit(0).cast("long")) - sent).alias("pending_remaining")).withColumn("org_id", F.lit(org_id)).withColumn("message", message)


def status(events: DataFrame, org_id: str | None) -> DataFrame:
    """Events, events that wait, and the organisation, if any."""
    return sync_counts(events).withColumn("org_id", F.lit(org_id).cast("string"))


def new_slice(slices: DataFrame, client_id: str, now_ms: int) -> DataFrame:
    """A telemetry event for each slice (file_path, target_symbol, tokens)."""
    saved = F.greatest(F.col("original_file_tokens") - F.col("estimated_tokens"), F.lit(0).cast("long"))
    return slices.select(F.uuid().alias("id"), F.lit(now_ms).alias("timestamp"), F.lit(client_id).alias("client_id"), F.lit("slice").alias("event_type"), "file_path", F.col("target_symbol").alias("symbol_name"), F.col("original_file_tokens").alias("raw_tokens"), F.col("estimated_tokens").alias("sliced_tokens"), saved.alias("tokens_saved"), F.lit(0).cast("long").alias("latency_us"), F.lit("success").alias("status"), F.lit(0).alias("synced"), F.lit(None).cast("string").alias("extra_json"))


def new_guard_checks(reports: DataFrame, client_id: str, now_ms: int) -> DataFrame:
    """A telemetry event for each report row (violations)."""
    n = F.col("violations")
    zero = F.lit(0).cast("long")
    return reports.select(F.uuid().alias("id"), F.lit(now_ms).alias("timestamp"), F.lit(client_id).alias("client_id"), F.lit("guard_check").alias("event_type"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("symbol_name"), zero.alias("raw_tokens"), zero.alias("sliced_tokens"), zero.alias("tokens_saved"), zero.alias("latency_us"), F.when(n == 0, "passed").otherwise("violation").alias("status"), F.lit(0).alias("synced"), F.to_json(F.struct(n.alias("violations_count"))).alias("extra_json"))


#: Newest events of an export, unless it asks for another number or for all.
EXPORT_LIMIT = 100_000
CSV_COLUMNS = ["id", "timestamp", "client_id", "event_type", "file_path", "symbol_name", "raw_tokens", "sliced_tokens", "tokens_saved", "latency_us", "status"]
_PLAIN = {"id", "timestamp", "raw_tokens", "sliced_tokens", "tokens_saved", "latency_us"}


def _exported(events: DataFrame, limit: int | None) -> DataFrame:
    return events if limit is None else recent(events, limit)


def _csv_line() -> Column:
    """Text in quotes (its quotes doubled), null as empty text."""
    field = lambda c: F.col(c).cast("string") if c in _PLAIN else F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[field(c) for c in CSV_COLUMNS])


def _json_line() -> Column:
    return F.to_json(F.struct(*CSV_COLUMNS, "extra_json"), {"ignoreNullFields": "false"})


def csv_lines(events: DataFrame, limit: int | None = EXPORT_LIMIT) -> DataFrame:
    """CSV lines of the newest events (all, if there is no limit)."""
    return _exported(events, limit).select("id", _csv_line().alias("line"))


def json_lines(events: DataFrame, limit: int | None = EXPORT_LIMIT) -> DataFrame:
    return _exported(events, limit).select("id", _json_line().alias("line"))


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def numbered_lines(events: DataFrame, form: str = "csv") -> DataFrame:
    """(row_no, id, line) of all events, numbered from the newest on."""
    rows = numbered(events, newest_first())
    return rows.select("row_no", "id", (_csv_line() if form == "csv" else _json_line()).alias("line"))


def export_parts(events: DataFrame, path: str, form: str = "csv", limit: int | None = None) -> dict:
    """Any number of events, the newest first, in numbered files with a
    manifest; the header of CSV is there once."""
    head = ",".join(CSV_COLUMNS) + "\n" if form == "csv" else ""
    return write_parts(_exported(events, limit), newest_first(), _csv_line() if form == "csv" else _json_line(), path, head)


def event_rows(events: DataFrame, limit: int) -> DataFrame:
    """What a list of recent events shows of each."""
    pct = F.when(F.col("raw_tokens") > 0, F.round(F.try_divide(F.col("tokens_saved").cast("double"), F.col("raw_tokens").cast("double")) * 100)).otherwise(0).cast("long")
    label = F.coalesce(F.nullif(F.col("symbol_name"), F.lit("")), F.nullif(F.col("file_path"), F.lit("")), F.lit("-"))
    return recent(events, limit).select("id", "client_id", "event_type", label.alias("label"), pct.alias("saved_pct"), round_half_away(F.col("latency_us") / F.lit(1000.0), 2).alias("latency_ms"))


def ledger(events: DataFrame, cap: int = 50) -> DataFrame:
    """The newest slices with a falling number, as a capped ledger keeps them."""
    kept = recent(events.filter("event_type = 'slice'"), cap)
    number = F.row_number().over(Window.partitionBy().orderBy("timestamp", "id"))
    pct = F.when(F.col("raw_tokens") > 0, round_half_away(F.try_divide(F.col("tokens_saved").cast("double"), F.col("raw_tokens").cast("double")) * 100, 1)).otherwise(0.0)
    return kept.select("id", "timestamp", "symbol_name", "raw_tokens", "sliced_tokens", "tokens_saved", number.alias("number"), pct.alias("compression_pct"))


def ledger_metrics(kept: DataFrame) -> DataFrame:
    """Mean of the records' percentages, unlike the summary's ratio of sums."""
    return kept.agg(F.count(F.lit(1)).alias("total_slices"), _total("tokens_saved").alias("total_tokens_saved"), usd(_total("tokens_saved")).alias("total_usd_saved"), F.coalesce(round_half_away(F.avg("compression_pct"), 1), F.lit(0.0)).alias("avg_compression"))


def roi(teams: DataFrame) -> DataFrame:
    """Projection from team_size, prompts_per_day and price_per_million."""
    tokens = (F.col("team_size") * F.col("prompts_per_day") * 9500 * 21).cast("long")
    return teams.select("*", tokens.alias("tokens_monthly"), (tokens / F.lit(1e6) * F.col("price_per_million")).alias("usd_monthly"), F.round(F.col("team_size") * 2.5 * 12).cast("long").alias("hours_annual"))
