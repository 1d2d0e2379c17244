"""Wall-clock, time-zone and session columns. Times are TIMESTAMP_NTZ on the broker's wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROKER_ZONE = "EET"
#: name: (zone, start, end); the end is exclusive.
SESSIONS = {"asia": ("Asia/Tokyo", "09:00", "18:00"), "london": ("Europe/London", "08:00", "17:00"), "new_york": ("America/New_York", "08:00", "17:00")}


def utc(ts: Column, zone: str = BROKER_ZONE) -> Column:
    """The UTC wall clock of a zone's wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def local(utc_ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_ts.cast("timestamp_ntz"))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a wall clock read as UTC."""
    return F.unix_timestamp(ts.cast("timestamp_ntz").cast("timestamp"))


def to_utc_epoch(ts: Column, semantics: str, zone: str = BROKER_ZONE) -> Column:
    """legacy_wall_clock reads the wall clock as UTC; broker_local_to_utc converts it. Wall clocks that the zone skips or repeats raise an error."""
    if semantics == "legacy_wall_clock":
        return epoch(ts)
    if semantics != "broker_local_to_utc":
        raise ValueError(f"unknown semantics {semantics!r}")
    at = utc(ts, zone)
    hour = F.expr("interval 1 hour")
    skipped = local(at, zone) != ts
    repeated = (local(at - hour, zone) == ts) | (local(at + hour, zone) == ts)
    wrong = F.raise_error(F.concat(F.lit("no single UTC time for "), ts.cast("string"))).cast("long")
    return F.when(skipped | repeated, wrong).otherwise(epoch(at))


def legacy_epoch_to_utc(seconds: Column, zone: str = BROKER_ZONE) -> Column:
    """An epoch that was made from a broker wall clock read as UTC, as the true epoch."""
    return epoch(utc(F.timestamp_seconds(seconds).cast("timestamp_ntz"), zone))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def _minutes(clock: str) -> int:
    hour, minute = clock.split(":")
    if not (0 <= int(hour) < 24 and 0 <= int(minute) < 60):
        raise ValueError(f"no HH:MM clock: {clock!r}")
    return int(hour) * 60 + int(minute)


def session_flag(ts: Column, zone: str, start: str, end: str, broker_zone: str = BROKER_ZONE) -> Column:
    """Whether the zone's clock is in [start, end), which may go over midnight; equal clocks mean always."""
    lo, hi = _minutes(start), _minutes(end)
    now = minute_of_day(local(utc(ts, broker_zone), zone))
    if lo == hi:
        return F.lit(True)
    return ((now >= lo) & (now < hi)) if lo < hi else ((now >= lo) | (now < hi))


def add_sessions(bars: DataFrame, sessions: dict = SESSIONS, broker_zone: str = BROKER_ZONE) -> DataFrame:
    flags = {f"session_{k}": session_flag(F.col("bar_ts"), *v, broker_zone) for k, v in sessions.items()}
    out = bars.withColumns(flags)
    return out.withColumn("session_overlap", F.col("session_london") & F.col("session_new_york"))


def add_calendar(bars: DataFrame) -> DataFrame:
    """broker_date, year, month, weekday (Monday 0), hour, minute."""
    ts = F.col("bar_ts")
    return bars.withColumns({"broker_date": F.date_format(ts, "yyyy-MM-dd"), "year": F.year(ts), "month": F.month(ts), "weekday": F.weekday(ts), "hour": F.hour(ts), "minute": F.minute(ts)})


def calendar_groups(bars: DataFrame) -> DataFrame:
    """Compact ids of day, month and year in time order, by symbol: ranks over the distinct days, of which there are few, joined back."""
    days = bars.select("symbol", F.to_date("bar_ts").alias("day")).distinct()
    w = Window.partitionBy("symbol")
    ids = days.select(
        "symbol", "day", (F.dense_rank().over(w.orderBy("day")) - 1).alias("day_id"),
        (F.dense_rank().over(w.orderBy(F.trunc("day", "month"))) - 1).alias("month_id"), (F.dense_rank().over(w.orderBy(F.trunc("day", "year"))) - 1).alias("year_id"),
    )
    return bars.withColumn("day", F.to_date("bar_ts")).join(ids, ["symbol", "day"]).drop("day")
