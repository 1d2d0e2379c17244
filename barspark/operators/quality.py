"""Checks, cleaning and gap columns of raw bars (symbol, bar_ts, ingest_seq, open, high, low, close, tick_volume, spread, real_volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.calendar import minute_of_day
from barspark.operators.frames import Frames

RESEARCH_START = "2017-01-01 00:00:00"


def invalid_ohlc() -> Column:
    """A missing or non-positive price, or one outside of high and low. Unknown counts as invalid."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    positive = (o > 0) & (h > 0) & (low > 0) & (c > 0)
    ordered = (h >= F.greatest(o, c)) & (low <= F.least(o, c)) & (low <= h)
    every = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
    return ~F.coalesce(every & positive & ordered, F.lit(False))


def invalid_spread() -> Column:
    return F.coalesce(F.col("spread") < 0, F.lit(True))


def negative_volume() -> Column:
    return F.coalesce(F.col("tick_volume") < 0, F.lit(False)) | F.coalesce(F.col("real_volume") < 0, F.lit(False))


def duplicate_timestamps(raw: DataFrame) -> DataFrame:
    """Every member of a time that occurs more than once in a symbol."""
    n = F.count("*").over(Window.partitionBy("symbol", "bar_ts"))
    return raw.withColumn("copies", n).filter("copies > 1")


def dedup_keep_last(raw: DataFrame) -> DataFrame:
    """The row of the highest ingest_seq for each symbol and time; partial maxima are taken before the shuffle."""
    rest = [c for c in raw.columns if c not in ("symbol", "bar_ts")]
    last = raw.groupBy("symbol", "bar_ts").agg(F.max_by(F.struct(*rest), "ingest_seq").alias("row"))
    return last.select("symbol", "bar_ts", "row.*").select(*raw.columns)


def gap_issues(bars: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """symbol, bar_ts, gap_seconds, previous_ts, issue_type, severity wherever more than one bar length lies between bars. A gap with a Saturday or Sunday in it is a closed market."""
    w = Frames("symbol", order="bar_ts")
    df = bars.withColumn("previous_ts", w.lag("bar_ts"))
    gap = F.timestamp_diff("SECOND", F.col("previous_ts"), F.col("bar_ts"))
    weekend = F.weekday("previous_ts") + F.datediff(F.to_date("bar_ts"), F.to_date("previous_ts")) >= 5
    df = df.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > bar_seconds)
    kind = F.when(weekend, F.lit("market_closed_gap")).otherwise(F.lit("unexpected_gap"))
    return df.select("symbol", "bar_ts", "gap_seconds", "previous_ts", kind.alias("issue_type"), F.when(weekend, F.lit("info")).otherwise(F.lit("warning")).alias("severity"))


def repeated_bar_runs(bars: DataFrame, least: int = 10, columns: tuple[str, ...] = ("open", "high", "low", "close", "spread")) -> DataFrame:
    """symbol, start_ts, n_bars of runs of at least ``least`` bars that are equal in the columns."""
    w = Frames("symbol", order="bar_ts")
    value = F.struct(*columns)
    new = ~F.coalesce(value.eqNullSafe(w.lag(value)), F.lit(False))
    runs = bars.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.so_far()))
    return runs.groupBy("symbol", "_run").agg(F.min("bar_ts").alias("start_ts"), F.count("*").alias("n_bars")).filter(F.col("n_bars") >= least).drop("_run")


def clean_bars(raw: DataFrame) -> DataFrame:
    return dedup_keep_last(raw).filter(~(invalid_ohlc() | invalid_spread() | negative_volume()))


def issues(raw: DataFrame, bar_seconds: int = 60, least_run: int = 10) -> DataFrame:
    """issue_type, symbol, bar_ts, severity, details of everything that is wrong with the raw bars."""

    def rows(df: DataFrame, kind: Column | str, ts: str, severity: Column | str, details: Column) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(lit(kind).alias("issue_type"), "symbol", F.col(ts).alias("bar_ts"), lit(severity).alias("severity"), details.alias("details"))

    checks = F.array(*(F.when(c, F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"))) for k, c, d in (
        ("invalid_ohlc", invalid_ohlc(), "prices are missing, not positive or out of order"), ("invalid_spread", invalid_spread(), "spread is missing or negative"), ("negative_volume", negative_volume(), "a volume is negative"),
    )))
    bad = raw.select("symbol", "bar_ts", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x"))
    gaps = gap_issues(dedup_keep_last(raw), bar_seconds)
    runs = repeated_bar_runs(clean_bars(raw), least_run)
    out = rows(duplicate_timestamps(raw), "duplicate_timestamp", "bar_ts", "warning", F.lit("the last row is kept"))
    out = out.unionByName(rows(bad, F.col("x.k"), "bar_ts", "error", F.col("x.d")))
    out = out.unionByName(rows(gaps, F.col("issue_type"), "bar_ts", F.col("severity"), F.concat(F.lit("gap_seconds="), F.col("gap_seconds").cast("string"))))
    return out.unionByName(rows(runs, "repeated_bar_run", "start_ts", "warning", F.concat(F.lit("bars="), F.col("n_bars").cast("string"))))


def summary(raw: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """One row a symbol: input_rows, clean_rows, removed_rows, non_monotonic_input and a map of issue counts."""
    late = F.coalesce(Frames("symbol", order="ingest_seq").lag("bar_ts") > F.col("bar_ts"), F.lit(False))
    seen = raw.withColumn("_late", late).groupBy("symbol").agg(F.count("*").alias("input_rows"), F.bool_or("_late").alias("non_monotonic_input"))
    good = clean_bars(raw).groupBy("symbol").agg(F.count("*").alias("clean_rows"))
    counts = issues(raw, bar_seconds).groupBy("symbol", "issue_type").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "n")))).alias("issue_counts"))
    out = seen.join(good, "symbol", "left").join(counts, "symbol", "left").withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0)))
    return out.select("symbol", "input_rows", "clean_rows", (F.col("input_rows") - F.col("clean_rows")).alias("removed_rows"), "non_monotonic_input", "issue_counts")


def research_window(bars: DataFrame, start: str = RESEARCH_START) -> DataFrame:
    return bars.filter(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))


def research_prefix(bars: DataFrame, n: int, start: str = RESEARCH_START) -> DataFrame:
    """The first n bars of each symbol in the research window; raises an error where there are fewer, also where a symbol has bars before the window only."""
    inside = F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz")
    counted = bars.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(Window.partitionBy("symbol")))
    short = F.assert_true(F.col("_n") >= n, F.lit("fewer bars than asked for"))
    w = Window.partitionBy("symbol").orderBy(F.desc("_in"), "bar_ts")
    return counted.filter(short.isNull()).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_in", "_n", "_place")


def gap_columns(bars: DataFrame, bar_seconds: int = 60, irregular_over: int = 300, cooldown: int = 200) -> DataFrame:
    """bars (with bar_idx) with gap_seconds, is_gap_after, is_scheduled_break_after, is_irregular_gap_after, entry_allowed and segment_id.

    A scheduled break is 45 minutes to 3 hours long, from 00:30-03:05 to 02:00-04:10 on the broker's clock. Entries are barred on the bar
    after an irregular gap and for the cooldown. Times that do not increase raise an error.
    """
    w = Frames("symbol")
    before, clock = w.lag("bar_ts"), minute_of_day(F.col("bar_ts"))
    df = bars.withColumn("gap_seconds", F.coalesce(F.timestamp_diff("SECOND", before, F.col("bar_ts")), F.lit(bar_seconds)))
    df = df.withColumn("gap_seconds", F.when(F.col("gap_seconds") > 0, F.col("gap_seconds")).otherwise(F.raise_error(F.lit("times must increase")).cast("long")))
    df = df.withColumn("_clock", clock).withColumn("_before", F.coalesce(w.lag(clock), clock))
    gap = F.col("gap_seconds") > bar_seconds
    scheduled = gap & F.col("gap_seconds").between(45 * 60, 3 * 60 * 60) & F.col("_before").between(30, 185) & F.col("_clock").between(120, 250)
    df = df.withColumn("is_gap_after", gap).withColumn("is_scheduled_break_after", scheduled)
    df = df.withColumn("is_irregular_gap_after", gap & (F.col("gap_seconds") > irregular_over) & ~scheduled)
    last = F.max(F.when(F.col("is_irregular_gap_after"), F.col("bar_idx"))).over(w.so_far())
    new = F.col("is_irregular_gap_after") & (F.col("bar_idx") > 0)
    out = df.withColumns({"entry_allowed": F.coalesce(F.col("bar_idx") - last >= cooldown, F.lit(True)), "segment_id": F.sum(new.cast("int")).over(w.so_far())})
    return out.drop("_clock", "_before")


