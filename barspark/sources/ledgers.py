"""Deal ledgers, logs and history archives as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = ("commission", "swap", "profit", "fee", "slippage", "adjustment")


def number(c: Column) -> Column:
    """A number written with spaces or thousands commas, or null."""
    return F.regexp_replace(c, r"[\s,]", "").try_cast("double")


def pair_deals(deals: DataFrame, symbol: str | None = None) -> DataFrame:
    """Trades of deals (account, symbol, time, entry in or out, side, volume, price, and MONEY columns as text): each in-deal with the out-deal that follows it. An unpaired deal raises an error."""
    df = deals if symbol is None else deals.filter(F.col("symbol") == symbol)
    there = [m for m in MONEY if m in df.columns]
    df = df.withColumns({x: number(F.col(x)) for x in ("volume", "price", *there)})
    w = Window.partitionBy("account", "symbol").orderBy("time")
    net = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in there), F.lit(0.0))
    df = df.withColumns({"_net": net, "_n": F.row_number().over(w)})
    df = df.withColumns({"exit_time": F.lead("time").over(w), "exit_price": F.lead("price").over(w), "_next": F.lead("entry").over(w), "_next_net": F.lead("_net").over(w)})
    odd = F.when((F.col("_n") % 2 == 1) == (F.col("entry") == "in"), F.lit(True)).otherwise(F.raise_error(F.lit("a deal is unpaired")).cast("boolean"))
    ins = df.filter(odd)
    paired = F.when(F.col("entry") != "in", F.lit(False)).when(F.col("_next") == "out", F.lit(True)).otherwise(F.raise_error(F.lit("a deal is unpaired")).cast("boolean"))
    return ins.filter(paired).select("account", "symbol", F.col("time").alias("entry_time"), "exit_time", "side", "volume", F.col("price").alias("entry_price"), "exit_price", (F.col("_net") + F.col("_next_net")).alias("net"))


# Fixed values of the log's format.
_STAMP = r"(\d{4}[.-]\d{2}[.-]\d{2} \d{2}:\d{2}:\d{2})"
_ENTRY = r"(?i)(BUY|SELL)\s*\|\s*volume=([0-9.]+)\s*\|\s*ATR=([0-9.]+)\s*\|\s*SL=([0-9.]+)\s*\|\s*TP=([0-9.]+)"
EXIT_PHRASES = {"stop loss triggered": "SL", "take profit triggered": "TP", "position closed due end of test": "END_OF_TEST"}
GUARD_PHRASES = {
    "No trade: spread=": "SKIPPED_SPREAD_GUARD", "Indicator data unavailable.": "SKIPPED_INDICATOR_DATA", "HTF completed-bar data unavailable": "SKIPPED_HTF_DATA",
    "Trade skipped: invalid/below-minimum volume.": "SKIPPED_VOLUME_GUARD", "OrderCalcProfit failed": "SKIPPED_RISK_CALC", "Order failed |": "SKIPPED_ORDER_FAILED",
}
RUN_END, BALANCE_LINE = "Test passed in", "final balance"


def _phrase(text: Column, phrases: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in phrases.items()))


def parse_log(lines: DataFrame, start_marker: str = "run started", bucket_seconds: int = 300) -> DataFrame:
    """source, line_no, ts, bucket, kind (entry, exit or guard), reason, and of entries direction, volume, atr, stop and target, of the last run in lines (source, line_no, text).

    A run stands behind the last start marker of a source, up to its first end line, or else its last line of a final balance, or else the end. Guards and exits are known by
    ``guard=reason``, ``EXIT`` or the phrases above.
    """
    w = Window.partitionBy("source")
    text, line = F.col("text"), F.col("line_no")
    df = lines.withColumn("_start", F.max(F.when(F.contains(text, F.lit(start_marker)), line)).over(w))
    inside = F.col("_start").isNull() | (line > F.col("_start"))
    end = F.coalesce(F.min(F.when(inside & F.contains(text, F.lit(RUN_END)), line)).over(w), F.max(F.when(inside & F.contains(text, F.lit(BALANCE_LINE)), line)).over(w))
    df = df.withColumn("_end", end).filter(inside & (F.col("_end").isNull() | (line <= F.col("_end"))))
    ts = F.to_timestamp_ntz(F.regexp_replace(F.regexp_extract("text", _STAMP, 1), r"\.", "-"), F.lit("yyyy-MM-dd HH:mm:ss"))
    guard = F.coalesce(F.nullif(F.regexp_extract("text", r"\bguard=(\w+)", 1), F.lit("")), _phrase(text, GUARD_PHRASES))
    ended = _phrase(F.lower(text), EXIT_PHRASES)
    entered = F.rlike("text", F.lit(_ENTRY)) | F.rlike("text", F.lit(r"\bENTRY\b"))
    kind = F.when(guard.isNotNull(), "guard").when(entered, "entry").when(ended.isNotNull() | F.rlike("text", F.lit(r"\bEXIT\b")), "exit")
    df = df.filter(F.regexp_extract("text", _STAMP, 1) != "").withColumns({"ts": ts, "kind": kind, "reason": F.coalesce(guard, F.when(~entered, ended))})
    part = lambda k: F.nullif(F.regexp_extract("text", _ENTRY, k), F.lit(""))
    fields = {"direction": F.upper(part(1)), **{name: part(k + 2).try_cast("double") for k, name in enumerate(("volume", "atr", "stop", "target"))}}
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / bucket_seconds).alias("bucket")
    return df.filter("kind is not null").select("source", "line_no", "ts", bucket, "kind", "reason", *(F.when(F.col("kind") == "entry", v).alias(k) for k, v in fields.items()))


def log_trades(events: DataFrame) -> DataFrame:
    """source, entry_time, exit_time, direction, volume, stop, target, exit_reason: each entry with the exit behind it. An exit without an entry is left out; an entry into an open trade, or one that is never closed, raises an error."""
    w = Window.partitionBy("source").orderBy("line_no")
    df = events.filter("kind != 'guard'")
    df = df.withColumns({"_next": F.lead("kind").over(w), "exit_time": F.lead("ts").over(w), "exit_reason": F.lead("reason").over(w)})
    closed = F.when(F.col("_next") == "exit", F.lit(True)).otherwise(F.raise_error(F.lit("a trade of the log is not closed before the next one")).cast("boolean"))
    return df.filter("kind = 'entry'").filter(closed).select("source", F.col("ts").alias("entry_time"), "exit_time", "direction", "volume", "stop", "target", "exit_reason")


def first_guards(events: DataFrame) -> DataFrame:
    """source, bucket, reason: the first guard of each bucket."""
    return events.filter("kind = 'guard'").groupBy("source", "bucket").agg(F.min_by("reason", "line_no").alias("reason"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no, text of text files; line_no (start of the split, row) grows along a file."""
    df = spark.read.text(path)
    line = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("_metadata.file_path").alias("source"), line.alias("line_no"), F.col("value").alias("text"))


# Fixed values of the file formats: of the keys of a field, the first one that is there counts.
HISTORY_KEYS = {
    "strategy_family": ("strategy_family", "family"), "strategy_name": ("strategy_name", "strategy", "name"), "status": ("status", "decision"),
}
RESULT_KEYS = {
    "net_profit": ("net_profit", "profit", "net_pnl"), "profit_factor": ("profit_factor", "pf"), "after_cost_profit": ("after_cost_profit", "after_cost_pnl"), "after_cost_pf": ("after_cost_pf", "after_cost_profit_factor"),
    "trades": ("trades", "completed_trades", "total_trades"), "max_drawdown_pct": ("max_drawdown_pct", "drawdown_pct"),
}
ID_KEYS = ("historical_id", "lab_id", "experiment_id", "id")
SOURCE_KEYS = ("source_file", "report_file", "source")
NOTE_KEYS = ("build", "notes", "reason", "symbol", "terminal_build", "timeframe")
ORIGIN = "historical_mt5"


def _first(json: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys))


def _json_value(json: Column, key: str) -> Column:
    """The value as JSON, or null where there is none."""
    found = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(~F.is_variant_null(found), F.to_json(found))


def history(ledger_lines: DataFrame, results: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row for each ledger line (text) that is JSON with an id, beside the results and manifest (historical_id, text, and perhaps file) of that id, with the notes of manifest and ledger as JSON."""
    rows = ledger_lines.withColumn("historical_id", F.nullif(F.trim(_first(F.col("text"), ID_KEYS)), F.lit(""))).filter("historical_id is not null")
    rows = rows.select("historical_id", F.lit(ORIGIN).alias("origin"), *(_first(F.col("text"), v).alias(k) for k, v in HISTORY_KEYS.items()), F.struct(*(_json_value(F.col("text"), k).alias(k) for k in NOTE_KEYS)).alias("_own"))

    def figure(name: str, keys: tuple[str, ...]) -> Column:
        x = _first(F.col("text"), keys).try_cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        return (x.cast("long") if name == "trades" else x).alias(name)

    file = lambda df, name: (F.col("file") if "file" in df.columns else F.lit(None).cast("string")).alias(name)
    res = results.select("historical_id", *(figure(k, v) for k, v in RESULT_KEYS.items()), file(results, "results_file"))
    man = manifests.select("historical_id", _first(F.col("text"), SOURCE_KEYS).alias("source_file"), file(manifests, "manifest_file"), F.struct(*(_json_value(F.col("text"), k).alias(k) for k in NOTE_KEYS)).alias("_theirs"))
    df = rows.join(res, "historical_id", "left").join(man, "historical_id", "left")
    notes = F.array_compact(F.array(*(F.concat(F.lit(f'"{k}":'), F.coalesce(F.col("_theirs")[k], F.col("_own")[k])) for k in NOTE_KEYS)))
    return df.withColumn("evidence_notes", F.when(F.size(notes) > 0, F.concat(F.lit("{"), F.array_join(notes, ","), F.lit("}")))).drop("_own", "_theirs")
