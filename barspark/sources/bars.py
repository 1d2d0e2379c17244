"""Reading and writing bars, features and their summaries. Schemas are given, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("time", T.StringType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("tick_volume", T.LongType()), T.StructField("spread", T.LongType()), T.StructField("real_volume", T.LongType()),
])
ATR_NAMES = ("atr_14_lag1", "atr14_lag1", "atr14")
METADATA = ("digits", "point", "contract_size", "volume_min", "volume_max", "volume_step", "currency", "server_timezone")


def finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinite doubles as nulls."""
    bad = lambda x: F.isnan(x) | F.col(x).isin(float("inf"), float("-inf"))
    return df.withColumns({n: F.when(~bad(n), F.col(n)) for n, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with a header; ingest_seq (file, start of the split, row) follows the order of file names and lines, however Spark deals the files out."""
    df = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return finite(df.withColumn("ingest_seq", seq).withColumn("bar_ts", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss"))).drop("time"))


def write_bars_csv(bars: DataFrame, path: str) -> None:
    out = bars.withColumn("time", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss")).select(*BAR_SCHEMA.names)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.withColumn("bar_ts", F.col("bar_ts").cast("string")).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_features(features: DataFrame, path: str) -> None:
    """Zstandard Parquet by symbol and year; readers of a year prune the rest."""
    df = features.withColumn("part_year", F.year("bar_ts"))
    df.repartition("symbol", "part_year").sortWithinPartitions("symbol", "bar_idx").write.mode("overwrite").option("compression", "zstd").partitionBy("symbol", "part_year").parquet(path)


def read_features(spark: SparkSession, path: str, metadata: DataFrame) -> DataFrame:
    """Features beside their symbol's metadata, with atr from the first of ATR_NAMES that is there, and broker_date. Missing metadata raises ValueError."""
    df = spark.read.parquet(path)
    there = [n for n in ATR_NAMES if n in df.columns]
    lacking = [m for m in METADATA if m not in metadata.columns]
    if not there or lacking:
        raise ValueError(f"no ATR column or no metadata {lacking}")
    df = df.withColumn("atr", F.coalesce(*(F.col(n) for n in there)))
    if "broker_date" not in df.columns:
        df = df.withColumn("broker_date", F.date_format("bar_ts", "yyyy-MM-dd"))
    meta = F.broadcast(metadata.select("symbol", F.struct(*METADATA).alias("meta")))  # a row for each symbol
    out = df.join(meta, "symbol", "left")
    return out.withColumn("meta", F.when(F.col("meta").isNotNull(), F.col("meta")).otherwise(F.raise_error(F.lit("a symbol has no metadata")).cast(out.schema["meta"].dataType)))


def union_bar_chunks(chunks: list[DataFrame], zone: str = "EET") -> DataFrame:
    """Pages of exported bars (symbol, time in epoch seconds, ...), the later page wins where times repeat; bar_ts is the zone's wall clock."""
    out = None
    for n, chunk in enumerate(chunks):
        rows = chunk.withColumn("page", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    rest = [x for x in out.columns if x not in ("symbol", "time")]
    last = out.groupBy("symbol", "time").agg(F.max_by(F.struct(*rest), "page").alias("row")).select("symbol", "time", "row.*").drop("page")
    utc = F.timestamp_seconds("time").cast("timestamp_ntz")
    return last.withColumn("bar_ts", F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
