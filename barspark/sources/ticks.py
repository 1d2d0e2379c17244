"""The tick store: Parquet by broker_date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000


def with_zoned_times(ticks: DataFrame, zone: str = "EET") -> DataFrame:
    """ticks (symbol, time_msc, bid, ask) with time_utc, time_broker and broker_date."""
    utc = F.timestamp_millis("time_msc").cast("timestamp_ntz")
    df = ticks.withColumn("time_utc", utc).withColumn("time_broker", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("time_utc")))
    return df.withColumn("broker_date", F.date_format("time_broker", "yyyy-MM-dd"))


def write_ticks(ticks: DataFrame, path: str, first_day: str, end_day: str, zone: str = "EET") -> None:
    """The ticks of broker days in [first_day, end_day); a day is split by hour over tasks, so that a busy day is not one task's."""
    df = with_zoned_times(ticks.drop("broker_date"), zone).filter((F.col("broker_date") >= first_day) & (F.col("broker_date") < end_day))
    df = df.repartition("broker_date", F.hour("time_broker")).sortWithinPartitions("broker_date", "time_msc")
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("broker_date").parquet(path)


def read_ticks(spark: SparkSession, path: str, from_msc: int, to_msc: int) -> DataFrame:
    """symbol, time_msc, bid, ask in [from_msc, to_msc]. Folders of days further off than a zone can shift are pruned; the rest is pushed down to the row groups."""
    day = lambda msc: F.date_format(F.timestamp_millis(F.lit(msc)).cast("timestamp_ntz"), "yyyy-MM-dd")
    df = spark.read.option("basePath", path).parquet(path).withColumn("broker_date", F.col("broker_date").cast("string"))
    near = F.col("broker_date").between(day(from_msc - DAY), day(to_msc + DAY))
    return df.filter(near & F.col("time_msc").between(from_msc, to_msc)).select("symbol", "time_msc", "bid", "ask")
