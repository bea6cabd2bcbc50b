"""Spending as a stream: an extension, with the batch rollup as its reference.

The days of spending are a running aggregation with a watermark. What a batch changed is written under the batch's number, so a batch
that is run again after a failure replaces its own output, and the newest row of each day is the day's total: every usage row counts
once, whatever stops and starts in between. A row that is later than the watermark is dropped by the state and counted nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from sheetloom.operators import jobs


def daily_spend(usage: DataFrame, pricing: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days over event time; rows later than `late` are dropped. usage may be a stream."""
    cost = jobs.priced(usage.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late), pricing)
    return cost.groupBy(F.window("at", "1 day")).agg(F.sum("usd").alias("usd"), F.count("*").alias("n")).select(F.col("window.start").alias("day"), "usd", "n")


def sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of use per job."""
    u = usage.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return u.groupBy("job_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n")).select("job_id", "s.start", "s.end", "n")


def file_stream(spark: SparkSession, folder: str, like: T.StructType, pattern: str = "*.parquet", files_a_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, so many a batch."""
    reader = spark.readStream.schema(like).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def start_daily(usage: DataFrame, pricing: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Starts (or resumes, by its checkpoint) the stream of days: takes what is there and ends."""

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return daily_spend(usage, pricing, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(spark: SparkSession, out: str) -> DataFrame:
    """(day, usd, n): the newest state of each day."""
    rows = spark.read.schema("day timestamp, usd double, n long, batch long").option("basePath", out).parquet(out)
    newest = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("batch")))
    return rows.withColumn("nth", newest).where("nth = 1").select("day", "usd", "n")
