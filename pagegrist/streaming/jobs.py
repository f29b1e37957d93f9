"""Structured Streaming over landed pages and attempts: windows, sessions, de-duplication. Gates with state are in gates.py.

Every job takes a streaming (or batch) DataFrame and returns one; the caller picks source, sink and trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import shared_dir

ATTEMPTS = "seq long, request_id long, domain string, engine string, elapsed_ms long, error_code string, ts timestamp"


def read_landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they land."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once it has read all that has landed so far: written batch by batch to the shared folder, then read.

    In complete mode each batch replaces the one before, so the last one's result stays.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out"))
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out")
    writer.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def rates(attempts: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """By domain and window: attempts and failures; rows later than the watermark are left out."""
    w = attempts.withWatermark("ts", late).groupBy("domain", F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.coalesce("error_code", F.lit("")) != "").alias("n_failed"))
    return w.select("domain", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "n_failed")


def sessions(attempts: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of attempts on a domain without a gap."""
    s = attempts.withWatermark("ts", late).groupBy("domain", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return s.select("domain", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "elapsed_ms")


def first_seen(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first page of each canonical address within the watermark."""
    return pages.withColumn("canonical", U.canonical(F.col("url"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["canonical"])
