"""Documents as a stream: new and changed ones are handed on, unchanged ones are not.

Each micro-batch is compared with the ledger kept as Parquet; a batch that runs
again after a failure writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash

_LEDGER = "key string, hash string, batch long"


def current_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last hash of each document."""
    try:
        rows = spark.read.schema(_LEDGER).option("recursiveFileLookup", True).parquet(path)
    except Exception as error:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], _LEDGER)
    last = Window.partitionBy("key").orderBy(F.desc("batch"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def ingest_stream(documents: DataFrame, ledger_path: str, checkpoint: str, apply: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Start handing ``documents(key, text)`` to ``apply(changed, batch)``; the last of repeated keys counts."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        hashed = rows.select("key", "text", content_hash(F.coalesce("text", F.lit(""))).alias("hash")).groupBy("key").agg(F.max_by("text", "hash").alias("text"), F.max("hash").alias("hash"))
        known = current_ledger(spark, ledger_path).where(F.col("batch") < number).select("key", "hash")
        fresh = hashed.join(known, ["key", "hash"], "left_anti").persist()
        apply(fresh.select("key", "text"), number)
        fresh.select("key", "hash", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/part-{number}")
        fresh.unpersist()

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per kind and window of event time, with late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
