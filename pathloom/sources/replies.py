"""Replies of an extractor, kept window by window, so that work that was broken off is taken up where it ended."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.ingest import EXTRACTION
from ..operators.lineage import scratch_path, settled
from . import snapshot

SCHEMA = "hash string, reply string, attempts int, error string"
NOT_ASKED = "not asked"


def parse_error(reply: Column) -> Column:
    """What keeps a reply from being read as an extraction; null if nothing does."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    # with an option given, Spark reads all fields though only one is used
    read = F.from_json(body, EXTRACTION.replace("struct<", "struct<_corrupt_record:string,", 1), {"mode": "PERMISSIVE"})
    return F.when(reply.isNull(), "no reply").when(body == "", "no object").when(read["_corrupt_record"].isNotNull(), "not an extraction")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """``(hash, reply, attempts, error)`` of all windows; of several replies to a text one that can be read."""
    if not snapshot.versions(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(f"{folder.rstrip('/')}/v*/replies")
    best = F.min_by(F.struct("reply", "attempts", "error"), F.struct(F.col("error").isNotNull().alias("bad"), "attempts", "reply"))
    return rows.groupBy("hash").agg(best.alias("r")).select("hash", "r.*")


def _asked(texts: DataFrame, extract: Callable[[DataFrame], DataFrame], attempts: int) -> DataFrame:
    """``texts(hash, text)`` with their replies; those that can't be read are asked for again, with the error."""
    left, done = texts.withColumn("error", F.lit(None).cast("string")), None
    for n in range(1, attempts + 1):
        replies = extract(left.select(F.col("hash").alias("chunk"), "text", "error")).groupBy(F.col("chunk").alias("hash")).agg(F.min("reply").alias("reply"))
        tried = left.select("hash", "text").join(replies, "hash", "left")
        tried = settled(tried.withColumn("attempts", F.lit(n)).withColumn("error", parse_error(F.col("reply"))))
        kept = (tried if n == attempts else tried.where("error is null")).select("hash", "reply", "attempts", "error")
        done = kept if done is None else done.unionByName(kept)
        left = tried.where("error is not null")
    return done


def extracted(
    chunks: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    folder: str,
    version: str = "1",
    size: int = 1_000_000,
    attempts: int = 2,
    windows: int | None = None,
) -> DataFrame:
    """``chunks(chunk, text)`` to ``(chunk, reply, attempts, error)``.

    ``extract`` turns ``(chunk, text, error)`` into ``(chunk, reply)``; equal
    texts are asked for once. Texts without a readable reply in ``folder`` are
    dealt by hash into windows of about ``size``, and a window's replies appear
    there at once, by a rename. So a run that breaks off loses one window, and
    the next one asks only for the rest and for what failed every attempt.
    ``windows`` ends the call after so many; what is left has the error
    ``not asked``. ``version`` names the extractor: another one asks anew.
    A null text counts as empty.
    """
    spark = chunks.sparkSession
    keyed = chunks.select("chunk", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", content_hash(F.concat(F.lit(f"{version}\n"), "text")))
    known = stored(spark, folder).where("error is null").select("hash")
    pending = settled(keyed.groupBy("hash").agg(F.first("text").alias("text")).join(known, "hash", "left_anti"))
    count = math.ceil(pending.count() / size)
    if count:
        # each window reads its own folder, not all that is pending
        dealt, slices = scratch_path(spark, "pending"), spark.sparkContext.defaultParallelism
        placed = pending.withColumn("window", F.pmod(F.xxhash64("hash"), F.lit(count))).withColumn("slice", F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(slices)))
        placed.repartition("window", "slice").drop("slice").write.partitionBy("window").parquet(dealt)
        held = [int(name.split("=")[1]) for name in snapshot.children(spark, dealt) if name.startswith("window=")]
        for window in sorted(held)[:windows]:
            texts = spark.read.schema("hash string, text string").parquet(f"{dealt}/window={window}").repartition(slices)
            snapshot.write_version(folder, {"replies": _asked(texts, extract, attempts)})
    got = keyed.select("chunk", "hash").join(stored(spark, folder), "hash", "left")
    return got.select("chunk", "reply", "attempts", F.when(F.col("attempts").isNull(), NOT_ASKED).otherwise(F.col("error")).alias("error"))
