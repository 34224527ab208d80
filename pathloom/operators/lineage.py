"""Cutting lineage and letting go of what was cut, numbering rows of large groups over ranges, and the first rows of groups of any size."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settled(frame: DataFrame) -> DataFrame:
    """Computed once, its lineage cut in the shared folder that spark.checkpoint.dir names.

    Only a local session may go without one; it gets a temporary folder.
    """
    _shared(frame.sparkSession)
    return frame.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Let go of shuffle files and kept frames that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which may come long
    after a large step that no one reads again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses (not created)."""
    return f"{_shared(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def first_rows(frame: DataFrame, keys: list[str], order: list[str | Column], limit: int, place: str = "n", spread: int = 32) -> DataFrame:
    """The first ``limit`` rows of each group in the order, with their place from 1.

    Up to a thousand, Spark drops the others before it shuffles. Beyond that a
    group is dealt by a hash of its rows to ``spread`` tasks, which drop theirs
    first, so that none sorts more than a share of a group of any size and no
    more than so many rows of each group leave a task.
    """
    threshold = int(frame.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit > threshold:
        hashed = [c for c, kind in frame.dtypes if not kind.startswith("map")]
        dealt = frame.withColumn("_deal", F.pmod(F.xxhash64(*hashed), F.lit(spread)))
        inner = Window.partitionBy(*keys, "_deal").orderBy(*order)
        frame = dealt.withColumn("_inner", F.row_number().over(inner)).where(F.col("_inner") <= limit).drop("_deal", "_inner")
    return frame.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= limit)


def numbered(frame: DataFrame, keys: list[str], order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """The frame with ``k``, each row's place in its group's order from 1, and ``n``, the group's size.

    Each of ``sums`` gets its running sum ``sum_<name>`` up to the row and its
    total ``all_<name>``. Rows are sorted over ranges and numbered in each;
    small sums of the ranges before are added. So a group of any size is spread
    over tasks.
    """
    ranged = settled(frame.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", F.count(F.lit(1)).over(inside).alias("_k"), *(F.sum(c).over(inside).alias(f"_s{i}") for i, c in enumerate(sums)))
    parts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    added = [x for i, c in enumerate(sums) for x in (F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}"), F.sum(f"_t{i}").over(whole).alias(f"all_{c}"))]
    offsets = parts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.sum("_n").over(whole).alias("n"), *added)
    out = own.join(offsets, [*keys, "_range"])
    totals = [(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(f"sum_{c}") for i, c in enumerate(sums)]
    return out.select(*frame.columns, (F.col("_k") + F.col("_b")).alias("k"), "n", *totals, *(f"all_{c}" for c in sums))
