"""Tables kept in the order of a key, with pages that read only their files.

Rows are dealt to files by ranges of the key, and a list of the files tells the
lowest and highest key of each, its rows, and how many rows lie in the files
before it. A row's position in the whole order is that base and its place in
the file, so neither a page nor a numbered scan sorts the table again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .snapshot import _fs

POSITION = "position"


def _key(names: list[str]) -> Column:
    return F.struct(*names)


def write_ordered(frame: DataFrame, path: str, key: list[str], files: int | None = None) -> OrderedTable:
    """Store the frame in the order of its key columns, visible by one rename.

    Rows of one key share a file and keep no order among themselves. Null keys
    come first. ``files`` is the number of ranges, else the session's number of
    shuffle partitions. Only key values are sampled for the ranges. The bases
    are sums over one row for each file.
    """
    if POSITION in frame.columns:
        raise ValueError(f"the name {POSITION} is taken")
    spark = frame.sparkSession
    own = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    dealt = frame.repartitionByRange(files, *key) if files else frame.repartitionByRange(*key)
    dealt.sortWithinPartitions(*key).write.parquet(f"{own}/rows")
    stored = spark.read.parquet(f"{own}/rows").select(F.col("_metadata.file_name").alias("file"), _key(key).alias("key"))
    spans = stored.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    spans.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.parquet(f"{own}/files")
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.rename(_fs(spark, own)[1], target)
    return OrderedTable(spark, path)


class OrderedTable:
    """A table that ``write_ordered`` has stored; positions count from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = spark.read.parquet(f"{self.path}/files")
        self.key = self.files.schema["low"].dataType.names
        self._schema = spark.read.parquet(f"{self.path}/rows").schema

    def _read(self, names: list[str] | None = None) -> DataFrame:
        at = f"{self.path}/rows"
        if names is not None and not names:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*(f"{at}/{n}" for n in names) if names else (at,))

    def _placed(self, names: list[str] | None, files: DataFrame) -> DataFrame:
        if names is not None and not names:
            return self._read(names).withColumn(POSITION, F.lit(0).cast("long"))
        own = self._read(names).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        bases = files.select(F.col("file").alias("__file"), F.col("base").alias("__base"))
        return own.join(bases, "__file").select(*self._schema.names, (F.col("__base") + F.col("__row")).alias(POSITION))

    def count(self) -> int:
        return self.files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]

    def numbered(self) -> DataFrame:
        """All rows with their position; a join with the list of files, no sort."""
        return self._placed(None, self.files)

    def page(self, start: int, limit: int) -> DataFrame:
        """The rows at the positions from ``start`` on, in order; at most ``limit`` files are listed and read."""
        if limit < 1 or start < 0:
            raise ValueError("a page starts at 0 or later and has a row at least")
        end = start + limit
        hit = self.files.where((F.col("base") < end) & (F.col("base") + F.col("rows") > start))
        names = [r["file"] for r in hit.orderBy("base").select("file").limit(limit).collect()]
        rows = self._placed(names, hit).where((F.col(POSITION) >= start) & (F.col(POSITION) < end))
        return rows.orderBy(POSITION)

    def _literal(self, values: tuple) -> Column:
        if len(values) != len(self.key):
            raise ValueError(f"the key has {len(self.key)} columns")
        types = self.files.schema["low"].dataType
        return F.struct(*(F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(values, types.fields, strict=True)))

    def after(self, *values: Any) -> int:
        """The position of the first row whose key is greater; reads the one file whose range holds the key."""
        asked = self._literal(values)
        below = self.files.where(F.col("high") <= asked).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        names = [r["file"] for r in self.files.where((F.col("low") <= asked) & (F.col("high") > asked)).select("file").collect()]
        return below + self._read(names).where(_key(self.key) <= asked).count()

    def pages(self, limit: int, after: tuple | None = None) -> Iterator[DataFrame]:
        """Page by page to the end, from the first row or from the first key greater than ``after``."""
        start, end = self.after(*after) if after else 0, self.count()
        while start < end:
            yield self.page(start, limit)
            start += limit

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, which has the key columns; keys without a row give none. Repeated keys count once."""
        asked = keys.select(*self.key).distinct()
        own = self._read()
        same = [own[k].eqNullSafe(asked[k]) for k in self.key]
        return own.join(asked, same, "left_semi")

    def changed(self, path: str, put: DataFrame | None = None, delete: DataFrame | None = None, files: int | None = None) -> OrderedTable:
        """A new table at ``path``: rows of deleted or newly put keys go, then the put rows come in.

        Of several put rows with one key all stay, as with ``write_ordered``.
        """
        own = self._read()
        gone = [f.select(*self.key) for f in (put, delete) if f is not None]
        for keys in gone:
            own = own.join(keys, [own[k].eqNullSafe(keys[k]) for k in self.key], "left_anti")
        if put is not None:
            own = own.unionByName(put.select(*self._schema.names))
        return write_ordered(own, path, self.key, files)
