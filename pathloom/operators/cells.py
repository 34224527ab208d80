"""Exact nearest vectors without comparing all: cells, the nearest first, the rest ruled out by bounds.

Each vector lies in the cell of its nearest centre; a cell knows its radius. No
vector of a cell scores more with a query than the centre does plus the query's
length times the radius. A few cells are opened first; of the others those whose
bound reaches the score that the first have secured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import first_rows, settled

#: Cells at most, and rows of one part of a cell, or queries of one block, about.
MOST_CELLS, PART = 1024, 4096


@dataclass(frozen=True)
class Cells:
    """``vectors(cell, part, place, key, v)``, numbered by key within their part, and ``centres(cell, centre, radius, parts)``."""

    vectors: DataFrame
    centres: DataFrame

    def save(self, path: str) -> None:
        self.vectors.write.parquet(f"{path.rstrip('/')}/vectors")
        self.centres.coalesce(1).write.parquet(f"{path.rstrip('/')}/centres")


def open_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(spark.read.parquet(f"{path.rstrip('/')}/vectors"), spark.read.parquet(f"{path.rstrip('/')}/centres"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def in_cells(vectors: DataFrame, cells: int | None = None, part: int = PART) -> Cells:
    """``vectors(key, v)`` of one length; null vectors take no part. Centres are vectors drawn by a hash of their key.

    A cell of any size is dealt into parts of about ``part`` rows.
    """
    spark = vectors.sparkSession
    rows = settled(vectors.where("v is not null").select("key", F.col("v").cast("array<double>").alias("v")))
    many = rows.count()
    cells = max(1, min(MOST_CELLS, cells or int(many**0.5 / 2)))
    drawn = rows.orderBy(F.xxhash64("key")).limit(cells).select("v").distinct().collect()  # a constant number
    centres = np.array([r["v"] for r in drawn]) if drawn else np.zeros((0, 0))
    width = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(1) / 2
        for batch in batches:
            own = _matrix(batch.column("v"), width)
            cell = (own @ centres.T - squares).argmax(1)
            apart = np.sqrt(((own - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], names=[*batch.schema.names, "cell", "apart"])

    kinds = dict(rows.dtypes)
    placed = settled(rows.mapInArrow(assign, f"key {kinds['key']}, v array<double>, cell int, apart double")) if many else rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("apart"))
    known = placed.groupBy("cell").agg((F.max("apart") * (1 + 1e-9) + 1e-9).alias("radius"), F.ceil(F.count("*") / part).cast("int").alias("parts")).collect()
    found = spark.createDataFrame([(r["cell"], centres[r["cell"]].tolist(), r["radius"], r["parts"]) for r in known], "cell int, centre array<double>, radius double, parts int")
    dealt = placed.join(F.broadcast(found.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    place = Window.partitionBy("cell", "part").orderBy("key")
    return Cells(settled(dealt.select("cell", "part", F.row_number().over(place).alias("place"), "key", "v")), found)


def _best(opened: DataFrame, cells: Cells, k: int, blocks: int) -> DataFrame:
    """``opened(q, qv, cell, part)`` to the best k of each query in each part: ``(q, cell, part, place, score)``."""
    kind = dict(opened.dtypes)["q"]
    asked = opened.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    met = cells.vectors.select("cell", "part", "place", "v").join(asked.select("cell", "part", "block").distinct(), ["cell", "part"])
    met = met.select(F.col("cell").alias("cell"), F.col("part").alias("part"), F.col("block").alias("block"), "place", "v")  # as columns of its own

    def score(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("place")
            matrix, places = np.stack(vectors["v"]), vectors["place"].to_numpy()
            for at in range(0, len(queries), 256):
                own = queries.iloc[at : at + 256]
                scores = np.round(np.stack(own["qv"]) @ matrix.T, 9)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"q": np.repeat(own["q"].to_numpy(), order.shape[1]), "cell": vectors["cell"].iloc[0], "part": vectors["part"].iloc[0], "place": places[order.ravel()], "score": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q", "cell", "part", "place", "score")})

    keys = ["cell", "part", "block"]
    return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(score, f"q {kind}, cell int, part int, place int, score double")


def search(queries: DataFrame, cells: Cells, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """``queries(q, v)`` to ``(q, key, score, rank)``, the k largest inner products, ties to smaller keys; and ``(q, round, cell)``, the cells opened.

    The same as comparing everything. Null query vectors find nothing.
    """
    known = cells.centres.collect()  # a row for each cell, a constant number
    kinds = dict(queries.dtypes)
    asked = settled(queries.where("v is not null").select("q", F.col("v").cast("array<double>").alias("qv")))
    if not known:
        empty = asked.select("q", F.lit(0).alias("round"), F.lit(0).alias("cell")).where("false")
        return asked.join(cells.vectors.select("key"), F.lit(False)).select("q", "key", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), empty
    number, parts = np.array([r["cell"] for r in known], np.int32), np.array([r["parts"] for r in known])
    centres, radius = np.array([r["centre"] for r in known]), np.array([r["radius"] for r in known])
    blocks = max(1, -(-asked.count() // PART))

    def choose(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _matrix(batch.column("qv"), centres.shape[1])
                bounds = own @ centres.T + np.sqrt((own**2).sum(1))[:, None] * radius
                near = np.zeros(bounds.shape, bool)
                np.put_along_axis(near, np.argsort(-bounds, axis=1, kind="stable")[:, :probes], True, 1)
                if not first:
                    held = batch.column("held").to_numpy(zero_copy_only=False)
                    near = ~near & (bounds >= held[:, None] - 1e-8 * (1 + np.abs(held[:, None])))
                at, which = np.nonzero(near)
                many = parts[which]
                at, which = np.repeat(at, many), np.repeat(which, many)
                part = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(at)), batch.column("qv").take(pa.array(at)), pa.array(number[which]), pa.array(part.astype(np.int32))], names=["q", "qv", "cell", "part"])

        return run

    schema = f"q {kinds['q']}, qv array<double>, cell int, part int"
    keyed = cells.vectors.select("cell", "part", "place", "key")
    one = settled(asked.mapInArrow(choose(True), schema))
    near = settled(_best(one, cells, k, blocks).join(keyed, ["cell", "part", "place"]).select("q", "key", "score"))
    held = first_rows(near, ["q"], [F.desc("score"), "key"], k).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-1e300)).alias("held"))
    two = settled(asked.join(held, "q").select("q", "qv", "held").mapInArrow(choose(False), schema))
    further = _best(two, cells, k, blocks).join(keyed, ["cell", "part", "place"]).select("q", "key", "score")
    best = first_rows(near.unionByName(further), ["q"], [F.desc("score"), "key"], k, "rank")
    opened = one.select("q", F.lit(1).alias("round"), "cell").unionByName(two.select("q", F.lit(2).alias("round"), "cell")).distinct()
    return best.select("q", "key", "score", F.col("rank").cast("int").alias("rank")), opened
