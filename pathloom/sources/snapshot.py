"""A graph and its side tables as versioned Parquet snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

FORMAT, VERSION = "pathloom-graph", 1
_META = "key string, value_json string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(graph: Graph, path: str, metadata: DataFrame | None = None, documents: DataFrame | None = None) -> None:
    """Written beside the target and then renamed, so that readers see all or nothing."""
    spark = graph.nodes.sparkSession
    own = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    graph.nodes.write.parquet(f"{own}/nodes")
    graph.edges.write.parquet(f"{own}/edges")
    (metadata if metadata is not None else spark.createDataFrame([], _META)).write.parquet(f"{own}/metadata")
    if documents is not None:
        documents.write.parquet(f"{own}/documents")
    spark.createDataFrame([(FORMAT, VERSION)], "format string, version int").coalesce(1).write.json(f"{own}/version")
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.rename(_fs(spark, own)[1], target)


def load(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph and its metadata; foreign formats and versions are refused."""
    row = spark.read.json(f"{path}/version").first()
    if row is None or (row["format"], row["version"]) != (FORMAT, VERSION):
        raise ValueError(f"{path} is no {FORMAT} snapshot of version {VERSION}")
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")), spark.read.parquet(f"{path}/metadata")


def migrate(graph: Graph, path: str) -> None:
    """Copy a graph and verify the counts; an existing target is refused."""
    save(graph, path)
    copied, _ = load(graph.nodes.sparkSession, path)
    if copied.counts().first() != graph.counts().first():
        raise ValueError("the copy has other counts")


def set_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(key, value_json)``: new values replace old ones, null removes."""
    return metadata.join(changes.select("key"), "key", "left_anti").unionByName(changes.where("value_json is not null").select("key", "value_json"))


def put_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.join(new.select("key"), "key", "left_anti").unionByName(new.select(*stored.columns))


def cached(keys: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """``keys(key, payload)`` with results from the cache, computed only for what it lacks."""
    known = keys.join(cache, "key")
    fresh = compute(keys.join(cache.select("key"), "key", "left_anti"))
    return known.select("key", "result").unionByName(fresh.select("key", "result"))


def write_results(scores: DataFrame, summary: DataFrame, path: str) -> None:
    """Records and their summary, which can be made again from the records."""
    scores.write.parquet(f"{path}/scores")
    summary.coalesce(1).write.json(f"{path}/summary")


def status(documents: DataFrame) -> DataFrame:
    """Documents of each source, and those of which only the hash is kept."""
    return documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("hash_only"))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, root = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    names = children(spark, path)
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_version(path: str, frames: dict[str, DataFrame]) -> int:
    """All frames as the next version of a folder, visible at once; earlier versions stay readable."""
    spark = next(iter(frames.values())).sparkSession
    number = max(versions(spark, path), default=0) + 1
    own = f"{path.rstrip('/')}/.{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{own}/{name}")
    fs, target = _fs(spark, f"{path.rstrip('/')}/v{number}")
    if not fs.rename(_fs(spark, own)[1], target):
        raise FileExistsError(f"{path}/v{number}")
    return number


def read_version(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    last = max(versions(spark, path))
    return {n: spark.read.parquet(f"{path.rstrip('/')}/v{last}/{n}") for n in names}
