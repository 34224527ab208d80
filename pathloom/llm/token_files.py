"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped.

Each part is three files: ``.bin`` has the ids one after another (16 bits if the
vocabulary fits, else 32), ``.idx`` the 64-bit offset of each document and of the
end, ``.doc`` the 64-bit document ids. Parts follow each other in ascending
doc_id; prefix sums of their lengths give each part's place in the whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import column_bytes, row_pieces
from .fast_tokens import encoder, with_end
from .scratch import settle


@dataclass(frozen=True)
class TokenFileConfig:
    tokenizer: str
    end_id: int = 0
    #: UTF-8 bytes of text that one part gets, unless that makes more than ``most_parts``.
    part_bytes: int = 64 << 20
    most_parts: int = 100_000


def _write(path: fs.FileSystem, name: str, chunks: Iterator[bytes]) -> None:
    """A whole file under its name at once: a task that runs again writes the same."""
    own = f"{name}.{uuid.uuid4().hex}"
    with path.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    path.move(own, name)


def _starts(sizes: DataFrame, config: TokenFileConfig) -> list[int]:
    """The first doc_id of each part but the first: cuts of even size in ``sizes(doc_id, bytes)``.

    Running sums over sorted ranges; rows with one doc_id stay together.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    even = max(config.part_bytes, -(-total // config.most_parts))
    if total <= even:
        return []
    ranged = sizes.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, 0)
    summed = settle(ranged.select("range", "doc_id", F.sum("bytes").over(inside).alias("upto")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = summed.groupBy("range").agg(F.max("upto").alias("own")).select("range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    part = F.floor((F.col("base") + F.col("upto") - 1) / even)
    firsts = summed.join(F.broadcast(bases), "range").groupBy(part.alias("part")).agg(F.min("doc_id").alias("first"))
    return [r["first"] for r in firsts.where("part > 0 and first is not null").orderBy("first").collect()]


def _part_of(doc_id: Column, starts: list[int]) -> Column:
    """How many starts are not above the id, by halving."""
    if not starts:
        return F.lit(0)
    held = F.lit(starts)

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        going, left = state["low"] < state["high"], F.get(held, middle) <= doc_id
        return F.struct(F.when(going & left, middle + 1).otherwise(state["low"]).alias("low"), F.when(going & ~left, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(len(starts).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), halve, lambda s: s["low"])
    return F.when(doc_id.isNull(), 0).otherwise(found)


def write_token_files(documents: DataFrame, folder: str, config: TokenFileConfig) -> DataFrame:
    """Write all documents in ascending doc_id and return the parts' manifest.

    The manifest has, a row each: part, n_docs, n_null (leading documents
    without an id), n_ids, width (bytes of an id), base (ids of all parts
    before). Rows with one doc_id follow each other by text; null texts count as empty.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(config.tokenizer)
        kind = np.dtype("<u2" if found.size <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        path, root = fs.FileSystem.from_uri(folder)
        path.create_dir(root, recursive=True)
        doc_ids, lengths = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        nulls = 0

        def chunks() -> Iterator[bytes]:
            nonlocal nulls
            for batch in batches:
                data, ends = column_bytes(batch.column("text"))
                names = batch.column("doc_id")
                nulls += names.null_count
                doc_ids.append(names.fill_null(0).to_numpy(zero_copy_only=False))
                for a, b in row_pieces(ends):
                    ids, counts = with_end(*found.encode(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]), config.end_id)
                    lengths.append(counts)
                    yield ids.astype(kind).tobytes()

        name = f"{root}/part-{part:06d}"
        _write(path, f"{name}.bin", chunks())
        offsets = np.cumsum(np.concatenate(lengths)).astype("<u8")
        _write(path, f"{name}.idx", iter([offsets.tobytes()]))
        _write(path, f"{name}.doc", iter([np.concatenate(doc_ids).astype("<i8").tobytes()]))
        if len(offsets) > 1:
            yield pa.record_batch([pa.array([x], pa.int64()) for x in (part, len(offsets) - 1, nulls, int(offsets[-1]), kind.itemsize)], names=["part", "n_docs", "n_null", "n_ids", "width"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    starts = _starts(slim.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes")), config)
    ordered = slim.repartitionById(len(starts) + 1, _part_of(F.col("doc_id"), starts)).sortWithinPartitions("doc_id", "text")
    written = settle(ordered.mapInArrow(run, "part long, n_docs long, n_null long, n_ids long, width long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _mapped(path: fs.FileSystem, name: str, kind: str) -> np.ndarray:
    if isinstance(path, fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with path.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), kind)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (in the whole), n_tokens, ids_crc32.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:06d}"
                ids = _mapped(path, f"{name}.bin", f"<u{row['width']}")
                offsets = _mapped(path, f"{name}.idx", "<u8").astype(np.int64)
                names = _mapped(path, f"{name}.doc", "<i8")
                for a in range(0, len(names), 4096):
                    b = min(a + 4096, len(names))
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
                    yield pa.record_batch(
                        [pa.array(names[a:b], mask=np.arange(a, b) < row["n_null"]), pa.array(row["base"] + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
