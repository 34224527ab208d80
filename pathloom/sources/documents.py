"""Documents from files: whole texts, JSON, JSON lines and CSV records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md", "markdown")
RECORD_SUFFIXES = ("json", "jsonl", "csv")
#: Fields that may hold a record's text, title or id, the first usable one first.
TEXT_FIELDS = ("text", "content", "body", "paragraph")
TITLE_FIELDS = ("title", "name", "heading")
ID_FIELDS = ("id", "_id", "doc_id", "uuid")


def record_text(fields: Column) -> Column:
    """The first non-blank text field of a map, else its ``key: value`` lines."""
    usable = [F.when(F.length(F.trim(F.coalesce(F.try_element_at(fields, F.lit(f)), F.lit("")))) > 0, F.try_element_at(fields, F.lit(f))) for f in TEXT_FIELDS]
    lines = F.array_join(F.transform(F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.coalesce(*usable, lines)


def unique_ids(rows: DataFrame) -> DataFrame:
    """Repeated ids get ``@`` and their index, in the order of ``ord``."""
    place = Window.partitionBy("doc_id").orderBy("ord")
    n = F.row_number().over(place)
    return rows.withColumn("n", n).withColumn("doc_id", F.when(F.col("n") > 1, F.concat("doc_id", F.lit("@"), (F.col("n") - 1).cast("string"))).otherwise(F.col("doc_id"))).drop("n")


def _relative(root: str) -> Column:
    return F.regexp_replace(F.input_file_name(), r"^.*?\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + r"\E/", "")


def _paths(root: str, suffixes: tuple[str, ...]) -> str:
    return "*.{" + ",".join(suffixes) + "}"


def read_text_files(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, title, text)``: one document for each text file, named by its path."""
    raw = spark.read.option("pathGlobFilter", _paths(root, TEXT_SUFFIXES)).option("recursiveFileLookup", True).text(root, wholetext=True)
    named = raw.select(_relative(root).alias("doc_id"), F.col("value").alias("text"))
    return named.select("doc_id", F.regexp_extract("doc_id", r"([^/]*)\.[^.]*$", 1).alias("title"), "text")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, title, text)``: one document for each record of JSON lines and CSV files."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(root)
    own = lines.select(_relative(root).alias("path"), F.monotonically_increasing_id().alias("ord"), F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    whole = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(root, wholetext=True)
    listed = whole.select(_relative(root).alias("path"), F.coalesce(F.from_json("value", "array<map<string,string>>"), F.array(F.from_json("value", "map<string,string>"))).alias("all"))
    exploded = listed.select("path", F.posexplode("all").alias("ord", "m")).where("m is not null").select("path", F.col("ord").cast("long").alias("ord"), "m")
    rows = own.unionByName(exploded)
    record = F.coalesce(*(F.try_element_at("m", F.lit(f)) for f in ID_FIELDS), F.col("ord").cast("string"))
    return unique_ids(rows.select("ord", F.concat("path", F.lit("#"), record).alias("doc_id"), F.coalesce(*(F.try_element_at("m", F.lit(f)) for f in TITLE_FIELDS)).alias("title"), record_text(F.col("m")).alias("text"))).drop("ord")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return read_text_files(spark, root).unionByName(read_records(spark, root))


def read_one(spark: SparkSession, root: str, doc_id: str) -> DataFrame:
    """A single document again; ids that leave the folder are refused."""
    path = doc_id.split("#", 1)[0]
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"{doc_id!r} leaves the folder")
    return read_documents(spark, root).where(F.col("doc_id") == doc_id)


def in_memory(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    ids = [r[0] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("document ids repeat")
    return spark.createDataFrame(rows, "doc_id string, text string")
