"""Merkle manifest of a dataset: a root, and for every row the path that proves it.

Rows are leaves of their group's tree, in which every three consecutive nodes
have one parent; the groups' roots are the leaves of one more tree. Blocks of a
power of three leaves are aligned with the tree, so each climbs by itself: a
level of a block is one string of fixed-width hexadecimal digests, cut by
substrings into the runs whose hashes are the next level. A node's siblings are
what flanks it in its run. The blocks' roots are leaves of the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

#: Width of a digest, and nodes under one parent.
DIGEST, ARITY = 64, 3
_RUN = DIGEST * ARITY
_SEGMENTS = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class MerkleConfig:
    #: What a leaf covers, in this order.
    columns: tuple = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    order: str = "doc_id"
    #: Levels that a block climbs: it has 3 to this power leaves at most.
    block_levels: int = 6


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values' encodings: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree with n of them."""
    height = F.when(n <= 1, 0)
    for h in range(1, 40):
        height = height.when(n <= ARITY**h, h)
    return height


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place within their ``key`` from 0, and ``n``, the key's rows.

    They are sorted over ranges and numbered in each; small counts of the
    ranges before are added, so that a large group is spread over tasks.
    """
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = settle(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = placed.groupBy("key", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("c"))
    shifts = spans.select("key", "part", (before - F.col("low")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return placed.join(shifts, ["key", "part"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """Nodes ``(key, pos, n, hash, carried)`` by blocks: items, the runs of each level, the block's root ``top``."""
    item = F.struct("pos", "hash", *carried)
    block = F.floor(F.col("pos") / ARITY**levels).alias("block")
    made = nodes.groupBy("key", "n", block).agg(F.sort_array(F.collect_list(item)).alias("items"))
    made = made.select("*", F.least(_height(F.col("n")), F.lit(levels)).alias("steps"), (_height(F.col("n")) <= levels).alias("done"))
    made = made.select("*", F.array_join(F.transform("items", lambda x: x["hash"]), "").alias("level"))
    for j in range(levels):
        going = F.col("steps") > j
        places = F.sequence(F.lit(0), F.ceil(F.length("level") / _RUN).cast("int") - 1)
        runs = F.transform(places, lambda i: F.substring(F.col("level"), i * _RUN + 1, F.lit(_RUN)))
        made = made.select("*", F.when(going, runs).otherwise(F.array().cast("array<string>")).alias(f"runs{j}"))
        above = F.array_join(F.transform(f"runs{j}", lambda r: F.sha2(r, 256)), "")
        made = made.select(*(c for c in made.columns if c != "level"), F.when(going, above).otherwise(F.col("level")).alias("level"))
    return made.withColumnRenamed("level", "top")


def _climb(nodes: DataFrame, carried: list[str], levels: int) -> list[DataFrame]:
    """Rounds of blocks, each over the roots of the one before, until every key has one root."""
    rounds = [settle(_blocks(nodes, carried, levels))]
    while not (rest := rounds[-1].where(~F.col("done"))).isEmpty():
        size = ARITY**levels
        above = rest.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("hash"))
        rounds.append(settle(_blocks(above, [], levels)))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    found = rounds[0].where("done").select("key", "top")
    for blocks in rounds[1:]:
        found = found.union(blocks.where("done").select("key", "top"))
    return found


def _descend(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The items of the first round with ``path``, the segments left and right of their ancestors up to the last root.

    ``above`` has for every key the path that goes on from its root, and more
    columns that all its items get.
    """
    passed = [c for c in above.columns if c not in ("key", "path")]
    below = None
    for blocks in reversed(rounds):
        whole = blocks.where("done").join(above, "key")
        if below is not None:
            further = below.select("key", F.col("pos").alias("block"), "path", *passed)
            whole = whole.unionByName(blocks.where(~F.col("done")).join(further, ["key", "block"]))

        def path(x: Column) -> Column:
            at, segments = F.pmod(x["pos"], F.lit(ARITY**levels)), []
            for j in range(levels):
                run = F.get(F.col(f"runs{j}"), F.floor(at / ARITY ** (j + 1)).cast("int"))
                k = (F.floor(at / ARITY**j) % ARITY).cast("int")
                segments.append(F.struct(F.substring(run, F.lit(1), k * DIGEST).alias("left"), F.substring(run, (k + 1) * DIGEST + 1, F.lit(_RUN)).alias("right")))
            return F.concat(F.slice(F.array(*segments).cast(_SEGMENTS), F.lit(1), F.col("steps")), F.col("path"))

        proved = whole.select("key", *passed, F.explode(F.transform("items", lambda x: F.struct(x.alias("item"), path(x).alias("path")))).alias("x"))
        below = proved.select("key", *passed, "x.item.*", "x.path")
    return below


def manifest(leaves: DataFrame, carried: list[str], config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """``leaves(group, order, hash, carried)`` to ``(carried, hash, path, subroot, root)``.

    Groups are ordered by name, null first, and within them leaves by the order
    column, null first; ties by hash, then by the carried columns. Repeated rows
    are leaves of their own. An empty table gives none. ``carried`` columns
    shouldn't be named as the others here.
    """
    levels = config.block_levels
    key = F.when(F.col(config.group).isNull(), "").otherwise(F.concat(F.lit("1"), F.col(config.group).cast("string")))
    rows = leaves.select(key.alias("key"), F.col(config.order).alias("place_by"), "hash", *carried)
    rounds = _climb(_numbered(rows, ["place_by", "hash"]).drop("place_by"), carried, levels)
    subroots = _roots(rounds).select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("top").alias("hash"))
    joints = _climb(_numbered(subroots, ["name"]), ["name"], levels)
    root = _roots(joints).select("key", F.array().cast(_SEGMENTS).alias("path"), F.col("top").alias("root"))
    above = _descend(joints, root, levels).select(F.col("name").alias("key"), F.col("hash").alias("subroot"), "path", "root")
    return _descend(rounds, settle(above), levels).drop("key", "pos")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the path, from the leaf upwards, each level's from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def merkle_report(documents: DataFrame, config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """Every row's leaf, roots and proof, and whether the row still proves itself after tampering.

    Where the CRC-32 of the decimal id is even, tampering deletes the text's
    line breaks. Null ids are encoded as such and never tampered with; null and
    empty texts stay as they are. Other columns take no part.
    """
    own = {c: F.col(c).cast("string") for c in config.columns}
    changed = {**own, "text": F.replace(own["text"], F.lit("\n"), F.lit(""))}
    hit = (F.crc32(own[config.order].cast("binary")) % 2 == 0) & own["text"].contains("\n")
    tampered = F.when(hit, leaf_digest(list(changed.values())))
    digests = settle(documents.select(F.col(config.group), F.col(config.order), F.col(config.order).alias("id"), leaf_digest(list(own.values())).alias("hash"), tampered.alias("tampered")))
    proved = manifest(digests, ["id", "tampered"], config)
    found = proved.select("id", "hash", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"))
    return found.select(F.col("id").alias(config.order), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
