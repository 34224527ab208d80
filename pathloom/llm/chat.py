"""Chat formatting of reply trees.

Messages name their parents. Repeated self-joins, each doubling the distance
that it covers, sum the scores from every node up to its root; branches are
ranked by them, and only the chosen ones' paths are listed, by the same jumps.
Each becomes one conversation in a template that marks the turns and escapes
its control strings inside texts, so that the turns can be read back. Column
expressions and joins only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates: none occurs inside a formatted text.
CONTROLS = (START, END, "<|im_sep|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>")
#: Stands for a null tree id inside the joins.
_NO_TREE = -(1 << 63)


@dataclass(frozen=True)
class ChatConfig:
    #: How many branches of each tree are formatted, the best first.
    branches: int = 1
    #: The loss mask covers the texts of these roles.
    learned: tuple = ("assistant",)


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first sign of each control string."""
    tails = "|".join(r"\Q" + c[1:] + r"\E" for c in CONTROLS)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={tails})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_mark(role: Column) -> Column:
    """Plain names as they are, others in hexadecimal after ``x-``."""
    return F.when(role.rlike(r"^(?!x-)[A-Za-z0-9_-]+$") & ~role.contains("\n"), role).otherwise(F.concat(F.lit("x-"), F.lower(F.hex(F.encode(role, "UTF-8")))))


def role_of(mark: Column) -> Column:
    return F.when(mark.startswith("x-"), F.decode(F.unhex(F.substring(mark, 3, 1 << 30)), "UTF-8")).otherwise(mark)


def linear_messages(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as trees in which each turn replies to the one before.

    Turns with one number follow each other by role and text. Rows are numbered
    through over sorted ranges, so that a long conversation needn't be in one
    task; nodes of one conversation have consecutive numbers.
    """
    # ranges are cut by short keys, as whole texts would be sampled to the driver; equal keys share a range
    keys, cut = ["conv_id", "turn", "role", "text"], ["conv_id", "turn", "short_role", "long_role", "short_text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    long_role = F.coalesce(F.length("role") > 40, F.lit(False))
    short = rows.withColumns({"short_role": F.substring("role", 1, 40), "long_role": long_role, "short_text": F.when(~long_role, F.substring("text", 1, 40))})
    ordered = short.repartitionByRange(*cut).sortWithinPartitions(*keys).drop("short_role", "long_role", "short_text")
    placed = settle(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    node = F.col("base") + F.col("place")
    numbered = placed.join(F.broadcast(bases), "part")
    # the first turn's parent is another conversation's node, which makes it a root
    return numbered.select("conv_id", node.alias("node"), (node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node that leads to a root, and the jumps of 1, 2, 4, ... steps.

    The first has ``(tree, node, length, total)``, the path's messages and their
    scores from the node up to the root; the others ``(tree, node, up)``. A
    parent that doesn't exist makes a root. When a round brings no node to its
    root, those that are left lead into cycles.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = F.when(F.col("known"), F.col("parent"))
    one = F.lit(1).cast("long")
    now = settle(messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left").select("tree", "node", up.alias("up"), one.alias("length"), F.col("score").alias("total")))
    ended = now.where("up is null").select("tree", "node", "length", "total")
    going = now.where("up is not null")
    levels = []
    while not going.isEmpty():
        levels.append(going.select("tree", "node", "up"))
        roots = ended.select("tree", F.col("node").alias("up"), F.col("length").alias("rest"), F.col("total").alias("sum"))
        far = going.select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("length").alias("rest"), F.col("total").alias("sum"))
        beyond = far.unionByName(roots.withColumn("top", F.lit(None).cast("long")))
        now = settle(going.join(beyond, ["tree", "up"]).select("tree", "node", F.col("top").alias("up"), (F.col("length") + F.col("rest")).alias("length"), (F.col("total") + F.col("sum")).alias("total")))
        arrived = now.where("up is null").select("tree", "node", "length", "total")
        if arrived.isEmpty():
            break
        ended = ended.union(arrived)
        going = now.where("up is not null")
    return ended, levels


def branch_nodes(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """All nodes from the given leaves up to their roots: ``(tree, leaf, node, height)``, 0 at the leaf."""
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    for level, jumps in enumerate(levels):
        further = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << level)).alias("height"))
        paths = settle(paths.union(further))
    return paths


def format_trees(messages: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """``messages(conv_id, node, parent, role, text, score)`` to ``(conv_id, leaf, rank, score, formatted, loss)``.

    Branches rank by the mean score of their messages, ties to the smaller
    leaf; null scores count as 0. ``loss`` has the spans (start, end) of the
    learned roles' texts in the formatted string. Null roles and texts count as
    empty. Nodes on a cycle, and branches that lead into one, belong to no
    conversation. Repeated nodes should not occur in one tree
    (``linear_messages`` numbers rows anew). An empty table gives none.
    """
    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_TREE)).alias("tree"),
        F.col("node").cast("long").alias("node"),
        F.col("parent").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    rooted, levels = _jumps(rows)
    parents = rows.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti").withColumn("score", F.col("total") / F.col("length"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = settle(leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.branches).select("tree", "node", "rank", "score"))
    paths = branch_nodes(chosen, levels)
    chosen = chosen.withColumnRenamed("node", "leaf")
    head = F.concat(F.lit(START), role_mark(F.col("role")), F.lit("\n"))
    turn = F.struct((-F.col("height")).alias("place"), head.alias("head"), escape(F.col("text")).alias("text"), F.col("role").isin(*config.learned).alias("learned"))
    gathered = (
        paths.join(chosen, ["tree", "leaf"])
        .join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
        .select("tree", "leaf", "rank", "score", turn.alias("turn"))
        .groupBy("tree", "leaf", "rank", "score")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )
    closing = f"{END}\n"

    def span(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["text"])
        own = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(closing)).cast("long").alias("at"), F.when(t["learned"], F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(closing))), "")
    loss = F.aggregate("turns", start, span, lambda s: s["out"])
    conv = F.when(F.col("tree") != _NO_TREE, F.col("tree"))
    return gathered.select(conv.alias("conv_id"), "leaf", "rank", "score", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.slice(F.split(formatted, r"\Q" + START + r"\E", -1), F.lit(2), F.lit(1 << 30))

    def turn(part: Column) -> Column:
        mark = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(mark) + 2, F.length(part) - F.length(mark) - 1 - len(END) - 1)
        return F.struct(role_of(mark).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chat_report(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """Digests of the turns and of the learned text, as read back from the formatted strings."""
    done = format_trees(linear_messages(conversations), config)
    read = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
