"""Repair of conversation structure: the cheapest edits that make the roles alternate.

Edits keep, rerole, delete or insert turns. A dynamic program over what was said
last gives the least cost from every place of a conversation to its end; edits
that lie on a cheapest way form a graph. Its nodes are ranked by the letters of
their edits, over lengths that double: a node's rank by 2k letters is that of
its rank by k and of the rank of the node k letters on, which a doubled pointer
names. The pointers then list the whole way at once, and equal ranks are equal
audits.

A conversation may be cut where partitions meet: a segment's costs are a small
matrix, and those before it need only its product with what comes after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

#: What was said last.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
#: A row's kind is three times what its role's first letter is (0: none of these) and one of these.
SOUND, TRUNCATED, DOOMED = range(3)
_LETTERS = np.array(["", "D", "I", "K", "R"])
_DELETE, _INSERT, _KEEP, _REROLE = range(1, 5)  # in the order of their letters
_NEVER = 1 << 40
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepairConfig:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    #: For each truncated turn that isn't deleted.
    truncated: int = 1


class _Edits:
    """Costs and targets of each edit by kind of row and by state."""

    def __init__(self, config: RepairConfig) -> None:
        #: Inserting leads to the turn that may follow.
        self.said = np.array([USER, USER, ASSISTANT, USER])
        self.insert = config.insert
        keeps = {(START, SYSTEM), (START, USER), *LEGAL}
        shape = (12, 4, 5)
        self.cost, self.target = np.full(shape, _NEVER, np.int64), np.zeros(shape, np.int64)
        for kind in range(12):
            code, fate = divmod(kind, 3)
            for state in range(4):
                self.cost[kind, state, _DELETE], self.target[kind, state, _DELETE] = config.delete, state
                if fate != DOOMED:
                    more = config.truncated * (fate == TRUNCATED)
                    self.cost[kind, state, _REROLE], self.target[kind, state, _REROLE] = config.rerole + more, self.said[state]
                    if (state, code) in keeps:
                        self.cost[kind, state, _KEEP], self.target[kind, state, _KEEP] = more, code
        #: Least cost to go from state to state by inserts, then by inserts and one row of a kind.
        closure = np.full((4, 4), _NEVER, np.int64)
        for state in range(4):
            closure[state, state] = 0
            one, two = self.said[state], self.said[self.said[state]]
            closure[state, one] = min(closure[state, one], config.insert)
            closure[state, two] = min(closure[state, two], 2 * config.insert)
        own = np.full((12, 4, 4), _NEVER, np.int64)
        for kind in range(12):
            for state in range(4):
                for edit in (_DELETE, _KEEP, _REROLE):
                    t = self.target[kind, state, edit]
                    own[kind, state, t] = min(own[kind, state, t], self.cost[kind, state, edit])
        self.moves = np.minimum((closure[None, :, :, None] + own[:, None]).min(2), _NEVER)
        self.ends = closure[:, [START, ASSISTANT]].min(1)


def segment_matrix(kinds: np.ndarray, edits: _Edits) -> np.ndarray:
    """Least costs from each state before the rows to each state after them, by halving."""
    own = edits.moves[kinds]
    while len(own) > 1:
        odd = own[-1:] if len(own) % 2 else own[:0]
        even = own[: len(own) // 2 * 2]
        own = np.concatenate([np.minimum((even[::2, :, :, None] + even[1::2, None]).min(2), _NEVER), odd])
    return own[0]


class Ways:
    """The cheapest edits of many segments of conversations at once.

    ``bounds`` cut the rows' kinds into segments; ``after`` has the costs from
    each state at a segment's end, and ``over`` is set where the conversation
    ends there. A segment has a place before each row and one at its end; a node
    is a place and a state.
    """

    def __init__(self, kinds: np.ndarray, bounds: np.ndarray, after: np.ndarray, over: np.ndarray, edits: _Edits) -> None:
        self.many = len(bounds) - 1
        lengths = np.diff(bounds)
        self.first = bounds[:-1] + np.arange(self.many)
        self.last = bounds[1:] + np.arange(self.many)
        places = len(kinds) + self.many
        self.row = np.full(places, -1)
        inner = np.ones(places, bool)
        inner[self.last] = False
        self.row[inner] = np.arange(len(kinds))
        costs = np.zeros((places, 4), np.int64)
        costs[self.last] = after
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = self.last[order], lengths[order]
        for t in range(int(lengths[0]) if self.many else 0):
            at = ends[: np.searchsorted(-lengths, -t, "left")] - 1 - t
            costs[at] = (edits.moves[kinds[self.row[at]]] + costs[at + 1][:, None]).min(2)
        self.costs = costs

        # options by letter; the first that is on a cheapest way is the least, as no two have one letter
        option = np.full((places, 4, 5), _NEVER, np.int64)
        onto = np.zeros((places, 4, 5), np.int64)
        at = np.flatnonzero(inner)
        kind = kinds[self.row[at]]
        target = edits.target[kind]
        option[at] = edits.cost[kind] + np.take_along_axis(costs[at + 1][:, None, :].repeat(4, 1), target, 2)
        onto[at] = (at[:, None, None] + 1) * 4 + target
        stays = inner.copy()
        stays[self.last[over]] = True
        option[stays, :, _INSERT] = edits.insert + costs[stays][:, edits.said]
        onto[:, :, _INSERT] = np.arange(places)[:, None] * 4 + edits.said
        cheapest = option == costs[:, :, None]
        cheapest[:, :, 0] = False
        if over.any():
            done = self.last[over]
            cheapest[done[:, None], [[START, ASSISTANT]]] = False
        letter = cheapest.argmax(2).ravel()
        self.letter = np.where(cheapest.any(2).ravel(), letter, 0)
        follow = np.where(self.letter > 0, onto.reshape(-1, 5)[np.arange(places * 4), letter], -1)

        # ranks by 1, 2, 4, ... letters; the pointers lead as many letters on, or to -1 beyond the end
        self.rank = self.letter.copy()
        self.jumps = []
        while (follow >= 0).any():
            self.jumps.append(follow)
            further = np.where(follow >= 0, self.rank[follow] + 1, 0)
            _, self.rank = np.unique(self.rank * (int(further.max()) + 1) + further, return_inverse=True)
            follow = np.where(follow >= 0, follow[follow], -1)

    def ways(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes on the ways from the given ones, and their starts' numbers, in order."""
        steps, start = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for level in range(len(self.jumps) - 1, -1, -1):
            onward = self.jumps[level][nodes]
            go = onward >= 0
            nodes, steps, start = np.concatenate([nodes, onward[go]]), np.concatenate([steps, steps[go] + (1 << level)]), np.concatenate([start, start[go]])
        order = np.lexsort((steps, start))
        return nodes[order], start[order]

    def exits(self, segment: int) -> list[int]:
        """The state at the segment's end for each state before it, where the conversation goes on."""
        nodes, start = self.ways(self.first[segment] * 4 + np.arange(4))
        return (nodes[np.flatnonzero(np.append(start[1:] != start[:-1], True))] % 4).tolist()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    return rows.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _placed(turns: DataFrame) -> DataFrame:
    """The turns with ``pos``, their place in the order of all conversations.

    Ranges are cut by short keys, never by whole texts.
    """
    short = F.substring("text", 1, 40)
    ranged = turns.withColumn("short", short).repartitionByRange("conv_id", "turn", "role", "short").sortWithinPartitions("conv_id", "turn", "role", "text").drop("short")
    rows = settle(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("pos", F.col("base") + F.col("place")).drop("part", "place", "base")


def _kinds(rows: DataFrame) -> DataFrame:
    """``(pos, conv_id, turn, fault, kind)``: the first fault that counts (blank, duplicate, truncated), and the kind."""
    solid = F.rtrim(F.col("text"), F.lit(_BLANKS))
    whole = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = rows.select("pos", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.right(solid, F.lit(1)).alias("last"), whole.alias("said"))
    firsts = seen.groupBy("conv_id", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    code = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    fate = F.when(F.col("fault").isin("blank", "duplicate"), DOOMED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(SOUND)
    return seen.join(firsts, "pos", "left").withColumn("fault", fault).select("pos", "conv_id", "turn", "fault", (code * 3 + fate).cast("int").alias("kind"))


class _Part:
    """A partition's rows, without texts, and where its conversations begin."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.table = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
        self.pos = self.table.column("pos").to_numpy()
        self.kinds = self.table.column("kind").to_numpy()
        conv = self.table.column("conv_id")
        null, value = conv.is_null().to_numpy(), conv.fill_null(0).to_numpy()
        new = np.append(True, (value[1:] != value[:-1]) | (null[1:] != null[:-1]))
        self.bounds = np.append(np.flatnonzero(new), len(value))
        self.many = len(self.bounds) - 1
        #: The segments that may go on in other partitions.
        self.outer = sorted({0, self.many - 1})

    def value(self, name: str) -> object:
        return self.table.column(name)[0].as_py()


def _filled(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return [b for b in batches if b.num_rows]


_OUTER = "part int, conv_id long, seg int"


def _joints(rows: DataFrame, config: RepairConfig) -> DataFrame:
    """For each partition what its first and last conversation need to know of the others.

    A row for each partition: ``enter``, the first one's state on entering (or
    null), ``before``, its last turn's code before, ``after``, the last one's
    costs at the end, and ``over``, whether it ends there.
    """
    edits = _Edits(config)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _filled(batches):
            part = _Part(found)
            out = [{"part": part.value("part"), "conv_id": part.table.column("conv_id")[int(part.bounds[g])].as_py(), "seg": g, "costs": segment_matrix(part.kinds[part.bounds[g] : part.bounds[g + 1]], edits).ravel().tolist(), "code": int(part.kinds[part.bounds[g + 1] - 1]) // 3} for g in part.outer]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("seg", pa.int32()), ("costs", pa.list_(pa.int64())), ("code", pa.int32())]))

    def behind(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "seg"]).reset_index(drop=True)
        costs, after = edits.ends, []
        for matrix in own["costs"][::-1]:
            after.append(costs.tolist())
            costs = (np.array(matrix).reshape(4, 4) + costs).min(1)
        own["after"] = after[::-1]
        own["before"] = [None, *own["code"][:-1]]
        own["over"] = [False] * (len(own) - 1) + [True]
        return own[["part", "conv_id", "seg", "after", "before", "over"]].astype({"before": "Int32"})

    ends = settle(rows.select("part", "pos", "conv_id", "kind").mapInArrow(measure, _OUTER + ", costs array<long>, code int").groupBy("conv_id").applyInPandas(behind, _OUTER + ", after array<long>, before int, over boolean"))
    known = ends.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("seg", "after", "over", "before"))).alias("outer"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _filled(batches):
            part, out = _Part(found), []
            for g, known in zip(part.outer, part.value("outer")):
                rows = slice(part.bounds[g], part.bounds[g + 1])
                ways = Ways(part.kinds[rows], np.array([0, rows.stop - rows.start]), np.array([known["after"]]), np.array([known["over"]]), edits)
                out.append({"part": part.value("part"), "conv_id": part.table.column("conv_id")[int(rows.start)].as_py(), "seg": g, "exits": ways.exits(0) if not known["over"] else [0] * 4})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("seg", pa.int32()), ("exits", pa.list_(pa.int32()))]))

    def enter(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "seg"])
        state, states = START, []
        for exits in own["exits"]:
            states.append(state)
            state = int(exits[state])
        return own[["part", "seg"]].assign(enter=states)

    entered = rows.join(F.broadcast(known), "part").select("part", "pos", "conv_id", "kind", "outer").mapInArrow(passed, _OUTER + ", exits array<int>").groupBy("conv_id").applyInPandas(enter, "part int, seg int, enter int")
    entered = settle(entered)
    firsts = entered.where("seg = 0").select("part", "enter")
    return known.join(firsts, "part").select("part", "enter", F.col("outer")[0]["before"].alias("before"), F.element_at("outer", -1)["after"].alias("after"), F.element_at("outer", -1)["over"].alias("over"))


_EDITED = "pos long, conv_id long, ahead array<string>, edit string, role string, behind array<string>, audit string, cost long, illegal long"


def _edited(config: RepairConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    edits = _Edits(config)
    names = np.array(["", "system", "user", "assistant"])
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*LEGAL))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := _filled(batches)):
            return
        part = _Part(found)
        after = np.tile(edits.ends, (part.many, 1))
        after[-1] = part.value("after")
        over = np.ones(part.many, bool)
        over[-1] = part.value("over")
        state = np.zeros(part.many, np.int64)
        state[0] = part.value("enter")
        ways = Ways(part.kinds, part.bounds, after, over, edits)
        nodes, _ = ways.ways(ways.first * 4 + state)
        nodes = nodes[ways.letter[nodes] > 0]
        letters, places, states = ways.letter[nodes], nodes // 4, nodes % 4
        row = ways.row[places]
        n = len(part.pos)
        # inserts before a row are its own; those at a conversation's end the last row's
        ahead, behind = [[] for _ in range(n)], [[] for _ in range(n)]
        insert = letters == _INSERT
        for place, r, name in zip(places[insert].tolist(), row[insert].tolist(), names[edits.said[states[insert]]].tolist()):
            if r >= 0:
                ahead[r].append(name)
            else:
                behind[int(ways.row[place - 1])].append(name)
        own = ~insert
        edit, role, cost = np.zeros(n, np.int64), np.full(n, "", object), np.zeros(n, np.int64)
        edit[row[own]] = letters[own]
        rerole = letters == _REROLE
        role[row[rerole]] = names[edits.said[states[rerole]]]
        cost[row[own]] = edits.cost[part.kinds[row[own]], states[own], letters[own]]
        cost += config.insert * np.array([len(a) + len(b) for a, b in zip(ahead, behind)], np.int64)
        letter = _LETTERS[edit]
        audit = ["I" * len(a) + x + "I" * len(b) for a, x, b in zip(ahead, letter, behind)]
        code = part.kinds // 3
        pair = np.append(True, legal[code[:-1], code[1:]])
        pair[part.bounds[:-1]] = True
        before = part.value("before")
        pair[0] = before is None or legal[before, code[0]]
        arrays = [pa.array(part.pos), part.table.column("conv_id").combine_chunks(), pa.array(ahead, pa.list_(pa.string())), pa.array(letter.tolist()), pa.array(role, pa.string()), pa.array(behind, pa.list_(pa.string())), pa.array(audit, pa.string()), pa.array(cost), pa.array((~pair).astype(np.int64))]
        whole = pa.table(arrays, names=["pos", "conv_id", "ahead", "edit", "role", "behind", "audit", "cost", "illegal"])
        yield from whole.to_batches(max_chunksize=10_000)

    return run


def plan_repairs(kinds: DataFrame, config: RepairConfig = RepairConfig()) -> DataFrame:
    """``kinds(pos, conv_id, kind)`` to one row of edits for each row, in the order of ``pos``.

    ``ahead`` and ``behind`` are the roles inserted next to it, ``edit`` its
    letter, ``role`` its new role if it gets one; ``audit`` and ``cost`` are of
    all these. A partition's kinds are held in memory, a few bytes a row.
    """
    rows = settle(kinds.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("part", F.spark_partition_id()))
    joined = rows.join(F.broadcast(_joints(rows, config)), "part")
    return joined.select("part", "pos", "conv_id", "kind", "enter", "before", "after", "over").mapInArrow(_edited(config), _EDITED)


def repair_report(turns: DataFrame, known: DataFrame | None = None, config: RepairConfig = RepairConfig()) -> DataFrame:
    """Each conversation's faults, and its cheapest repair.

    ``turns(conv_id, turn, role, text)`` with one number follow each other by
    role and text; null numbers come first, null roles and texts are one space.
    A null ``conv_id`` is a conversation too. Those of ``known`` that have no
    turns left get zeros and an empty repair. Other columns take no part; an
    empty table gives none.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    rows = settle(_placed(slim))
    kinds = settle(_kinds(rows))
    edits = settle(plan_repairs(kinds.select("pos", "conv_id", "kind"), config))
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    faults = ("blank", "duplicate", "truncated")
    by_turn = kinds.groupBy("conv_id", "turn").agg(*map(count, faults))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    states = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in faults))

    # texts and edits of a conversation meet in one shuffle, as one row must have their hash
    none = F.lit(None)
    said = rows.select("conv_id", F.struct("pos", "role", "text").alias("turn"), none.cast("struct<pos:long,ahead:array<string>,edit:string,role:string,behind:array<string>,audit:string>").alias("change"), none.cast("long").alias("cost"), none.cast("long").alias("illegal"))
    done = edits.select("conv_id", none.cast("struct<pos:long,role:string,text:string>").alias("turn"), F.struct("pos", "ahead", "edit", "role", "behind", "audit").alias("change"), "cost", "illegal")
    met = said.union(done).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.sort_array(F.collect_list("change")).alias("changes"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))

    def lines(change: Column, turn: Column) -> Column:
        empty = lambda roles: F.transform(roles, lambda r: F.concat(r, F.lit(":")))
        own = F.when(change["edit"] == "K", F.array(F.concat(turn["role"], F.lit(":"), turn["text"]))).when(change["edit"] == "R", F.array(F.concat(change["role"], F.lit(":"), turn["text"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(empty(change["ahead"]), own, empty(change["behind"]))

    repaired = F.array_join(F.flatten(F.zip_with("changes", "turns", lines)), "\n")
    results = met.select("conv_id", "illegal", "cost", F.array_join(F.transform("changes", lambda c: c["audit"]), "").alias("audit"), F.sha2(repaired, 256).alias("repaired_sha256"))
    whole = (turns if known is None else known).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for frame in (states, results):
        whole = whole.join(frame.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counted = [zero(c) for c in ("gaps", *faults, "illegal", "cost")]
    return whole.select("conv_id", *counted, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
