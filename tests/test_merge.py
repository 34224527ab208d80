"""Merges at once against merges one after the other."""

import random

import pytest

from pathloom.operators import merge
from pathloom.operators.graph import Graph

MERGES = "absorbed string, keep string, ord long"
NODES = "id string, type string, name string, aliases array<string>, summary string"


class Plain:
    """One merge after the other."""

    def __init__(self, nodes, edges, attributes, provenance):
        self.nodes = {i: {"type": t, "name": n, "aliases": list(a), "summary": s} for i, t, n, a, s in nodes}
        self.types = {i: {t: {i}} for i, t, *_ in nodes}
        self.edges = dict(edges)
        self.values = {i: {} for i in self.nodes}
        for i, key, value, source in attributes:
            self.values[i].setdefault(key, {}).setdefault(value, set()).add(source)
        self.provenance = {i: list(p) for i, p in provenance.items()}

    def merge(self, absorbed, keep):
        a, k = self.nodes.pop(absorbed), self.nodes[keep]
        k["aliases"] = [x for x in dict.fromkeys((*k["aliases"], a["name"], *a["aliases"])) if x != k["name"]]
        k["summary"] = k["summary"] if k["summary"] is not None else a["summary"]
        for t, ids in self.types.pop(absorbed).items():
            self.types[keep].setdefault(t, set()).update(ids)
        for key, values in self.values.pop(absorbed).items():
            for value, sources in values.items():
                self.values[keep].setdefault(key, {}).setdefault(value, set()).update(sources)
        self.provenance[keep] = list(dict.fromkeys(self.provenance[keep] + self.provenance.pop(absorbed)))
        out = {}
        for (s, t, o), n in self.edges.items():
            now = (keep if s == absorbed else s, t, keep if o == absorbed else o)
            if now[0] != now[2] or s == o:
                out[now] = out.get(now, 0) + n
        self.edges = out


def made(seed, n, merges):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    nodes = [(i, rng.choice("xxy"), f"name {rng.randrange(n)}", sorted({f"alias {rng.randrange(9)}" for _ in range(rng.randrange(3))}), rng.choice([None, None, f"about {i}"])) for i in ids]
    edges = {(rng.choice(ids), rng.choice("rs"), rng.choice(ids)): rng.randrange(1, 4) for _ in range(4 * n)}
    attributes = sorted({(i, rng.choice("ab"), rng.choice("123"), rng.choice("pqr")) for i in ids for _ in range(2)})
    provenance = {i: list(dict.fromkeys(rng.choice("stuvw") for _ in range(2))) for i in ids}
    left, sequence = list(ids), []
    for _ in range(merges):
        absorbed, keep = rng.sample(left, 2)
        left.remove(absorbed)
        sequence.append((absorbed, keep))
    return nodes, edges, attributes, provenance, sequence


@pytest.mark.parametrize("seed, n, merges", [(0, 8, 5), (1, 40, 35), (2, 60, 20)])
def test_equals_the_sequence(spark, seed, n, merges):
    nodes, edges, attributes, provenance, sequence = made(seed, n, merges)
    plain = Plain(nodes, edges, attributes, provenance)
    for absorbed, keep in sequence:
        plain.merge(absorbed, keep)
    mapping = merge.resolved(spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(sequence)], MERGES))
    found, conflicts = merge.merged_nodes(spark.createDataFrame(nodes, NODES), mapping)
    assert {r["id"]: (r["type"], r["name"], r["aliases"], r["summary"]) for r in found.collect()} == {i: tuple(x.values()) for i, x in plain.nodes.items()}
    assert {(r["id"], r["type"], tuple(r["sources"])) for r in conflicts.collect()} == {(i, t, tuple(sorted(ids))) for i, types in plain.types.items() if len(types) > 1 for t, ids in types.items()}
    rows = spark.createDataFrame([(*e, w) for e, w in edges.items()], "source string, type string, target string, n long")
    assert {(r["source"], r["type"], r["target"]): r["n"] for r in merge.merged_edges(rows, mapping).collect()} == plain.edges
    values = spark.createDataFrame([(i, k, v, 0, s) for i, k, v, s in attributes], "id string, key string, value string, ord int, source_id string")
    kept, differing = merge.merged_attributes(values, mapping)
    assert {(r["id"], r["key"]) for r in kept.collect()} == {(i, k) for i, keys in plain.values.items() for k in keys}
    assert {(r["id"], r["key"], r["value"], tuple(r["sources"])) for r in differing.collect()} == {(i, k, v, tuple(sorted(s))) for i, keys in plain.values.items() for k, vs in keys.items() if len(vs) > 1 for v, s in vs.items()}
    support = spark.createDataFrame([(i, s, n) for i, p in provenance.items() for n, s in enumerate(p)], "element string, source_id string, ord int")
    got = {}
    for r in sorted(merge.merged_provenance(support, mapping).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["element"], []).append(r["source_id"])
    assert got == plain.provenance


def test_kept_values_and_edges_attributes(spark):
    """The kept node's own value stays, else that of the node absorbed first."""
    mapping = merge.resolved(spark.createDataFrame([("c", "b", 1), ("b", "a", 3), ("d", "a", 2)], MERGES))
    values = spark.createDataFrame([("c", "k", "3", 0, "s"), ("d", "k", "4", 0, "s"), ("b", "k", "2", 0, "t"), ("a", "own", "1", 0, "t"), ("c", "own", "9", 0, "u")], "id string, key string, value string, ord int, source_id string")
    kept, _ = merge.merged_attributes(values, mapping)
    assert {(r["id"], r["key"], r["value"]) for r in kept.collect()} == {("a", "k", "4"), ("a", "own", "1")}
    edges = spark.createDataFrame([("b", "r", "x", "w", "2", 0, "s"), ("a", "r", "x", "w", "1", 0, "t"), ("a", "r", "d", "w", "5", 0, "t")], "source string, type string, target string, key string, value string, ord int, source_id string")
    kept, conflicts = merge.merged_edge_attributes(edges, mapping)
    assert [(tuple(r["id"]), r["value"]) for r in kept.collect()] == [(("a", "r", "x"), "1")]
    assert {(r["value"], tuple(r["sources"])) for r in conflicts.collect()} == {("1", ("t",)), ("2", ("s",))}


def test_a_long_chain(spark):
    """A thousand merges in a row end in one node, in the order in which it took them in."""
    n = 1000
    mapping = merge.resolved(spark.createDataFrame([(f"n{i}", f"n{i - 1}", -i) for i in range(1, n + 1)], MERGES)).collect()
    assert len(mapping) == n and {r["keep"] for r in mapping} == {"n0"}
    assert [r["absorbed"] for r in sorted(mapping, key=lambda r: r["way"])] == [f"n{i}" for i in range(1, n + 1)]


def test_odd_merges(spark):
    assert merge.resolved(spark.createDataFrame([], MERGES)).count() == 0
    rows = merge.resolved(spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("d", "d", 3)], MERGES)).collect()
    assert [(r["absorbed"], r["keep"]) for r in rows] == [("a", "b")]
    for cycle in ([("a", "b", 1), ("b", "a", 2)], [("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "a", 4)]):
        with pytest.raises(ValueError, match="cycle"):
            merge.resolved(spark.createDataFrame(cycle, MERGES))


def test_cascade(spark):
    graph = Graph(spark.createDataFrame([(i, "t", i) for i in "abcd"], "id string, type string, name string"), spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "d")], "source string, type string, target string"))
    out = merge.cascade(graph, spark.createDataFrame([("b",), ("zz",)], "id string"), spark.createDataFrame([("c", "r", "d"), ("a", "r", "b")], "source string, type string, target string"))
    assert tuple(out.first()) == (1, 2, 1)
