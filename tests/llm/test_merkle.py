"""The Merkle manifest against trees built level by level."""

import hashlib
import random
import zlib

import pytest

from pathloom.llm.merkle import MerkleConfig, manifest, merkle_report

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    values = [*row[:4], row[4].replace("\n", "") if cut and row[4] is not None else row[4]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            way = path(trees[s], at) + path(top, i)
            own = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
            for a, b in way:
                own = digest(a, own, b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest(*(a + b for a, b in way)), own, own == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n):
    rng = random.Random(n)
    names = [None, "", "a", "é", "z", "ä b", "\U0001f600"] + ["hot"] * 6
    rows = [(None if rng.random() < 0.02 else rng.randrange(10**6), rng.choice(names), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "zz", "\n"])) for _ in range(n)]
    return rows + [rows[3]] * 4 + [(7, "long", "en", 9, "ab\n" * 60000)] if n > 10 else rows


@pytest.mark.parametrize("n, levels", [(0, 1), (1, 1), (40, 1), (300, 2), (300, 6)])
def test_equals_trees(spark, n, levels):
    """Null and repeated ids and rows, null and empty groups, a long text, an empty table, several rounds of blocks."""
    rows = rows_of(n)
    found = merkle_report(spark.createDataFrame(rows, SCHEMA), MerkleConfig(block_levels=levels))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_powers_of_three(spark):
    for n in (2, 3, 4, 9, 10, 27, 28):
        rows = [(i, "a", None, i, "x\n") for i in range(n)]
        found = merkle_report(spark.createDataFrame(rows, SCHEMA).repartition(3), MerkleConfig(block_levels=1))
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_clashing_columns(spark):
    """Columns named as internal ones take no part."""
    rows = rows_of(30)
    frame = spark.createDataFrame([(*r, "k", 1, "h") for r in rows], SCHEMA + ", key string, pos int, hash string")
    assert sorted(map(tuple, merkle_report(frame).collect()), key=str) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "ab"[i % 2], "en", 3, "x\ny") for i in range(60)]
    found = {r["doc_id"]: r["verified"] for r in merkle_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(60)}


def test_paths(spark):
    """Carried columns come back, and paths have a segment a level."""
    leaves = spark.createDataFrame([(i, "a", digest(str(i)), -i) for i in range(10)], "doc_id long, source string, hash string, note int")
    found = manifest(leaves, ["note"]).collect()
    assert sorted(r["note"] for r in found) == list(range(-9, 1)) and {len(r["path"]) for r in found} == {3}
