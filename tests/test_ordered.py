import random

import pytest
from pyspark.sql import functions as F

from pathloom.sources.ordered import OrderedTable, write_ordered


def table(spark, tmp_path, rows, schema="id string, n int", key=("id",), files=5):
    return write_ordered(spark.createDataFrame(rows, schema), str(tmp_path / "t"), list(key), files)


def test_pages_joined_are_the_sorted_table(spark, tmp_path):
    rows = [(f"k{i}", i) for i in range(503)]
    random.Random(1).shuffle(rows)
    stored = table(spark, tmp_path, rows)
    assert stored.files.count() > 2 and stored.count() == 503
    got = [tuple(r) for page in stored.pages(100) for r in page.collect()]
    assert got == [(k, n, i) for i, (k, n) in enumerate(sorted(rows))]
    assert sorted((r["position"], r["id"]) for r in stored.numbered().collect()) == [(i, k) for i, (k, _) in enumerate(sorted(rows))]


def test_a_page_reads_only_its_files(spark, tmp_path):
    stored = table(spark, tmp_path, [(f"{i:05}", i) for i in range(1000)], files=8)
    page = stored.page(500, 10)
    assert [r["n"] for r in page.collect()] == list(range(500, 510))
    assert len(page.inputFiles()) <= 4  # one or two of the rows, one of the list
    assert len([f for f in stored.numbered().inputFiles() if "/rows/" in f]) >= 6


def test_pages_go_on_after_a_key(spark, tmp_path):
    stored = table(spark, tmp_path, [(f"{i:03}", i) for i in range(0, 200, 2)])
    for key, first in (("", 0), ("000", 2), ("001", 2), ("099", 100), ("100", 102), ("198", None), ("zzz", None)):
        got = [r["n"] for page in stored.pages(1000, (key,)) for r in page.collect()]
        assert (got[0] if got else None) == first, key


def test_ties_share_a_file_and_none_is_lost(spark, tmp_path):
    rows = [("same", i) for i in range(300)] + [(f"a{i}", i) for i in range(50)] + [(f"z{i}", i) for i in range(50)]
    stored = table(spark, tmp_path, rows)
    pages = [[r["id"] for r in page.collect()] for page in stored.pages(64)]
    assert [x for p in pages for x in p] == sorted(k for k, _ in rows)
    assert stored.after("same") == 350 and stored.after("a9") == 50
    held = stored._read().where("id = 'same'").select(F.col("_metadata.file_name").alias("f")).distinct()
    assert held.count() == 1


def test_keys_of_several_columns(spark, tmp_path):
    rows = [(s, t, i) for i, (s, t) in enumerate((s, t) for s in ("b", "a", "é", "B") for t in (10, 9, 2))]
    stored = table(spark, tmp_path, rows, "s string, t int, n int", ("s", "t"), 3)
    assert [(r["s"], r["t"]) for p in stored.pages(5) for r in p.collect()] == sorted((s, t) for s, t, _ in rows)
    assert stored.after("a", 9) == 5
    with pytest.raises(ValueError):
        stored.after("a")


def test_nulls_come_first(spark, tmp_path):
    stored = table(spark, tmp_path, [("b", 1), (None, 2), ("a", 3), (None, 4)], files=2)
    assert [r["id"] for r in stored.page(0, 9).collect()] == [None, None, "a", "b"]
    assert {r["n"] for r in stored.get(spark.createDataFrame([(None,), ("a",), ("a",), ("q",)], "id string")).collect()} == {2, 3, 4}
    assert stored.after(None) == 2


def test_empty_table_and_bad_pages(spark, tmp_path):
    stored = table(spark, tmp_path, [])
    assert list(stored.pages(10)) == [] and stored.numbered().count() == 0
    assert stored.page(0, 5).columns == ["id", "n", "position"] and stored.page(0, 5).count() == 0
    assert stored.after("x") == 0
    for start, limit in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            stored.page(start, limit)
    with pytest.raises(FileExistsError):
        table(spark, tmp_path, [("a", 1)])
    with pytest.raises(ValueError):
        write_ordered(spark.createDataFrame([(1,)], "position int"), str(tmp_path / "u"), ["position"])


def test_put_replaces_and_delete_removes(spark, tmp_path):
    stored = table(spark, tmp_path, [(f"{i:02}", i) for i in range(20)])
    put = spark.createDataFrame([(-5, "05"), (99, "99")], "n int, id string")
    new = stored.changed(str(tmp_path / "t2"), put, spark.createDataFrame([("07",), ("none",)], "id string"), 3)
    want = sorted((f"{i:02}", -5 if i == 5 else i) for i in [*range(20), 99] if i != 7)
    assert [(r["id"], r["n"]) for p in new.pages(6) for r in p.collect()] == want
    assert OrderedTable(spark, str(tmp_path / "t")).count() == 20
