"""Collections: leaves that split, upserts that touch few of them, versions that stay readable."""

import pytest
from pyspark.sql import functions as F

from quire.sources import collection, files


def points(spark, ids, value="a"):
    return spark.createDataFrame([(i, f"{value}{i}") for i in ids], "point_id long, v string")


def state(spark, path, **options):
    return {r.point_id: r.v for r in collection.read_collection(spark, path, **options).collect()}


def check(spark, path, leaf_rows):
    """Leaves part all hashes among them, each with the rows that it says."""
    found = collection.leaves(spark, path)
    assert sum(0.5 ** len(leaf.bits) for leaf in found) == 1
    for leaf in found:
        assert leaf.rows <= leaf_rows
        rows = spark.read.parquet(f"{path}/{leaf.folder}") if leaf.rows else None
        bits = F.substring(F.lpad(F.bin(F.xxhash64("point_id")), 64, "0"), 1, len(leaf.bits))
        if rows is not None:
            assert rows.count() == leaf.rows == rows.filter(bits == leaf.bits).count()


def test_leaves_split_at_their_bound(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.upsert_collection(spark, points(spark, range(30)), path, leaf_rows=50)
    assert [leaf.bits for leaf in collection.leaves(spark, path)] == [""]
    collection.upsert_collection(spark, points(spark, range(20, 400), "b"), path, leaf_rows=50)
    assert len(collection.leaves(spark, path)) >= 8
    check(spark, path, 50)
    assert state(spark, path) == {i: f"{'a' if i < 20 else 'b'}{i}" for i in range(400)}
    collection.rebuild_collection(points(spark, range(300)), path, leaf_rows=64)
    assert state(spark, path) == {i: f"a{i}" for i in range(300)}
    assert len(collection.leaves(spark, path)) == 8


def test_an_upsert_writes_touched_leaves_only(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.rebuild_collection(points(spark, range(200)), path, leaf_rows=30)
    before = {leaf.bits: leaf.folder for leaf in collection.leaves(spark, path)}
    collection.upsert_collection(spark, points(spark, [5], "new"), path, leaf_rows=60)
    after = {leaf.bits: leaf.folder for leaf in collection.leaves(spark, path)}
    assert sum(before[b] != after[b] for b in before) == 1
    assert state(spark, path)[5] == "new5" and len(state(spark, path)) == 200
    collection.upsert_collection(spark, points(spark, []), path)
    assert {leaf.bits: leaf.folder for leaf in collection.leaves(spark, path)} == after


def test_open_readers_and_old_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.rebuild_collection(points(spark, range(100)), path, leaf_rows=30)
    planned = collection.read_collection(spark, path)
    for k in range(2):
        collection.upsert_collection(spark, points(spark, range(0, 100, 3), f"n{k}-"), path, leaf_rows=30)
    assert {r.point_id: r.v for r in planned.collect()} == {i: f"a{i}" for i in range(100)}
    assert state(spark, path, version=1)[3] == "a3" and state(spark, path)[3] == "n1-3"
    for k in range(3):
        collection.upsert_collection(spark, points(spark, range(100), f"m{k}-"), path, leaf_rows=30)
    assert collection.versions(spark, path) == [4, 5, 6]
    held = {leaf.folder for v in (4, 5, 6) for leaf in collection.leaves(spark, path, v) if leaf.rows}
    there = {f"data/{d}/{leaf}" for d in files.listed(spark, f"{path}/data") for leaf in files.listed(spark, f"{path}/data/{d}") if leaf.startswith("__leaf")}
    assert there == held


def test_writers_that_die(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    collection.rebuild_collection(points(spark, range(40)), path, leaf_rows=10)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(files, "publish", killed)
        with pytest.raises(RuntimeError):
            collection.upsert_collection(spark, points(spark, range(80), "x"), path, leaf_rows=10)
    assert state(spark, path) == {i: f"a{i}" for i in range(40)}
    collection.upsert_collection(spark, points(spark, range(80), "x"), path, leaf_rows=10)
    assert state(spark, path) == {i: f"x{i}" for i in range(80)}
    check(spark, path, 10)


def test_odd_points(spark, tmp_path):
    path = str(tmp_path / "c")
    frame = spark.createDataFrame([(1, None, "x"), (None, "n", "y"), (None, "n", "y"), (1, None, "x")], "point_id long, v string, __leaf_ string")
    collection.upsert_collection(spark, frame, path, leaf_rows=1)
    assert sorted(map(str, (r.point_id for r in collection.read_collection(spark, path).collect()))) == ["1", "None"]
    collection.upsert_collection(spark, frame.withColumn("v", F.lit("z")), path, leaf_rows=1)
    assert {r.v for r in collection.read_collection(spark, path).collect()} == {"z"} and collection.read_collection(spark, path).count() == 2
    collection.rebuild_collection(frame.limit(0), path)
    assert collection.read_collection(spark, path).columns == frame.columns and collection.read_collection(spark, path).count() == 0


def test_lookup_reads_few_leaves(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.rebuild_collection(points(spark, range(500)), path, leaf_rows=20)
    found = collection.lookup(spark, path, points(spark, [7, 300, 9999]))
    assert {r.point_id for r in found.collect()} == {7, 300}
    assert len(found.inputFiles()) <= 3 * 2 < len(collection.read_collection(spark, path).inputFiles())
