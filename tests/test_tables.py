"""Overlap joins by a grid, checked writes, relational merges, image files."""

import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, parse, spatial
from quire.sources import relational, storage

BOX = "struct<x:double,y:double,w:double,h:double>"


def _boxes(r, n, key, name):
    sizes = [0.0, 0.01, 0.1, 0.9, 1.4]
    return [(r.choice(["p", "q", None] if n < 50 else ["p"]), i, (round(r.uniform(-0.2, 1.1), r.choice([1, 6])), round(r.uniform(-0.2, 1.1), 2), r.choice(sizes), r.choice(sizes)) if r.random() > 0.05 else None) for i in range(n)]


@pytest.mark.parametrize("n,m", [(0, 5), (20, 30), (150, 400), (60, 2000)])
def test_overlaps_against_all_pairs(spark, n, m):
    r = random.Random(n)
    a, b = _boxes(r, n, "l", "lb"), _boxes(r, m, "r", "rb")
    frame = lambda rows, i, x: spark.createDataFrame(rows, f"page string, {i} int, {x} {BOX}")
    found = spatial.overlapping(frame(a, "i", "s"), frame(b, "j", "t"), ["page"], "s", "t").select("i", "j").collect()
    want = {
        (i, j) for p, i, s in a for q, j, t in b
        if p is not None and p == q and s and t and min(s[0] + s[2], t[0] + t[2]) > max(s[0], t[0]) and min(s[1] + s[3], t[1] + t[3]) > max(s[1], t[1])
    }
    assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_a_crowded_page(spark):
    """50,000 spans and 5,000 boxes of one page without their 250 million pairs."""
    box = lambda k, w: F.struct((k * 0.6180339887 % 1 * 0.98).alias("x"), (k * 0.7548776662 % 1 * 0.98).alias("y"), F.lit(w).alias("w"), F.lit(w).alias("h"))
    page = [F.lit("r").alias("parse_run_id"), F.lit(0).alias("page")]
    spans = spark.range(50_000).select(*page, F.col("id").cast("int").alias("ord"), F.lit("t").alias("text"), box(F.col("id"), 0.004).alias("bbox"))
    found = spark.range(5_000).select(*page, F.col("id").cast("int").alias("ord"), box(F.col("id"), 0.02).alias("bbox"))
    began = time.time()
    rows = layout.spans_in_regions(spans, found)
    assert rows.filter("size(spans) > 0").count() == 5_000
    cited = spans.select("parse_run_id", F.col("ord").alias("citation_id"), "page", "bbox")
    blocks = found.withColumn("block_id", F.concat(F.lit("b"), "ord"))
    assert parse.source_block(cited, blocks).count() == 50_000
    assert time.time() - began < 120


def test_source_block_without_overlap(spark):
    cited = spark.createDataFrame([("r", 1, 0, (0.9, 0.9, 0.05, 0.05)), ("r", 2, 0, (0.1, 0.1, 0.1, 0.1)), ("r", 3, 5, (0.1, 0.1, 0.1, 0.1)), ("r", 4, 0, None)], f"parse_run_id string, citation_id int, page int, bbox {BOX}")
    blocks = spark.createDataFrame([("r", 0, "b1", 1, (0.1, 0.1, 0.1, 0.1)), ("r", 0, "b0", 0, (0.5, 0.5, 0.1, 0.1)), ("r", 0, "b2", 2, (0.1, 0.1, 0.1, 0.1))], f"parse_run_id string, page int, block_id string, ord int, bbox {BOX}")
    found = {r.citation_id: (r.block_id, round(r.shared, 6)) for r in parse.source_block(cited, blocks).collect()}
    assert found == {1: ("b0", 0.0), 2: ("b1", 0.01), 3: (None, 0.0), 4: ("b0", 0.0)}


def test_rows_of_another_workspace_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ws: spark.createDataFrame([(w, i) for i, w in enumerate(ws)], "workspace_id string, v int")
    assert storage.append_checked(rows("a", "a", "a"), path, "a") == 3
    for bad in (rows("a", "b"), rows("a", None)):
        with pytest.raises(Exception, match="a row isn't of workspace a"):
            storage.append_checked(bad.repartition(2), path, "a")
    assert storage.append_checked(rows("b"), path, "b") == 1
    assert spark.read.parquet(path).groupBy("workspace_id").count().orderBy("workspace_id").collect() == [("a", 3), ("b", 1)]
    assert storage.read_table(spark, path, "a").count() == 3


def test_merges_can_be_repeated(spark):
    url = "jdbc:derby:memory:merges;create=true"
    relational.create(spark, url, "runs", "id BIGINT PRIMARY KEY, state VARCHAR(20), n INT")
    rows = lambda *r: spark.createDataFrame(r, "id long, state string, n int")
    skewed = rows(*[(i * i * 1000, "queued", i) for i in range(40)], (None, "lost", 0), (1, "queued", 1), (1, "queued", 1))
    assert relational.merge(skewed, url, "runs", ["id"]) == 41
    for _ in range(2):
        relational.merge(rows((0, "failed", 9), (5, "new", None)), url, "runs", ["id"])
    found = {r.ID: (r.STATE, r.N) for r in relational.read_even(spark, url, "runs", "id", 7).collect()}
    assert len(found) == 42 and found[0] == ("failed", 9) and found[5] == ("new", None) and found[1000] == ("queued", 1)
    with pytest.raises(Exception, match="STATE|truncation|length"):
        relational.merge(rows((7, "x" * 50, 1), (0, "changed", 1)), url, "runs", ["id"])
    after = {r.ID: (r.STATE, r.N) for r in relational.read_even(spark, url, "runs", "id", 3).collect()}
    assert after == found  # the failed merge left nothing
    tables = spark.read.jdbc(url, "SYS.SYSTABLES").filter("TABLENAME like 'STAGING%'").count()
    assert tables == 0
