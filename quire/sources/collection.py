"""Keyed collections by extendible hashing, with snapshots.

A collection is a folder. ``data`` holds folders of Parquet files, each with the rows of one leaf: the keys whose
hash begins with the leaf's bits. ``snapshots/N.json`` lists the leaves of version N: bits, folder and rows.
A leaf that outgrows its bound splits into leaves of one bit more, so an upsert writes the leaves that its keys
fall into, in as many tasks as there are leaves, and no others. A version counts once its snapshot file is there;
the folders of the last versions stay, so what was read from them can still be worked on. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

#: Rows of a leaf at most, of a file at most, and versions that stay readable.
LEAF_ROWS, FILE_ROWS, KEEP = 1_000_000, 500_000, 3
#: Larger directories are joined instead of broadcast.
BROADCAST_SLOTS = 1 << 20


@dataclass(frozen=True)
class Leaf:
    """Keys whose hash begins with ``bits`` (a text of 0 and 1)."""

    bits: str
    folder: str
    rows: int


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions whose snapshots are still there."""
    return [int(name[:-5]) for name in files.listed(spark, f"{path}/snapshots") if name.endswith(".json")]


def _snapshot(spark: SparkSession, path: str, version: int | None) -> dict:
    there = versions(spark, path)
    if not there:
        return {"schema": None, "leaves": []}
    return json.loads(files.read_text(spark, f"{path}/snapshots/{version or there[-1]:09d}.json"))


def leaves(spark: SparkSession, path: str, version: int | None = None) -> list[Leaf]:
    """Leaves of a version, by default the last; none of a collection that isn't there."""
    return [Leaf(**leaf) for leaf in _snapshot(spark, path, version)["leaves"]]


def read_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A collection as a version, by default the last, has it."""
    found = _snapshot(spark, path, version)
    if found["schema"] is None:
        raise FileNotFoundError(f"no collection at {path}")
    return _rows(spark, path, found["schema"], [leaf["folder"] for leaf in found["leaves"] if leaf["rows"]])


def _rows(spark: SparkSession, path: str, schema: dict, folders: list[str]) -> DataFrame:
    kind = StructType.fromJson(schema)
    return spark.read.schema(kind).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], kind)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "point_id") -> DataFrame:
    """The rows of a collection with the keys of ``keys``; only leaves that these fall into are read."""
    found = _snapshot(spark, path, None)
    if found["schema"] is None:
        raise FileNotFoundError(f"no collection at {path}")
    wanted = keys.select(key).distinct()
    hit = {r[0] for r in _placed(wanted, key, [leaf["bits"] for leaf in found["leaves"]]).select("__leaf").distinct().collect()}
    rows = _rows(spark, path, found["schema"], [leaf["folder"] for leaf in found["leaves"] if leaf["bits"] in hit and leaf["rows"]])
    return rows.join(wanted.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def rebuild_collection(points: DataFrame, path: str, key: str = "point_id", leaf_rows: int = LEAF_ROWS, keep: int = KEEP) -> None:
    """Replace a whole collection; readers see the old one until the new one is committed."""
    spark = points.sparkSession
    depth = 0
    n = points.count()
    while n > leaf_rows << depth:
        depth += 1
    _write(spark, points, path, key, [], _of_depth("", depth), leaf_rows, keep)


def upsert_collection(
    spark: SparkSession, points: DataFrame, path: str, key: str = "point_id", order: str | None = None, leaf_rows: int = LEAF_ROWS, keep: int = KEEP
) -> None:
    """Put points into a collection, last write wins.

    Of points that share a key the one with the greatest ``order`` column counts (without one, or on
    ties, the greatest hash of the row, so that reruns agree); null keys are keys like any other. Only leaves
    that get points are written again; a crash at any time leaves the last version. An empty ``points``
    changes nothing. Columns are those of ``points``.
    """
    ranks = [F.col(order).desc_nulls_last()] if order else []
    by_key = Window.partitionBy(key).orderBy(*ranks, F.xxhash64(*points.columns).desc())
    new = points.withColumn("__i", F.row_number().over(by_key)).filter("__i = 1").drop("__i")
    place = files.scratch(spark, "upsert")
    new.write.parquet(place)  # read four times, by a sort and by joins
    new = spark.read.schema(new.schema).parquet(place)
    before = leaves(spark, path) or [Leaf("", "", 0)]
    touched = {r["__leaf"]: r["count"] for r in _placed(new, key, [leaf.bits for leaf in before]).groupBy("__leaf").count().collect()}
    old = [leaf for leaf in before if leaf.bits in touched]
    if touched:
        held = [leaf.folder for leaf in old if leaf.rows]
        rows = new
        if held:
            same = F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}"))
            kept = _rows(spark, path, _snapshot(spark, path, None)["schema"], held).alias("old").join(new.select(key).alias("new"), same, "left_anti")
            rows = kept.select(new.columns).unionByName(new)
        bits = [leaf.bits for leaf in old]
        full = [leaf.bits for leaf in old if leaf.rows + touched[leaf.bits] > leaf_rows]  # counts an update twice: asked again below
        if full:
            bits = [b for b in bits if b not in full] + _split(rows, key, full, leaf_rows)
        _write(spark, rows, path, key, [leaf for leaf in before if leaf.bits not in touched], bits, leaf_rows, keep)
    files.deleted(spark, place)


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key))


def _bits(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash as text."""
    return F.substring(F.lpad(F.bin(h), 64, "0"), 1, depth)


def _of_depth(bits: str, more: int) -> list[str]:
    return [bits + (format(k, f"0{more}b") if more else "") for k in range(1 << more)]


def _placed(rows: DataFrame, key: str, bits: list[str]) -> DataFrame:
    """``rows`` with ``__leaf``, the one of ``bits`` that their key's hash begins with; others go."""
    depth = max(map(len, bits))
    slots = [(s, b) for b in bits for s in _of_depth(b, depth - len(b))]
    if depth == 0:
        return rows.withColumn("__leaf", F.lit(""))
    directory = rows.sparkSession.createDataFrame(slots, "__slot string, __leaf string")
    if len(slots) <= BROADCAST_SLOTS:
        directory = F.broadcast(directory)
    return rows.withColumn("__slot", _bits(_hash(key), depth)).join(directory, "__slot").drop("__slot")


def _split(rows: DataFrame, key: str, full: list[str], leaf_rows: int) -> list[str]:
    """Leaves in place of the ``full`` ones, each with as few bits as keep it within its bound."""
    out, ask = [], full
    while ask:
        more = {b: b for b in ask}
        depth = max(map(len, ask)) + 4
        counted = _placed(rows, key, ask).groupBy("__leaf", _bits(_hash(key), depth).alias("b")).count().collect()
        sizes = {r.b: r["count"] for r in counted}  # 16 entries a leaf, or more for those of fewer bits
        ask = []
        for b in more:
            queue = [b]
            while queue:
                now = queue.pop()
                n = sum(c for x, c in sizes.items() if x.startswith(now))
                if n <= leaf_rows:
                    out.append(now)
                elif len(now) < depth and len(now) < 64:
                    queue += [now + "0", now + "1"]
                elif len(now) < 64:
                    ask.append(now)
                else:
                    out.append(now)
    return sorted(out)


def _write(spark: SparkSession, rows: DataFrame, path: str, key: str, same: list[Leaf], bits: list[str], leaf_rows: int, keep: int) -> None:
    """Commit a version of the leaves ``same`` and of ``rows`` in leaves of ``bits``."""
    there = versions(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    placed = _placed(rows, key, bits).withColumn("__leaf", F.concat(F.lit("b"), "__leaf"))
    out = placed.repartition(max(1, len(bits)), "__leaf").write.option("maxRecordsPerFile", min(FILE_ROWS, leaf_rows))
    out.partitionBy("__leaf").parquet(f"{path}/{folder}")
    made = {name[len("__leaf=b") :] for name in files.listed(spark, f"{path}/{folder}") if name.startswith("__leaf=b")}
    counts = {}
    if made:
        counts = {r[0][1:]: r[1] for r in spark.read.parquet(f"{path}/{folder}").groupBy(F.col("__leaf").cast("string")).count().collect()}
    new = [Leaf(b, f"{folder}/__leaf=b{b}" if b in counts else "", counts.get(b, 0)) for b in bits]
    listed = sorted([*same, *new], key=lambda leaf: leaf.bits)
    version = (there[-1] if there else 0) + 1
    files.publish(spark, f"{path}/snapshots/{version:09d}.json", json.dumps({"schema": rows.schema.jsonValue(), "leaves": [vars(leaf) for leaf in listed]}))
    _forget(spark, path, [*there, version], keep)


def _forget(spark: SparkSession, path: str, there: list[int], keep: int) -> None:
    """Delete all versions but the last ``keep``, and the folders that only they used."""
    gone, stay = there[:-keep], there[-keep:]
    if not gone:
        return
    used = {leaf.folder for v in stay for leaf in leaves(spark, path, v)}
    old = {leaf.folder for v in gone for leaf in leaves(spark, path, v)}
    files.deleted(spark, *(f"{path}/snapshots/{v:09d}.json" for v in gone), *(f"{path}/{f}" for f in sorted(old - used) if f))
