"""Approximate nearest neighbours: NN-descent builds the graph, queries search it greedily.

Equal vectors are one node, so a vector that a third of all rows hold is one node with many rows.
The graph starts from random directions (nodes that share their nearest direction, in groups of
bounded size) and gets better by local joins: nodes that have a neighbour in common meet there, in
blocks of bounded size, and what improves a node's list is merged into it, until little changes. A
query starts at its own place; all queries go one step of the greedy search at once, in joins of
ids, and only ids of nodes that aren't on a query's list are sent. How wide a search has to be depends on the
data and its size: a sample of the queries is also compared with all nodes, and searches go on, twice
as wide, until they find enough of what that finds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_if_small
from .common import cut, deleted, scratch

#: Most members of a block that is compared all with all: of a direction, and of a common neighbour.
BLOCK, HUB = 512, 128
#: Larger tables of nodes that very many others have as a neighbour are joined instead of broadcast.
BROADCAST_HUBS = 500_000
#: Queries whose true nearest nodes are looked up to see how wide searches must be, and the share of those that must be found.
PROBES, RECALL = 100, 0.95
_LISTS = "node long, ids array<long>, ds array<float>"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) without vectors that are null, empty, zero or hold null or non-finite components.

    Vectors of another length than most have take no part either; ties go to the shorter length.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    lengths = kept.groupBy(F.size("v").alias("d")).count()
    length = lengths.orderBy(F.desc("count"), "d").limit(1).select("d").first()
    return kept.filter(F.size("v") == (length.d if length else 0))


def _binary(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _packed(nodes: DataFrame) -> DataFrame:
    """(node, v) with v as bytes of 32-bit floats, for the approximate steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("<f4") if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "v"])

    return nodes.mapInArrow(run, "node long, v binary")


def _compare(groups: DataFrame, keep: int) -> DataFrame:
    """Of each member of ``groups`` (array of node, v, worst) the ``keep`` best in its group under its worst, as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            column = batch.column("members")
            flat = column.flatten()
            node, worst, vectors = flat.field("node").to_numpy(), flat.field("worst").to_numpy(), flat.field("v")
            ends = np.cumsum([0, *column.value_lengths().to_pylist()])
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                x = _binary(vectors[i:j])
                s = (x * x).sum(1)
                dist = np.sqrt(np.maximum(s[:, None] + s - 2 * (x @ x.T), 0))
                np.fill_diagonal(dist, np.inf)
                k = min(keep, j - i - 1)
                best = np.argpartition(dist, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(dist, best, 1)
                good = got < worst[i:j, None]
                some = good.any(axis=1)
                out.append((node[i:j][some], node[i:j][best[good]], got[good], good.sum(axis=1)[some]))
            a, b, d, n = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, t) for t in (np.int64, np.int64, np.float32, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), _lists(b, n, pa.int64()), _lists(d, n, pa.float32())], names=["node", "ids", "ds"])

    return groups.select("members").mapInArrow(run, _LISTS)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """(node, v, ids, ds, changed): the ``k`` nearest in all lists of a node; ``changed`` are those not in its own one.

    ``rows`` has (node, v, ids, ds), v only in the node's own row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, own = batch.column("ids"), batch.column("own")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            ids, d = lists.flatten().to_numpy(), batch.column("ds").flatten().to_numpy()
            order = np.lexsort((d, ids, row))
            order = order[_firsts(row[order], ids[order])]
            order = order[np.lexsort((ids[order], d[order], row[order]))]
            row, ids, d = row[order], ids[order], d[order]
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            top = np.arange(len(row)) - begin[row] < k
            row, ids, d = row[top], ids[top], d[top]
            n = np.bincount(row, minlength=batch.num_rows)
            before = [set(x) for x in own.to_pylist()]
            changed = [sum(i not in before[r] for i in x) for r, x in enumerate(map(np.ndarray.tolist, np.split(ids, np.cumsum(n)[:-1])))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("v"), _lists(ids, n, pa.int64()), _lists(d, n, pa.float32()), pa.array(changed, pa.int32())],
                names=["node", "v", "ids", "ds", "changed"],
            )

    own = F.first(F.when(F.col("v").isNotNull(), F.col("ids")), ignorenulls=True)
    merged = rows.groupBy("node").agg(
        F.first("v", ignorenulls=True).alias("v"), F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("ds")).alias("ds"), own.alias("own")
    )
    return merged.mapInArrow(run, "node long, v binary, ids array<long>, ds array<float>, changed int")


def _firsts(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])])[: len(row)]


def _alone(nodes: DataFrame) -> DataFrame:
    """Each of ``nodes`` (node, v) with empty lists."""
    return nodes.select("node", "v", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("ds"))


def _starts(nodes: DataFrame, n: int, tables: int, k: int, seed: int) -> DataFrame:
    """First neighbours: nodes with the same nearest of some random directions, in blocks."""
    directions = int(min(4096, max(1, 2 * n // BLOCK)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = _binary(batch.column("v")), []
            for t in range(tables):
                rays = np.random.default_rng(seed + t).normal(size=(directions, x.shape[1])).astype(np.float32)
                rays /= np.linalg.norm(rays, axis=1, keepdims=True)
                cell.append(np.argmax(x @ rays.T, axis=1) + t * directions)
            cells = pa.array([*np.stack(cell, 1).astype(np.int32)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), cells], names=["node", "v", "cell"])

    rows = cut(nodes.mapInArrow(cells, "node long, v binary, cell array<int>")).select("node", "v", F.explode("cell").alias("cell"))
    sizes = F.broadcast(rows.groupBy("cell").agg(F.count("*").alias("n")))  # tables * directions rows at most
    part = F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("n") / (BLOCK / 2)))
    groups = rows.join(sizes, "cell").groupBy("cell", part.alias("part"))
    groups = groups.agg(F.collect_list(F.struct("node", "v", F.lit(float("inf")).cast("float").alias("worst"))).alias("members"))
    return _best(_alone(nodes).unionByName(_compare(groups, k), allowMissingColumns=True), k)


def _freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints of rounds before, which it does when the driver collects garbage."""
    spark._jvm.System.gc()


def graph(nodes: DataFrame, k: int = 32, tables: int = 3, settled: float = 0.03, seed: int = 11) -> DataFrame:
    """(node, v, ids, ds, changed): the ``k`` nearest found of each of ``nodes`` (node, v as bytes), nearest first.

    Rounds end when less than ``settled`` of all entries change, however many it takes (more nodes take more); they do end, as an entry
    only ever gives way to a nearer one. A round
    sends every node with its vector to its neighbours, and what they find back: two exchanges, and a
    small one that counts how many come to a node.
    """
    n = nodes.count()
    knn = cut(_starts(nodes, n, tables, k, seed))
    while True:
        worst = F.when(F.size("ids") < k, F.lit(float("inf"))).otherwise(F.array_max("ds")).cast("float")
        sent = knn.select(F.explode(F.concat("ids", F.array("node"))).alias("pivot"), "node", "v", worst.alias("worst"))
        hubs = cut(sent.groupBy("pivot").agg(F.count("*").alias("n")).filter(F.col("n") > HUB))
        small = hubs.count() <= BROADCAST_HUBS
        sent = sent.join(F.broadcast(hubs) if small else hubs, "pivot", "left")
        part = F.pmod(F.xxhash64("node", "pivot"), F.ceil(F.coalesce("n", F.lit(1)) / HUB))
        groups = sent.groupBy("pivot", part.alias("part")).agg(F.collect_list(F.struct("node", "v", "worst")).alias("members"))
        knn = cut(_best(knn.drop("changed").unionByName(_compare(groups, 16), allowMissingColumns=True), k))
        if (knn.agg(F.sum("changed")).first()[0] or 0) <= settled * n * k:
            return knn
        _freed(nodes.sparkSession)


def _distances(pairs: DataFrame) -> DataFrame:
    """(q, node, d) of rows (q, qv, node, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.linalg.norm(_binary(batch.column("qv")) - _binary(batch.column("v")), axis=1) if batch.num_rows else np.empty(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(d, pa.float32())], names=["q", "node", "d"])

    return pairs.select("q", "qv", "node", "v").mapInArrow(run, "q long, node long, d float")


_SEEN = "q long, ids array<long>, ds array<float>, opened array<boolean>, front array<long>"


def _advance(rows: DataFrame, width: int) -> DataFrame:
    """Searches (q, ids, ds, opened) with the nodes to open next: those among the ``width`` nearest that aren't open.

    Lists keep the nearest ``2 * width``, nearest first: what is farther can't get among the ``width`` nearest any more, nor
    among those of a search twice as wide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *batch.column("ids").value_lengths().to_pylist()]).tolist()
            ids, ds, opened = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ds", "opened"))
            kept, n, fronts, m = [], [], [], []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                order = i + np.lexsort((ids[i:j], ds[i:j]))[: 2 * width]
                near = order[:width]
                kept.append(order)
                fronts.append(near[~opened[near]])
                n.append(len(order))
                m.append(len(fronts[-1]))
            kept, fronts = (np.concatenate([np.empty(0, np.int64), *x]) for x in (kept, fronts))
            done = opened.copy()
            done[fronts] = True
            lists = [_lists(ids[kept], n, pa.int64()), _lists(ds[kept], n, pa.float32()), _lists(done[kept], n, pa.bool_()), _lists(ids[fronts], m, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("q"), *lists], names=["q", "ids", "ds", "opened", "front"])

    return rows.select("q", "ids", "ds", "opened").mapInArrow(run, _SEEN)


def _radii(nodes: DataFrame, probes: list[tuple[int, bytes]], top: int) -> DataFrame:
    """(q, n, radius): how many other nodes, ``top`` at most, are a probe's nearest of all ``nodes``, and how far the last of them is."""
    shared = nodes.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, x, out = batch.column("node").to_numpy(), _binary(batch.column("v")), []
            for q, v in shared.value:
                d = np.linalg.norm(np.frombuffer(v, "<f4") - x, axis=1)[node != q]
                out.append(np.partition(d, top - 1)[:top] if len(d) > top else d)
            q = pa.array([q for q, _ in shared.value], pa.int64())
            yield pa.RecordBatch.from_arrays([q, _lists(np.concatenate(out), np.array([len(d) for d in out]), pa.float32())], names=["q", "ds"])

    near = nodes.select("node", "v").mapInArrow(run, "q long, ds array<float>").groupBy("q")
    near = near.agg(F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, top).alias("ds"))
    return near.select("q", F.size("ds").alias("n"), F.array_max("ds").alias("radius"))


def _share_found(seen: DataFrame, radii: DataFrame) -> float:
    """Share of the nearest nodes of the probes that their searches have on their lists, by distance, so that ties count alike."""
    near = F.size(F.filter("ds", lambda d: d <= F.col("radius") * (1 + 1e-6))) - 1  # without the query's own node
    hits = seen.join(F.broadcast(radii), "q").agg(F.sum(F.least(near, "n")).alias("hits"), F.sum("n").alias("n")).first()
    return hits.hits / hits.n if hits.n else 1.0


def search(knn: DataFrame, queries: DataFrame, width: int = 96, top: int = 10) -> DataFrame:
    """(q, node): the ``width`` nearest nodes that a greedy search from each query node finds.

    A query (q, a node of the graph) starts at its own place. Each round opens, for all queries at
    once, the nodes among its ``width`` nearest that aren't open yet, until none is left. If then less than RECALL of the
    ``top`` nearest nodes of PROBES of the queries are found, searches go on twice as wide, as long as that finds more. The graph is
    a table in buckets of nodes, so rounds send queries to it and don't move it.
    """
    spark = knn.sparkSession
    buckets, name, place = int(spark.conf.get("spark.sql.shuffle.partitions")), f"neighbours_{uuid.uuid4().hex}", scratch(spark, "graph")
    kept = knn.select("node", "v", "ids").repartition(buckets, "node")
    kept.write.bucketBy(buckets, "node").sortBy("node").option("path", place).saveAsTable(name)
    table = spark.table(name)
    start = knn.join(queries.select(F.col("q").alias("node")), "node")
    asked = cut(start.select(F.col("node").alias("q"), F.col("v").alias("qv")))
    probes = [(r.q, bytes(r.qv)) for r in asked.orderBy("q").limit(PROBES).collect()]  # ids of nodes are hashes, so this is a sample
    radii = cut(_radii(knn, probes, top))
    vectors = broadcast_if_small(asked)
    own = lambda kind, value: F.array(F.lit(value).cast(kind))
    start = start.select(
        F.col("node").alias("q"), F.concat(F.array("node"), "ids").alias("ids"), F.concat(own("float", 0.0), "ds").alias("ds"),
        F.concat(own("boolean", True), F.transform("ids", lambda _: F.lit(False))).alias("opened"),
    )
    seen, wide, before = cut(_advance(start, width)), width, -1.0
    while True:
        front = seen.select("q", F.explode("front").alias("node"))
        if front.isEmpty():
            share = _share_found(seen, radii)
            if share >= RECALL or share < before + 0.005:
                break
            wide, before = 2 * wide, share
            seen = cut(_advance(seen, wide))
            continue
        reach = front.join(table.select("node", "ids"), "node").groupBy("q").agg(F.flatten(F.collect_list("ids")).alias("reach"))
        fresh = seen.join(reach, "q").select("q", F.explode(F.array_except("reach", "ids")).alias("node"))
        met = _distances(fresh.join(table.select("node", "v"), "node").join(vectors, "q"))
        met = met.groupBy("q").agg(F.collect_list("node").alias("new"), F.collect_list("d").alias("far"))
        both = lambda old, new, kind: F.concat(old, F.coalesce(new, F.array().cast(f"array<{kind}>"))).alias(old)
        closed = F.transform("new", lambda _: F.lit(False))
        seen = seen.join(met, "q", "left").select("q", both("ids", "new", "long"), both("ds", "far", "float"), both("opened", closed, "boolean"))
        seen = cut(_advance(seen, wide))
        _freed(spark)
    spark.sql(f"DROP TABLE {name}")
    deleted(spark, place)
    return seen.select("q", F.explode(F.slice("ids", 1, width)).alias("node"))


def nearest(rows: DataFrame, top: int = 10, every: int = 100, k: int = 32, width: int = 96) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query.

    Queries are the rows of ``rows`` (vec_id, embedding) whose vec_id is divisible by ``every``; all
    rows are indexed and all but the query's own row are candidates. ``score`` is the Euclidean
    distance of the original vectors in double precision; ties go to the smaller vec_id. Vectors that
    ``usable`` leaves out take no part, as query or candidate; rows that repeat a vec_id count once
    for each different vector. A query with fewer candidates has them all. Other columns are ignored;
    an empty table gives an empty result.
    """
    good = usable(rows)
    nodes = cut(good.groupBy("v").agg(F.min("vec_id").alias("least")).select(F.xxhash64("v").alias("node"), "v"))
    ids = good.select(F.xxhash64("v").alias("node"), "vec_id").distinct()
    knn = graph(cut(_packed(nodes)), max(k, top + 1))
    asked = cut(ids.filter(F.pmod("vec_id", F.lit(every)) == 0))
    found = search(knn, asked.select(F.col("node").alias("q")).distinct(), max(width, 2 * top), top)
    first = ids.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("i") <= top + 1)
    first = first.select("node", "vec_id")
    original = nodes.select("node", "v")
    pairs = found.join(original, "node").join(original.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    gap = F.aggregate(F.zip_with("v", "qv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.select("q", "node", F.sqrt(gap).alias("score"))
    hits = exact.join(first, "node").join(asked.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")), "q")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    hits = hits.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return hits.select("query_id", "rank", "vec_id", "score")
