"""Shared pieces of the training-data operators: scratch space, words, hashes, components."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (tests on one machine) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quire-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and where."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables made by ``written``."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Scratch tables of one job, deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def drop(self) -> None:
        deleted(self.spark, *self.paths)
        self.paths = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_task(spark: SparkSession, f: Callable, *args: object) -> object:
    """``f(*args)`` run in one task: linear algebra of a size that parameters bound.

    Spark gives a worker as many BLAS threads as a task has cores; the driver's own pool can hang
    after the fork that starts the JVM.
    """
    shared = spark.sparkContext.broadcast(args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*shared.value))], pa.binary())], names=["x"])

    return pickle.loads(spark.range(1).coalesce(1).mapInArrow(run, "x binary").first().x)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SLICE = 1 << 17
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, 0 to at least ``n`` - 1."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def folded(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For ``word_hashes``: each byte's value and if it parts words, after ``table`` has replaced it."""
    to = np.frombuffer(table, np.uint8)
    own = finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return np.where(_SPACE[to], np.uint64(0), own[to]), _SPACE[to]


PLAIN_BYTES = bytes(range(256))


def word_hashes(texts: pa.Array, fold: tuple[np.ndarray, np.ndarray] | None = None, sizes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one entry more than texts).

    ``sizes`` takes arrays of the words' characters.

    A word is a run of bytes that don't part words (ASCII white space, or what ``fold`` says). Its hash
    is a polynomial in its bytes, taken from running sums over slices of the texts' own buffer, so
    no word becomes an object. Null texts have no words.
    """
    value, space_of = fold or _plain_fold
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    bounds = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    end, lo, hashes, places = int(bounds[-1]), int(bounds[0]), [], []
    while lo < end:
        hi = min(end, lo + _SLICE)
        while hi < end:  # go on to the next white space
            ahead = np.flatnonzero(space_of[data[hi : hi + _SLICE]])
            if len(ahead):
                hi += int(ahead[0])
                break
            hi = min(end, hi + _SLICE)
        raw = data[lo:hi]
        up, down = _power(hi - lo)
        space = space_of[raw]
        cut_at = bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")] - lo
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        first[cut_at] = ~space[cut_at]
        last[cut_at - 1] = ~space[cut_at - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        terms = value[raw] * up[: hi - lo]
        sums = np.cumsum(terms)
        hashes.append(finish((sums[last] - sums[first] + terms[first]) * down[first]))
        places.append(first + lo)
        if sizes is not None:
            letters = np.cumsum(raw & 0xC0 != 0x80)
            sizes.append(letters[last] - letters[first] + 1)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    return h, np.searchsorted(at, bounds)


def run_hashes(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each run of ``n`` word hashes from place ``first`` on; ``n`` is 1 at least."""
    up, down = _power(len(h))
    terms = h * up[: len(h)]
    sums = np.cumsum(terms)
    return finish((sums[first + n - 1] - sums[first] + terms[first]) * down[first] + n.astype(np.uint64))


def slices(batch: pa.RecordBatch, most: int = 1 << 22, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of its texts; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, part, size, power = None, h, 1, base % 2**64
    covered, left = 0, width
    while left:
        if left & 1:
            piece = part[covered : covered + n]
            done = piece if done is None else done * np.uint64(power) + piece
            covered += size
        left >>= 1
        if left:
            part = part[:-size] * np.uint64(power) + part[size:]
            power, size = power * power % 2**64, size * 2
    return finish(done)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_plain_fold = folded(PLAIN_BYTES)


#: Links that one task of ``connected`` contracts; tasks are as many as that takes.
LINKS_A_TASK = 500_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's ``edges`` (a, b) as links (a, b) of every node to the smallest one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in list(root)]
        rows = [(a, b) for a, b in rows if a != b]
        for k in range(0, len(rows), 65_536):
            a, b = zip(*rows[k : k + 65_536], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b) that isn't the smallest: rows (id, component).

    Every partition contracts its own links, first as they come, then in tasks of about LINKS_A_TASK.
    Unless that was one task, rounds of hooking and pointer jumping follow: a node keeps its smallest
    link, its others link what they point to with the smallest, and links to a node that has a smaller
    link itself go there. A round that finds neither is the last. Rows are grouped by the larger
    end, of which a task holds one link, so a component of a third of all nodes isn't a hot
    group; the jump joins only targets. No link or component comes to the driver.
    """
    links = cut(_contracted(edges.filter("a is not null and b is not null and a <> b")))
    by_node = Window.partitionBy("a").orderBy("b")
    for _ in range(most_rounds):
        tasks = -(-links.count() // LINKS_A_TASK)
        if tasks < 2:
            return cut(_contracted(links.coalesce(1))).select(F.col("a").alias("id"), F.col("b").alias("component"))
        links = _contracted(links.coalesce(tasks))
        low = cut(links.select("a", "b", F.row_number().over(by_node).alias("i"), F.first("b").over(by_node).alias("m")))
        firsts = low.filter("i = 1").select("a", "m")
        hooks = low.filter("i > 1 and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = firsts.select("m").distinct().join(firsts.select(F.col("a").alias("m"), F.col("m").alias("up")), "m")
        if not moved.select("m").union(hooks.select("b")).count():
            return firsts.select(F.col("a").alias("id"), F.col("m").alias("component"))
        jumps = firsts.join(moved, "m", "left").select("a", F.coalesce("up", "m").alias("b"))
        links = cut(jumps.union(hooks))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


#: Larger tables of components are joined instead of broadcast.
BROADCAST_PARTS = 1_000_000


def listed_members(listed: DataFrame) -> DataFrame:
    """(v, node, first, often) for rows (v, node): lists of two members or more, with their smallest member and size."""
    lists = listed.groupBy("v").agg(F.min("node").alias("first"), F.count("*").alias("often")).filter("often > 1")
    return listed.join(lists, "v")


def linked(members: DataFrame, left: DataFrame, right: DataFrame, possible, confirmed, dense=None, hot: int = 64, once: bool = False) -> DataFrame:
    """Components (id, component) of the links among nodes that meet in a list.

    ``members`` has (v, node, first): node is in list v, whose smallest member is first (and with ``dense``
    the list's size ``often``). ``left`` and ``right`` have (a, ...) and (b, ...): what the column
    ``possible`` looks at; ``confirmed`` keeps the true links of (a, b) rows. Every list first links
    its members to its smallest one, a number of rows in proportion to the lists. Only members that are
    then outside that one's component meet the rest of the list, again only in rows that ``possible``
    lets out. With ``once``, for nodes that meet in many lists, a pair comes from the first of its lists only. With ``dense``, lists of more than ``hot`` members never become pairs: nodes that such
    lists connect are a group, and ``dense`` finds the links between the components of a group, given
    (node, part, grp), part being the component so far.
    """
    scratch = Scratch(members.sparkSession)
    members = scratch.keep(members, "list-members")
    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = scratch.keep(stars.join(right, "b").join(left, "a").filter(possible).select("a", "b"), "list-stars")
    found = connected(confirmed(stars))
    part = F.broadcast(found) if found.count() <= BROADCAST_PARTS else found
    placed = members.join(part.select(F.col("id").alias("node"), F.col("component").alias("part")), "node", "left")
    placed = placed.join(part.select(F.col("id").alias("first"), F.col("component").alias("head")), "first", "left")
    placed = placed.withColumn("part", F.coalesce("part", "node")).withColumn("head", F.coalesce("head", "first"))
    small = placed.filter(F.col("often") <= hot) if dense else placed
    outside = scratch.keep(small.filter("part <> head").select("v", "node", "part"), "list-outside")
    held = small.join(outside.select("v").distinct(), "v", "left_semi")
    one = outside.select("v", F.col("node").alias("a"), F.col("part").alias("part_a")).join(left, "a")
    two = held.select("v", F.col("node").alias("b"), F.col("part").alias("part_b"), F.expr("part <> head").alias("out")).join(right, "b")
    if once:  # a pair whose components differ has a member outside in each of its lists, so these are all its lists
        lists = scratch.keep(held.groupBy("node").agg(F.collect_list("v").alias("lists")), "list-lists")
        one = one.join(lists.select(F.col("node").alias("a"), F.col("lists").alias("lists_a")), "a")
        two = two.join(lists.select(F.col("node").alias("b"), F.col("lists").alias("lists_b")), "b")
        possible = possible & (F.array_min(F.array_intersect("lists_a", "lists_b")) == F.col("v"))
    apart = (F.col("part_a") != F.col("part_b")) & (~F.col("out") | (F.col("a") < F.col("b")))
    rest = one.join(two, "v").filter(apart & possible).select("a", "b")
    rest = scratch.keep(rest if once else rest.distinct(), "list-rest")
    more = [] if rest.isEmpty() else [confirmed(rest)]
    large = placed.filter(F.col("often") > hot) if dense else None
    if dense and not large.isEmpty():
        groups = connected(large.select(F.col("first").alias("a"), F.col("node").alias("b")))
        own = large.select("node", "part").distinct().join(groups.withColumnRenamed("id", "node"), "node", "left")
        more.append(dense(scratch.keep(own.select("node", "part", F.coalesce("component", "node").alias("grp")), "list-groups")))
    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    for found_more in more:
        stars = stars.union(found_more)
    whole = connected(stars) if more else found
    scratch.drop()
    return whole
