"""Hard negatives by exact inner-product search in STR-packed R-trees.

All rows are packed into trees by sort-tile-recurse: slabs of one coordinate, cut along another, by a
range partition over all rows; inside a tree along its own widest coordinates down to pages. Every page
and every node above has a minimum bounding box. For an anchor, each coordinate of a box gives an
interval of products, and their sums hold all scores below. A best-first queue opens the node with the
highest upper end; it leaves out boxes outside the wanted scores and those strictly below the worst
row that is still kept (of equal scores, those whose smallest id is larger).

Trees hold one label each, so positives are looked for in trees of the anchor's label and negatives in
the others. Anchors go to the trees whose root they can't leave out; a task streams through its trees'
rows and anchors and holds one tree at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a tree, rows of a page, children of a node.
TREE_ROWS, PAGE_ROWS, FANOUT = 8192, 64, 16
#: Anchors that one copy of a tree serves.
PART_ANCHORS = 65_536
#: Roots that are on the driver, and sent to tasks, at a time.
ROOTS = 4096
_NONE = -(1 << 62)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of rows (vec_id, label, v) that can take part: ``v`` of whole numbers.

    Rows with a null vec_id, label, vector or component take no part, nor do vectors of another length
    than most (ties: the shorter). Of rows that share a vec_id the one with the smallest label, then vector, stays.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    kept = rows.filter(good & F.forall("v", lambda x: x.isNotNull()))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    lengths = kept.groupBy(F.size("v").alias("d")).count()
    usual = F.broadcast(lengths.orderBy(F.desc("count"), "d").limit(1))
    kept = kept.join(usual, F.size("v") == usual["d"]).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    return kept.select("vec_id", "x.label", "x.v")


def _matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def pages_of(v: np.ndarray, ids: np.ndarray, size: int = PAGE_ROWS) -> np.ndarray:
    """Page of each row, by sort-tile-recurse along the coordinates with the widest spread; ties by id."""
    axes = np.argsort(-v.var(0), kind="stable").tolist()
    done, groups = [], [np.arange(len(v))]
    for depth, axis in enumerate(axes):
        parts = []
        for group in groups:
            pages = -(-len(group) // size)
            if pages == 1:
                done.append(group)
                continue
            slabs = max(2, int(np.ceil(pages ** (1 / (len(axes) - depth))))) if depth + 1 < len(axes) else pages
            group = group[np.lexsort((ids[group], v[group, axis]))]
            step = -(-pages // slabs) * size
            parts += [group[k : k + step] for k in range(0, len(group), step)]
        groups = parts
    done += groups
    page = np.empty(len(v), np.int64)
    for k, group in enumerate(sorted((g for g in done if len(g)), key=lambda g: (v[g].min(0).tolist(), ids[g].min()))):
        page[group] = k
    return page


class Tree:
    """An R-tree over the rows of one label: boxes of nodes by level, the pages first."""

    def __init__(self, page: np.ndarray, ids: np.ndarray, v: np.ndarray):
        """Rows in the order of their pages."""
        self.ids, self.v = ids, v
        cuts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        self.levels = [(cuts, np.minimum.reduceat(v, cuts), np.maximum.reduceat(v, cuts), np.minimum.reduceat(ids, cuts))]
        while len(self.levels[-1][0]) > 1:
            _, lo, hi, first = self.levels[-1]
            cuts = np.arange(0, len(lo), FANOUT)
            self.levels.append((cuts, np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.minimum.reduceat(first, cuts)))

    def best_first(self, q: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of pages, opened from the highest upper end of their scores on.

        ``wanted(least, most, first)`` says if a box whose scores are within ``least`` and ``most`` and whose
        smallest id is ``first`` can still matter; it's asked again when the box's turn comes.
        """
        up, down = np.maximum(q, 0), np.minimum(q, 0)

        def boxes(level: int, a: int, b: int) -> None:
            _, lo, hi, first = self.levels[level]
            most, least = hi[a:b] @ up + lo[a:b] @ down, lo[a:b] @ up + hi[a:b] @ down
            for k, (m, n, f) in enumerate(zip(most.tolist(), least.tolist(), first[a:b].tolist(), strict=True), a):
                if wanted(n, m, f):
                    heapq.heappush(queue, (-m, f, level, k, n))

        queue: list[tuple] = []
        boxes(len(self.levels) - 1, 0, 1)
        while queue:
            most, first, level, k, least = heapq.heappop(queue)
            if not wanted(least, -most, first):
                continue
            cuts = self.levels[level][0]
            a, b = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else len(self.levels[level - 1][0] if level else self.ids)
            if level:
                boxes(level - 1, a, b)
            else:
                yield self.ids[a:b], self.v[a:b] @ q


class Best:
    """The first ``k`` rows by score from high to low, then by id; scores from ``least`` to ``most`` only."""

    def __init__(self, k: int, least: float = -np.inf, most: float = np.inf, worst: tuple[float, int] | None = None):
        self.k, self.least, self.most, self.rows, self.worst = k, least, most, [], worst

    def wants(self, least: float, most: float, first: int) -> bool:
        if most < self.least or least > self.most:
            return False
        return self.worst is None or (-min(most, self.most), first) < (-self.worst[0], self.worst[1])

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        low = max(self.least, self.worst[0]) if self.worst else self.least
        at = np.flatnonzero((scores >= low) & (scores <= self.most))
        if not len(at):
            return
        if len(at) > self.k:
            at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
        rows = [*self.rows, *zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)]
        self.rows = sorted(rows)[: self.k]
        if len(self.rows) == self.k:
            self.worst = min((-self.rows[-1][0], self.rows[-1][1]), self.worst or (-np.inf, 0), key=lambda w: (-w[0], w[1]))


def _spread(points: DataFrame) -> tuple[int, np.ndarray, float]:
    """Rows, variance of each coordinate, largest absolute component; a row a partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, 0.0, 0.0
        for batch in (b for b in batches if b.num_rows):
            v = _matrix(batch.column("v"), np.float64)
            n, total, most = n + len(v), total + np.stack([v.sum(0), (v * v).sum(0)]), max(most, float(np.abs(v).max()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()]), pa.array([most])], names=["n", "total", "most"])

    found = points.select("v").mapInArrow(run, "n long, total array<double>, most double").collect()
    if not found:
        return 0, np.zeros(0), 0.0
    n = sum(r.n for r in found)
    total, squares = np.array(sorted(r.total for r in found)).sum(0).reshape(2, -1) / n
    return n, squares - total * total, max(r.most for r in found)


def _packed(points: DataFrame, n: int, spread: np.ndarray, tree_rows: int) -> DataFrame:
    """(tree, label, page, vec_id, v, lo, hi, first): all rows in trees; a tree's first row has its box."""
    if not n:
        return points.select(F.lit(0).cast("long").alias("tree"), "label", F.lit(0).alias("page"), "vec_id", "v", F.col("v").alias("lo"), F.col("v").alias("hi"), F.col("vec_id").alias("first"))
    one, two = (np.argsort(-spread, kind="stable").tolist() * 2)[:2]
    tiles = -(-n // tree_rows)
    slabs = int(np.ceil(np.sqrt(tiles)))
    x = F.col("v")[one].cast("double")
    quantiles = points.select(x.alias("x")).approxQuantile("x", [k / slabs for k in range(1, slabs)], 0.25 / slabs) if slabs > 1 else []
    slab = F.size(F.filter(F.array(*(F.lit(q) for q in quantiles)), lambda q: q < x)) if quantiles else F.lit(0)
    tiled = points.withColumn("slab", slab).withColumn("along", F.col("v")[two])
    tiled = tiled.repartitionByRange(tiles, "label", "slab", "along", "vec_id").sortWithinPartitions("label", "slab", "along", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, made = [], 0, 0

        def tree(label: int) -> pa.RecordBatch:
            nonlocal made
            ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
            page = pages_of(v, ids)
            order = np.lexsort((ids, page))
            box = [None] * (len(ids) - 1)
            columns = [
                pa.array(np.full(len(ids), TaskContext.get().partitionId() << 32 | made)), pa.array(np.full(len(ids), label)), pa.array(page[order], pa.int32()), pa.array(ids[order]),
                pa.array(list(v[order]), pa.list_(pa.int64())), pa.array([v.min(0), *box], pa.list_(pa.int64())), pa.array([v.max(0), *box], pa.list_(pa.int64())), pa.array([int(ids.min()), *box], pa.int64()),
            ]
            made += 1
            return pa.RecordBatch.from_arrays(columns, names=["tree", "label", "page", "vec_id", "v", "lo", "hi", "first"])

        label = None
        for batch in batches:
            labels, ids, v = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            at = 0
            while at < len(ids):
                if size and (labels[at] != label or size == tree_rows):
                    yield tree(label)
                    held, size = [], 0
                label = int(labels[at])
                to = min(at + tree_rows - size, int(np.searchsorted(labels, label, "right")))
                held.append((ids[at:to], v[at:to]))
                size, at = size + to - at, to
        if size:
            yield tree(label)

    return tiled.select("label", "vec_id", "v").mapInArrow(run, "tree long, label long, page int, vec_id long, v array<long>, lo array<long>, hi array<long>, first long")


_ROUTE = "tree long, anchor_id long, label long, q array<long>, floor long, floor_id long, windows array<struct<least:long,most:long>>"


def _routes(anchors: DataFrame, trees: DataFrame, stage: str) -> DataFrame:
    """A row an anchor and tree that it has to look into.

    ``best``: the tree of its label with the highest upper end. ``rest``: the others of its label that can
    hold a row before (floor, floor_id). ``other``: trees of other labels whose scores meet a window. Roots
    are gone through in groups of ROOTS, each sent to the tasks that hold anchors.
    """
    roots = trees.filter("lo is not null").select("tree", "label", "lo", "hi", "first")
    chunks = max(1, -(-roots.count() // ROOTS))
    chosen = [roots.filter(F.pmod(F.xxhash64("tree"), F.lit(chunks)) == k) for k in range(chunks)]
    spark, parts = anchors.sparkSession, []
    for rows in chosen:
        found = rows.orderBy("tree").collect()  # about ROOTS rows
        if not found:
            continue
        tree, label, first = (np.array([r[c] for r in found]) for c in ("tree", "label", "first"))
        sent = spark.sparkContext.broadcast((tree, label, first, *(np.array([r[c] for r in found], np.float64) for c in ("lo", "hi"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tree, label, first, lo, hi = sent.value
            for batch in batches:
                for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                    q, own = _matrix(part.column("q"), np.float64), part.column("label").to_numpy()
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    most, same = up @ hi.T + down @ lo.T, own[:, None] == label
                    top = np.where(same, most, -np.inf).argmax(1)
                    if stage == "other":
                        least, take = up @ lo.T + down @ hi.T, np.zeros(same.shape, bool)
                        for k, windows in enumerate(part.column("windows").to_pylist()):
                            for w in windows:
                                take[k] |= (most[k] >= w["least"]) & (least[k] <= w["most"])
                        take &= ~same
                    elif stage == "best":
                        take = np.zeros(same.shape, bool)
                        take[np.arange(len(q)), top] = True
                        take &= same
                    else:
                        floor = part.column("floor").fill_null(_NONE).to_numpy()[:, None]
                        before = part.column("floor_id").fill_null(0).to_numpy()[:, None]
                        take = same & ((most > floor) | (most == floor) & (first < before))
                        take[np.arange(len(q)), top] = False
                    a, t = np.nonzero(take)
                    some = part.take(pa.array(a))
                    yield pa.RecordBatch.from_arrays([pa.array(tree[t]), *some.columns], names=["tree", *some.schema.names])

        parts.append(anchors.mapInArrow(run, _ROUTE))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _searched(trees: DataFrame, routes: DataFrame, parts: int, exact: bool, positives: int, negatives: int) -> DataFrame:
    """(anchor_id, least, most, id, score): the best rows of each route's tree, for each window or (null) for all scores.

    ``positives`` of 1 or more looks for so many rows but the anchor's own, else ``negatives`` a window.
    """
    fields = "part int, kind int, page int, vec_id long, v array<long>"
    rows = trees.select("tree", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "page", "vec_id", "v")
    asked = routes.select(
        "tree", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.col("anchor_id").alias("vec_id"), F.col("q").alias("v"), "floor", "floor_id", "windows",
    )
    both = rows.unionByName(asked, allowMissingColumns=True).repartition("tree", "part").sortWithinPartitions("tree", "part", "kind", "page", "vec_id")
    kind = np.float64 if exact else np.int64

    def answers(tree: Tree, rows: pa.RecordBatch) -> Iterator[tuple]:
        q_all, windows_all = _matrix(rows.column("v"), kind), rows.column("windows").to_pylist()
        floors = zip(rows.column("floor").to_pylist(), rows.column("floor_id").to_pylist(), strict=True)
        for anchor, q, floor, windows in zip(rows.column("vec_id").to_pylist(), q_all, floors, windows_all, strict=True):
            if positives:
                kept = [Best(positives, worst=None if floor[0] is None else floor)]
            else:
                kept = [Best(negatives, w["least"], w["most"]) for w in windows]
            for ids, scores in tree.best_first(q, lambda n, m, f, kept=kept: any(b.wants(n, m, f) for b in kept)):
                if positives:
                    other = ids != anchor
                    ids, scores = ids[other], scores[other]
                for b in kept:
                    b.add(ids, scores)
            for b, w in zip(kept, windows or [{"least": None, "most": None}], strict=True):
                for score, i in b.rows:
                    yield anchor, w["least"], w["most"], i, int(-score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("tree", "part", "kind")])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                some, key = batch.slice(lo, hi - lo), tuple(keys[:2, lo].tolist())
                if key != at:
                    at, tree, held = key, None, []
                if keys[2, lo] == 0:
                    held.append((some.column("page").to_numpy(), some.column("vec_id").to_numpy(), _matrix(some.column("v"), kind)))
                    continue
                if tree is None:
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                out = [*zip(*answers(tree, some), strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "least", "most", "id", "score"])

    ordered = both.select("tree", *(f.split()[0] for f in fields.split(", ")), "floor", "floor_id", "windows")
    return ordered.mapInArrow(run, "anchor_id long, least long, most long, id long, score long")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v).

    ``v`` holds whole numbers, scores are their inner products: higher ones first, ties to the smaller
    vec_id. Anchors are the rows for which ``anchors`` is true. An anchor's positives are its first
    ``positives`` other rows of the same label; each gets its first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1 on. Fewer rows
    than asked for are all returned; without any there is no row. ``usable`` says which rows take part;
    other columns are ignored. An empty table, or one without anchors, gives no rows. Raises
    OverflowError if scores might not fit in 62 bits.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    points = scratch.keep(usable(rows), "points")
    rows_all, spread, most = _spread(points)
    size = len(spread) * most * most
    if size >= 2.0**62:
        raise OverflowError(f"scores up to {size} don't fit")
    exact = size < 2.0**53  # then sums of doubles are whole numbers without rounding
    trees = scratch.keep(_packed(points, rows_all, spread, tree_rows), "trees")
    none = F.lit(None)
    asked = points.filter(anchors).select(F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"))
    asked = scratch.keep(asked.select("*", none.cast("long").alias("floor"), none.cast("long").alias("floor_id"), none.cast("array<struct<least:long,most:long>>").alias("windows")), "anchors")
    n = asked.count()
    if not n:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        scratch.drop()
        return out
    parts = -(-n // PART_ANCHORS)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _searched(trees, _routes(asked, trees, "best"), parts, exact, positives, 0)
    near = scratch.keep(near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives).select("anchor_id", "id", "score", "k"), "near")
    floors = near.filter(F.col("k") == positives).select("anchor_id", F.col("score").alias("floor"), F.col("id").alias("floor_id"))
    floored = asked.drop("floor", "floor_id").join(floors, "anchor_id", "left").select(asked.columns)
    more = _searched(trees, _routes(floored, trees, "rest"), parts, exact, positives, 0).select("anchor_id", "id", "score")
    first = near.select("anchor_id", "id", "score").unionByName(more).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives)
    share = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    least, most = F.ceil(share(low)).cast("long"), F.floor(share(high)).cast("long")
    first = scratch.keep(first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least"), most.alias("most")), "positives")
    windows = first.filter("least <= most").groupBy("anchor_id").agg(F.array_sort(F.collect_set(F.struct("least", "most"))).alias("windows"))
    windowed = asked.drop("windows").join(windows, "anchor_id").select(asked.columns)
    found = _searched(trees, _routes(windowed, trees, "other"), parts, exact, 0, negatives)
    order = Window.partitionBy("anchor_id", "least", "most").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = first.join(found, ["anchor_id", "least", "most"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
