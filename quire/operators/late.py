"""Late interaction: for each token of a query the best cosine among a page's patches, summed.

Queries and pages are tables. A task gets a part of the queries, then streams through a part of the pages, so
neither has to fit anywhere as a whole. ``top_pages`` reads packed signs instead of vectors first: a patch is
its signs times their mean size, and the same again for what that leaves, in a few levels of a bit a
component each, and the length of the last rest. The product of a token and what the signs say is exact, and with
the rest it is at most the rest's length. Pages that these bounds can't exclude are scored exactly: a part of the
queries and the pages that it asks for meet in a task, so no vector is sent once a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a task holds, pages of a task, levels of signs of a patch.
QUERY_PART, PAGE_PART, LEVELS = 2048, 65_536, 8
#: What rounding of doubles may add to a bound.
_SLACK = 1e-9
_SCORES = "query_id long, point_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of a column of lists of vectors as a matrix, and where each list begins (one entry more)."""
    offsets = lists.offsets.to_numpy()
    inner = lists.flatten()
    width = np.diff(inner.offsets.to_numpy())
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors of different lengths")
    values = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(width), -1) if len(width) else values.reshape(0, 0), offsets - offsets[0]


def _dealt(key: str, n: int) -> Column:
    """Which of ``n`` parts a query or page belongs to."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)).cast("int")


def _parts(pages: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Into how many parts queries and pages are dealt; 0 where there are none."""
    rows, asked = pages.count(), queries.count()
    return -(-asked // QUERY_PART), rows and max(pages.sparkSession.sparkContext.defaultParallelism, -(-rows // PAGE_PART))


def _meeting(pages: DataFrame, queries: DataFrame, page_columns: list[str], work: Callable, schema: str, dealt: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``work(ids, tokens, starts, batches)`` for each part of queries and part of pages.

    Queries stand in QUERY_PART at most a part and are sent to every part of pages, and pages
    to every part of queries, or to the one in their column ``part``; ``batches`` are Arrow batches of ``page_columns``.
    """
    spark = pages.sparkSession
    parts, places = dealt or _parts(pages, queries)
    if not parts or not places:
        return spark.createDataFrame([], schema)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    to = F.col("part") if "part" in pages.columns and dealt else each(parts).alias("part")
    left = queries.select(_dealt("query_id", parts).alias("part"), each(places).alias("place"), F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("tokens").cast("array<array<double>>").alias("tokens"))
    right = pages.select(to, _dealt("point_id", places).alias("place"), F.lit(1).alias("kind"), F.col("point_id").cast("long").alias("id"), *page_columns)
    both = left.unionByName(right, allowMissingColumns=True).select("part", "place", "kind", "id", "tokens", *page_columns)
    both = both.repartition("part", "place").sortWithinPartitions("part", "place", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "place", "kind")])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]).tolist() if batch.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                some, key = batch.slice(lo, hi - lo), tuple(keys[:2, lo].tolist())
                if key != at:
                    if state is not None:
                        yield from state.end()
                    at, held, state = key, [], None
                if keys[2, lo] == 0:
                    q, starts = _flat(some.column("tokens"))
                    held.append((some.column("id").to_numpy(), _unit(q), np.diff(starts)))
                elif held:
                    if state is None:
                        ids, q, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
                        state = work(ids, q, np.cumsum([0, *sizes])[:-1])
                    yield from state.pages(some)
        if state is not None:
            yield from state.end()

    return both.mapInArrow(run, schema)


class _Exact:
    """Scores of all pages for all queries of a part; with ``k`` only the best of each query go on."""

    def __init__(self, k: int | None, signs: bool, ids: np.ndarray, q: np.ndarray, starts: np.ndarray):
        self.k, self.signs, self.ids, self.q, self.starts = k, signs, ids, q, starts
        self.best: list[np.ndarray] = [np.empty((0, len(ids))), np.empty((0, len(ids)), np.int64)]

    def pages(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
            d, places = _flat(part.column("patches"))
            d = _unit(np.where(d >= 0, 1.0, -1.0) if self.signs else d)
            near = np.maximum.reduceat(self.q @ d.T, places[:-1], axis=1)
            scores = np.add.reduceat(near, self.starts, axis=0).T
            points = np.repeat(part.column("id").to_numpy()[:, None], len(self.ids), 1)
            if self.k is None:
                yield self._rows(scores, points)
            else:
                scores, points = np.concatenate([self.best[0], scores]), np.concatenate([self.best[1], points])
                order = np.lexsort((points, -scores), axis=0)[: self.k]
                self.best = [np.take_along_axis(x, order, 0) for x in (scores, points)]

    def _rows(self, scores: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        ids = np.broadcast_to(self.ids, scores.shape)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).ravel()) for x in (ids, points, scores)], names=["query_id", "point_id", "score"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.k is not None:
            yield self._rows(*self.best)


def max_sim(pages: DataFrame, queries: DataFrame, k: int | None = None, quantise: bool = False) -> DataFrame:
    """(query_id, point_id, score) of every query (query_id, tokens) and page (point_id, patches), both by cosine.

    With ``k`` a task only sends on its ``k`` best a query; with ``quantise`` a patch counts by its signs.
    Pages without patches and queries without tokens (or null ones) give no rows; zero vectors have cosine 0 to
    all. Negative scores are kept. Repeated rows are scored alike. Raises ValueError for vectors of different lengths.
    """
    pages, queries = pages.filter("size(patches) > 0"), queries.filter("size(tokens) > 0")
    return _meeting(pages, queries, ["patches"], lambda *x: _Exact(k, quantise, *x), _SCORES)


def packed(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(point_id, n, signs, sizes, rest) of pages (point_id, patches), which ``top_pages`` scans.

    A patch, as a vector of length 1, has ``levels`` times its sign bits in words of 64 and their size, and the
    length of what they leave, which a level brings down to about 0.6 of what it was. Eight levels take an
    eighth of the bytes of doubles and some numbers a patch. A zero vector has sizes and rest 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, places = _flat(batch.column("patches"))
            rest, words, sizes = _unit(d), [], []
            for _ in range(levels):
                plus = rest >= 0
                sizes.append(np.abs(rest).mean(1))
                words.append(_words(plus))
                rest = rest - np.where(plus, 1.0, -1.0) * sizes[-1][:, None]
            wide = levels * words[0].shape[1]
            listed = lambda x, per: pa.ListArray.from_arrays(pa.array((places * per).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("point_id"), pa.array(np.diff(places), pa.int32()), listed(np.concatenate(words, 1).view(np.int64), wide),
                    listed(np.stack(sizes, 1), levels), listed(np.linalg.norm(rest, axis=1), 1),
                ], names=["point_id", "n", "signs", "sizes", "rest"],
            )

    rows = pages.filter("size(patches) > 0").select(F.col("point_id").cast("long").alias("point_id"), "patches")
    return rows.mapInArrow(run, "point_id long, n int, signs array<long>, sizes array<double>, rest array<double>")


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    wide = -(-bits.shape[1] // 64) * 64
    full = np.zeros((len(bits), wide), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.uint64)


class _Bounds:
    """Bounds of the scores of packed pages; what its own lower bounds exclude is left out."""

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray, starts: np.ndarray):
        self.k, self.ids, self.starts, self.q = k, ids, starts, q
        self.low = np.full((k, len(ids)), -np.inf)

    def pages(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
            n = part.column("n").to_numpy()
            values = lambda c: part.column(c).flatten().to_numpy().reshape(int(n.sum()), -1)  # noqa: E731, B023
            sizes, rest = values("sizes"), values("rest")[:, 0]
            levels = values("signs").view(np.uint8).reshape(len(rest), sizes.shape[1], -1)
            plus = np.unpackbits(levels, axis=2)[:, :, : self.q.shape[1]]
            near = self.q @ np.einsum("nl,nld->nd", sizes, 2.0 * plus - 1.0).T
            spread = rest + _SLACK
            places = np.cumsum([0, *n])[:-1]
            sums = lambda m: np.add.reduceat(np.maximum.reduceat(m, places, axis=1), self.starts, axis=0).T  # noqa: E731, B023
            upper, lower = sums(np.minimum(near + spread, 1 + _SLACK)), sums(np.maximum(near - spread, -1 - _SLACK))
            self.low = -np.sort(-np.concatenate([self.low, lower]), axis=0)[: self.k]
            page, query = np.nonzero(upper >= self.low[-1])
            columns = (self.ids[query], part.column("id").to_numpy()[page], upper[page, query], lower[page, query])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "point_id", "upper", "lower"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def bounds(signs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, upper, lower) of pages of ``packed`` that can be among the ``k`` best of a query."""
    queries = queries.filter("size(tokens) > 0").dropDuplicates(["query_id"])  # a repeated query must not count its bounds twice
    found = _meeting(signs, queries, ["n", "signs", "sizes", "rest"], lambda *x: _Bounds(k, *x), "query_id long, point_id long, upper double, lower double")
    whole = Window.partitionBy("query_id").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    floor = F.coalesce(F.nth_value("lower", k).over(whole), F.lit(float("-inf")))
    return found.withColumn("floor", floor).filter("upper >= floor").drop("floor")


class _Asked:
    """Scores of pages for the queries of a part that ask for them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, starts: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.q, self.starts, self.sizes = ids[self.order], q, starts[self.order], np.diff([*starts, len(q)])[self.order]

    def pages(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
            d, places = _flat(part.column("patches"))
            d, asked, found = _unit(d), part.column("asked"), []
            for i, point in enumerate(part.column("id").to_pylist()):
                wanted = asked[i].values.to_numpy()
                at = np.flatnonzero(np.isin(self.ids, wanted))
                for size in np.unique(self.sizes[at]):  # one small product a pair, so equal pages get equal scores
                    some = at[self.sizes[at] == size]
                    tokens = self.q[self.starts[some][:, None] + np.arange(size)]
                    scores = (tokens @ d[places[i] : places[i + 1]].T).max(2).sum(1)
                    found.append((self.ids[some], np.full(len(some), point), scores))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "point_id", "score"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def top_pages(signs: DataFrame, pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, score) with the ``k`` best pages of each query (and others) by ``max_sim``, found by packed signs.

    ``signs`` is ``packed(pages)``, usually a table written with the pages. Only pages whose bounds allow
    it are read as vectors and scored; the bounds are proven, so none of the best is lost, ties included.
    """
    pages, queries = pages.filter("size(patches) > 0"), queries.filter("size(tokens) > 0")
    dealt = _parts(pages, queries)
    if not all(dealt):
        return pages.sparkSession.createDataFrame([], _SCORES)
    asked = bounds(signs, queries, k).groupBy(_dealt("query_id", dealt[0]).alias("part"), "point_id").agg(F.collect_set("query_id").alias("asked"))
    patches = F.col("patches").cast("array<array<double>>").alias("patches")
    rows = asked.join(pages.select(F.col("point_id").cast("long").alias("point_id"), patches), "point_id")
    return _meeting(rows, queries, ["patches", "asked"], _Asked, _SCORES, dealt)
