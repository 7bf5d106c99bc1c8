"""The block that follows each, and the order that follows from it: a sweep over pages with grids of block centres.

The cheapest block that may follow is the nearest one of its kind: of a column, and with or without a lower
case start, as the rest of the cost is the same within a kind. Pages are gone through from the last to the
first, and blocks of the pages behind lie in one grid a kind, of which only the first block at each place
counts. So a block looks at the cells around its own, in its page and in the pages behind, until what is
further away would cost more. No pair matrix is made.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import inf, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

_ANY, _LINE, _COLUMN = range(3)
#: Bounds of costs are computed apart from costs; they give way by this much for rounding.
_SLACK = 1e-9


class _Grid:
    """Blocks of one kind by cells of their centres."""

    def __init__(self, corner: tuple[float, float], side: float, size: int):
        self.corner, self.side, self.size, self.cells = corner, side, size, {}

    def cell(self, cx: float, cy: float) -> tuple[int, int]:
        return int((cx - self.corner[0]) / self.side), int((cy - self.corner[1]) / self.side)

    def put(self, key: tuple, i: int) -> None:
        """Blocks come in descending order: of those with a key the last to come is the first in order."""
        self.cells.setdefault(self.cell(key[0], key[1]), {})[key] = i

    def rings(self, at: tuple[int, int]) -> Iterator[tuple[float, dict]]:
        """(least distance, blocks of a cell), cells by rings around ``at``; each ring begins with no blocks."""
        a, b = at
        cells, size, step = self.cells, self.size, self.side
        yield 0.0, cells.get(at, {})
        for r in range(1, size):
            if (2 * r + 1) ** 2 > 4 * len(cells):  # few cells are filled: the rest of them in one go
                for (c, d), held in sorted(cells.items(), key=lambda x: max(abs(x[0][0] - a), abs(x[0][1] - b))):
                    far = max(abs(c - a), abs(d - b))
                    if far >= r:
                        yield (far - 1) * step, held
                return
            near = (r - 1) * step
            yield near, {}  # the caller may stop here
            for c in range(max(0, a - r), min(size - 1, a + r) + 1):
                side = range(b - r, b + r + 1) if abs(c - a) == r else (b - r, b + r)
                for d in side:
                    if (c, d) in cells:
                        yield near, cells[c, d]


def followers(
    page: list, x: list[float], y: list[float], w: list[float], h: list[float], opened: list[bool], lower: list[bool],
    alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3,
) -> tuple[list[int], list[float]]:
    """The cheapest block that may follow each (-1: none) and its cost, for blocks of one run in input order, by page.

    ``opened`` says that a text ends open, ``lower`` that it starts in lower case. Ties go to the first in input order.
    """
    n = len(page)
    col = [int(a + b / 2 > 0.62) for a, b in zip(x, w, strict=True)]
    cx = [(a + (a + b)) / 2 for a, b in zip(x, w, strict=True)]
    cy = [(a + (a + b)) / 2 for a, b in zip(y, h, strict=True)]
    next_of, cost_of = [-1] * n, [inf] * n
    corner = (min(cx, default=0.0), min(cy, default=0.0))
    extent = max(max(cx, default=0.0) - corner[0], max(cy, default=0.0) - corner[1])

    def grid_for(m: int) -> _Grid:
        size = max(1, min(256, int(sqrt(m) / 2)))
        return _Grid(corner, extent / size * 1.000001 or 1.0, size)

    behind: dict[tuple[int, bool], _Grid] = {}
    hi = n
    while hi:
        lo = hi
        while lo and page[lo - 1] == page[hi - 1]:
            lo -= 1
        own: dict[tuple[int, bool], _Grid] = {}
        for i in range(hi - 1, lo - 1, -1):
            own.setdefault((col[i], lower[i]), grid_for(hi - lo)).put((cx[i], cy[i], x[i], y[i]), i)
        for i in range(lo, hi):
            px, py, left, top, best, found = cx[i], cy[i], x[i], y[i], inf, -1
            for grids, here in ((own, True), (behind, False)):
                for (c, small), grid in sorted(grids.items(), key=lambda g: g[0][0] != col[i]):
                    rule = _ANY if not here else _LINE if c == col[i] else _COLUMN
                    if rule == _COLUMN and c < col[i]:
                        continue
                    words, aside = beta * (0.0 if opened[i] and small else 0.2), gamma * (0.0 if c == col[i] else 0.8)
                    least = words + aside - _SLACK
                    for near, held in grid.rings(grid.cell(px, py)):
                        if alpha * min(1.0, near) + least > best:
                            break
                        for key, j in held.items():
                            if rule == _LINE:
                                if not (key[3] > top or (abs(key[3] - top) < 0.02 and key[2] > left)):
                                    continue
                            elif rule == _COLUMN and not key[3] >= top - 0.08:
                                continue
                            dx, dy = key[0] - px, key[1] - py
                            cost = alpha * min(1.0, sqrt(dx * dx + dy * dy)) + words + aside
                            if cost < best or (cost == best and j < found):
                                best, found = cost, j
            next_of[i], cost_of[i] = found, best
        for i in range(hi - 1, lo - 1, -1):
            behind.setdefault((col[i], lower[i]), grid_for(n)).put((cx[i], cy[i]), i)
        hi = lo
    return next_of, cost_of


def topological(next_of: list[int], rank: list[int]) -> list[int]:
    """Each block's place when a block comes after all that it follows, of ready ones the lowest ``rank`` first.

    A cycle anywhere gives every block its ``rank``.
    """
    degree = [0] * len(next_of)
    for j in next_of:
        if j >= 0:
            degree[j] += 1
    ready = [(rank[i], i) for i, d in enumerate(degree) if not d]
    heapq.heapify(ready)
    place, n = [0] * len(next_of), 0
    while ready:
        i = heapq.heappop(ready)[1]
        place[i] = n
        n += 1
        j = next_of[i]
        if j >= 0:
            degree[j] -= 1
            if not degree[j]:
                heapq.heappush(ready, (rank[j], j))
    return place if n == len(next_of) else rank


def by_group(rows: DataFrame, keys: list[str], order: list[str], fields: list[StructField], work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``rows`` with the columns ``fields`` that ``work`` gives for all rows of a key, which it gets in ``order``.

    One shuffle by the keys and a sort that can spill. ``work`` gets many keys at a time where they are
    small, as (rows, bounds of the keys); a task holds one key's rows and one Arrow batch.
    """

    def groups(batch: pa.RecordBatch) -> list[int]:
        found = [*zip(*(batch.column(k).to_pylist() for k in keys), strict=True)]
        return [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = work(batch, groups(batch))
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = groups(batch)
            same = bool(held) and all(held[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys)
            if same and len(bounds) == 2:  # one key goes on
                held.append(batch)
                continue
            cut = bounds[-2]
            whole = [*held, batch.slice(0, cut)] if cut else held
            if held or cut:
                yield done(joined(whole))
            held = [batch.slice(cut)]
        if held:
            yield done(joined(held))

    sent = rows.drop(*(f.name for f in fields)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sent.mapInArrow(run, StructType([*sent.schema.fields, *fields]))
