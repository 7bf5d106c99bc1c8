"""Successors and reading order against all pairs."""

import random
import time
from math import inf, sqrt

import pytest
from pyspark.sql import functions as F

from quire.operators import assembly
from quire.operators.successors import followers, topological

from test_operators import block_rows


def all_pairs(page, x, y, w, h, opened, lower):
    n, next_of, cost_of = len(page), [], []
    col = [int(a + b / 2 > 0.62) for a, b in zip(x, w, strict=True)]
    cx, cy = [(a + (a + b)) / 2 for a, b in zip(x, w, strict=True)], [(a + (a + b)) / 2 for a, b in zip(y, h, strict=True)]
    for i in range(n):
        best, found = inf, -1
        for j in range(n):
            if page[j] != page[i]:
                after = page[j] > page[i]
            elif col[j] != col[i]:
                after = col[j] > col[i] and y[j] >= y[i] - 0.08
            else:
                after = y[j] > y[i] or (abs(y[j] - y[i]) < 0.02 and x[j] > x[i])
            if after and j != i:
                dx, dy = cx[j] - cx[i], cy[j] - cy[i]
                gap = min(1.0, sqrt(dx * dx + dy * dy))
                cost = 0.4 * gap + 0.3 * (0.0 if opened[i] and lower[j] else 0.2) + 0.3 * (0.0 if col[i] == col[j] else 0.8)
                if cost < best:
                    best, found = cost, j
        next_of.append(found)
        cost_of.append(best)
    return next_of, cost_of


def _layout(r, n, kind):
    pages = sorted(r.randrange(r.choice([1, 3, 20])) for _ in range(n))
    near = {"random": lambda: r.random(), "ties": lambda: r.choice([0.05, 0.1, 0.35, 0.6]), "outside": lambda: r.uniform(-2, 3), "crowded": lambda: 0.5 + r.random() / 500}[kind]
    x, y = [near() for _ in range(n)], [near() for _ in range(n)]
    size = (lambda: r.choice([0.0, 0.02, 0.3])) if kind == "ties" else r.random
    return pages, x, y, [size() for _ in range(n)], [size() for _ in range(n)], [r.random() < 0.4 for _ in range(n)], [r.random() < 0.4 for _ in range(n)]


@pytest.mark.parametrize("kind", ["random", "ties", "outside", "crowded"])
def test_sweep_against_all_pairs(kind):
    r = random.Random(kind)
    for n in [*range(8), *(r.randrange(400) for _ in range(25))]:
        rows = _layout(r, n, kind)
        assert followers(*rows) == all_pairs(*rows)


@pytest.mark.parametrize("pages,kind", [(1, "random"), (400, "random"), (400, "ties"), (20_000, "random")])
def test_sweep_of_a_large_document(pages, kind):
    r, n = random.Random(1), 20_000
    page, x, y, w, h, opened, lower = _layout(r, n, kind)
    page = sorted(r.randrange(pages) for _ in range(n))
    began = time.process_time()
    next_of, _ = followers(page, x, y, w, h, opened, lower)
    topological(next_of, list(range(n)))
    assert time.process_time() - began < 10


def test_cycles_fall_back():
    assert topological([1, 0, -1], [2, 0, 1]) == [2, 0, 1]
    assert topological([2, 0, -1], [0, 1, 2]) == [1, 0, 2]


def test_successors_of_odd_blocks(spark):
    rows = [("a", 0, 0, "paragraph", None, (0.1, 0.1, 0.2, 0.02)), ("a", 0, 1, "paragraph", "b", (0.5, 0.5, 0.2, 0.02)), ("b", 3, 0, "paragraph", "", (0.1, 0.1, 0.2, 0.02))]
    blocks = block_rows(spark, rows)
    blocks = blocks.withColumn("bbox", F.when(F.col("ord") == 0, F.col("bbox")))  # a null box is a point at the corner
    assert [(x.block_id, x.next_id) for x in assembly.successors(blocks).collect()] == [("b1", "b0")]
    assert sorted((x.parse_run_id, x.block_id, x["rank"]) for x in assembly.reading_order(blocks).collect()) == [("a", "b0", 1), ("a", "b1", 0), ("b", "b0", 0)]
    assert assembly.reading_order(blocks.limit(0)).count() == 0


def test_long_runs_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        r = random.Random(4)
        rows = [(str(run), k // 9, k, "paragraph", "t", (0.1, round(r.random(), 4), 0.2, 0.02)) for run in range(6) for k in range(r.choice([1, 6, 7, 8, 30]))]
        done = assembly.reading_order(block_rows(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in range(6):
        own = [x for x in rows if x[0] == str(run)]
        box = list(zip(*(x[5] for x in own), strict=True))
        next_of, _ = all_pairs([x[1] for x in own], *map(list, box), [False] * len(own), [True] * len(own))
        hint = sorted(range(len(own)), key=lambda i: (own[i][1], own[i][5][1]))
        place = topological(next_of, [hint.index(i) for i in range(len(own))])
        assert {x.block_id: x["rank"] for x in done if x.parse_run_id == str(run)} == {f"b{x[2]}": place[k] for k, x in enumerate(own)}
