"""Graphs that take many rounds to settle, and searches that have to be wider than they start."""

import functools

import numpy as np
from pyspark.sql import functions as F

from quire.llm import neighbours


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)


def recall(x, rows, top=10):
    hits, found = 0, {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:top].tolist()) & got)
    return hits / top / len(found)


def test_graph_of_many_rounds(spark, monkeypatch):
    """With a quarter of the groups compared in a round it takes many to settle, as in a large graph; more than 8 were an error."""
    compare, rounds = neighbours._compare, []

    def quarter(groups, keep):
        if "pivot" in groups.columns:
            rounds.append(1)
            groups = groups.filter(F.pmod(F.xxhash64("pivot"), F.lit(4)) == len(rounds) % 4)
        return compare(groups, keep)

    monkeypatch.setattr(neighbours, "_compare", quarter)
    monkeypatch.setattr(neighbours, "graph", functools.partial(neighbours.graph, settled=0.001))
    x = np.random.default_rng(6).normal(size=(2000, 32)).astype(np.float32)
    got = neighbours.nearest(table(spark, x)).collect()
    assert len(rounds) > 8 and recall(x, got) >= 0.9


def test_search_is_as_wide_as_it_has_to_be(spark):
    """48 dimensions without clusters: 20 nodes a search find too little."""
    x = np.random.default_rng(5).normal(size=(6000, 48)).astype(np.float32)
    assert recall(x, neighbours.nearest(table(spark, x), k=16, width=20).collect()) >= 0.93
