"""Late interaction: packed signs exclude nothing that counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import index, late


def _unit(x):
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _brute(pages, queries):
    out = {}
    for q, tokens in queries:
        for p, patches in pages:
            if tokens and patches:
                out[q, p] = float((_unit(np.array(tokens, float)) @ _unit(np.array(patches, float)).T).max(1).sum())
    return out


def _tables(spark, seed, n, d, m):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    vector = lambda k: (centres[rng.integers(0, 5, k)] * rng.choice([0.0, 1.0, 3.0]) + rng.normal(size=(k, d))).round(3).tolist()
    pages = [(i, vector(int(rng.integers(1, 6)))) for i in range(n)]
    pages += [(n + i, pages[0][1]) for i in range(n // 3)]  # a page that very many repeat
    pages += [(9000, []), (9001, None), (9002, [[0.0] * d])]
    queries = [(i, vector(int(rng.integers(1, 4)))) for i in range(m)] + [(900, [[0.0] * d]), (901, []), (902, None)]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} array<array<double>>")
    return pages, queries, frame(pages, "point_id", "patches"), frame(queries, "query_id", "tokens")


@pytest.mark.parametrize("seed,d", [(1, 64), (2, 7), (3, 130), (4, 1)])
def test_packed_signs_lose_none_of_the_best(spark, seed, d, monkeypatch):
    monkeypatch.setattr(late, "QUERY_PART", 5)
    pages, queries, p, q = _tables(spark, seed, 90, d, 12)
    want = _brute(pages, queries)
    found = {(r.query_id, r.point_id): r.score for r in late.max_sim(p, q).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    for k in (1, 7, 500):
        kept = late.bounds(late.packed(p), q, k).collect()
        assert all(r.lower <= want[r.query_id, r.point_id] <= r.upper for r in kept)
        hits = {(r.query_id, r.point_id): r.score for r in late.top_pages(late.packed(p), p, q, k).collect()}
        for query in {a for a, _ in want}:
            scores = sorted((s for (a, _), s in want.items() if a == query), reverse=True)
            least = scores[min(k, len(scores)) - 1]
            assert {b for a, b in hits if a == query} >= {b for (a, b), s in want.items() if a == query and s >= least - 1e-12}
        assert len(hits) == len(kept) == len({(r.query_id, r.point_id) for r in kept})
    if d == 64:  # the bounds do exclude pages, more of them with more levels
        few, many = (late.bounds(late.packed(p, n), q, 1).count() for n in (2, 6))
        assert many < len(want) / 2 and many < few


def test_bounds_are_close_and_repeated_queries_count_alike(spark):
    pages, queries, p, q = _tables(spark, 6, 60, 64, 8)
    width = lambda signs: np.mean([r.upper - r.lower for r in late.bounds(signs, q, 500).collect()])
    assert width(late.packed(p)) < 0.75 * width(late.packed(p, 4))
    twice = late.top_pages(late.packed(p), p, q.unionByName(q), 3)
    assert twice.count() == 2 * twice.distinct().count()


def test_partial_best_and_empty_tables(spark):
    pages, queries, p, q = _tables(spark, 5, 40, 6, 4)
    want = _brute(pages, queries)
    top = index.top_hits(late.max_sim(p, q, 3), 3).collect()
    for query in {a for a, _ in want}:
        rows = sorted(((-s, b) for (a, b), s in want.items() if a == query))[:3]
        assert np.allclose([r.score for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == query], [-s for s, _ in rows])
    for a, b in ((p.limit(0), q), (p, q.limit(0)), (p.filter("point_id = 9000"), q)):
        assert late.max_sim(a, b).count() == 0 and late.top_pages(late.packed(a), a, b, 2).count() == 0
    signs = late.max_sim(p.withColumn("id", F.lit("x")).withColumn("kind", F.lit(3)), q, quantise=True)
    s = {k: v for k, v in pages if v}
    one = next(r for r in signs.collect() if r.query_id == 0 and r.point_id == 1)
    assert abs(one.score - _brute([(1, np.where(np.array(s[1]) >= 0, 1, -1).tolist())], queries[:1])[0, 1]) < 1e-9
    with pytest.raises(Exception, match="different lengths"):
        late.max_sim(spark.createDataFrame([(1, [[1.0], [1.0, 2.0]])], "point_id long, patches array<array<double>>"), q).collect()
