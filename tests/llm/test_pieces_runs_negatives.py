"""SentencePiece ids, periodic runs and hard negatives against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives, periodic, pieces, queries

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(queries.piece_model())


def _ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_ids_equal_the_library(encoder):
    own = encoder.library
    rng = random.Random(5)
    parts = ["a", "ab", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "ﬁ", "漢", "\0", "the", " the", "ing", "0", "==", "　", "😀", "</s>", "<0x0A>", "\x01", " " * 17]
    parts += [own.id_to_piece(rng.randrange(259, own.get_piece_size())) for _ in range(80)]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    assert [_ids(raw) for raw in encoder.encode(texts)] == own.encode(texts)
    long = "".join(rng.choices(parts, k=60_000))
    assert _ids(encoder.encode([long, "x" * 50_000])[0]) == own.encode(long)
    assert _ids(encoder.encode(["x" * 50_000])[0]) == own.encode("x" * 50_000)


def test_pairs_are_what_the_library_says(encoder):
    own, rng = encoder.library, random.Random(7)
    tokens = [t for t in encoder.steps if pieces.SPACE not in own.id_to_piece(t)]
    yes = 0
    for _ in range(4000):
        a, b = rng.choices(tokens, k=2)
        # a sign that no piece holds keeps the mark at a text's start away from the pair
        found = own.encode("\n" + own.id_to_piece(a) + own.id_to_piece(b))[2:]
        assert encoder.compatible(a, b) == (found == [a, b])
        yes += found == [a, b]
    assert 0 < yes < 4000


def test_ways_to_encode_agree(encoder):
    rng = random.Random(9)
    cuts = list({"".join(rng.choices("abcdeinrstéüÄ.,-1%", k=rng.randrange(1, 20))) for _ in range(3000)})
    cuts += ["\n" + c for c in cuts[:500]] + ["\n"]
    side = pieces.SideBySide(encoder)
    one = [_ids(pieces.PieceEncoder.__missing__(encoder, c)) for c in cuts]
    assert [_ids(raw) for raw in side.encode(cuts)] == one


def test_encoded_rows(spark, encoder):
    texts = [None, "", " ", "a  b", "the end.", "the end.", "á\0é\n\n z ", "word " * 3000]
    rows = [(k if k != 3 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{DOCS}, ids string")
    done = pieces.decoded(pieces.encoded(docs, queries.piece_model()), queries.piece_model())
    found = sorted(((r.doc_id, r.ids, r.text) for r in done.collect()), key=str)
    own = encoder.library
    want = [(d, [*own.encode(t or ""), 2], own.decode([*own.encode(t or ""), 2])) for d, t, _ in rows]
    assert found == sorted(want, key=str)
    assert pieces.encoded(docs.limit(0), queries.piece_model()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 264])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decoded(odd, queries.piece_model()).collect()} == {1: "", 2: own.decode([264])}


def test_other_models_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(pieces.PieceEncoder, "ids", lambda self, text: [0])
    with pytest.raises(ValueError, match="BPE"):
        pieces.PieceEncoder(queries.piece_model())


def brute_runs(w, least):
    """Every stretch that repeats with a period and can't be extended, with its smallest period."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, size, q) for (a, size), q in out.items())


def _texts(rng, n):
    texts = []
    for _ in range(n):
        w = rng.choices("abcdef"[: rng.choice([1, 2, 3, 6])], k=rng.randrange(50))
        for _ in range(rng.randrange(4)):
            base = rng.choices("abcdxyz", k=rng.randrange(1, 10))
            w += (base * 30)[: rng.randrange(60)] + rng.choices("abcdxyz", k=rng.randrange(4))
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts


@pytest.mark.parametrize("least", [2, 3, 7, 12, 13])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = _texts(rng, rng.randrange(1, 8))
        for t, (words, runs) in zip(texts, periodic.text_runs(texts, least, rng.choice([1, 40, 1000])), strict=True):
            want = brute_runs(t.split(), least)
            assert [tuple(r) for r in runs.tolist()] == want
            gone = {i for a, size, q in want for i in range(a + q, a + size)}
            assert periodic.kept_words(len(words), runs).tolist() == [i not in gone for i in range(len(words))]


def test_extensions_against_letters():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 80))] + [0]
        own, n = periodic.Extensions(s, 4), len(s)
        assert np.argsort(own.rank).tolist() == sorted(range(n), key=lambda k: s[k:])
        i, j = np.array([(a, b) for a in range(n) for b in range(n) if a != b]).T
        for a, b, size in zip(i.tolist(), j.tolist(), own(i, j).tolist(), strict=True):
            k = 0
            while max(a, b) + k < n and s[a + k] == s[b + k]:
                k += 1
            assert size == k


def test_periodic_rows(spark):
    texts = [None, "", " \n", "a b " * 8, "a b " * 8, "x " * 11, "x " * 12, "é " * 5000, " ".join(map(str, range(3000)))]
    docs = spark.createDataFrame([(k if k != 4 else None, t, "c") for k, t in enumerate(texts)], f"{DOCS}, runs string")
    found = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed_text) for r in periodic.periodic_runs(docs).collect()}
    assert found[0, 0] == found[1, 0] == found[2, 0] == ([], "")
    assert found[3, 16] == found[None, 16] == ([(0, 16, 2)], "a b")
    assert found[5, 11] == ([], " ".join("x" * 11))
    assert found[6, 12] == ([(0, 12, 1)], "x")
    assert found[7, 5000] == ([(0, 5000, 1)], "é")
    assert found[8, 3000] == ([], texts[8])
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, tmp_path):
    rng = random.Random(1)
    texts = [*_texts(rng, 200), None, "", "one two"]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for d, t in enumerate(texts):
        w, h = (t or "").split(), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w, 12)
        gone = {i for a, size, q in runs for i in range(a + q, a + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = found[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{a},{size},{q}\n" for a, size, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert planted > 10


POINTS = "vec_id long, label long, v array<long>"


def brute_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    rows = [(i, c, np.array(v, object)) for i, c, v in rows]
    out = []
    for a, label, q in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-int((v * q).sum()), i, c == label) for i, c, v in rows if i != a)
        for s, p in [(-s, i) for s, i, same in scored if same][:positives]:
            good = [(-t, i) for t, i, same in scored if not same and low * s <= -100 * t <= high * s][:negatives]
            out += [(a, p, k, i, s, t) for k, (t, i) in enumerate(good, 1)]
    return sorted(out)


def _found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,d,labels,spread,tree_rows", [(1, 6, 3, 40, 64), (2, 3, 2, 3, 50), (3, 1, 1, 9, 100), (4, 12, 9, 1 << 22, 4096), (5, 8, 4, 1 << 28, 40)])
def test_negatives_against_brute_force(spark, seed, d, labels, spread, tree_rows):
    rng = np.random.default_rng(seed)
    v = rng.integers(-spread, spread + 1, (400, d)) + rng.integers(0, spread // 2 + 1, (400, 1))
    v[rng.random(400) < 0.3] = v[7]  # a third of all rows hold one vector
    label = np.where(rng.random(400) < 0.4, 0, rng.integers(0, labels, 400))
    rows = [(int(i) * 3 - 300, int(c), x.tolist()) for i, c, x in zip(rng.permutation(400), label, v, strict=True)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, POINTS), F.col("vec_id") % 10 == 0, tree_rows=tree_rows)
    assert _found(found) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    good = [(10, 0, [3, 4]), (1, 0, [3, 3]), (2, 1, [2, 3]), (3, 1, [1, 2]), (4, 1, [-3, -4]), (5, 0, [0, 0])]
    odd = [(None, 0, [9, 9]), (6, None, [9, 9]), (7, 0, None), (8, 1, [9, None]), (9, 1, [9, 9, 9]), (11, 1, [])]
    frame = spark.createDataFrame([*good, *odd, good[2]], POINTS).withColumn("score", F.lit("x")).withColumn("tree", F.lit(1))
    is_anchor = F.col("vec_id") == 10
    assert _found(negatives.hard_negatives(frame, is_anchor)) == brute_negatives(good, lambda i: i == 10)
    assert _found(negatives.hard_negatives(frame, is_anchor, positives=1, negatives=1, low=1, high=100)) == brute_negatives(good, lambda i: i == 10, 1, 1, 1, 100)
    assert _found(negatives.hard_negatives(frame, F.lit(False))) == []
    assert _found(negatives.hard_negatives(frame.limit(0), is_anchor)) == []
    with pytest.raises(OverflowError):
        negatives.hard_negatives(spark.createDataFrame([(1, 0, [1 << 40, 1])], POINTS), F.lit(True))


def test_tree_prunes_and_finds(spark):
    """The best-first search opens few pages and misses none."""
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(20, 4))[rng.integers(0, 20, 4000)] * 100 + rng.normal(size=(4000, 4)) * 5).astype(np.int64)
    ids = rng.permutation(4000).astype(np.int64)
    page = negatives.pages_of(v, ids)
    assert np.bincount(page).max() <= negatives.PAGE_ROWS
    order = np.lexsort((ids, page))
    tree = negatives.Tree(page[order], ids[order], v[order].astype(float))
    opened = 0
    for q in v[:50].astype(float):
        best = negatives.Best(5)
        for some, scores in tree.best_first(q, best.wants):
            opened += 1
            best.add(some, scores)
        scores = v @ q
        assert [i for _, i in best.rows] == [i for _, i in sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:5]]
    assert opened < 50 * (page.max() + 1) / 4
