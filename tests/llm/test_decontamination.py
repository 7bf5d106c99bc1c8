"""The latent search finds what exact counts of all texts with all items find, and nothing comes without it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontaminate


def _corpus(seed, third):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    usual = [word() for _ in range(30)]
    text = lambda n, often=0.5: " ".join(rng.choice(usual) if rng.random() < often else word() for _ in range(n))
    items = [(i, f"{text(rng.randrange(14, 40), 0.2)}. {text(6, 0.2)}.") for i in range(60)]
    docs, planted = [], set()
    for d in range(600):
        body = text(rng.randrange(5, 300))
        if d % 3 == 0:
            i, item = items[rng.randrange(50)]
            words = item.split()
            if d % 2:  # some of its words are others, its end stays
                words = [word() if rng.random() < 0.2 and k < len(words) - 8 else w for k, w in enumerate(words)]
            body = f"{body} {' '.join(words)} {text(rng.randrange(100))}"
            planted.add((d, i))
        docs.append((d, body))
    if third:  # a third of all rows hold one shortened item
        i, item = items[55]
        for d in range(600, 900):
            docs.append((d, f"{text(20)} {' '.join(w for k, w in enumerate(item.split()) if k % 5)} {text(20)}"))
            planted.add((d, i))
    return docs, items, planted


def _found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}


def test_latent_search_against_exact_counts(spark):
    docs, items, planted = _corpus(1, third=False)
    found = _found(spark, docs, items)
    assert planted <= found and len(found - planted) < 5
    exact = _found(spark, docs, items, most_common=0.0)  # then no item has rare words, and all go by exact counts
    assert len(found & exact) >= 0.95 * len(exact)
    without = _found(spark, docs, items, rules=decontaminate.Rules(cosine=1.1))
    assert len(without) < len(planted) / 10  # the search is what finds them


def test_an_item_that_a_third_of_all_rows_hold(spark):
    docs, items, planted = _corpus(2, third=True)
    found = _found(spark, docs, items)
    assert planted <= found and len(found - planted) < 5


def test_parts_of_a_benchmark(spark, monkeypatch):
    docs, items, planted = _corpus(3, third=False)
    monkeypatch.setattr(decontaminate, "SPACE_WORDS", 300)
    found = _found(spark, docs[:300], items)
    assert {p for p in planted if p[0] < 300} <= found


def test_null_ids(spark):
    docs, items, _ = _corpus(4, third=False)
    text = items[0][1]
    found = _found(spark, [(None, text), (1, text), (1, text), (2, None)], [(None, text), (7, text), (8, None)])
    assert found == {(None, None), (None, 7), (1, None), (1, 7)}


@pytest.mark.parametrize("n", [50, 70_000])  # numbers of 16 and of 32 bits
def test_words_are_numbered_once_for_all_passes(spark, n):
    texts = ["w1 w2 other, W7", None, "", "w49 " * 3, " ".join(f"w{k}" for k in range(0, 60, 7))]
    known = np.unique(decontaminate.words(pa.array([" ".join(f"w{k}" for k in range(n))]))[0])
    known = np.unique(np.concatenate([known, known[:9] + np.uint64(1)]))  # share their places
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = decontaminate._numbered(docs, known)
    space = decontaminate.Space(known, np.zeros(len(known)))
    found = {}
    for batch in rows.toArrow().to_batches():
        for part, ids, bounds in space.numbers([batch]):
            for k, d in enumerate(part.column("doc_id").to_pylist()):
                found[d] = ids[bounds[k] : bounds[k + 1]].tolist()
    h, bounds = decontaminate.words(pa.array(texts))
    want = decontaminate.numbered(h, known)
    assert found == {d: want[bounds[d] : bounds[d + 1]].tolist() for d in range(len(texts))}
