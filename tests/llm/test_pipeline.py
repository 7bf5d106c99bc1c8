"""The pipeline's stages on the smallest supplied tables, each held against a brute-force version."""

import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline  # noqa: E402
from quire.llm import quality  # noqa: E402
from quire.llm.queries import vocabulary  # noqa: E402

from test_llm_operators import WORD, brute_components  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    texts = [{r.doc_id: r for r in s.collect()} for s in steps[:4]]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~quality.held_out())
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert set(texts[1]) == {d for d, s in scores.items() if s >= 0.3}
    _, part = brute_components([(d, r.text) for d, r in texts[1].items()], 5, 80)
    assert set(texts[2]) == {d for d in part if part[d] == d}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, r in texts[2].items() if any(t in r.text for t in items)}
    assert held.isdisjoint(texts[3]) and len(texts[2]) - len(texts[3]) <= len(held) + 1
    mixed = steps[4].collect()
    per, size = defaultdict(int), {d: len(WORD.findall(r.text)) for d, r in texts[3].items()}
    for d, r in texts[3].items():
        per[r.source] += size[d]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and {r.doc_id for r in mixed} <= set(texts[3])
    assert sum(size[r.doc_id] for r in mixed) == pytest.approx(sum(per.values()), rel=0.15)
    t, at = Tokenizer.from_file(vocabulary()), 0
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in steps[5].collect())
    for want, found in zip(sorted(mixed, key=lambda r: r.doc_id), got, strict=True):
        ids = [*t.encode(want.text, add_special_tokens=False).ids, 2]
        assert found == (at, want.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert re.fullmatch(r"doc_id,start,n_tokens,ids_crc32", ",".join(steps[5].columns))


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table: each stage's docstring."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    some = docs.first()
    add = [(None, "no id at all", None, None, 1), (10**9, None, None, None, 0), (10**9 + 1, "", "en", "x", 0), (10**9 + 2, "word " * 60_000, "en", "x", 1), tuple(some), tuple(some), (some.doc_id, "the same id, another text", "en", None, 5)]
    odd = docs.union(spark.createDataFrame(add, docs.schema))
    for name in ("score", "node", "size", "__text_id_", "item_id"):
        odd = odd.withColumn(name, F.lit("clash"))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name == "token output":
            assert len(rows) == odd.count()
            continue
        assert out.columns == odd.columns and all(r.score == "clash" for r in rows)
        counts[name] = Counter(r.doc_id for r in rows)
    near, clean, mixed = counts["minhash near-dedup"], counts["benchmark decontamination"], counts["source mixing"]
    assert near[None] == near[10**9] == near[10**9 + 1] == 1 and near[some.doc_id] == 2  # two texts under one id
    rows = Counter(r.doc_id for r in odd.collect())  # each row up to three times
    assert clean[None] == 1 and all(n <= 3 * rows[d] for d, n in mixed.items())
