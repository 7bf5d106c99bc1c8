"""A stream of documents through the whole parse: equal to the batch, also after killed and replayed batches."""

import pytest
from pyspark.sql import functions as F

from quire import fixtures as fx
from quire.operators import parse
from quire.plans import jobs
from quire.sources import files
from quire.streaming import jobs as streams
from quire.streaming import tables

SCHEMA = "doc_id long, text string"


def _rows(n):
    lines = ["Section one", "a | b | c", "words that go on,", "and on here", "total amount = 3", "Plain."]
    return [(i, "\n".join(lines[(i + k) % 6] for k in range(i * 7 % 40 + 1)) if i % 9 else None) for i in range(n)]


def _key(df):
    columns = [c for c in sorted(df.columns) if c != "batch"]
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def _same_as_batch(spark, root, docs):
    good = docs.filter("text is not null")
    blocks = jobs.corpus_parse(fx.spans_of(good))
    assert _key(tables.read(spark, root, "blocks", "parse_run_id", "runs")) == _key(blocks)
    assert _key(tables.read(spark, root, "citations", "parse_run_id", "runs")) == _key(parse.citation_rows(blocks))
    assert _key(tables.read(spark, root, "reviews", "parse_run_id", "runs")) == _key(parse.review_actions(blocks))
    runs = {r.parse_run_id: r.error for r in tables.read(spark, root, "runs", "parse_run_id").collect()}
    assert runs == {str(r.doc_id): None if r.text else "no text" for r in docs.collect()}
    assert {r.doc_id for r in tables.read(spark, root, "dead_letters").collect()} == {r.doc_id for r in docs.filter("text is null").collect()}


def _start(spark, home, n=1):
    stream = streams.document_stream(spark, f"{home}/in", SCHEMA, n)
    return streams.incremental_parse(stream, fx.spans_of, f"{home}/out", f"{home}/progress")


def test_stream_equals_batch_also_after_kills(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(_rows(40), SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    real, seen = tables.Batch.write, []

    def dies(self, name, rows):
        seen.append((self.number, name))
        if (self.number, name) in {(0, "reviews"), (1, "runs")} and seen.count((self.number, name)) == 1:
            real(self, name, rows)
            raise RuntimeError("killed after the table was written")
        return real(self, name, rows)

    monkeypatch.setattr(tables.Batch, "write", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            _start(spark, tmp_path).awaitTermination()
    _start(spark, tmp_path).awaitTermination()
    assert len(tables.commits(spark, f"{tmp_path}/out")) == 3
    _same_as_batch(spark, f"{tmp_path}/out", docs)
    attempts = [files.listed(spark, f"{tmp_path}/out/blocks/batch={b}") for b in range(3)]
    assert all(len(a) == 1 for a in attempts)


def test_replays_change_nothing(spark, tmp_path):
    docs = spark.createDataFrame(_rows(12), SCHEMA)
    docs.write.parquet(f"{tmp_path}/in")
    _start(spark, tmp_path, 100).awaitTermination()
    before = tables.commits(spark, f"{tmp_path}/out")
    count = []
    tables.into_tables(f"{tmp_path}/out", lambda *_: count.append(1))(docs, 0)
    assert not count and tables.commits(spark, f"{tmp_path}/out") == before
    with pytest.raises(FileExistsError):
        files.publish(spark, f"{tmp_path}/out/_commits/{0:012d}.json", "{}")


def test_documents_that_come_again(spark, tmp_path):
    docs = spark.createDataFrame(_rows(12), SCHEMA)
    docs.write.parquet(f"{tmp_path}/in")
    _start(spark, tmp_path, 100).awaitTermination()
    later = spark.createDataFrame([(1, "All new."), (2, None), (50, "Another.\nLine")], SCHEMA)
    later.write.mode("append").parquet(f"{tmp_path}/in")
    _start(spark, tmp_path, 100).awaitTermination()
    root = f"{tmp_path}/out"
    texts = {}
    for r in tables.read(spark, root, "blocks", "parse_run_id", "runs").collect():
        texts.setdefault(r.parse_run_id, []).append(r.text)
    assert texts["1"] == ["All new."] and "2" not in texts and "50" in texts
    assert tables.read(spark, root, "blocks").filter("parse_run_id = '1'").select("batch").distinct().count() == 2
    assert {r.parse_run_id: r.error for r in tables.read(spark, root, "runs", "parse_run_id").collect()}["2"] == "no text"


def test_commits_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT", 3)
    root = str(tmp_path)
    each = tables.into_tables(root, lambda rows, batch: batch.write("t", rows.withColumn("b", F.lit(batch.number))))
    for k in range(8):
        each(spark.range(2), k)
    assert sorted(tables.commits(spark, root)) == list(range(8))
    assert files.listed(spark, f"{root}/_commits") == ["000000000006.json", "000000000007.json", "upto-000000000005.json"]
    assert sorted(r.b for r in tables.read(spark, root, "t").collect()) == sorted([*range(8)] * 2)
    each(spark.range(9), 2)  # a replay of a batch that was taken up
    assert tables.read(spark, root, "t").count() == 16
    with pytest.raises(FileNotFoundError):
        tables.read(spark, root, "none")
