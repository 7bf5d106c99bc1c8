"""Incremental parse and index, run state, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse, runs
from ..plans import jobs
from ..sources import collection
from . import tables


def incremental(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, order: str | None = None) -> StreamingQuery:
    """Run ``job`` on each micro-batch of documents and upsert its rows into the collection at ``path`` by ``key``.

    A document never spans batches, so no state is kept; replays of a batch write the same rows.
    """

    def each(batch: DataFrame, _: int) -> None:
        collection.upsert_collection(batch.sparkSession, job(batch), path, key, order)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def incremental_parse(
    stream: DataFrame, spans_of: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, key: str = "doc_id", text: str = "text"
) -> StreamingQuery:
    """Parse a stream of documents into the tables ``runs``, ``blocks``, ``citations``, ``reviews`` and ``dead_letters`` at ``root``.

    ``spans_of`` gives the spans of documents, with ``key`` as parse_run_id. A document without text is
    a dead letter and a run with that error. A micro-batch's tables are committed together, and once:
    a batch that was killed or is replayed leaves nothing twice. A document that comes again in a
    later batch replaces what the earlier one left; ``tables.read`` does so by the table ``runs``. A document
    that comes twice in one batch counts once.
    """

    def work(rows: DataFrame, batch: tables.Batch) -> None:
        blank = F.col(text).isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")
        good, bad = with_dead_letters(rows.dropDuplicates([key]), F.when(blank, F.lit("no text")))
        blocks = batch.write("blocks", jobs.corpus_parse(spans_of(good)))
        batch.write("citations", parse.citation_rows(blocks))
        batch.write("reviews", parse.review_actions(blocks))
        bad = batch.write("dead_letters", bad)
        run = F.col(key).cast("string").alias("parse_run_id")
        batch.write("runs", good.select(run, F.lit(None).cast("string").alias("error")).unionByName(bad.select(run, "error")))

    return stream.writeStream.foreachBatch(tables.into_tables(root, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_states(events: DataFrame, late: str | None = None) -> DataFrame:
    """Latest state of each run in update mode; a watermark only bounds the state kept."""
    return runs.latest_state(events.withWatermark("ts", late) if late else events)


def with_dead_letters(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with a problem and the last 4000 characters of it)."""
    marked = rows.withColumn("error", problem)
    bad = marked.filter("error is not null").withColumn("error", F.right("error", F.lit(4000)))
    return marked.filter("error is null").drop("error"), bad
