"""Run state, rollups, manifests, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed", "cancelled")


def of_workspace(rows: DataFrame, workspace: Column) -> DataFrame:
    """Rows of one tenant: every read goes through this filter, which prunes partitions by workspace."""
    return rows.filter(F.col("workspace_id") == workspace)


def eligible(runs: DataFrame, readable: bool = False) -> DataFrame:
    """Runs that extraction may use (succeeded), or whose blocks may be read."""
    return runs.filter(F.col("status").isin("intake_complete", "succeeded") if readable else F.col("status") == "succeeded")


def joined_runs(runs: DataFrame, documents: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run with document and blocks, runs whose document is missing), never across tenants."""
    docs = documents.select("workspace_id", "document_id", "filename")
    held = runs.join(docs, ["workspace_id", "document_id"])
    rows = held.join(blocks.drop("document_id"), ["workspace_id", "parse_run_id"])
    return rows, runs.join(docs, ["workspace_id", "document_id"], "left_anti")


def rollup(blocks: DataFrame) -> DataFrame:
    """Blocks, flagged blocks and mean calibrated confidence by run; 0 where there is none."""
    return blocks.groupBy("parse_run_id").agg(
        F.count("*").alias("n_blocks"), F.count_if("needs_review").alias("n_flagged"),
        F.coalesce(F.avg("confidence.calibrated"), F.lit(0.0)).alias("mean_confidence"),
    )


def latest_state(events: DataFrame) -> DataFrame:
    """Last state of each run; a terminal state wins over later others."""
    final = F.col("state").isin(*TERMINAL)
    return events.groupBy("parse_run_id").agg(F.max_by("state", F.struct(final.alias("final"), "ts", "event_id")).alias("state"), F.max("ts").alias("last_ts"))


def tenant_costs(events: DataFrame) -> DataFrame:
    return events.groupBy("workspace_id").agg(F.sum("cost_credits").alias("cost_credits"), F.countDistinct("parse_run_id").alias("n_runs"))


def stage_timings(events: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile by stage of agent_timings_ms."""
    rows = events.select(F.explode("agent_timings_ms").alias("stage", "ms"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.5).alias("median_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def completed(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Runs marked succeeded from ``totals`` (parse_run_id, page_count, file_hash, timings); new timings win."""
    rows = runs.join(totals, "parse_run_id")
    kept = F.map_filter(F.coalesce("agent_timings_ms", F.create_map().cast("map<string,int>")), lambda k, _: ~F.array_contains(F.map_keys("timings"), k))
    return rows.select(
        "workspace_id", "document_id", "parse_run_id", F.lit("succeeded").alias("status"), F.lit(1.0).alias("progress"), "page_count", "file_hash",
        F.map_concat(kept, "timings").alias("agent_timings_ms"), F.lit(None).cast("string").alias("error"),
    )


def artifact_path(kind: str, name: Column) -> Column:
    return F.concat(F.lit("/"), F.concat_ws("/", "workspace_id", "document_id", F.lit(kind), name))


def manifest(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Artifact paths by run: original, page renders, block crops, ast and log."""
    keys = ["workspace_id", "document_id", "parse_run_id"]
    renders = pages.groupBy(*keys).agg(F.array_sort(F.collect_set(artifact_path("renders", F.concat(F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(".png"))))).alias("renders"))
    crops = blocks.groupBy(*keys).agg(F.array_sort(F.collect_set(artifact_path("crops", F.concat("block_id", F.lit(".png"))))).alias("crops"))
    rows = renders.join(crops, keys, "left")
    return rows.select(
        *keys, artifact_path("originals", F.lit("document.pdf")).alias("original"), "renders", F.coalesce("crops", F.array().cast("array<string>")).alias("crops"),
        artifact_path("ast", F.concat("parse_run_id", F.lit(".json"))).alias("ast"), artifact_path("logs", F.concat("parse_run_id", F.lit(".log"))).alias("log"),
    )


def progress(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages done of pages in all, and ordered block ids, once a run may be read; 0 and none before."""
    done = blocks.groupBy("parse_run_id").agg(
        F.countDistinct("page").alias("done"), F.array_sort(F.collect_list(F.struct("page", "reading_order_rank", "block_id"))).alias("b")
    )
    rows = runs.join(done, "parse_run_id", "left")
    ready = F.col("status").isin("intake_complete", "succeeded")
    none = F.array().cast("array<string>")
    return rows.select(
        "parse_run_id", "status", F.when(ready, F.coalesce("done", F.lit(0))).otherwise(0).alias("pages_done"), F.coalesce("page_count", "done", F.lit(0)).alias("pages_total"),
        F.when(ready, F.coalesce(F.transform("b", lambda x: x.block_id), none)).otherwise(none).alias("block_ids"),
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """Texts of a run in reading order with blank lines between; blocks without text are left out."""
    rows = blocks.filter("coalesce(text, '') <> ''")
    parts = F.array_sort(F.collect_list(F.struct("reading_order_rank", "text")))
    return rows.groupBy("parse_run_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("markdown"))


def listing(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy("parse_run_id", "page", "reading_order_rank", "block_id")


def failures(runs: DataFrame, most_chars: int = 4000) -> DataFrame:
    """Failed runs with the end of their error."""
    return runs.filter("status = 'failed'").select("parse_run_id", F.right("error", F.lit(most_chars)).alias("error"))
