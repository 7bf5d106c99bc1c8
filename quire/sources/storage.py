"""Files, tables, documents as JSON, logs and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .collection import read_collection, rebuild_collection, upsert_collection  # noqa: F401
from .files import scratch  # noqa: F401

GOLDEN = (
    "doc_type string, page_count int, teds_threshold double, block_types array<string>, "
    "tables array<struct<page:int,html:string,teds_threshold:double>>, extraction map<string,string>, "
    "expected_confidence_calibrated_min double, retrieval struct<query:string,expected_page:int>"
)
LOG_KEYS = ("stage", "event", "run", "pages", "blocks", "error", "ms")


def raw_files(spark: SparkSession, path: str, workspace_id: str, content_type: str = "application/pdf") -> DataFrame:
    """Registered files: content hash, size, type and name (``document.pdf`` where there is none)."""
    return registered(spark.read.format("binaryFile").load(path), workspace_id, content_type)


def registered(files: DataFrame, workspace_id: str, content_type: str = "application/pdf") -> DataFrame:
    name = F.nullif(F.element_at(F.split("path", "/"), -1), F.lit(""))
    digest = F.sha2("content", 256)
    return files.select(
        F.lit(workspace_id).alias("workspace_id"), digest.alias("document_id"), F.coalesce(name, F.lit("document.pdf")).alias("filename"),
        digest.alias("file_hash_sha256"), F.length("content").cast("long").alias("byte_size"), F.lit(content_type).alias("content_type"),
    )


def read_table(spark: SparkSession, path: str, workspace_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if workspace_id is None else rows.filter(F.col("workspace_id") == workspace_id)


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by workspace, so that a tenant's reads prune to its folders."""
    rows.write.mode(mode).partitionBy("workspace_id").parquet(path)


def append_checked(rows: DataFrame, path: str, workspace_id: str) -> int:
    """Append rows of one workspace to a table by workspace; how many there were.

    A row of another workspace, or of none, fails the job before anything is committed: readers see the
    table as it was. The counts come from the write itself.
    """
    own = F.col("workspace_id").eqNullSafe(F.lit(workspace_id))
    refused = F.raise_error(F.concat(F.lit(f"a row isn't of workspace {workspace_id}: "), F.coalesce(F.col("workspace_id").cast("string"), F.lit("null"))))
    count = Observation("checked")
    checked = rows.withColumn("workspace_id", F.when(own, F.col("workspace_id")).otherwise(refused)).observe(count, F.count("*").alias("n"))
    checked.write.mode("append").partitionBy("workspace_id").parquet(path)
    return count.get["n"]


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A relational table read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def asts(blocks: DataFrame, status: str = "succeeded") -> DataFrame:
    """(parse_run_id, ast): one JSON text per run, keys in order, blocks by rank."""
    block = F.struct("bbox", "block_id", "confidence", "page", "reading_order_rank", "text", "type")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reading_order_rank", block.alias("b")))), lambda x: x.b)
    rows = blocks.groupBy("workspace_id", "document_id", "parse_run_id").agg(ordered.alias("blocks"), F.array_sort(F.collect_set("page")).alias("pages"))
    body = F.struct("blocks", "document_id", "pages", "parse_run_id", F.lit(status).alias("status"), "workspace_id")
    return rows.select("parse_run_id", F.to_json(body).alias("ast"))


def write_asts(blocks: DataFrame, path: str) -> None:
    asts(blocks).select("ast").write.mode("overwrite").text(path)


def log_lines(events: DataFrame, keys: tuple[str, ...] = LOG_KEYS) -> DataFrame:
    """``key=value`` lines of the columns that aren't null, in order of ``keys``."""
    there = [k for k in keys if k in events.columns]
    return events.select(F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in there]).alias("line"))


def parsed_log(lines: DataFrame, keys: tuple[str, ...] = LOG_KEYS) -> DataFrame:
    """Columns of log lines; values may hold spaces and JSON, as only known keys end them."""
    after = "|".join(keys)
    value = lambda k: F.nullif(F.regexp_extract("line", rf"(?:^| ){k}=(.*?)(?= (?:{after})=|$)", 1), F.lit(""))
    return lines.select("line", *[value(k).alias(k) for k in keys])


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return rows.withColumn("case", F.regexp_extract(F.input_file_name(), r"([^/]+)\.expected\.json$", 1))
