"""Tables that the document queries read, derived from the supplied ones, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans of pages of 12 lines; every third document has two columns."""
    return spans_of(table(spark, sf_dir, "documents"))


def spans_of(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    slot, two = F.col("ord") % 12, F.col("doc_id") % 3 == 0
    row = F.when(two, slot % 6).otherwise(slot)
    x = F.when(two & (slot >= 6), 0.58).otherwise(0.08)
    y = F.lit(0.05) + F.lit(0.03) * row + F.when(row >= 3, 0.2).otherwise(0.0)
    return docs.filter(F.trim("text") != "").select(
        (F.col("doc_id") % 5).cast("string").alias("workspace_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").cast("string").alias("parse_run_id"), F.floor(F.col("ord") / 12).cast("int").alias("page"), "ord", "text",
        boxes.box(x, y, F.lit(0.36), F.lit(0.02)).alias("bbox"), F.lit("serif").alias("font"), F.when(slot == 0, 18.0).otherwise(11.0).alias("size"),
    )


SPANS = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
slots AS (SELECT *, ord % 12 AS slot, doc_id % 3 = 0 AS two FROM lines WHERE trim(text, ' ') <> ''),
placed AS (SELECT *, CASE WHEN two THEN slot % 6 ELSE slot END AS r FROM slots),
spans AS (SELECT CAST(doc_id % 5 AS VARCHAR) AS workspace_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) AS parse_run_id,
  CAST(ord // 12 AS INT) AS page, CAST(ord AS INT) AS ord, text, CASE WHEN two AND slot >= 6 THEN 0.58::DOUBLE ELSE 0.08::DOUBLE END AS x,
  0.05::DOUBLE + 0.03::DOUBLE * r + CASE WHEN r >= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS y, 0.36::DOUBLE AS w, 0.02::DOUBLE AS h,
  CASE WHEN slot = 0 THEN 18.0::DOUBLE ELSE 11.0::DOUBLE END AS size FROM placed)"""
#: On these spans the running union's left and bottom are the last span's, so a lag says the same as the fold.
REGIONS = SPANS + """,
lagged AS (SELECT *, lag(x) OVER o AS px, lag(y + h) OVER o AS pb FROM spans WINDOW o AS (PARTITION BY parse_run_id, page ORDER BY y, x, ord)),
numbered AS (SELECT *, sum(CASE WHEN px IS NULL OR NOT (abs(y - pb) < 0.035::DOUBLE AND abs(x - px) < 0.08::DOUBLE) THEN 1 ELSE 0 END)
  OVER (PARTITION BY parse_run_id, page ORDER BY y, x, ord) - 1 AS region FROM lagged),
unions AS (SELECT workspace_id, document_id, parse_run_id, page, CAST(region AS INT) AS ord, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2,
  avg(size) AS average_size, count(*) AS n_spans, trim(string_agg(text, ' ' ORDER BY y, x, ord), ' ') AS text FROM numbered GROUP BY ALL),
padded AS (SELECT *, greatest(0.0::DOUBLE, x1 - 0.006::DOUBLE) AS x, greatest(0.0::DOUBLE, y1 - 0.004::DOUBLE) AS y,
  least(1.0::DOUBLE, x1 + (x2 - x1) + 0.006::DOUBLE) AS xr, least(1.0::DOUBLE, y1 + (y2 - y1) + 0.004::DOUBLE) AS yb, lower(text) AS low FROM unions),
typed AS (SELECT *, xr - x AS w, yb - y AS h, CASE WHEN y > 0.92 THEN 'footer'
  WHEN average_size >= 16 OR starts_with(low, 'chapter') OR starts_with(low, 'section') OR starts_with(low, 'appendix') THEN 'header'
  WHEN contains(low, '|') OR contains(low, ' total ') OR contains(low, ' amount ') OR contains(low, ' qty ') OR contains(low, 'table ') THEN 'table'
  WHEN contains(low, '=') OR contains(low, '∑') OR contains(low, '\\frac') OR contains(low, ' equation ') THEN 'equation' ELSE 'paragraph' END AS type FROM padded),
regions AS (SELECT *, CASE WHEN type IN ('table', 'equation', 'figure') OR w > 0.75 THEN 'mineru' ELSE 'paddleocr' END AS route,
  'blk_p' || page || '_' || type || '_' || ord AS block_id, 0.88::DOUBLE AS layout_confidence FROM typed)"""
BLOCKS = REGIONS + """,
blocks AS (SELECT *, CASE WHEN route = 'mineru' THEN 0.25::DOUBLE ELSE 0.96::DOUBLE END AS raw,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN route = 'mineru' THEN 0.25::DOUBLE ELSE 0.96::DOUBLE END) * 0.75::DOUBLE + layout_confidence * 0.25::DOUBLE)) AS calibrated FROM regions)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packets: a turn is a page of one block."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("parse_run_id"), F.col("turn").cast("int").alias("page"), F.lit(0).alias("ord"),
        F.concat_ws("_", F.lit("t"), "turn").alias("block_id"), F.when(F.col("role") == "system", "header").otherwise("paragraph").alias("type"),
        F.col("turn").cast("int").alias("reading_order_rank"), "text",
    )


PACKETS = """
packets AS (SELECT CAST(conv_id AS VARCHAR) AS parse_run_id, CAST(turn AS INT) AS page, 0 AS ord, CASE WHEN role = 'system' THEN 'header' ELSE 'paragraph' END AS type,
  CAST(turn AS INT) AS reading_order_rank, text FROM conversations),
pages AS (SELECT parse_run_id, page, string_agg(trim(text, ' ' || chr(10) || chr(9) || chr(13)), ' ' ORDER BY reading_order_rank, ord) AS text FROM packets
  WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY ALL)"""


def page_vectors(spark: SparkSession, sf_dir: str, per: int = 8) -> DataFrame:
    """Eight vectors in a row are the patches of a page; pages belong to five workspaces."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / per).alias("point_id"), "vec_id", "embedding")
    listed = rows.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    page = F.col("point_id")
    return listed.select(
        "point_id", (page % 5).cast("string").alias("workspace_id"), page.cast("string").alias("document_id"), F.lit(0).alias("page"),
        F.transform("p", lambda x: x.embedding).alias("patches"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100 and the three behind it are a query's tokens."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 100 < 4").select(F.floor(F.col("vec_id") / 100).alias("query_id"), "vec_id", "embedding")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    return listed.select("query_id", F.transform("p", lambda x: x.embedding).alias("tokens"))


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of 8 x 8 grey pixels."""
    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64")
    grey = F.transform("embedding", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 250 + 100 * v.cast("double")))).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return rows.select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))


IMAGES = """
pixels AS (SELECT vec_id, (i - 1) % 8 AS px, (i - 1) // 8 AS py, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, 250 + 100 * CAST(v AS DOUBLE)))) AS g
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64))"""


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("score"), F.col("quality").alias("truth"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state changes of runs, one run a user."""
    return run_events_of(table(spark, sf_dir, "events"))


def run_events_of(rows: DataFrame) -> DataFrame:
    state = {"signup": "queued", "view": "running", "click": "intake_complete", "purchase": "succeeded", "error": "failed"}
    names = F.create_map(*[F.lit(x) for pair in state.items() for x in pair])
    ms = F.create_map(F.lit("intake"), F.pmod(F.col("event_id"), F.lit(100)).cast("int"), F.lit("layout"), F.pmod(F.col("event_id"), F.lit(37)).cast("int"))
    return rows.select(
        (F.col("user_id") % 5).cast("string").alias("workspace_id"), F.col("user_id").cast("string").alias("parse_run_id"), F.col("event_id"),
        F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("queued")).alias("state"), "ts", F.col("value").alias("cost_credits"), ms.alias("agent_timings_ms"),
    )


EVENTS = """
run_events AS (SELECT CAST(user_id % 5 AS VARCHAR) AS workspace_id, CAST(user_id AS VARCHAR) AS parse_run_id, event_id, CASE event_type WHEN 'view' THEN 'running'
  WHEN 'click' THEN 'intake_complete' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS state, ts, value AS cost_credits,
  event_id % 100 AS intake_ms, event_id % 37 AS layout_ms FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a document, in a state that its id gives."""
    d = F.col("doc_id")
    names = F.array(*map(F.lit, ("queued", "running", "intake_complete", "succeeded", "failed")))
    return table(spark, sf_dir, "documents").select(
        (d % 5).cast("string").alias("workspace_id"), d.cast("string").alias("document_id"), d.cast("string").alias("parse_run_id"),
        F.get(names, (d % 7 % 5).cast("int")).alias("status"), F.lit(None).cast("int").alias("page_count"),
        F.create_map(F.lit("intake"), (d % 11).cast("int"), F.lit("verify"), (d % 13).cast("int")).alias("agent_timings_ms"), F.col("text").alias("error"),
    )


RUNS = """
runs AS (SELECT CAST(doc_id % 5 AS VARCHAR) AS workspace_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) AS parse_run_id,
  list_extract(['queued', 'running', 'intake_complete', 'succeeded', 'failed'], CAST(doc_id % 7 % 5 AS INT) + 1) AS status, doc_id, text FROM documents)"""


def ranked(blocks: DataFrame) -> DataFrame:
    """Blocks with reading_order_rank by page and ord, for queries that need any rank."""
    order = Window.partitionBy("parse_run_id").orderBy("page", "ord")
    return blocks.withColumn("reading_order_rank", F.row_number().over(order) - 1)
