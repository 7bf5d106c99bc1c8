"""Page chunks, point ids, late interaction and fused ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from .late import max_sim

# Fixed value: the namespace of page point ids.
POINT_NAMESPACE = "7f3a2b1c-4d5e-6f70-8a9b-0c1d2e3f4a5b"


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of a name, equal to the standard library's."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1
    nibble = F.element_at(F.array(*map(F.lit, "89ab")), variant)
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), nibble, cut(18, 3), F.lit("-"), cut(21, 12))


def page_chunks(blocks: DataFrame) -> DataFrame:
    """One row per page: texts joined by line feeds (blank ones too), block ids, box, point id."""
    b = F.col("bbox")
    listed = F.array_sort(F.collect_list(F.struct("ord", "block_id", "text")))
    rows = blocks.groupBy("workspace_id", "document_id", "parse_run_id", "page").agg(
        listed.alias("b"), F.min(b.x).alias("x1"), F.min(b.y).alias("y1"), F.max(b.x + b.w).alias("x2"), F.max(b.y + b.h).alias("y2")
    )
    x1, y1 = F.least(F.lit(1.0), F.col("x1")), F.least(F.lit(1.0), F.col("y1"))
    x2, y2 = F.greatest(F.lit(0.0), F.col("x2")), F.greatest(F.lit(0.0), F.col("y2"))
    whole = F.when((x2 > x1) & (y2 > y1), boxes.box(x1, y1, x2 - x1, y2 - y1)).otherwise(boxes.FULL_PAGE())
    return rows.select(
        "workspace_id", "document_id", "parse_run_id", "page",
        F.array_join(F.transform("b", lambda x: F.coalesce(x.text, F.lit(""))), "\n").alias("text"),
        F.transform("b", lambda x: x.block_id).alias("block_ids"), whole.alias("bbox"),
        uuid5(F.concat_ws(":", "document_id", "page")).alias("vector_ref"),
    )


def normalised(v: Column) -> Column:
    """A vector by its length; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def sign_quantised(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def top_hits(scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best (1 to 50) points of each query, ties to the smaller point_id."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(pages: DataFrame, queries: DataFrame, workspace: Column, k: int = 5) -> DataFrame:
    """Hits within a workspace, with payload, full-page box and render path."""
    mine = pages.filter(F.col("workspace_id") == workspace)
    hits = top_hits(max_sim(mine, queries, k), k).join(mine.drop("patches"), "point_id")
    path = F.concat_ws("/", F.lit(""), "workspace_id", "document_id", F.lit("renders"), F.concat("page", F.lit(".png")))
    return hits.withColumn("bbox", boxes.FULL_PAGE()).withColumn("render_path", path)


def hybrid(dense: Column, sparse: Column, visual: Column, meta: Column, rerank: Column, weights=(0.30, 0.20, 0.30, 0.10, 0.10)) -> Column:
    a, b, c, d, e = weights
    return a * dense + b * sparse + c * visual + d * meta + e * rerank


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score) of rankings (query_id, ranking_id, doc_id, rank from 1)."""
    return rankings.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def upserted(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def sync_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection_id").agg(F.countDistinct("parse_run_id").alias("queued_documents"), F.count("*").alias("pages_indexed"))
