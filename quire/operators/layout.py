"""Spans to regions: grouping fold, detector regions, types, routes and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from .folds import fold
from .spatial import overlapping

RUN = ["workspace_id", "document_id", "parse_run_id"]


def group_spans(spans: DataFrame, gap_y: float = 0.035, gap_x: float = 0.08) -> DataFrame:
    """``spans`` with ``region``, counted from 0 on each page.

    In order of y, x and ord, a span joins the current group if its top is within ``gap_y`` of the
    group's bottom and its left within ``gap_x`` of the group's left; the group's box is the running
    union, clamped to the page.
    """

    def step(state, row):
        b = row["bbox"]
        if state is not None:
            region, left, bottom = state
            if abs(b["y"] - bottom) < gap_y and abs(b["x"] - left) < gap_x:
                return (region, min(left, max(0.0, b["x"])), max(bottom, min(1.0, b["y"] + b["h"]))), region
            region += 1
        else:
            region = 0
        return (region, max(0.0, b["x"]), min(1.0, b["y"] + b["h"])), region

    rows = spans.withColumn("__y", F.col("bbox.y")).withColumn("__x", F.col("bbox.x"))
    return fold(rows, [*RUN, "page"], ["__y", "__x", "ord"], ["bbox"], "region", step).drop("__y", "__x")


def regions(grouped: DataFrame, source_type: str = "native") -> DataFrame:
    """One row per region of ``group_spans``: box, text, size, type, route, confidence, block_id."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "ord", "text", "bbox")))
    b = F.col("bbox")
    out = grouped.groupBy(*RUN, "page", "region").agg(
        F.min(b.x).alias("x1"), F.min(b.y).alias("y1"), F.max(b.x + b.w).alias("x2"), F.max(b.y + b.h).alias("y2"),
        F.avg("size").alias("average_size"), F.count("*").alias("n_spans"),
        F.max((~text.is_blank(F.col("text"))).cast("int")).alias("has_text"), lines.alias("lines"),
    )
    joined = text.stripped(F.array_join(F.transform("lines", lambda s: s.text), " "))
    union = boxes.from_corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    out = out.withColumn("text", joined).withColumn("union_box", union)
    out = out.withColumn("bbox", boxes.padded(F.col("union_box")))
    out = out.withColumn("type", text.region_type(F.col("text"), F.col("average_size"), F.col("bbox.y")))
    route = text.route(F.col("type"), F.col("bbox.w"), F.col("n_spans") > 0, F.lit(source_type))
    block_id = F.concat(F.lit("blk_p"), F.col("page"), F.lit("_"), F.col("type"), F.lit("_"), F.col("region"))
    return out.select(
        *RUN, "page", F.col("region").alias("ord"), block_id.alias("block_id"), "type", "bbox", "text", "average_size",
        "n_spans", route.alias("route"), layout_confidence(F.col("n_spans"), F.col("has_text") == 1).alias("layout_confidence"),
        F.array_sort(F.transform("lines", lambda s: F.struct(s.y, s.x, s.ord, s.text, s.bbox))).alias("spans"),
    )


def layout_confidence(n_spans: Column, has_text: Column) -> Column:
    return F.when(n_spans <= 0, 0.45).when(has_text, 0.88).otherwise(0.55)


def detector_regions(detected: DataFrame) -> DataFrame:
    """Rows of an outside detector with page box, block type and confidence; rows without extent go."""
    b = boxes.detector_box(*map(F.col, ("left", "top", "right", "bottom", "image_w", "image_h")))
    confidence = F.coalesce(boxes.clamp01(F.col("confidence")), F.lit(0.85))
    return (
        detected.withColumn("bbox", b)
        .filter("bbox is not null")
        .withColumn("type", text.block_type_of_label(F.col("label")))
        .withColumn("layout_confidence", confidence)
    )


def spans_in_regions(spans: DataFrame, detected: DataFrame, least_iou: float = 0.01) -> DataFrame:
    """Detector regions (parse_run_id, page, ord) with the spans that overlap them, in span order.

    Boxes meet by page and grid cell (``spatial.overlapping``); regions without spans stay with an
    empty array.
    """
    s = spans.select("parse_run_id", "page", F.col("ord").alias("span_ord"), "text", F.col("bbox").alias("span_box"))
    pair = overlapping(s, detected.select("parse_run_id", "page", "ord", "bbox"), ["parse_run_id", "page"], "span_box", "bbox")
    pair = pair.filter(boxes.iou(F.col("span_box"), F.col("bbox")) > least_iou)
    found = pair.groupBy("parse_run_id", "page", "ord").agg(
        F.array_sort(F.collect_list(F.struct("span_ord", "text"))).alias("spans")
    )
    none = F.array().cast("array<struct<span_ord:int,text:string>>")
    return detected.join(found, ["parse_run_id", "page", "ord"], "left").withColumn("spans", F.coalesce("spans", none))
