"""Regions to blocks: text and confidence by route, verification, citations, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, markup, text
from .layout import RUN
from .spatial import overlapping


def outcome(route: Column, kind: Column, body: Column, has_spans: Column) -> list[Column]:
    """engine, raw confidence, html and needs_review for a region's native text, apart: what a query doesn't read isn't made."""
    paragraph = F.concat(F.lit("<p>"), text.escaped_html(body), F.lit("</p>"))
    plain = F.when(has_spans, F.lit("native_pdf_anchor")).otherwise("paddleocr_unavailable")
    table = F.when(kind == "table", markup.one_row_table(body)).otherwise(
        F.concat(F.lit("<div>"), text.escaped_html(body), F.lit("</div>"))
    )
    by = lambda simple, complex_, other: F.when(route == "paddleocr", simple).when(route == "mineru", complex_).otherwise(other)
    return [
        by(plain, F.lit("native_spans_only"), F.lit("olmocr_native_anchor_fallback")).alias("engine"),
        by(F.when(has_spans, 0.96).otherwise(0.20), F.lit(0.25), F.when(body != "", 0.25).otherwise(0.10)).alias("raw"),
        by(paragraph, table, paragraph).alias("html"), by(F.lit(False), F.lit(False), F.lit(True)).alias("needs_review"),
    ]


def blended(raw: Column, layout: Column) -> Column:
    return boxes.clamp01(raw * 0.75 + layout * 0.25)


def citation(page: Column, body: Column, box: Column) -> Column:
    return F.struct(page.alias("page"), F.substring(body, 1, 120).alias("matching_text"), F.array(box).alias("bboxes"))


def blocks(regions: DataFrame) -> DataFrame:
    """Block rows of all routes in one projection (no union, no second scan)."""
    known = [c for c in regions.columns if c not in ("engine", "raw", "html", "needs_review")]
    out = regions.select(*known, *outcome(F.col("route"), F.col("type"), F.col("text"), F.col("n_spans") > 0))
    score = blended(F.col("raw"), F.col("layout_confidence"))
    return out.select(
        *RUN, "page", "ord", "block_id", "type", "bbox", "text", "html", "route",
        "engine", F.struct("raw", score.alias("calibrated")).alias("confidence"),
        "layout_confidence", F.array().cast("array<string>").alias("children"),
        F.array(citation(F.col("page"), F.col("text"), F.col("bbox"))).alias("citations"), "needs_review",
    )


def ocr_regions(lines: DataFrame) -> DataFrame:
    """Recognised lines (polygon, text, confidence) to one region row each; blank regions go."""
    xs, ys = F.transform("polygon", lambda p: p.x), F.transform("polygon", lambda p: p.y)
    span = lambda v, size: boxes.clamp01((F.array_max(v) - F.array_min(v)) / size)
    b = F.struct(
        boxes.clamp01(F.array_min(xs) / F.col("image_w")).alias("x"), boxes.clamp01(F.array_min(ys) / F.col("image_h")).alias("y"),
        span(xs, F.col("image_w")).alias("w"), span(ys, F.col("image_h")).alias("h"),
    )
    rows = lines.withColumn("b", b).groupBy("parse_run_id", "block_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "text", F.round("confidence", 4).alias("confidence"), "b"))).alias("words"),
        F.round(F.avg(F.col("confidence").cast("decimal(18,10)")), 4).cast("double").alias("confidence"),  # decimals: the same in any order
    )
    body = text.stripped(F.array_join(F.transform("words", lambda w: w.text), " "))
    rows = rows.withColumn("text", body).filter("text <> ''")
    return rows.withColumn("html", F.concat(F.lit("<p>"), text.escaped_html(F.col("text")), F.lit("</p>")))


def verified(
    metrics: DataFrame, alpha: float = 0.35, beta: float = 0.25, gamma: float = 0.25, delta: float = 0.15, flag_over: float = 0.15
) -> DataFrame:
    """``metrics`` with ``verifier``: score, loss, flag and components from columns that models supply.

    Needs ssim, cer, layout_iou, clip_sim and is_degraded. A missing cer counts as 0 and a missing
    clip_sim as 1, marked by ``component_missing``; degraded renders score .5 and are flagged.
    """
    cer, clip = F.coalesce("cer", F.lit(0.0)), F.coalesce("clip_sim", F.lit(1.0))
    loss = alpha * (1 - F.col("ssim")) + beta * cer + gamma * (1 - F.col("layout_iou")) + delta * (1 - clip)
    bad = F.coalesce("is_degraded", F.lit(False))
    part = lambda x: F.when(bad, 0.0).otherwise(F.round(x, 4))
    verifier = F.struct(
        F.when(bad, 0.5).otherwise(F.round(boxes.clamp01(1 - loss), 4)).alias("score"),
        F.when(bad, 0.5).otherwise(F.round(loss, 4)).alias("L_verify"),
        (bad | (loss > flag_over)).alias("flag_for_repair"),
        F.struct(
            part(F.col("ssim")).alias("ssim"), part(1 - cer).alias("ocr_consistency"),
            part(F.col("layout_iou")).alias("layout_iou"), part(clip).alias("clip_sim"),
        ).alias("components"),
        (F.col("cer").isNull() | F.col("clip_sim").isNull()).alias("component_missing"),
    )
    return metrics.withColumn("verifier", verifier)


def review_actions(blocks: DataFrame) -> DataFrame:
    """One action row for each block that needs review."""
    payload = F.struct("page", "type", F.substring("text", 1, 120).alias("text"), "confidence")
    return blocks.filter("needs_review").select(
        "workspace_id", "parse_run_id", "block_id", F.lit("verifier").alias("actor_id"), F.lit("needs_review").alias("action"), payload.alias("payload")
    )


def corrected(blocks: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks with review closed where corrected, appended actions, corrections without a block).

    The corrected text and box stay in the action; the block itself isn't changed by them.
    """
    keys = ["workspace_id", "parse_run_id", "block_id"]
    done = corrections.select(*keys).distinct().withColumn("done", F.lit(True))
    out = blocks.join(done, keys, "left")
    out = out.withColumn("needs_review", F.when(F.col("done"), False).otherwise(F.col("needs_review"))).drop("done")
    known = corrections.join(blocks.select(*keys).distinct(), keys, "left_semi")
    return out, known, corrections.join(blocks.select(*keys), keys, "left_anti")


def citation_rows(blocks: DataFrame) -> DataFrame:
    """One row per block citation."""
    rows = blocks.select("workspace_id", "parse_run_id", "block_id", F.explode("citations").alias("c"))
    return rows.select("workspace_id", "parse_run_id", "block_id", F.lit(None).cast("string").alias("field_name"), "c.*")


def all_citations(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """Block citations and those of ``fields`` (workspace_id, parse_run_id, field_name, block_id, citations) in one table.

    Private fields (``_``) are left out; fields without citations give no row.
    """
    public = fields.filter(~F.startswith("field_name", F.lit("_")))
    rows = public.select("workspace_id", "parse_run_id", "block_id", "field_name", F.explode("citations").alias("c"))
    return citation_rows(blocks).unionByName(rows.select("workspace_id", "parse_run_id", "block_id", "field_name", "c.*"))


def source_block(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each citation (parse_run_id, citation_id, page, bbox) with the block of its page that it overlaps most.

    Without any overlap that is the page's first block; pages without blocks give null.
    """
    keys = ["parse_run_id", "page"]
    b = blocks.select(*keys, "block_id", "ord", F.col("bbox").alias("block_box"))
    pairs = overlapping(citations.select(*keys, "citation_id", "bbox"), b, keys, "bbox", "block_box")
    rank = F.struct(boxes.overlap_area(F.col("block_box"), F.col("bbox")).alias("shared"), (-F.col("ord")).alias("first"))
    best = pairs.groupBy(*keys, "citation_id").agg(F.max_by("block_id", rank).alias("best_id"), F.max(rank.shared).alias("best"))
    first = b.groupBy(*keys).agg(F.min_by("block_id", F.struct("ord", "block_id")).alias("first_id"))
    rows = citations.select(*keys, "citation_id").distinct().join(best, [*keys, "citation_id"], "left").join(first, keys, "left")
    return rows.select("parse_run_id", "citation_id", "page", F.coalesce("best_id", "first_id").alias("block_id"), F.coalesce("best", F.lit(0.0)).alias("shared"))
