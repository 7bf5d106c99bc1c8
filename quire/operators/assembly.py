"""Reading order, paragraph merging and table stitching of a run's blocks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from ..functions import boxes, text
from .folds import fold
from .layout import RUN
from .successors import by_group, followers, topological


def edge_weight(left: Column, right: Column, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3) -> Column:
    """Cost of reading ``right`` after ``left`` (structs with bbox, text, col)."""
    a, b = left.bbox, right.bbox
    dx = (b.x + (b.x + b.w)) / 2 - (a.x + (a.x + a.w)) / 2
    dy = (b.y + (b.y + b.h)) / 2 - (a.y + (a.y + a.h)) / 2
    spatial = F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy))
    column = F.when(left.col == right.col, 0.0).otherwise(0.8)
    return alpha * spatial + beta * text.semantic_gap(left.text, right.text) + gamma * column


def may_follow(left: Column, right: Column) -> Column:
    """If ``right`` can come after ``left`` (structs with page, col, bbox)."""
    a, b = left.bbox, right.bbox
    column = (right.col > left.col) & (b.y >= a.y - 0.08)
    line = (b.y > a.y) | ((F.abs(b.y - a.y) < 0.02) & (b.x > a.x))
    return F.when(right.page != left.page, right.page > left.page).when(right.col != left.col, column).otherwise(line)


def stitch_score(
    header_a: Column, header_b: Column, widths_a: Column, widths_b: Column, continuation: Column, caption: Column,
    alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.2, delta: float = 0.1,
) -> Column:
    """How well a table continues another: equal headers, like columns, running text, a caption cue."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    gap = total(F.zip_with(widths_a, widths_b, lambda x, y: F.abs(x - y))) / F.greatest(total(widths_a), F.lit(1.0))
    shape = F.when(F.size(widths_a) == F.size(widths_b), 1.0 - F.least(F.lit(1.0), gap)).otherwise(0.0)
    header = F.when(text.stripped(header_a) == text.stripped(header_b), 1.0).otherwise(0.0)
    return alpha * header + beta * shape + gamma * continuation + delta * F.when(caption, 1.0).otherwise(0.0)


def baseline_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``rank_hint`` from 0 by page, column, y, x, then ord."""
    order = Window.partitionBy(*RUN).orderBy("page", boxes.column_hint(F.col("bbox")), F.col("bbox.y"), F.col("bbox.x"), "ord", "block_id")
    return blocks.withColumn("rank_hint", F.row_number().over(order) - 1)


def _followed(blocks: DataFrame, ranked: bool) -> DataFrame:
    """``blocks`` with next_id and weight, or with rank, run by run."""
    near = [StructField("next_id", blocks.schema["block_id"].dataType), StructField("weight", DoubleType())]

    def work(batch: pa.RecordBatch, bounds: list[int]) -> list[pa.Array]:
        box = [pc.fill_null(pc.struct_field(batch.column("bbox"), k).cast(pa.float64()), 0.0).to_pylist() for k in "xywh"]
        page, texts, ids = batch.column("page").to_pylist(), batch.column("text").to_pylist(), batch.column("block_id").to_pylist()
        opened = [(t or "").rstrip().endswith(_OPEN) for t in texts]
        lower = [(t or "").lstrip()[:1].islower() for t in texts]
        next_id, weight, rank = [], [], []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            x, y, w, h = (c[lo:hi] for c in box)
            after, cost = followers(page[lo:hi], x, y, w, h, opened[lo:hi], lower[lo:hi])
            if ranked:
                hint = sorted(range(hi - lo), key=lambda i: (page[lo + i], x[i] + w[i] / 2 > 0.62, y[i], x[i]))  # noqa: B023
                place = [0] * (hi - lo)
                for k, i in enumerate(hint):
                    place[i] = k
                rank += topological(after, place)
            else:
                next_id += [ids[lo + j] if j >= 0 else None for j in after]
                weight += [c if j >= 0 else None for j, c in zip(after, cost, strict=True)]
        return [pa.array(rank, pa.int32())] if ranked else [pa.array(next_id, batch.schema.field("block_id").type), pa.array(weight, pa.float64())]

    return by_group(blocks, RUN, ["page", "ord", "block_id"], [StructField("rank", IntegerType())] if ranked else near, work)


def successors(blocks: DataFrame) -> DataFrame:
    """(run, block_id, next_id, weight): the cheapest block that may follow each, first in input order (page, ord, block_id) on ties.

    Blocks that none may follow are left out. Null texts count as empty, null boxes as points at the page's corner.
    """
    return _followed(blocks, False).filter("next_id is not null").select(*RUN, "block_id", "next_id", "weight")


_OPEN = ("-", ",", ";")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``rank``: topological order of the successor graph, ready blocks by baseline order.

    A cycle anywhere gives the whole run its baseline order. One shuffle by run; a task holds the
    blocks of one document and works in proportion to them, see ``successors``.
    """
    return _followed(blocks, True)


def merge_paragraphs(ranked: DataFrame) -> DataFrame:
    """Merge each broken paragraph with its follower; a merged pair takes no third part.

    Consecutive pairs that could merge form an island; within it every other pair does.
    """
    order = Window.partitionBy(*RUN).orderBy("rank")
    nxt = lambda c: F.lead(c).over(order)
    col = boxes.column_hint(F.col("bbox"))
    joins = (
        (F.col("type") == "paragraph") & (nxt("type") == "paragraph") & (nxt("page") - F.col("page")).isin(0, 1)
        & (col == F.lead(col).over(order)) & (text.semantic_gap(F.col("text"), nxt("text")) == 0.0)
    )
    rows = ranked.withColumn("j", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("breaks", F.sum(F.when(F.col("j"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*RUN, F.coalesce("breaks", F.lit(0))).orderBy("rank")))
    rows = rows.withColumn("takes", F.col("j") & (F.col("i") % 2 == 1))
    more = [nxt(c).alias(f"next_{c}") for c in ("text", "block_id", "citations")]
    rows = rows.select("*", F.lag("takes").over(order).alias("taken"), *more).filter("not coalesce(taken, false)")
    whole = text.stripped(F.concat(F.regexp_replace("text", "-+$", ""), F.lit(" "), F.regexp_replace("next_text", r"(?U)^\s+", "")))
    pick = lambda new, old: F.when(F.col("takes"), new).otherwise(F.col(old))
    rows = rows.withColumn("text", pick(whole, "text"))
    return rows.select(
        *[c for c in ranked.columns if c not in ("text", "html", "children", "citations")], "text",
        pick(F.concat(F.lit("<p>"), text.escaped_html(F.col("text")), F.lit("</p>")), "html").alias("html"),
        pick(F.concat("children", F.array("next_block_id")), "children").alias("children"),
        pick(F.concat("citations", "next_citations"), "citations").alias("citations"),
    )


def stitch_tables(merged: DataFrame, chain: bool = False, least: float = 0.7) -> DataFrame:
    """Join tables that go on on the next page. The joined table keeps its first page, so a third page
    starts anew unless ``chain``."""

    def first_line(t: str) -> str:
        return t.strip().split("\n", 1)[0].strip() if t.strip() else ""

    def step(state, row):
        body, w = row["text"] or "", row["bbox"]["w"]
        if state is not None and row["type"] == "table" and state["type"] == "table" and row["page"] == state["page"] + 1:
            score = 0.4 * (state["header"] == first_line(body)) + 0.3 * (1 - min(1.0, abs(state["w"] - w) / max(state["w"], 1.0)))
            score += 0.2 * (0.8 if body else 0.0) + 0.1 * ("continued" in body.lower())
            if score > least:
                header = state["header"] or first_line(body)
                return state | {"header": header, "page": row["page"] if chain else state["page"]}, state["head"]
        return {"type": row["type"], "page": row["page"], "header": first_line(body), "w": w, "head": row["rank"], "rank": row["rank"]}, row["rank"]

    headed = fold(merged, RUN, ["rank"], ["type", "page", "text", "bbox", "rank"], "head", step)
    parts = F.array_sort(F.collect_list(F.struct("rank", "text", "html", "block_id", "children", "citations")))
    same = [c for c in merged.columns if c not in (*RUN, "rank", "text", "html", "children", "citations")]
    out = headed.groupBy(*RUN, "head").agg(parts.alias("p"), *[F.min_by(c, "rank").alias(c) for c in same])
    rest = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    return out.select(
        *RUN, F.col("head").alias("rank"), *same,
        F.when(F.size("p") > 1, text.stripped(F.array_join(F.transform("p", lambda x: x.text), "\n"))).otherwise(F.get("p", F.lit(0)).text).alias("text"),
        F.array_join(F.transform("p", lambda x: x.html), "").alias("html"),
        F.concat(F.get("p", F.lit(0)).children, F.transform(rest, lambda x: x.block_id)).alias("children"),
        F.flatten(F.transform("p", lambda x: x.citations)).alias("citations"),
    )


def assemble(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order, merged and stitched, with reading_order_rank from 0."""
    done = stitch_tables(merge_paragraphs(reading_order(blocks)))
    order = Window.partitionBy(*RUN).orderBy("rank")
    return done.withColumn("reading_order_rank", F.row_number().over(order) - 1).drop("rank")
