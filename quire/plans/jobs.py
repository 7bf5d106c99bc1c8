"""Corpus parse, extraction, splitting, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text
from ..operators import assembly, extraction, layout, packets, parse


def corpus_blocks(spans: DataFrame) -> DataFrame:
    """Spans to blocks: group into regions, type, route, read and score them."""
    return parse.blocks(layout.regions(layout.group_spans(spans)))


def corpus_parse(spans: DataFrame) -> DataFrame:
    """Spans to blocks in reading order, merged and stitched."""
    return assembly.assemble(corpus_blocks(spans))


def split_packets(blocks: DataFrame, split_under: float = 0.35, heading_under: float = 0.55, min_pages: int = 1, stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """Blocks of packets to segments."""
    pages = packets.page_text(blocks)
    like = packets.adjacent_similarity(pages, packets.term_weights(pages, stop))
    starts = packets.boundaries(pages, like, packets.heading_pages(blocks), split_under, heading_under, min_pages)
    return packets.segments(pages, like, starts).unionByName(packets.empty_run_segments(blocks, pages))


def category_scores(blocks: DataFrame, categories: DataFrame, stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """Score of every page for every category of a table (ord, label, description)."""
    return packets.lexical_scores(packets.page_text(blocks, "\n"), packets.categories_of(categories), stop)


def classify_pages(blocks: DataFrame, categories: DataFrame, threshold: float = 0.25, stop: list[str] = text.STOP_WORDS) -> DataFrame:
    return packets.decide(category_scores(blocks, categories, stop), min(threshold, 0.15))


def extract_fields(blocks: DataFrame, fields: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, fields to reject for want of a citation); ``runs`` without blocks have only the latter."""
    found = extraction.extract(blocks, fields, runs)
    return found, extraction.without_citations(found)
