"""Page texts are read whole: what stands behind the first 2048 signs counts like what stands before."""

import pytest
from pyspark.sql import functions as F

from quire.operators import packets
from quire.plans import jobs

#: Words without a meaning for any rule, and stop words, which no vector holds.
LONG, SILENT = "lorem ipsum " * 300, "the of and " * 300


def blocks(spark, pages):
    rows = [("p", n, 0, "paragraph", n, t) for n, t in pages]
    return spark.createDataFrame(rows, "parse_run_id string, page int, ord int, type string, reading_order_rank int, text string")


def pages_of(spark, pages):
    return spark.createDataFrame([("p", n, t) for n, t in pages], "parse_run_id string, page int, text string")


def similarity(spark, *texts):
    pages = pages_of(spark, enumerate(texts))
    return packets.adjacent_similarity(pages, packets.term_weights(pages))


def test_category_scores(spark):
    """f18: words and the label behind the beginning."""
    cats = [("invoice", "bill with total amount due"), ("letter", "dear sirs")]
    got = {r.label: r.score for r in packets.lexical_scores(pages_of(spark, [(0, SILENT + "invoice total amount")]), cats).collect()}
    short = {r.label: r.score for r in packets.lexical_scores(pages_of(spark, [(0, "invoice total amount")]), cats).collect()}
    assert got == pytest.approx(short) and got["invoice"] > 0.5 and got["letter"] == 0


def test_classified_pages_and_run_labels(spark):
    """j05 and f29: the label that only the end of a page tells."""
    cats = spark.createDataFrame([(0, "invoice", "bill amount due payment"), (1, "contract", "agreement party")], "ord int, label string, description string")
    done = jobs.classify_pages(blocks(spark, [(0, LONG + "contract agreement party"), (1, "invoice amount due")]), cats)
    assert {r.page: r.label for r in done.collect()} == {0: "contract", 1: "invoice"}
    assert packets.run_level(done).first().page_labels == {0: "contract", 1: "invoice"}


def test_adjacent_similarity(spark):
    """w10: pages that are alike, or differ, behind the beginning only."""
    assert similarity(spark, SILENT + "red stone", SILENT + "red stone").first().similarity == pytest.approx(1)
    other = similarity(spark, LONG + "red " * 2000, LONG + "blue " * 2000).first().similarity
    assert other < 0.3


def test_split_boundaries(spark):
    """w11: a page is cut off where only its end differs from the page before."""
    rows = blocks(spark, [(0, LONG + "red " * 2000), (1, LONG + "blue " * 2000)])
    pages = packets.page_text(rows)
    starts = packets.boundaries(pages, packets.adjacent_similarity(pages, packets.term_weights(pages)), packets.heading_pages(rows))
    assert sorted(r.page for r in starts.collect()) == [0, 1]


def test_segments(spark):
    """w12: the same for segments, and labels that words far behind tell, over the ends of pages too."""
    got = jobs.split_packets(blocks(spark, [(0, LONG + "red " * 2000), (1, LONG + "blue " * 2000 + "whereas")])).orderBy("start_page").collect()
    assert [(r.start_page, r.label) for r in got] == [(0, "document"), (1, "contract")]
    for texts, label in (
        ([LONG, LONG + "terms", "and", "conditions " + LONG], "contract"), ([LONG + "whereas", LONG + "Bill", "to " + LONG], "invoice"),
        ([LONG, LONG, LONG + "amount"], "document"),
    ):
        pages = pages_of(spark, enumerate(texts))
        like = pages.filter("page > 0").select("parse_run_id", "page", F.lit(0.9).alias("similarity"))
        found = packets.segments(pages, like, pages.filter("page = 0").select("parse_run_id", "page")).collect()
        assert [(r.start_page, r.end_page, r.label) for r in found] == [(0, len(texts) - 1, label)]
