"""Packets of pages: page texts, term vectors, splitting and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .folds import fold
from .sizes import broadcast_if_small

KEY = ["parse_run_id"]
PAGE = ["parse_run_id", "page"]


def page_text(blocks: DataFrame, joiner: str = " ") -> DataFrame:
    """Stripped texts that aren't blank, joined by page in block order; pages without text have no row."""
    rows = blocks.withColumn("t", text.stripped(F.col("text"))).filter("t <> ''")
    parts = F.array_sort(F.collect_list(F.struct("reading_order_rank", "ord", "t")))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p.t), joiner).alias("text"))


def _raw_weights(pages: DataFrame, stop: list[str], most_chars: int | None) -> DataFrame:
    """(parse_run_id, page, term, v): TF-IDF before scaling, dealt out by run.

    Page texts are shuffled by run, once, and their terms, many times as many bytes, not at all: the counts
    by run, page and term are aggregations and windows within a run's rows, in sorts that can spill.
    """
    own = pages.select(*PAGE, "text").repartition(*KEY).withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
    own = own.select(*PAGE, "n", F.explode(text.terms(F.col("text"), stop, most_chars)).alias("term"))
    tf = own.groupBy(*PAGE, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = tf.withColumn("df", F.count("*").over(Window.partitionBy(*KEY, "term")))
    return df.select(*PAGE, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))


def term_weights(pages: DataFrame, stop: list[str] = text.STOP_WORDS, most_chars: int | None = None) -> DataFrame:
    """(parse_run_id, page, term, weight): TF-IDF of each run's pages, unit length, in sparse rows dealt out by run.

    Whole texts are read, unless ``most_chars`` says how much of each.
    """
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*PAGE)))
    return _raw_weights(pages, stop, most_chars).select(*PAGE, "term", (F.col("v") / norm).alias("weight"))


def adjacent_similarity(pages: DataFrame, weights: DataFrame) -> DataFrame:
    """(parse_run_id, page, before, similarity): each page but a run's first with the page before it.

    A term's row meets the one of the page before as its neighbour among the run's rows of that term.
    """
    steps = pages.select(*PAGE, F.lag("page").over(Window.partitionBy(*KEY).orderBy("page")).alias("before")).filter("before is not null")
    order = Window.partitionBy(*KEY, "term").orderBy("page")
    rows = weights.select(*PAGE, F.lag("page").over(order).alias("before"), (F.col("weight") * F.lag("weight").over(order)).alias("p"))
    dot = rows.filter("before is not null").groupBy(*PAGE, "before").agg(F.sum("p").alias("dot"))
    return steps.join(dot, [*PAGE, "before"], "left").select(*PAGE, "before", F.coalesce("dot", F.lit(0.0)).alias("similarity"))


def dense_similarity(pages: DataFrame) -> DataFrame:
    """The same from an embedding column of unit vectors."""
    order = Window.partitionBy(*KEY).orderBy("page")
    rows = pages.select(*PAGE, F.lag("page").over(order).alias("before"), "embedding", F.lag("embedding").over(order).alias("e0"))
    return rows.filter("before is not null").select(*PAGE, "before", dot(F.col("embedding"), F.col("e0")).alias("similarity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def heading_pages(blocks: DataFrame) -> DataFrame:
    """Pages after the first number that have a heading block or a text that starts like one."""
    low = text.stripped(F.lower("text"))
    starts = F.greatest(*[F.startswith(low, F.lit(w)) for w in ("section", "exhibit", "appendix", "schedule")])
    head = F.lower("type").isin("heading", "header") | starts
    return blocks.filter((F.col("page") > 0) & F.coalesce(head, F.lit(False))).select(*PAGE).distinct()


def boundaries(
    pages: DataFrame, similarity: DataFrame, headings: DataFrame, split_under: float = 0.35, heading_under: float = 0.55, min_pages: int = 1
) -> DataFrame:
    """(parse_run_id, page): where segments start.

    First pass: pages less like the one before than ``split_under``, at least ``min_pages`` after the
    last boundary. Second pass: heading pages under ``heading_under``, in page order, measured from
    the last boundary added so far (so they only come behind all of the first pass).
    """
    rows = pages.select(*PAGE).join(similarity.select(*PAGE, "similarity"), PAGE, "left")
    rows = rows.join(headings.withColumn("heading", F.lit(True)), PAGE, "left")

    def first(state, row):
        if state is None:
            return row["page"], 1
        if row["similarity"] is not None and row["similarity"] < split_under and row["page"] - state >= min_pages:
            return row["page"], 1
        return state, 0

    marked = fold(rows, KEY, ["page"], ["page", "similarity"], "cut", first)
    last = marked.filter("cut = 1").groupBy(*KEY).agg(F.max("page").alias("last"))
    marked = marked.join(last, KEY)

    def second(state, row):
        state = row["last"] if state is None else state
        like = row["similarity"]
        if row["cut"]:
            return state, 1
        if row["heading"] and like is not None and like < heading_under and row["page"] - state >= min_pages:
            return row["page"], 1
        return state, 0

    done = fold(marked, KEY, ["page"], ["page", "similarity", "heading", "cut", "last"], "bound", second)
    return done.filter("bound = 1").select(*PAGE)


def segments(pages: DataFrame, similarity: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per segment: first and last page, page_count, share of pages, label, confidence, evidence.

    The page count includes page numbers without text. Runs of one page score .8. A label is told by whole texts: a page
    is read on into the pages behind it as far as words that begin on it can reach, so no segment's text is put together.
    """
    order = Window.partitionBy(*KEY).orderBy("page")
    rows = pages.join(starts.withColumn("start", F.lit(1)), PAGE, "left").join(similarity.select(*PAGE, "similarity"), PAGE, "left")
    rows = rows.withColumn("segment", F.sum(F.coalesce("start", F.lit(0))).over(order))
    rows = rows.withColumn("inner", F.when(F.col("start").isNull(), F.col("similarity")))
    longest = max(len(m) for _, marks in text.SEGMENT_LABELS for m in marks)
    behind = Window.partitionBy(*KEY, "segment").orderBy("page").rowsBetween(1, longest)
    ahead = F.array_join(F.collect_list(F.substring("text", 1, longest)).over(behind), " ")
    rows = rows.withColumn("label", text.segment_label_number(F.concat_ws(" ", "text", F.substring(ahead, 1, longest))))
    out = rows.groupBy(*KEY, "segment").agg(
        F.min("page").alias("start_page"), F.max("page").alias("last_text_page"), F.avg("inner").alias("mean"), F.count("*").alias("n"),
        F.min("label").alias("label"),
    )
    by_run = Window.partitionBy(*KEY)
    nxt = F.lead("start_page").over(by_run.orderBy("segment"))
    out = out.withColumn("end_page", F.coalesce(nxt - 1, F.col("last_text_page"))).withColumn("pages", F.sum("n").over(by_run))
    single = F.col("pages") == 1
    coherence = F.when(single, 0.8).when(F.col("n") == 1, 1.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean"))), 4))
    count = F.col("end_page") - F.col("start_page") + 1
    return out.select(
        *KEY, "start_page", "end_page", count.alias("page_count"), text.segment_label_name(F.col("label")).alias("label"), coherence.alias("confidence"),
        F.when(single, "single page").otherwise(F.format_string("tfidf semantic coherence=%.3f", coherence)).alias("evidence"),
        (count / (F.max("end_page").over(by_run) + 1)).alias("share"),
    )


def empty_run_segments(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs without any page text: one segment with score .5."""
    rest = runs.select(*KEY).distinct().join(pages.select(*KEY), KEY, "left_anti")
    return rest.selectExpr("parse_run_id", "0 as start_page", "0 as end_page", "1 as page_count", "'document' as label", "0.5D as confidence", "'no parse blocks' as evidence", "1.0D as share")


#: Categories of a taxonomy at most: they are a parameter and are read on the driver.
MOST_CATEGORIES = 1_000


def categories_of(rows: DataFrame) -> list[tuple[str, str]]:
    """(label, description) of a table of categories (ord, label, description), in order."""
    found = taxonomy(rows).orderBy("ord").limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"a taxonomy has {MOST_CATEGORIES} categories at most")
    return [(r.label, r.description) for r in found]


def taxonomy(rows: DataFrame) -> DataFrame:
    """(ord, label, description): blank labels go, a missing description is the label."""
    label = text.stripped(F.col("label"))
    described = F.nullif(text.stripped(F.coalesce("description", "label")), F.lit(""))
    return rows.filter(label != "").select("ord", label.alias("label"), F.coalesce(described, label).alias("description"))


def category_rows(categories: list[tuple[str, str]]) -> Column:
    """Categories (label, description) as an array column to explode: a parameter, few and bounded."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("label"), F.lit(b or a).alias("description")) for i, (a, b) in enumerate(categories)])


def lexical_scores(pages: DataFrame, categories: list[tuple[str, str]], stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """(parse_run_id, page, ord, label, score): TF-IDF cosine of pages and categories plus keyword boost.

    Each run's corpus is its pages and all categories, which stand as pages with numbers under 0.
    A term's row gets the weights of the run's categories with that term, at most one a category, by a window.
    """
    cats = category_rows(categories)
    of_run = pages.select(*KEY).distinct().select(*KEY, F.inline(cats))
    kind = pages.schema["page"].dataType
    added = of_run.select(*KEY, (-1 - F.col("ord")).cast(kind).alias("page"), F.concat_ws(" ", "label", "description").alias("text"))
    weights = term_weights(pages.select(*PAGE, "text").unionByName(added), stop)
    told = F.collect_list(F.when(F.col("page") < 0, F.struct((-1 - F.col("page")).cast("int").alias("ord"), F.col("weight").alias("w0"))))
    near = weights.withColumn("cats", told.over(Window.partitionBy(*KEY, "term"))).filter("page >= 0 and size(cats) > 0")
    near = near.select(*PAGE, "weight", F.inline("cats")).groupBy(*PAGE, "ord").agg(F.sum(F.col("weight") * F.col("w0")).alias("dot"))
    pair = pages.select(*PAGE, F.lower("text").alias("t"), F.inline(cats))
    pair = pair.select(*PAGE, "ord", "label", keyword_boost(F.col("t"), F.col("label"), F.col("description")).alias("boost"))
    return pair.join(near, [*PAGE, "ord"], "left").select(*PAGE, "ord", "label", (F.coalesce("dot", F.lit(0.0)) + F.col("boost")).alias("score"))


def keyword_boost(page: Column, label: Column, description: Column) -> Column:
    """.35 for the label in the text, .08 up to .3 for description words over four letters and known words."""
    words = F.array_distinct(F.filter(F.split(F.lower(description), r"(?U)\s+"), lambda w: F.length(w) > 4))
    known = F.create_map(*[x for k, v in text.CATEGORY_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.coalesce(F.try_element_at(known, F.lower(label)), F.array().cast("array<string>"))

    def boost(low: Column) -> Column:
        hits = F.size(F.filter(F.concat(words, extra), lambda w: F.contains(low, w)))
        return F.when(F.contains(low, F.lower(label)), 0.35).otherwise(0.0) + F.least(F.lit(0.3), 0.08 * hits)

    return F.get(F.transform(F.array(F.lower(page)), boost), F.lit(0))  # in lower case once a page, not once a word


def decide(scores: DataFrame, threshold: float) -> DataFrame:
    """One row per page: best label (first wins) or uncertain, confidence, score map, alternatives."""
    rows = scores.groupBy(*PAGE).agg(
        F.max_by(F.struct("label", "score"), F.struct("score", -F.col("ord"))).alias("best"),
        F.array_sort(F.collect_list(F.struct("ord", "label", F.round("score", 4).alias("score")))).alias("all"),
    )
    label = F.when(F.col("best.score") >= threshold, F.col("best.label")).otherwise("uncertain")
    ranked = F.array_sort(F.transform("all", lambda x: F.struct((-x.score).alias("s"), x.ord, x.label)))
    return rows.select(
        *PAGE, label.alias("label"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("best.score"))), 4).alias("confidence"),
        F.map_from_entries(F.transform("all", lambda x: F.struct(x.label, x.score))).alias("scores"),
        F.transform(ranked, lambda x: x.label).alias("alternatives"),
    )


def dense_scores(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """Scores from unit vectors of pages and of the categories (ord, label) of each page's taxonomy_id."""
    cats = categories.select("taxonomy_id", "ord", "label", F.col("embedding").alias("c"))
    return pages.join(broadcast_if_small(cats), "taxonomy_id").select(*PAGE, "ord", "label", dot(F.col("embedding"), F.col("c")).alias("score"))


def run_level(decided: DataFrame) -> DataFrame:
    """One row per run: page to label, and ``page:label`` to score."""
    scores = F.flatten(F.collect_list(F.transform(F.map_entries("scores"), lambda e: F.struct(F.concat_ws(":", "page", e.key).alias("k"), e.value.alias("v")))))
    labels = F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "label"))))
    return decided.groupBy(*KEY).agg(labels.alias("page_labels"), F.map_from_entries(F.array_sort(scores)).alias("scores"))
