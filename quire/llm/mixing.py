"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates are exponentially tilted by size, the tilts come from distributed Newton iterations on
the convex dual, and rates are rounded into copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Larger tables of sources are joined instead of broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_counts(sizes: DataFrame) -> DataFrame:
    """(source, size, c): how many rows of ``sizes`` (source, size) have a size; a table of such rows stays as it is."""
    return sizes if "c" in sizes.columns else sizes.groupBy("source", "size").agg(F.count("*").alias("c"))


def _small(sources: DataFrame) -> DataFrame:
    """A table of one row a source, to be broadcast if it is small, so that a hot source isn't one task."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    budget: float | None = None,
) -> DataFrame:
    """One row per source: size, target words, number of documents.

    ``sizes`` has ``source`` and ``size``. Sources ordered by code point, null last, take the
    ``weights`` in turn and share ``budget`` words (all words by default); a target stops at
    ``max_copies`` times its source's size and the excess is shared again by weight. That fixed
    point is "level times weight, at most the cap"; the level comes from running sums over the
    sources ordered by cap over weight.
    """
    per = size_counts(sizes).groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.sum("c").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    cap = F.col("source_size") * max_copies
    per = per.select("*", weight.alias("w")).withColumn("ratio", cap / F.col("w"))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    ahead, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.sum("source_size").over(everything) if budget is None else F.lit(float(budget))
    level = (total - F.coalesce(F.sum(cap).over(ahead), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    settled = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    per = per.withColumn("level", F.coalesce(settled, F.lit(float("inf"))))
    target = F.least(cap.cast("double"), F.when(cap > 0, F.col("level") * F.col("w")).otherwise(0.0))
    per = per.withColumn("target", target)

    return per.select("source", "source_size", "n", "target")


def balanced(sizes: DataFrame, targets: DataFrame, max_copies: int = 3, tolerance: float = 1e-7, most_rounds: int = 60) -> DataFrame:
    """``targets`` with ``tilt``: a document of ``size`` words has the rate ``least(exp(tilt * size), max_copies)``.

    Entropy balancing: of all rates between 0 and ``max_copies`` whose words add up to each source's
    target, those nearest to 1 in the sum of ``r ln r - r + 1`` over documents. The convex dual has one
    unknown a source, its tilt; gradient (words taken less the target) and curvature are sums over
    documents, taken from the table of distinct sizes. Each round is one distributed aggregation for
    all sources: a Newton step where it stays in the interval that holds the solution, else its middle.
    Rounds end when every source is within ``tolerance`` of its target. A source at its cap or
    without words has no tilt (null).
    """
    hist = size_counts(sizes).filter("size > 0").select(F.col("source").alias("s"), "size", "c")
    hist = hist if "c" in sizes.columns else cut(hist)
    smallest = hist.groupBy("s").agg(F.min("size").alias("least"))
    cap = F.col("source_size") * max_copies
    open_ = targets.filter((F.col("target") > 0) & (F.col("target") < cap * (1 - 1e-12)))
    open_ = open_.join(smallest, F.col("source").eqNullSafe(F.col("s"))).withColumn("edge", F.log(F.col("target") / F.col("source_size")) / F.col("least"))
    state = open_.select(
        F.col("source").alias("of"), "target", F.least("edge", F.lit(0.0)).alias("lo"), F.greatest("edge", F.lit(0.0)).alias("hi"),
        (F.log(F.col("target") / F.col("source_size")) / (F.col("source_size") / F.col("n"))).alias("tilt"), F.lit(1.0).alias("gap"),
    )
    state = cut(state)
    small = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for _ in range(most_rounds):
        rate = F.exp(F.col("tilt") * F.col("size"))
        words = F.col("c") * F.col("size") * F.least(rate, F.lit(float(max_copies)))
        bend = F.when(rate < max_copies, F.col("c") * F.col("size") * F.col("size") * rate).otherwise(0.0)
        sums = hist.join(F.broadcast(state) if small else state, F.col("s").eqNullSafe(F.col("of"))).groupBy("of", "target", "lo", "hi", "tilt").agg(F.sum(words).alias("words"), F.sum(bend).alias("bend"))
        over = F.col("words") > F.col("target")
        sums = sums.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("tilt"))).withColumn("hi", F.when(over, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.try_divide(F.col("words") - F.col("target"), F.col("bend"))
        inside = (step >= F.col("lo")) & (step <= F.col("hi"))
        gap = F.abs(F.col("words") / F.col("target") - 1)
        tilt = F.when(gap <= tolerance, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(sums.select("of", "target", "lo", "hi", tilt.alias("tilt"), gap.alias("gap")))
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    found = state.select("of", "tilt")
    return targets.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    budget: float | None = None,
    chunk_rows: int = 4096,
    fill_rounds: int = 3,
) -> DataFrame:
    """``docs`` with a column ``mix``: struct of size, source_size, target, rate, copies, taken.

    ``docs`` needs doc_id, text and source; other columns pass through, and a column called
    ``mix`` is replaced. A document's size is its number of words, 0 for null or empty texts; a
    null source is a source of its own. ``balanced`` gives the documents' rates. They become copies chunk
    by chunk: a source's rows are dealt by a hash of doc_id and text into chunks of about ``chunk_rows``
    rows, so a source that holds a third of all rows is many tasks. In a chunk, by falling size,
    fractions add up, and where the sum passes a whole number the document gets the copy more. What the chunk still has too few or too many goes to the largest documents
    that fit: in ``fill_rounds`` rounds by one copy up or down to the rate's whole neighbours, then in
    as many between 0 and ``max_copies``; each round at least halves the rest. No sampling and no
    random numbers: reruns agree. Repeated rows are rows like any other. An empty table gives an
    empty result.
    """
    kept = [c for c in docs.columns if c != "mix"]
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("source"), size.alias("size"))
    hist = cut(size_counts(rows.select("source", "size")))  # texts are read twice: here and for the copies
    per = _small(cut(balanced(hist, cut(source_targets(hist, weights, max_copies, budget)), max_copies).withColumnRenamed("source", "per_source")))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("per_source")), "left")
    turn = F.xxhash64(F.col("row.doc_id"), F.col("row.text"))
    tilted = F.round(F.least(F.exp(F.col("tilt") * F.col("size")), F.lit(float(max_copies))), 9)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(max_copies)).otherwise(tilted)
    rows = rows.select(
        "row", "source", "size", "source_size", "target", rate.alias("rate"), turn.alias("turn"),
        F.pmod(turn, F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_rows))).alias("chunk"),
    )
    order = Window.partitionBy("source", "chunk").orderBy(F.col("size").desc(), "turn", "row.doc_id")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    base = F.floor("rate")
    rows = rows.withColumn("base", base).withColumn("part", F.col("rate") - base).withColumn("added", F.round(F.sum("part").over(upto), 6))
    before = F.coalesce(F.lag("added").over(order), F.lit(0.0))
    every = lambda shift: (F.floor(F.col("added") + shift) - F.floor(before + shift)).cast("int")
    missing = lambda more: F.sum(F.col("part") * F.col("size")).over(whole) - F.sum(more * F.col("size")).over(whole)
    rows = rows.withColumn("more_0", every(0.0)).withColumn("more_1", every(0.5))
    rows = rows.withColumn("rest_0", missing(F.col("more_0"))).withColumn("rest_1", missing(F.col("more_1")))
    later = F.abs(F.col("rest_1")) < F.abs(F.col("rest_0"))
    rows = rows.withColumn("more", F.when(later, F.col("more_1")).otherwise(F.col("more_0")))
    rows = rows.withColumn("rest", F.when(later, F.col("rest_1")).otherwise(F.col("rest_0"))).drop("rest_0", "rest_1", "more_0", "more_1")
    for k in range(2 * fill_rounds):
        high, low = (F.lit(1), F.lit(0)) if k < fill_rounds else (max_copies - F.col("base"), -F.col("base"))
        gap = F.abs(F.col("rest")) + 0.5
        room = F.when(F.col("rest") > 0, F.col("more") < high).otherwise(F.col("more") > low)
        fits = room & (F.col("size") > 0) & (F.col("size") <= gap)
        rows = rows.withColumn("upto", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(upto))
        rows = rows.withColumn("step", F.when(fits & (F.col("upto") <= gap), F.signum("rest")).otherwise(0).cast("int"))
        rows = rows.withColumn("more", F.col("more") + F.col("step")).withColumn(
            "rest", F.col("rest") - F.sum(F.col("step") * F.col("size")).over(whole)
        )
    copies = (F.col("base") + F.col("more")).cast("int")
    result = F.struct(
        "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
    return rows.withColumn("__mix", result).select("row.*", F.col("__mix").alias("mix"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as the mixture has them: each as often as its copies, without ``mix``."""
    copy = F.explode(F.when(F.col("mix.copies") > 0, F.sequence(F.lit(1), F.col("mix.copies"))))
    rows = mixed.select(F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c != "mix"]).alias("row"), copy.alias("copy"))
    return rows.select("row.*")
