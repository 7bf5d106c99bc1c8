"""Calibration, golden data and retrieval quality."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calibration_error(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected calibration error of (score, truth): bins of equal width, the last one closed.

    Bins are compared with the edges ``i * (1 / n_bins)``; rows outside all bins only count in the
    denominator.
    """
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    s, which = F.col("score"), None
    for i in range(n_bins):
        inside = (s >= edges[i]) & ((s <= edges[i + 1]) if i == n_bins - 1 else (s < edges[i + 1]))
        which = F.when(inside, i) if which is None else which.when(inside, i)
    by_bin = rows.withColumn("bin", which).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("truth").cast("double")).alias("acc"))
    part = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)
    return by_bin.agg(F.sum(part).alias("s"), F.sum("n").alias("n")).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("ece"), F.coalesce("n", F.lit(0)).alias("n_rows"))


def fit_calibrator(rows: DataFrame) -> IsotonicRegressionModel:
    """Isotonic fit of truth on score; equal scores are put together first, so the sort is over distinct scores."""
    grouped = rows.filter("score is not null and truth is not null").groupBy("score").agg(F.avg(F.col("truth").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    table = VectorAssembler(inputCols=["score"], outputCol="features").transform(grouped)
    return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(table)


def calibrated(rows: DataFrame, model: IsotonicRegressionModel, column: str = "calibrated") -> DataFrame:
    """Scores by the model: interpolated between boundaries, clipped outside."""
    table = VectorAssembler(inputCols=["score"], outputCol="features", handleInvalid="skip").transform(rows)
    return model.setPredictionCol(column).transform(table).drop("features")


def squeezed(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9.]+", "")


def table_score(text: Column, expected_html: Column) -> Column:
    """Share of the expected table's tokens found in the text; 0 if there are none.

    Text and tokens are bound as an array's element, so that they are made once a row and not again for each token.
    """
    tokens = F.regexp_extract_all(expected_html, F.lit(r"[A-Za-z0-9.$,]+"), F.lit(0))
    tokens = F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.lower(t).isin("table", "tr", "td", "th"))
    bound = F.array(F.struct(F.array_distinct(F.transform(tokens, squeezed)).alias("tokens"), squeezed(text).alias("actual")))
    share = lambda b: F.when(F.size(b.tokens) > 0, F.size(F.filter(b.tokens, lambda t: F.contains(b.actual, t))) / F.size(b.tokens)).otherwise(0.0)
    return F.get(F.transform(bound, share), F.lit(0))


def value_present(text: Column, value: Column, number: Column) -> Column:
    """If a value, or a number with two decimals or as a whole, stands in the text."""
    actual = squeezed(text)
    two = squeezed(F.format_string("%.2f", number))
    whole = F.when(number == F.floor(number), squeezed(F.format_string("%.0f", number)))
    near = F.contains(actual, two) | F.coalesce(F.contains(actual, whole), F.lit(False))
    near = F.when(number.isNotNull(), near)
    return F.contains(actual, squeezed(value)) | F.coalesce(near, F.lit(False))


# Block types of golden data and the words that tell them.
GOLDEN_TYPES = {
    "heading": ["invoice", "statement", "agreement", "notes", "form 10-k", "receipt", "understanding"],
    "table": ["item", "qty", "amount", "balance", "accuracy", "total"],
    "formula": ["formula", "e = mc"],
    "signature": ["signature"],
    "footer": ["footer"],
}


def inferred_types(text: Column) -> Column:
    low = F.lower(text)
    hits = [F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words]), F.lit(kind)) if len(words) > 1 else F.when(F.contains(low, F.lit(words[0])), F.lit(kind)) for kind, words in GOLDEN_TYPES.items()]
    return F.array_compact(F.array(F.lit("text"), *hits))


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """What golden data expects and the result lacks."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def summary(table_scores: DataFrame, ndcgs: DataFrame, scored: DataFrame) -> DataFrame:
    """(metric, value) of an evaluation run: mean table score, mean nDCG at 5, expected calibration error."""
    row = lambda rows, name, value: rows.select(F.lit(name).alias("metric"), value.alias("value"))
    mean = lambda rows, c: rows.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("v"))
    return (
        row(mean(table_scores, "score"), "table_teds", F.col("v"))
        .unionByName(row(mean(ndcgs, "ndcg"), "retrieval_ndcg_at_5", F.col("v")))
        .unionByName(row(calibration_error(scored), "confidence_ece", F.col("ece")))
    )


def ndcg(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg): 1 / log2(rank + 1) of the expected point within the first ``k`` hits, else 0."""
    found = hits.filter(F.col("rank") <= k).join(expected, ["query_id", "point_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = expected.select("query_id").distinct().join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0)).alias("ndcg"))
