"""A training corpus from ``documents`` in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, near_dup, quality, tokens
from quire.llm.common import deleted, scratch, written
from quire.llm.queries import vocabulary

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose whole text scores LEAST_QUALITY or more; labels of held-out documents aren't used.

    Null and empty texts are scored by their statistics, which are zero. Rows that repeat a doc_id or all
    columns are scored alike and stay or go together. Without labelled rows, or in an empty table, every
    score is 0.5. Other columns pass through, one called like the score too.
    """
    labels = _table(spark, sf_dir, "labels").filter(~quality.held_out())
    model, name = quality.fit(docs, labels), "score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, name).filter(f"`{name}` >= {LEAST_QUALITY}").drop(name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id (five words, similarity 0.8).

    Null and empty texts are copies of nothing and stay, and so do rows with a null doc_id; of rows that
    share doc_id and text one stays. An empty table stays empty; other columns pass through.
    """
    return near_dup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``; rows that share a hit row's doc_id go too.

    Null and empty texts hold nothing, rows with a null doc_id stay. An empty table stays empty; other
    columns pass through.
    """
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` as often as the mixture of sources takes them, 0 to 3 times.

    A null source is a source of its own; null and empty texts have no words and stand as often as their
    source's rate says. Repeated rows are rows like any other. An empty table stays empty; other
    columns pass through, but for one called ``mix``, which goes.
    """
    return mixing.repeated(mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, read back from the token files that it writes.

    Null and empty texts have their end id only, repeated rows are written as often as they occur, null
    doc_ids come first. An empty table gives no rows; other columns are ignored. The files stay in the
    shared folder, under ``corpus-tokens-*``: they are the corpus.
    """
    folder = scratch(spark, "corpus-tokens")
    tokens.write(docs, folder, vocabulary())
    return tokens.read(spark, folder, digest=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token output", token_stage),
]

#: The classifier and the latent search can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, place = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            deleted(spark, before)
        before = place
    return docs
