"""Tables of a stream that are committed together.

A micro-batch writes each of its tables into a folder of its own, ``<table>/batch=<id>/attempt=<id>``, and then
one file, ``_commits/<batch>.json``, that names the folders. Until that file is there the batch doesn't exist for
readers, and once it is there a replay of the batch changes nothing. So however often a job is killed,
every batch counts once and with all its tables. Every COMPACT batches one file takes up all before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

COMPACT = 50


def commits(spark: SparkSession, root: str) -> dict[int, dict[str, str]]:
    """The folder of each table, by committed batch."""
    names = files.listed(spark, f"{root}/_commits")
    whole = [n for n in names if n.startswith("upto-") and n.endswith(".json")]
    found: dict[int, dict[str, str]] = {}
    last = -1
    if whole:
        last = int(whole[-1][5:-5])
        found = {int(k): v for k, v in json.loads(files.read_text(spark, f"{root}/_commits/{whole[-1]}")).items()}
    for name in names:
        if name.endswith(".json") and name[0].isdigit() and int(name[:-5]) > last:
            found[int(name[:-5])] = json.loads(files.read_text(spark, f"{root}/_commits/{name}"))
    return found


class Batch:
    """One micro-batch on its way into the tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number, self.attempt = spark, root, number, uuid.uuid4().hex
        self.folders: dict[str, str] = {}
        self.done = number in commits(spark, root)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of the batch; what it returns reads the written rows."""
        folder = f"{name}/batch={self.number}/attempt={self.attempt}"
        rows.write.parquet(f"{self.root}/{folder}")
        self.folders[name] = folder
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")

    def commit(self) -> None:
        files.publish(self.spark, f"{self.root}/_commits/{self.number:012d}.json", json.dumps(self.folders))
        self.done = True
        for name, folder in self.folders.items():  # what killed attempts have left
            at = f"{self.root}/{name}/batch={self.number}"
            files.deleted(self.spark, *(f"{at}/{a}" for a in files.listed(self.spark, at) if a != folder.rpartition("/")[2]))
        if self.number % COMPACT == COMPACT - 1:
            self._compact()

    def _compact(self) -> None:
        found = commits(self.spark, self.root)
        path = f"{self.root}/_commits/upto-{self.number:012d}.json"
        if not files.exists(self.spark, path):
            files.publish(self.spark, path, json.dumps(found))
        names = files.listed(self.spark, f"{self.root}/_commits")
        old = [n for n in names if n.endswith(".json") and n != path.rpartition("/")[2] and int(n.removeprefix("upto-")[:-5]) <= self.number]
        files.deleted(self.spark, *(f"{self.root}/_commits/{n}" for n in old))


def into_tables(root: str, work: Callable[[DataFrame, Batch], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``work`` writes the tables of a batch, unless the batch is committed already."""

    def each(rows: DataFrame, number: int) -> None:
        batch = Batch(rows.sparkSession, root, number)
        if batch.done:
            return
        rows.persist()  # a batch is read once for each of its tables
        try:
            work(rows, batch)
            batch.commit()
        finally:
            rows.unpersist()

    return each


def read(spark: SparkSession, root: str, name: str, key: str | None = None, keys_of: str | None = None) -> DataFrame:
    """A table as the committed batches have it, with the number of the ``batch``.

    With ``key`` only the rows of each key's last batch count, by the table ``keys_of`` (by default the table
    itself), which holds every key of every batch, also those that left no row in this table.
    """
    found = commits(spark, root)
    at = lambda table: [f"{root}/{found[b][table]}" for b in sorted(found) if table in found[b]]
    if not at(name):
        raise FileNotFoundError(f"no committed table {name} at {root}")
    load = lambda table: spark.read.option("basePath", f"{root}/{table}").parquet(*at(table)).drop("attempt")
    rows = load(name)
    if key is None:
        return rows
    last = load(keys_of or name).groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi")
