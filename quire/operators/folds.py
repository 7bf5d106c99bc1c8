"""Order-dependent folds: one state a key, rows streamed in sorted order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def fold(
    df: DataFrame, keys: list[str], order: list[str], reads: list[str], name: str, step: Callable[[Any, dict], tuple[Any, int]]
) -> DataFrame:
    """``df`` with an int column ``name`` from ``step(state, row) -> (state, value)``.

    Rows with equal ``keys`` are visited in ``order``, starting with the state None. One shuffle by
    the keys and a sort that can spill; a task holds one state and one Arrow batch, however many
    rows a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            values = []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            rows = batch.select(reads).to_pylist()
            for key, row in zip(key_rows, rows, strict=True):
                if key != now:
                    now, state = key, None
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int32())], names=[*batch.schema.names, name])

    rows = df.drop(name).repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, IntegerType())]))
