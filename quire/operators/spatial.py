"""Boxes that overlap on a page, by a grid.

Every box goes to the cells that it touches, and boxes meet by page and cell; a pair counts in the cell that
holds the upper left corner of what both share, so once. The grid is finer on pages with more boxes, and one
cell on pages with few, so a crowded page is many small groups instead of all its pairs in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes of the right side a cell, about; and cells a side of a page at most.
CELL_BOXES, MOST_CELLS = 16, 64


def _cell(x: Column, cells: Column) -> Column:
    return F.least(F.greatest(F.floor(x * cells), F.lit(0)), cells - 1)


def _spread(rows: DataFrame, box: str, name: str) -> DataFrame:
    """``rows`` once for each cell that ``box`` touches; the box's fields as plain columns, which a generator may be read through."""
    b, n = F.col(box), F.col("cells")
    plain = {f"{name}{f}": b[f] for f in rows.schema[box].dataType.fieldNames()}
    rows = rows.withColumns(plain).drop(box)
    x, y = F.col(f"{name}x"), F.col(f"{name}y")
    rows = rows.withColumns({f"{name}right": x + F.col(f"{name}w"), f"{name}bottom": y + F.col(f"{name}h")})
    along = lambda low, high: F.sequence(_cell(low, n), F.greatest(_cell(low, n), _cell(F.col(f"{name}{high}"), n)))
    return rows.withColumn("cell_x", F.explode(along(x, "right"))).withColumn("cell_y", F.explode(along(y, "bottom")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose boxes share an area, each pair once.

    Columns of both sides but the keys must have different names. Rows with a null key or box meet nothing; repeated
    rows make repeated pairs. Boxes may reach beyond the page.
    """
    left, right = (d.filter(F.col(f"{b}.x").isNotNull() & F.col(f"{b}.w").isNotNull() & F.col(f"{b}.y").isNotNull() & F.col(f"{b}.h").isNotNull()) for d, b in ((left, left_box), (right, right_box)))
    sizes = right.groupBy(*keys).agg(F.least(F.lit(MOST_CELLS), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") / CELL_BOXES)))).cast("long").alias("cells"))
    one = _spread(left.join(sizes, keys), left_box, "one_")
    two = _spread(right.join(sizes, keys), right_box, "two_").drop("cells")
    pairs = one.join(two, [*keys, "cell_x", "cell_y"])
    low = lambda c: F.greatest(f"one_{c}", f"two_{c}")
    shared = (F.least("one_right", "two_right") > low("x")) & (F.least("one_bottom", "two_bottom") > low("y"))
    first = (_cell(low("x"), F.col("cells")) == F.col("cell_x")) & (_cell(low("y"), F.col("cells")) == F.col("cell_y"))
    whole = lambda d, box, name: F.struct(*(F.col(f"{name}{f}").alias(f) for f in d.schema[box].dataType.fieldNames())).alias(box)
    kept = [c for c in (*left.columns, *right.columns) if c not in (*keys, left_box, right_box)]
    return pairs.filter(shared & first).select(*keys, *kept, whole(left, left_box, "one_"), whole(right, right_box, "two_"))
