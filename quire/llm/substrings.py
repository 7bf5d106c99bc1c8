"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words. Its anchor is the smallest hash among its runs of ``run``
words, so equal windows have equal anchors and a count over anchors is never below the count over
windows. Partitions sketch the anchors of their documents (once a document) in count-min tables that
stop at 2; the merged tables overestimate. The second pass sends only windows whose anchor is
estimated repeated to an exact grouping by window, so no repeated window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import deleted, finish, signed, slices, window_hashes, word_hashes, written

RUN = 8
TABLES = 3
_BLOCK = 65_536


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    gap = width - size
    return np.minimum(x[:-gap], x[gap:]) if gap else x


def anchors(texts: pa.Array, width: int, run: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Word hashes, anchors of windows by their first word, and (text, first window, last + 1) of each text that has some."""
    h, bounds = word_hashes(texts)
    first, last = bounds[:-1], bounds[1:] - width + 1
    long = np.flatnonzero(last > first)
    runs = window_hashes(h, run)
    smallest = _sliding_min(runs, width - run + 1) if len(h) >= width else np.empty(0, np.uint64)
    return h, smallest, [*zip(long.tolist(), first[long].tolist(), last[long].tolist(), strict=True)]


def _cells(values: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64(cells - 1)
    return [(finish(values + np.uint64(0x9E3779B97F4A7C15 * (d + 1) % 2**64)) & mask).astype(np.int64) for d in range(TABLES)]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def sketch_cells(docs: DataFrame, width: int, most_cells: int = 2**25) -> int:
    """Cells of each table: a power of two near twice the anchors expected, bounded by a parameter.

    Beyond the bound tables fill up and more windows go to the exact pass; none is lost.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = 2.5 * chars / 6 * 2 / max(2, width - RUN)
    return int(min(most_cells, max(2**16, 2 ** int(np.ceil(np.log2(max(1.0, wanted)))))))


def repeated_cells(docs: DataFrame, width: int, run: int, cells: int) -> list[np.ndarray]:
    """Count-min tables merged over all partitions, as bit maps of the cells that reach 2."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((TABLES, cells), np.uint8)
        for part in (x for batch in batches for x in slices(batch)):
            _, anchor, windows = anchors(part.column("text"), width, run)
            found = [np.unique((a := anchor[i:j])[_edges(a)]) for _, i, j in windows]
            if found:
                for d, at in enumerate(_cells(np.concatenate(found), cells)):
                    at, n = np.unique(at, return_counts=True)
                    table[d][at] = np.minimum(2, table[d][at] + np.minimum(2, n))
        out = []
        for d in range(TABLES):
            there = np.flatnonzero(table[d])
            for block in np.split(there, np.flatnonzero(np.diff(there // _BLOCK)) + 1):
                if len(block):
                    low, twice = (block % _BLOCK).astype("<u2"), table[d][block] > 1
                    out.append((d, int(block[0] // _BLOCK), low[~twice].tobytes(), low[twice].tobytes()))
        columns = [*zip(*out, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["d", "block", "once", "twice"],
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.uint8)
        for once, twice in zip(group["once"], group["twice"], strict=True):
            at = np.frombuffer(once, "<u2")
            total[at] = np.minimum(2, total[at] + 1)
            total[np.frombuffer(twice, "<u2")] = 2
        return pd.DataFrame({"d": group["d"].iloc[:1], "block": group["block"].iloc[:1], "bits": [np.packbits(total > 1).tobytes()]})

    rows = docs.select("text").mapInArrow(sketch, "d int, block int, once binary, twice binary")
    maps = [np.zeros(cells // 8, np.uint8) for _ in range(TABLES)]
    for r in rows.groupBy("d", "block").applyInPandas(merge, "d int, block int, bits binary").toLocalIterator():
        maps[r.d][r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return maps


def _estimated(docs: DataFrame, width: int, run: int, cells: int, maps: list[np.ndarray]) -> DataFrame:
    """Windows estimated repeated: (doc_id, text_id, at, h, anchor); 96 bits name a window."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # TABLES * cells bits, bounded by most_cells

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in (x for b in batches for x in slices(b)):
            rows: list[tuple] = []
            h, anchor, windows = anchors(batch.column("text"), width, run)
            whole = window_hashes(h, width)
            for k, i, j in windows:
                a = anchor[i:j]
                edge = _edges(a)
                value = a[edge]
                hit = np.ones(len(value), bool)
                for table, at in zip(tables, _cells(value, cells), strict=True):
                    hit &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                if hit.any():
                    keep = np.flatnonzero(np.repeat(hit, np.diff(np.append(edge, len(a)))))
                    rows.append((k, keep.astype(np.int32), signed(whole[i:j][keep]), (a[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            at, h, anchor = ([r[i] for r in rows] for i in (1, 2, 3))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("text_id").take(take), pa.array(at, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64())), pa.array(anchor, pa.list_(pa.int32()))],
                names=["doc_id", "text_id", "at", "h", "anchor"],
            )

    found = docs.mapInArrow(run_, "doc_id long, text_id long, at array<int>, h array<long>, anchor array<int>")
    return found.select("doc_id", "text_id", F.inline(F.arrays_zip("at", "h", "anchor")))


def remove_repeats(docs: DataFrame, width: int = 50, run: int = RUN, most_cells: int = 2**25) -> DataFrame:
    """``docs`` with ``dedup``: struct of kept_text, n_words, n_removed.

    Each word covered by a window of ``width`` words is removed if that word sequence also starts in
    a document with a smaller doc_id; windows are judged on the input. Words are runs of anything but
    ASCII white space, unchanged; kept words are joined by one space. Null and empty texts have no
    words and an empty kept_text; texts shorter than a window lose nothing. A null doc_id counts as
    larger than all others. Rows that share a doc_id don't count against each other. Other columns
    pass through and a column called ``dedup`` is replaced. An empty table gives an empty result.
    """
    last = 2**63 - 1
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), text_id.alias("text_id"), "text")
    cells = sketch_cells(docs, width, most_cells)
    windows, place = written(_estimated(ids, width, run, cells, repeated_cells(docs, width, run, cells)), "windows")
    first = windows.groupBy("h", "anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first, place_0 = written(first.drop("last"), "windows-first")  # a table of its own: Spark can split the join's hot windows
    hits = windows.join(first, ["h", "anchor"]).filter("doc_id > first")
    spans, place_2 = written(hits.groupBy("doc_id", "text_id").agg(F.collect_set("at").alias("at")), "spans")
    deleted(docs.sparkSession, place, place_0)

    kept = [c for c in docs.columns if c != "dedup"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), text_id.alias("text_id"),
    )
    rows = rows.join(spans, ["doc_id", "text_id"], "left").select("row", "text", "at")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at"), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                if at.is_valid:
                    start = at.values.to_numpy()
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + width, -1)
                keep = np.cumsum(gone[:-1]) == 0
                left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]) if at.is_valid else b" ".join(words)
                out.append({"kept_text": left.decode(), "n_words": len(words), "n_removed": int(len(words) - keep.sum())})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _DEDUP)], names=["row", "dedup"])

    schema = StructType([*rows.select("row").schema.fields, StructField("dedup", _DEDUP_TYPE)])
    return rows.mapInArrow(cut_out, schema).select("row.*", "dedup")


_DEDUP_TYPE = StructType([StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
_DEDUP = pa.struct([("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
