"""MinHash near-deduplication with bottom-k sketches from one hash function.

Documents with equal shingle sets are one node. A node's sketch is its k smallest shingle hashes.
Nodes meet in the inverted lists of retained values; pairs pass if the sketch of their union, taken
from both sketches, allows the similarity; exact Jaccard on the full sets confirms them.

Links that the similarity asks for are kept by two bounds. (1) The sketches of a pair at the
threshold share at least ``shared`` values but for a chance under 1e-7; pairs of sets no larger than k
are exact, and where only one is, ``least_shared`` has the bound. (2) By the prefix principle such a pair also meets in a list when each
node only enters the lists of its ``size - shared + 1`` rarest values; values that very many
documents hold (a passage in a third of all rows) are the first to go.

Components need no pair of every two copies: every list first links its members to its smallest
one; only members left outside that member's component are then compared with the rest of the list.
Long lists (near copies by the thousand, not all alike enough) are compared block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, finish, folded, linked, listed_members, signed, slices, window_hashes, word_hashes

#: A-Z lower-cased.
_FOLD = folded(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
#: Pairs to verify with fewer nodes than this fetch their texts by a broadcast of ids (8 bytes each).
BROADCAST_IDS = 500_000
#: Nodes of a block of a dense group.
BLOCK = 1024


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; of the whole sequence if it is shorter."""
    h, bounds = word_hashes(texts, _FOLD)
    shingles = signed(window_hashes(h, width))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(shingles[a : b - width + 1])
        elif b > a:
            yield signed(finish(window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            yield np.empty(0, np.int64)


def shared_at_least(size: int, similarity: float, chance: float = 1e-7) -> int:
    """Values that two bottom-``size`` sketches share, but for ``chance``, at that similarity."""
    below = 0.0
    for x in range(size + 1):
        below += comb(size, x) * similarity**x * (1 - similarity) ** (size - x)
        if below > chance:
            return max(1, x)
    return size


def least_shared(size: int, percent: int, shared: int, chance: float = 1e-7) -> list[int]:
    """Sketch values that a set of 1, 2, ... ``size`` shingles, and of more, shares with a partner at the threshold.

    A partner that is whole too shares the intersection itself. One of more than ``size`` shingles
    only shows its ``size`` smallest: how many of those are shared is hypergeometric, and the least
    number but for ``chance`` over all such partners counts.
    """
    out = []
    for n in range(1, size + 1):
        least = -(-n * percent // 100)
        for m in range(size + 1, n * 100 // percent + 1):
            both = -(-(n + m) * percent // (100 + percent))  # intersection at the threshold
            below, x = 0.0, max(0, size - (m - both))
            while x < min(both, size):
                below += comb(both, x) * comb(m - both, size - x) / comb(m, size)
                if below > chance:
                    break
                x += 1
            least = min(least, x)
        out.append(max(1, least))
    return [*out, min(shared, min(out[size * percent // 100 :]))]


def _signatures(docs: DataFrame, width: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            n, node, sketch = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                node.append(xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                sketch.append(s[:size])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "text_id", "n_shingles", "node", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id().alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, n_shingles long, node long, sketch array<long>")


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) of the ``wanted`` nodes (node, doc_id), from the whole text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            sets = [*shingle_sets(batch.column("text"), width)]
            same = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(same, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "same", "set"]
            )

    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("node", "text")
    sets = texts.mapInArrow(run, "node long, same long, set array<long>")
    return sets.filter("node = same").drop("same").dropDuplicates(["node"])


def _possible(size: int, shared: int, similarity: Column) -> Column:
    """If sketches ``x`` and ``y`` of sets of ``nx`` and ``ny`` shingles allow the similarity."""
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, size)
    both = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    whole = (F.col("nx") <= size) & (F.col("ny") <= size) & (F.size(F.array_union("x", "y")) <= size)
    sizes = F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9
    return sizes & F.when(whole, both >= similarity * F.size(union) - 1e-9).otherwise(both >= shared)


def _dense_links(docs: DataFrame, nodes: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join components of dense groups: (a, b), a spanning few of each pair of blocks.

    A group is dealt by a hash into blocks of about BLOCK nodes; each two blocks are one small task
    that holds their full sets and counts exact intersections by postings. Nothing but links that join
    two components leaves it, so a group of n alike nodes sends n rows a block, not its pairs.
    """
    mixed = own.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).filter("parts > 1")
    own = cut(own.join(mixed, "grp"))
    sets = _sets(docs, cut(own.select("node").join(nodes.select("node", "doc_id"), "node")), width)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = own.join(sets, "node").select("grp", "node", "part", "set", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = rows.select("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "part", "set")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        side, node, part = group["i"].to_numpy(), group["node"].to_numpy(), group["part"].to_numpy()
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        one, two = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        sets = group["set"].tolist()
        size = np.array([len(s) for s in sets])
        values, place = np.unique(np.concatenate([sets[k] for k in one] or [np.empty(0, np.int64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(one)), size[one])
        order = np.argsort(place, kind="stable")
        owner, ends = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
        root = {p: p for p in part.tolist()}

        def top(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        out = []
        for k in two:
            at = np.searchsorted(values, sets[k])
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == sets[k])] if len(values) else at[:0]
            if not len(at):
                continue
            both = np.bincount(np.concatenate([owner[a:b] for a, b in zip(ends[at], ends[at + 1], strict=True)]), minlength=len(one))
            hit = both * 100 >= (size[one] + size[k] - both) * percent
            for m in np.flatnonzero(hit & (part[one] != part[k])).tolist():
                a, b = top(part[one[m]]), top(part[k])
                if a != b:
                    root[a] = b
                    out.append((node[one[m]], node[k]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("grp", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, size: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, part, text_id) for each row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of distinct ``width``-word shingles (A-Z lower-cased,
    words by ASCII white space, whole texts) have a Jaccard similarity of ``percent`` or more. A
    text with fewer words has its whole word sequence as its one shingle. ``component_id`` is the
    smallest doc_id reachable; kept means that it is the row's own. Null and empty texts have empty
    sets and are linked with nothing, not even each other; rows with a null doc_id take no part
    (component null, kept true). Rows that share a doc_id keep a set each. ``part`` names a row's
    component without its doc_ids, ``text_id`` its text. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark, t = docs.sparkSession, percent / 100
    shared = shared_at_least(size, t)
    scratch = Scratch(spark)
    rows = scratch.keep(_signatures(docs, width, size), "near-signatures")
    usable = rows.filter("node is not null and doc_id is not null")
    nodes = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = scratch.keep(nodes, "near-nodes")
    keys = nodes.select("node", F.size("sketch").alias("m"), "n", F.explode("sketch").alias("v"))
    often = keys.groupBy("v").agg(F.count("*").alias("often")).filter("often > 1")
    needed = F.element_at(F.array(*[F.lit(x) for x in least_shared(size, percent, shared)]), F.least("n", F.lit(size + 1)).cast("int"))
    listed = (
        keys.join(often, "v")
        .groupBy("node")
        .agg(F.first("m").alias("m"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "v"))).alias("vs"))
        .withColumn("left", (F.col("m") - needed + 1) - (F.col("m") - F.size("vs")))  # values held once are the rarest
        .filter("left > 0")
        .select("node", F.explode(F.slice("vs", 1, F.col("left").cast("int"))).alias("v"))
        .select("node", F.col("v.v").alias("v"))
    )
    sketches = nodes.select("node", "n", "sketch")
    x = sketches.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
    possible = _possible(size, shared, F.lit(t))

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = scratch.keep(_sets(docs, scratch.keep(wanted.join(nodes.select("node", "doc_id"), "node"), "near-wanted"), width), "near-sets")
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (
            pairs.join(right, "b").join(left, "a")
            .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
            .filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
            .select("a", "b")
        )

    def dense(own: DataFrame) -> DataFrame:
        return _dense_links(docs, nodes, own, width, percent)

    whole = linked(listed_members(scratch.keep(listed, "near-lists")), x, y, possible, confirmed, dense)
    named = nodes.select("node", "doc_id").join(whole.withColumnRenamed("id", "node"), "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("own"))
    heads = smallest.join(nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("its")), "component")
    least = scratch.keep(heads.select("component", F.least("own", "its").alias("component_id")), "near-heads")
    if least.count() <= BROADCAST_IDS:  # a component of very many nodes isn't one task then
        least = F.broadcast(least)
    members_of = whole.select(F.col("id").alias("node"), "component").union(heads.select(F.col("component").alias("node"), "component"))
    ids = cut(members_of.join(least, "component").select("node", "component", "component_id"))
    first = nodes.select("node", F.col("doc_id").alias("copy_of"))
    result = rows.join(first, "node", "left").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "copy_of"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    part = F.coalesce("component", "node", "text_id")
    result = result.select("doc_id", "n_shingles", component.alias("component_id"), part.alias("part"), "text_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    result = cut(result.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "part", "text_id"))
    scratch.drop()
    return result


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, size: int = 32) -> DataFrame:
    """The rows of ``docs`` with one row of each component, the one with the smallest doc_id.

    Rows that share a doc_id are told apart by their texts: of a component the one with the smallest
    text hash stays, and of rows with one doc_id and text one stays, the first by a hash of all its columns.
    Texts without words are linked with nothing, so each different one stays. Rows with a null doc_id stay.
    """
    rows = near_duplicates(docs, width, percent, size).filter("kept and doc_id is not null")
    chosen = rows.groupBy("doc_id", "part").agg(F.min("text_id").alias("text_id")).select("doc_id", "text_id").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # other columns can't clash with names used here
    texts = docs.select("doc_id", _text_id().alias("text_id"), whole.alias("row")).join(chosen, ["doc_id", "text_id"], "left_semi")
    order = Window.partitionBy("doc_id", "text_id").orderBy(F.xxhash64("row"))
    first = texts.withColumn("i", F.row_number().over(order)).filter("i = 1")
    return first.select("row.*").unionByName(docs.filter("doc_id is null"))
