"""Runs: maximal periodic stretches of words, by Lyndon roots and longest common extensions.

A run is a stretch with smallest period q that is at least 2q long and that no neighbouring word
extends. Every run holds a word where the longest Lyndon word that begins there, under one of two
opposite orders of the words, is one of its periods. So for both orders every place gives one
candidate, which is extended to both sides. Extensions are longest common prefixes in the words and
in their reversal: depths of lowest common ancestors in the two suffix trees, which Ukkonen's
algorithm builds and an Euler tour with range minima answers in constant time.

Before that, words which can't stand in a run are set aside: in a run of L words with period q, at least
L / 2 words in a row equal those q words further on, so every word of it is covered by a sequence of that
many words which recurs in the document. Stretches of covered words of many documents share a tree; a
sign of its own ends each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finish, slices, window_hashes, word_hashes

#: Words that share a pair of trees; a longer stretch has trees of its own.
TREE_WORDS = 60_000


def suffix_tree(s: list[int], letters: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last letter stands there only.

    Node 0 is the root. An edge to a node holds ``s`` from its first number to its second (leaves: to
    the end); the dictionary has the child below ``node * letters + letter``.
    """
    start, stop, link, child = [0], [0], [0], {}
    n, node, edge, length, rest = len(s), 0, 0, 0, 0
    for i, c in enumerate(s):
        rest += 1
        made = 0
        while rest:
            if not length:
                edge = i
            key = node * letters + s[edge]
            down = child.get(key)
            if down is None:
                child[key] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                first = start[down]
                size = min(stop[down], i + 1) - first
                if length >= size:
                    node, edge, length = down, edge + size, length - size
                    continue
                if s[first + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                middle = child[key] = len(start)
                start += (first, i)
                stop += (first + length, n)
                link += (0, 0)
                child[middle * letters + c] = middle + 1
                start[down] = first + length
                child[middle * letters + s[first + length]] = down
                if made:
                    link[made] = middle
                made = middle
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, stop, child


class RangeMinimum:
    """Minima of ranges of an array: of whole blocks by a sparse table, of their ends by running minima."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        size = -(-len(values) // self.BLOCK)
        grid = np.full((size, self.BLOCK), np.iinfo(np.int32).max, np.int32)
        grid.reshape(-1)[: len(values)] = values
        self.grid = grid.reshape(-1)
        self.ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [grid.min(1)]
        while 2 << (len(self.levels) - 1) <= size:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from ``a`` to ``b``, both included."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // self.BLOCK, b // self.BLOCK
        found = np.minimum(self.behind[a], self.ahead[b])
        for k in range(self.BLOCK):  # ranges inside one block
            same = np.flatnonzero((left == right) & (b - a == k))
            if len(same):
                found[same] = self.grid[a[same, None] + np.arange(k + 1)].min(1)
        between = right - left - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k, row in enumerate(self.levels):
            at = np.flatnonzero((between > 0) & (level == k))
            if len(at):
                found[at] = np.minimum(found[at], np.minimum(row[left[at] + 1], row[right[at] - (1 << k)]))
        return found


class Extensions:
    """Longest common prefixes of suffixes of ``s``, and the suffixes' order."""

    def __init__(self, s: list[int], letters: int):
        n = len(s)
        start, stop, child = suffix_tree(s, letters)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        ends = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # children by parent, then by letter
        below, parent = ends[order].tolist(), keys[order] // letters
        first = np.searchsorted(parent, np.arange(len(start) + 1)).tolist()
        tour, leaf_at, leaves = [], [0] * n, []
        at, depth, path, deep = list(first[:-1]), [0] * len(start), [0], 0
        while path:  # a node stands in the tour once before its children and once after each
            node = path[-1]
            tour.append(depth[node])
            k = at[node]
            if k == first[node + 1]:
                if k == first[node]:  # a leaf
                    suffix = n - depth[node]
                    leaf_at[suffix] = len(tour) - 1
                    leaves.append(suffix)
                path.pop()
                continue
            at[node] = k + 1
            node_below = below[k]
            deep = depth[node] + stop[node_below] - start[node_below]
            depth[node_below] = deep
            path.append(node_below)
        self.minimum, self.leaf_at = RangeMinimum(np.array(tour, np.int32)), np.array(leaf_at)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.minimum(self.leaf_at[i], self.leaf_at[j])


def _lyndon(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word from each place on: up to the next smaller suffix."""
    n = len(rank)
    size, later = [0] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while later and rank[later[-1]] > r:
            later.pop()
        size[i] = (later[-1] if later else n) - i
        later.append(i)
    return np.array(size)


def all_runs(s: list[int], letters: int, least: int = 2) -> np.ndarray:
    """(start, length, period) of every run of ``least`` letters or more, by start, then period.

    The last letter of ``s`` stands there only and is the smallest; so are the ends of stretches in it, if it
    holds several, each by a sign of its own.
    """
    n = len(s)
    if n < 2:
        return np.empty((0, 3), np.int64)
    forth = Extensions(s, letters)
    back = Extensions([*s[-2::-1], s[-1]], letters)
    found = []
    for rank in (forth.rank, -forth.rank):
        i, p = np.arange(n), _lyndon(rank.tolist())
        i, p = i[i + p < n], p[i + p < n]
        left = np.zeros(len(i), np.int64)
        inner = i > 0  # place x of s is place n - 2 - x of the reversal
        left[inner] = back(n - 1 - i[inner], n - 1 - i[inner] - p[inner])
        right = forth(i, i + p)
        size = left + right + p
        good = (size >= 2 * p) & (size >= least)
        found.append(np.stack([i - left, size, p], 1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(h: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that may hold a run, given the texts' words and bounds."""
    width = (least + 1) // 2
    starts, ends = bounds[:-1], bounds[1:]
    while True:
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        if not len(place):
            return starts, ends
        key = window_hashes(h[place], width)
        key ^= finish(owner[: len(key)].astype(np.uint64))
        key = key[owner[: len(key)] == owner[len(owner) - len(key) :]]  # windows inside one stretch
        inside = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(place) + 1, np.int64)
        np.add.at(cover, inside[again], 1)
        np.add.at(cover, inside[again] + width, -1)
        covered = np.cumsum(cover[:-1]) > 0
        first = covered & np.r_[True, ~covered[:-1] | (owner[1:] != owner[:-1])]
        last = covered & np.r_[~covered[1:] | (owner[1:] != owner[:-1]), True]
        new_starts, new_ends = place[np.flatnonzero(first)], place[np.flatnonzero(last)] + 1
        keep = new_ends - new_starts >= least
        if keep.sum() == len(starts) and (new_starts[keep] == starts).all() and (new_ends[keep] == ends).all():
            return starts, ends
        starts, ends = new_starts[keep], new_ends[keep]


def text_runs(texts: list[str], least: int = 12, tree_words: int = TREE_WORDS) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    h, bounds = word_hashes(pa.array(texts, pa.string()))
    words = [t.encode().split() for t in texts]
    starts, ends = _stretches(h, bounds, least)
    text_of = np.searchsorted(bounds, starts, "right") - 1
    found: list[list[np.ndarray]] = [[] for _ in texts]
    k = 0
    while k < len(starts):
        size, more = 0, k
        while more < len(starts) and (more == k or size + ends[more] - starts[more] <= tree_words):
            size += ends[more] - starts[more]
            more += 1
        number: dict[bytes, int] = {}
        s, at, signs = [], [], more - k  # letters under ``signs`` end stretches
        for j in range(k, more):
            own = bounds[text_of[j]]
            at.append(len(s))
            s += [number.setdefault(w, signs + len(number)) for w in words[text_of[j]][starts[j] - own : ends[j] - own]]
            s.append(more - 1 - j)
        runs = all_runs(s, signs + len(number), least)
        owner = np.searchsorted(at, runs[:, 0], "right") - 1
        runs[:, 0] += starts[k:more][owner] - np.array(at)[owner] - bounds[text_of[k:more][owner]]
        cuts = np.searchsorted(owner, np.arange(more - k + 1))
        for j in range(k, more):
            if cuts[j - k] < cuts[j - k + 1]:
                found[text_of[j]].append(runs[cuts[j - k] : cuts[j - k + 1]])
        k = more
    none = np.empty((0, 3), np.int64)
    return [(w, np.concatenate(f) if f else none) for w, f in zip(words, found, strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) of every row of ``docs`` (doc_id, text).

    ``runs`` has the (start, length, period) of every run of ``least`` words or more, by start, then
    period; words are what ASCII white space parts, numbered from 0. ``collapsed_text`` has the words that
    no run holds after its first period, joined by single spaces. Null and empty texts have no words and
    no runs, and an empty collapsed text. Rows are worked on one by one, without a shuffle: null doc_ids
    and repeated rows stay as they are, an empty table gives no rows, other columns are ignored. A
    task holds the trees of about TREE_WORDS words, or of one longer stretch.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1 << 21)):
            texts = batch.column("text").fill_null("").to_pylist()
            sizes, counts, flat, kept = [], [], [], []
            for text, (words, runs) in zip(texts, text_runs(texts, least), strict=True):
                sizes.append(len(words))
                counts.append(len(runs))
                flat.append(runs)
                if len(runs):
                    words = [w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k]
                kept.append(b" ".join(words).decode())
            columns = np.concatenate(flat).T if flat else np.empty((3, 0), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed_text"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _RUNS)
