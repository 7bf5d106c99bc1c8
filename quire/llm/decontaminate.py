"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages of words. Passages are TF-IDF vectors
over the words of the benchmark that aren't common in the corpus. A randomised SVD, whose one pass
over the corpus sums ``X'(XO)`` partition by partition for a random O, gives one latent space for the
whole benchmark; items are rows of X too, as heavy together as all corpus passages. Passages near an item by
cosine are candidates. Only for items most of whose words are common in the corpus, as where a large group of
copies holds them, the space can't tell; their candidates are the passages that share as many of
their words as any accepted passage must, by exact counts. A longest common subsequence of words, or a shorter one together with the item's answer, confirms
them, so that paraphrases and spliced items are found and mere likeness isn't enough.

Words are 64-bit hashes, texts are rows of numbers of the benchmark's words, and subsequences of many
candidates advance side by side, an item's words being the bits of a 64-bit number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, in_task, slices, word_hashes, written

_FOLD = folded(bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256)))
#: Words of a passage, and from one passage's start to the next.
PASSAGE, STEP = 64, 32
#: Items that are compared with a slice of texts at once; a pass over the documents goes through all of them.
BLOCK_ITEMS = 200
#: Words of the items that share a latent space; a larger benchmark has several, each searched for on its own.
SPACE_WORDS = 200_000


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words without ASCII punctuation of all texts, and where each text's begin."""
    return word_hashes(pc.utf8_lower(texts), _FOLD)


def answer(text: str | None) -> str:
    """The item's last sentence or line of two words or more: what a paraphrase must still contain."""
    parts = (text or "").replace("\n", ". ").split(". ")
    sizes = np.diff(words(pa.array(parts, pa.string()))[1])
    return next((p for p, n in zip(reversed(parts), sizes[::-1], strict=True) if n > 1), text or "")


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Sequences:
    """Longest common subsequences of some word sequences with many stretches of texts at once.

    ``sequences`` are arrays of word numbers below ``n_words``; other words are ``n_words``.
    """

    def __init__(self, sequences: list[np.ndarray], n_words: int):
        self.sequences, self.size = sequences, np.array([len(x) for x in sequences])
        self.bits = np.zeros((len(sequences), n_words + 1), np.uint64)
        for k, x in enumerate(sequences):
            if len(x) <= 64:
                np.bitwise_or.at(self.bits[k], x, np.uint64(1) << np.arange(len(x), dtype=np.uint64))

    def common(self, which: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each (which, start, stop) the common length of that sequence and ``ids[start:stop]``."""
        out = np.zeros(len(which), np.int64)
        long = self.size[which] > 64
        for k in np.flatnonzero(long).tolist():
            q = int(which[k])
            out[k] = common_subsequence(self.sequences[q].tolist(), ids[start[k] : stop[k]].tolist())
        short = np.flatnonzero(~long)
        short = short[np.argsort(start[short] - stop[short], kind="stable")]  # the longest first
        for k in range(0, len(short), 32_768):
            some = short[k : k + 32_768]
            q, at, n = which[some], start[some], (stop - start)[some]
            row, active = np.full(len(some), 2**64 - 1, np.uint64), len(some)
            for step in range(int(n[0])):
                while n[active - 1] <= step:
                    active -= 1
                r = row[:active]
                u = r & self.bits[q[:active], ids[at[:active] + step]]
                row[:active] = (r + u) | (r - u)
            size = self.size[q].astype(np.uint64)
            low = np.where(size == 64, np.uint64(2**64 - 1), (np.uint64(1) << (size & np.uint64(63))) - np.uint64(1))
            out[some] = self.size[q] - np.bitwise_count(row & low)
        return out


@dataclass(frozen=True)
class Rules:
    """When a candidate counts as the item: a common subsequence of at least ``verbatim`` of the item's
    words; or at least ``paraphrase`` of them and ``answered`` of the answer's words, if the
    passage is near by ``cosine`` or holds ``paraphrase`` of the words' weight among the items (else
    stop words alone would do)."""

    cosine: float = 0.3
    verbatim: float = 0.7
    paraphrase: float = 0.5
    answered: float = 0.8


def last_passage(n: np.ndarray) -> np.ndarray:
    """Number of the last passage of texts of ``n`` words."""
    return np.maximum(0, -(-(n - PASSAGE) // STEP))


def passages_of(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, passage) pairs for words at places ``at`` of texts of ``n`` words."""
    last, high = last_passage(n), at // STEP
    one, two = np.minimum(high, last), high - 1
    where = np.arange(len(at))
    second = (two >= 0) & (two != one) & (two <= last)
    return np.concatenate([where, where[second]]), np.concatenate([one, two[second]])


class Space:
    """Weighted words of passages: ``idf`` by word number, 0 for words that don't count."""

    def __init__(self, known: np.ndarray, idf: np.ndarray):
        self.known, self.idf = known, np.append(idf, 0.0)
        self.place = np.cumsum(self.idf > 0) - 1  # a word's place among those that count
        self.size = int((self.idf > 0).sum())

    def numbers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of rows of ``_numbered``, each word's number and where each text's words begin."""
        kind = _kind(self.known)
        for part in (x for b in batches for x in slices(b, (1 << 19) * kind.itemsize, "ids")):
            ids = part.column("ids")
            _, ends, data = ids.buffers()
            bounds = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            flat = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].view(kind).astype(np.int64)
            yield part, flat, (bounds - bounds[0]) // kind.itemsize

    def rows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, value) of the unit passage vectors in order of row, and each row's text and passage."""
        at = np.flatnonzero(self.idf[ids] > 0)
        if not len(at):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.float32),) + (np.empty(0, np.int64),) * 2
        doc = np.searchsorted(bounds, at, "right") - 1
        which, passage = passages_of(at - bounds[doc], np.diff(bounds)[doc])
        many = int(passage.max()) + 1
        key = (doc[which] * many + passage) * self.size + self.place[ids[at[which]]]
        key, count = np.unique(key, return_counts=True)
        place, word = key // self.size, key % self.size
        starts = _starts(place)
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
        value = count * self.idf[self.idf > 0][word]
        norm = np.sqrt(np.add.reduceat(value**2, starts))
        return row, word, (value / norm[row]).astype(np.float32), place[starts] // many, place[starts] % many


def numbered(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes among the sorted ``known`` ones; the number of those where there is none."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _times(row: np.ndarray, value: np.ndarray, right: np.ndarray, word: np.ndarray) -> np.ndarray:
    """X times ``right`` for the rows of X given by entries in order of row."""
    return np.add.reduceat(right[word] * value[:, None], _starts(row), axis=0) if len(row) else np.empty((0, right.shape[1]), right.dtype)


class Overlap:
    """Which passages share enough different words with an item to be accepted, by exact counts.

    A common subsequence of c of an item's n words, d of them different, has at least ``c - (n - d)``
    different ones. Counts of whole texts, then of windows that hold any passage's region, leave few
    to the subsequence itself.
    """

    def __init__(self, items: list[np.ndarray], share: float, n_words: int):
        self.sequences = Sequences(items, n_words)
        self.least = np.array([ceil(share * len(ws) - 1e-9) for ws in items])
        self.different = np.maximum(1, self.least - np.array([len(ws) - len({*ws.tolist()}) for ws in items]))
        own = np.unique(np.concatenate(items))
        self.place = np.full(n_words + 1, len(own))
        self.place[own] = np.arange(len(own))
        self.holds = np.zeros((len(own) + 1, len(items)), np.float32)
        for i, ws in enumerate(items):
            self.holds[self.place[ws], i] = 1
        region = PASSAGE + 2 * int(self.sequences.size.max())
        self.step = -(-max(PASSAGE, region // 2) // STEP) * STEP
        self.window = region + self.step

    def _shared(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many different words of each item stand in each stretch of ``ids``."""
        n = stop - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        seen = np.zeros((len(start), len(self.holds)), np.float32)
        seen[np.repeat(np.arange(len(start)), n), self.place[ids[at]]] = 1
        return seen[:, :-1] @ self.holds[:-1]

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, item, passage) that can be accepted, as rows."""
        first, n = bounds[:-1], np.diff(bounds)
        out = [np.empty((0, 3), np.int64)]
        block = max(1, (1 << 24) // len(self.holds))
        for k in range(0, len(n), block):
            asked = self._shared(ids, first[k : k + block], bounds[1:][k : k + block]) >= self.different
            texts = np.flatnonzero(asked.any(axis=1))
            windows = np.maximum(1, -(-(n[k + texts] - self.window) // self.step) + 1)  # the last one reaches the end
            text = np.repeat(texts, windows)
            place = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * self.step
            for j in range(0, len(text), block):
                t, start = text[j : j + block], place[j : j + block]
                size = n[k + t]
                begin = first[k + t] + start
                stop = first[k + t] + np.minimum(size, start + self.window)
                w, q = np.nonzero((self._shared(ids, begin, stop) >= self.different) & asked[t])
                good = self.sequences.common(q, ids, begin[w], stop[w]) >= self.least[q]
                w, q = w[good], q[good]
                want, start, size, t = self.sequences.size[q], start[w], size[w], t[w]
                last = last_passage(size)
                low = np.where(start > 0, -(-(start + want) // STEP), 0)
                high = np.where(start + self.window >= size, last, np.minimum(last, (start + self.window - PASSAGE - want) // STEP))
                many = np.maximum(0, high - low + 1)
                passage = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
                out.append(np.stack([np.repeat(k + t, many), np.repeat(q, many), passage], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def _kind(known: np.ndarray) -> np.dtype:
    return np.dtype("<u2" if len(known) < 65536 else "<u4")


class _Table:
    """Numbers of many words by one look-up in a table of first bits; only words whose place several known ones share are searched for."""

    def __init__(self, known: np.ndarray):
        bits = min(22, max(8, len(known).bit_length() + 6))
        self.known, self.shift = known, np.uint64(64 - bits)
        place = known >> self.shift
        self.number = np.zeros(1 << bits, np.int32)
        self.number[place[::-1]] = np.arange(len(known), dtype=np.int32)[::-1]  # the first of each place
        self.shared = np.bincount(place.astype(np.int64), minlength=1 << bits) > 1

    def numbers(self, h: np.ndarray) -> np.ndarray:
        place = h >> self.shift
        number = self.number[place]
        out = np.where(self.known[number] == h, number, np.int32(len(self.known)))
        again = np.flatnonzero(self.shared[place])
        out[again] = numbered(h[again], self.known)
        return out


def _numbered(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, ids): each word's place among ``known``, or their number, as 16-bit numbers if they fit, else 32-bit ones.

    Written to the shared folder, as three passes read it and words are only hashed once; texts stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = _Table(known), _kind(known)
        for part in (x for b in batches for x in slices(b)):
            h, bounds = words(part.column("text"))
            ids = table.numbers(h).astype(kind)
            ends = pa.py_buffer((bounds * kind.itemsize).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, ends, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, ids binary"), "word-numbers")[0]


def _counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """For rows of ``_numbered``: in how many documents each known word occurs, and how many documents there are."""
    space = Space(known, np.zeros(len(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for part, ids, bounds in space.numbers(batches):
            at = np.flatnonzero(ids < len(known))
            doc = np.searchsorted(bounds, at, "right") - 1
            once = np.sort(doc * len(known) + ids[at])
            total[:-1] += np.bincount(once[_starts(once)] % max(1, len(known)), minlength=len(known))
            total[-1] += part.num_rows
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["i", "n"])

    out = np.zeros(len(known) + 1, np.int64)
    for r in docs.select("ids").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out[:-1], int(out[-1])


def _sketch(docs: DataFrame, space: Space, test: np.ndarray) -> tuple[np.ndarray, float]:
    """X'(X test) over all passages of rows of ``_numbered``, and how many those are."""
    v, l = test.shape
    test = test.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((v, l)), 0
        touched = np.zeros(v, bool)
        for _, ids, bounds in space.numbers(batches):
            row, word, value, of, _ = space.rows(ids, bounds)
            if not len(row):
                continue
            y = _times(row, value, test, word)
            order = np.argsort(word, kind="stable")
            w = word[order]
            starts = _starts(w)
            total[w[starts]] += np.add.reduceat(y[row[order]] * value[order][:, None], starts, axis=0)
            touched[w[starts]] = True
            n += len(of)
        there = np.flatnonzero(touched)
        rows = [r.astype("<f4").tobytes() for r in total[there]] + [np.full(l, n, "<f4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*there.tolist(), v], pa.int64()), pa.array(rows, pa.binary())], names=["i", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(l)
        for x in group["sums"]:
            total += np.frombuffer(x, "<f4")
        return pd.DataFrame({"i": group["i"].iloc[:1], "sums": [total.tobytes()]})

    out = np.zeros((v + 1, l))
    for r in docs.select("ids").mapInArrow(run, "i long, sums binary").groupBy("i").applyInPandas(add, "i long, sums binary").toLocalIterator():
        out[r.i] = np.frombuffer(r.sums)
    return out[:-1], float(out[-1, 0])


def latent_basis(docs: DataFrame, space: Space, items: tuple, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (words by at most ``rank``) of the corpus' and the items' passages.

    Nystrom form of the randomised SVD: one pass over the corpus. Its result on the driver is bounded
    by the benchmark's words times ``rank``. Items are rows of X that weigh as much as the corpus together.
    """
    v = space.size
    l = min(v, rank + 8)
    test = in_task(docs.sparkSession, lambda: np.linalg.qr(np.random.default_rng(seed).normal(size=(v, l)))[0])
    y, n = _sketch(docs, space, test)
    row, word, value, of, _ = items

    def factors(y: np.ndarray, test: np.ndarray) -> np.ndarray:
        if len(row):
            own = np.zeros_like(y)
            np.add.at(own, word, _times(row, value, test, word)[row] * value[:, None])
            y = y + max(1.0, n / len(of)) * own
        y = y + np.finfo(float).eps * max(1.0, np.linalg.norm(y)) * 100 * test
        core = test.T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max(initial=0) * 1e-12
        u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        return u[:, : min(rank, int((s > s.max(initial=0) * 1e-9).sum()))]

    return in_task(docs.sparkSession, factors, y, test).astype(np.float32)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), rank: int = 224, most_common: float = 0.02
) -> DataFrame:
    """(doc_id, item_id, common, n_item, answered, cosine): each document and item that it contains.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; whole texts are read, other columns
    are ignored. Words in more than ``most_common`` of the documents don't count towards ``cosine``
    (for an item that has no other words, all its words count). They count for the subsequence, and for
    the weight of the item's words that a passage holds, which is how rare they are among the items of
    the whole benchmark. Null and empty texts hold and are nothing; repeated rows of documents are
    reported once for each row; items with equal texts are each reported. Empty tables give an empty result.

    The benchmark is the query set, read on the driver in parts of about SPACE_WORDS words, which bounds
    what is sent to tasks; for each part, texts are read once and the numbers of their words three times. Inside a task items go by in blocks of
    BLOCK_ITEMS; an item's result doesn't depend on its block.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    found, told, size = None, [], 0
    for r in rows:
        told.append((r[0], r[1], answer(r[1])))
        size += len(r[1] or "") // 5  # about
        if size >= SPACE_WORDS:
            part = _contaminated(docs, told, rules, rank, most_common)
            found, told, size = part if found is None else found.unionByName(part), [], 0
    if told or found is None:
        part = _contaminated(docs, told, rules, rank, most_common)
        found = part if found is None else found.unionByName(part)
    return found


def _contaminated(docs: DataFrame, told: list[tuple], rules: Rules, rank: int, most_common: float) -> DataFrame:
    """``contaminated`` for items (item_id, text, answer) that share a latent space."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, common int, n_item int, answered double, cosine double"
    h, bounds = words(pa.array([t for _, t, _ in told], pa.string()))
    known = np.unique(h)
    if not len(known):
        return spark.createDataFrame([], schema)
    ids = numbered(h, known)
    items = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    h, bounds = words(pa.array([a for *_, a in told], pa.string()))
    answers = [x for x in np.split(numbered(h, known), bounds[1:-1])]
    filled = [k for k, x in enumerate(items) if len(x)]
    names, items, answers = ([x[k] for k in filled] for x in ([t[0] for t in told], items, answers))
    docs = _numbered(docs, known)
    df, n = _counts(docs, known)
    counts = df <= max(most_common * n, 1)
    few = np.array([2 * counts[x].sum() < len(x) for x in map(np.unique, items)])
    for x in items:
        if not counts[x].any():
            counts[x] = True
    space = Space(known, np.where(counts, np.log((1 + n) / (1 + df)) + 1, 0.0))
    of_items = space.rows(np.concatenate(items), np.cumsum([0, *map(len, items)]))
    basis = latent_basis(docs, space, of_items, rank)
    row, word, value, text, _ = of_items
    asked = _times(row, value, basis, word)
    asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-12)
    among = Counter(w for x in items for w in {*x.tolist()})
    weight = np.array([log((1 + len(told)) / (1 + among[w])) for w in range(len(known))] + [0.0])  # no copies in the documents change it
    blocks = []
    share = min(rules.verbatim, rules.paraphrase)
    for k in range(0, len(items), BLOCK_ITEMS):
        of = (text >= k) & (text < k + BLOCK_ITEMS)
        own = items[k : k + BLOCK_ITEMS]
        total = np.array([weight[np.unique(x)].sum() for x in own])
        blocks.append((k, own, answers[k : k + BLOCK_ITEMS], asked[of], text[of] - k, total, np.flatnonzero(few[k : k + BLOCK_ITEMS])))
    shared = spark.sparkContext.broadcast((space, basis, blocks, names, weight))  # bounded by the benchmark's words and rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, basis, blocks, names, weight = shared.value
        n_words = len(space.known)
        tools = [
            (Sequences(own, n_words), Sequences(said, n_words), Overlap([own[i] for i in few], share, n_words) if len(few) else None)
            for _, own, said, *_, few in blocks
        ]
        for part, ids, bounds in space.numbers(batches):
            row, word, value, doc, passage = space.rows(ids, bounds)
            x = _times(row, value, basis, word)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            best: dict[tuple[int, int], tuple] = {}
            for (first, own, _, asked, text, total, few), (wholes, ends, overlap) in zip(blocks, tools, strict=True):
                for found in _hits(ids, bounds, x, doc, passage, own, asked, text, total, few, wholes, ends, overlap, weight, rules):
                    key = (found[0], first + found[1])
                    best[key] = max(best.get(key, found[2:]), found[2:])
            column = part.column("doc_id").to_pylist()
            out = [(column[d], names[q], c, n, told, cosine) for (d, q), (c, n, told, cosine) in best.items()]
            columns = [*zip(*out, strict=True)] or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "common", "n_item", "answered", "cosine"])

    return docs.mapInArrow(run, schema)


def _hits(ids, bounds, x, doc, passage, own, asked, text, total, few, wholes, ends, overlap, weight, rules) -> Iterator[tuple]:
    """(text, item, common, size, answered, cosine) of each passage of some texts that is accepted for one of ``own``."""
    pairs = [np.empty((0, 3), np.int64)]
    if overlap:  # items that the space can't tell
        exact = overlap.candidates(ids, bounds)
        exact[:, 1] = few[exact[:, 1]]
        pairs.append(exact)
    for k in range(0, len(x), 65_536):
        r, q = np.nonzero(x[k : k + 65_536] @ asked.T >= rules.cosine)
        pairs.append(np.stack([doc[k + r], text[q], passage[k + r]], axis=1))
    d, t, p = np.unique(np.concatenate(pairs), axis=0).T
    n, want = np.diff(bounds)[d], wholes.size[t]
    start = bounds[d] + np.maximum(0, p * STEP - want)
    stop = bounds[d] + np.minimum(n, p * STEP + PASSAGE + want)
    common = wholes.common(t, ids, start, stop)
    good = common >= np.ceil(min(rules.verbatim, rules.paraphrase) * want - 1e-9)
    d, t, p, start, stop, common = (z[good] for z in (d, t, p, start, stop, common))
    told = ends.common(t, ids, start, stop) / ends.size[t]
    key = doc * (int(passage.max(initial=0)) + 1) + passage  # in order
    many = int(passage.max(initial=0)) + 1
    for k in range(len(d)):
        size, cosine, mine = len(own[t[k]]), 0.0, int(d[k]) * many + int(p[k])
        at = int(np.searchsorted(key, mine))
        if p[k] < many and at < len(key) and key[at] == mine:
            cosine = float((x[at] @ asked[text == t[k]].T).max(initial=0.0))
        held = np.intersect1d(own[t[k]], ids[start[k] : stop[k]])
        near_enough = cosine >= rules.cosine or weight[held].sum() >= rules.paraphrase * total[t[k]] > 0
        paraphrased = near_enough and common[k] >= rules.paraphrase * size and told[k] >= rules.answered
        if paraphrased or common[k] >= rules.verbatim * size:
            yield int(d[k]), int(t[k]), int(common[k]), size, float(told[k]), cosine


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't found to hold a benchmark item; null doc_ids stay."""
    found = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
