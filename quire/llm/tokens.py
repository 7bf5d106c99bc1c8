"""Token ids as canonical, length-limited Huffman code in independent blocks.

File format: a folder with two Parquet tables. ``codebook`` has a row per id that occurs (id, bits):
the canonical code follows from the lengths. ``blocks`` has a row per block of whole documents:
``start`` (ids of all documents before the block), ``n`` ids, ``payload`` (codes, most significant
bit first), ``checkpoints`` (the bit where each run of ``STRIDE`` ids begins) and ``docs`` (doc_id,
start, n). Blocks don't depend on each other, and with its checkpoints a block is decoded by one
table look-up per id for all runs side by side.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, scratch, slices

END_ID = 2
MOST_BITS = 20
STRIDE = 1024
BLOCK_IDS = 65_536
#: Pieces that a worker keeps, and bytes of the texts that it encodes at once.
MOST_PIECES, TEXT_BYTES = 500_000, 1 << 22

# White space other than space and line feed.
_OTHER_SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that aren't words parted by single spaces or line feeds, or that hold a mark used below.
_NOT_PLAIN = rf"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\x01{_OTHER_SPACE}]"
#: A word with a full stop or comma at its end.
_SIGNED_WORD = rf"\A\x00?[{''.join(chr(c) for c in range(0x370) if chr(c).isalpha())}]+[.,]\z"
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]
_tokenizers: dict[str, Encoder] = {}


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library.

    Byte-level tokenizers with the usual pattern never join over the start of " word" or a line feed,
    so texts are cut there, Arrow numbers the distinct pieces of many texts at once, and each is encoded
    once and kept, which gives the ids of the whole texts. A piece of letters only, but for a full
    stop or comma at its end, is one word to the tokenizer (and one more for the sign); such words go to
    its BPE model directly. Texts with other white space, marks (\\0, \\1) or special tokens, and all texts
    if the file has another pre-tokenizer or a normaliser, are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = MOST_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.end = np.array([end_id], "<u4").tobytes()
        rules = json.loads(self.tokenizer.to_str())
        step = rules["pre_tokenizer"] or {}
        self.cuts = rules["normalizer"] is None and rules["model"]["type"] == "BPE"
        self.cuts &= (step.get("type"), step.get("use_regex"), step.get("add_prefix_space")) == ("ByteLevel", True, False)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_NOT_PLAIN, *(re.escape(t) for t in special)])
        signs = _byte_signs()
        self.model, self.space = self.tokenizer.model, signs[32]
        self.signs = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0x370)}
        self.marks = {c: self._ids([c])[0] for c in ".,"}
        self.pieces = self._first_pieces()

    def _first_pieces(self) -> dict[str, bytes]:
        return {"\1": self.end, "\n": self._ids(["\n"])[0]}

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text and the end id as little-endian unsigned 32-bit integers; null texts are empty."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.whole) if self.cuts else pa.array([True] * len(texts), pa.bool_())
        out: list[bytes | None] = [None] * len(texts)
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(at.tolist(), self._ids(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = ids + self.end
        at = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if len(at):
            marked = pc.replace_substring(texts.take(pa.array(at)), "\n", " \n \0")  # \0: no space before the piece; \1: end
            parts = pc.split_pattern(pc.binary_join_element_wise("\0", marked, " \1", ""), " ")
            numbered = parts.flatten().dictionary_encode()
            raw = self._pieces(numbered.dictionary)
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            flat, number = np.frombuffer(b"".join(raw), "<u4"), numbered.indices.to_numpy()
            each = size[number]
            ends = np.cumsum(each)
            kind = np.int32 if max(ends[-1], len(flat)) < 2**31 else np.int64
            at_id = np.repeat(((np.cumsum(size) - size)[number] - (ends - each)).astype(kind), each)
            at_id += np.arange(ends[-1], dtype=kind)
            ids = flat[at_id]
            stops = ends[np.cumsum(parts.value_lengths().to_numpy()) - 1].tolist()
            for i, a, b in zip(at.tolist(), [0, *stops], stops, strict=False):
                out[i] = ids[a:b].tobytes()
        return out

    def _pieces(self, wanted: pa.Array) -> list[bytes]:
        """Ids of the distinct pieces; a word is kept once, whatever sign follows it."""
        signed = pc.match_substring_regex(wanted, _SIGNED_WORD)
        numbered = pc.if_else(signed, pc.utf8_slice_codeunits(wanted, 0, -1), wanted).dictionary_encode()
        names, pieces, rest = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self.pieces, []
        tokenize, space, signs = self.model.tokenize, self.space, self.signs
        for name in [x for x in names if x not in pieces]:
            if name.isalpha() and name.isascii():
                word = space + name
            else:
                bare = name[1:] if name[0] == "\0" else name
                if not (bare.isalpha() and (bare.isascii() or max(bare) < "\u0370")):  # letters to any Unicode version
                    rest.append(name)
                    continue
                word = bare.translate(signs) if bare is not name else space + bare.translate(signs)
            ids = [t.id for t in tokenize(word)]
            pieces[name] = _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            pieces.update(zip(some, self._ids([x[1:] if x[0] == "\0" else f" {x}" for x in some]), strict=True))
        found = [pieces[x] for x in names]
        if len(pieces) > self.most:  # those of these texts stay
            self.pieces = self._first_pieces() | dict(zip(names[: self.most // 2], found, strict=False))
        found = [found[k] for k in numbered.indices.to_numpy().tolist()]
        at = np.flatnonzero(signed.to_numpy(zero_copy_only=False))
        stops = pc.ends_with(wanted, ".").to_numpy(zero_copy_only=False)[at]
        for k, stop in zip(at.tolist(), stops.tolist(), strict=True):
            found[k] += self.marks["." if stop else ","]
        return found

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder a worker process, file and end id."""
    key = f"{end_id} {path}"
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(path, end_id)
    return _tokenizers[key]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, at, ids, counts) in ascending order of doc_id, nulls first, ties by text.

    ``part`` numbers the range partitions, ``at`` is the ids before the document in its part, and
    ``ids`` holds little-endian 16-bit ids if all fit, else 32-bit ones, with a leading byte 2 or 4.
    A part ends with a row of its own, which isn't a document: ``at`` is all its ids, and ``counts`` how often
    each id occurs in it, as little-endian 64-bit integers. Documents have null ``counts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(vocabulary, end_id).batch, TaskContext.get().partitionId(), 0
        total = np.zeros(1, "<i8")
        for batch in (x for b in batches for x in slices(b, TEXT_BYTES)):
            ids, starts, raws = [], [], encode(batch.column("text"))
            _add(total, np.bincount(np.frombuffer(b"".join(raws), "<u4")))
            for raw in raws:
                x = np.frombuffer(raw, "<u4")
                ids.append(b"\2" + x.astype("<u2").tobytes() if x.max() < 65536 else b"\4" + x.tobytes())
                starts.append(at)
                at += len(x)
            yield _packed([part] * len(ids), batch.column("doc_id"), starts, ids, [None] * len(ids))
        if at:
            yield _packed([part], [None], [at], [None], [total.tobytes()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, _TOKENIZED)


_TOKENIZED = "part int, doc_id long, at long, ids binary, counts binary"


def _packed(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "doc_id", "at", "ids", "counts"])


def _add(total: np.ndarray, counts: np.ndarray) -> None:
    if len(counts) > len(total):
        total.resize(len(counts), refcheck=False)
    total[: len(counts)] += counts


def _unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)


def global_counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs in all parts of ``tokenized`` rows; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, "<i8")
        for batch in batches:
            for raw in batch.column("counts"):
                _add(total, np.frombuffer(raw.as_buffer(), "<i8"))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    found = rows.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in found.collect()}


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Bits of each id's code: optimal under ``most`` bits, by package-merge."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n < 2:
        return dict.fromkeys(ids, 1)
    if n > 2**most:
        raise ValueError(f"{n} ids don't fit codes of {most} bits")
    leaves = np.array([counts[i] for i in ids], np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        levels.append(order < n)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    bits, take = np.zeros(n, int), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        bits[:k] += 1
        take = 2 * (take - k)
    return dict(zip(ids, bits.tolist(), strict=True))


class Code:
    """Canonical code of the given lengths: codes by length, then id."""

    def __init__(self, lengths: dict[int, int]):
        self.ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        self.bits = np.array([lengths[i] for i in self.ids.tolist()], np.int64)
        self.width = int(self.bits.max(initial=1))
        steps = 1 << (self.width - self.bits)
        self.codes = (np.cumsum(steps) - steps) >> (self.width - self.bits)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload, and the bit where each run of STRIDE ids begins."""
        if not hasattr(self, "by_id"):
            self.by_id = np.zeros((int(self.ids.max(initial=0)) + 1, 2), np.int64)
            self.by_id[self.ids, 0], self.by_id[self.ids, 1] = self.codes, self.bits
        code, bits = self.by_id[ids, 0], self.by_id[ids, 1]
        ends = np.cumsum(bits)
        starts, total = ends - bits, int(ends[-1]) if len(ends) else 0
        shifted, byte = code << (32 - bits - (starts & 7)), starts >> 3
        out = np.zeros(total // 8 + 5)
        for k in range(4):  # codes don't overlap, so adding is joining
            out += np.bincount(byte + k, (shifted >> (24 - 8 * k)) & 255, len(out))
        return out[: (total + 7) // 8].astype(np.uint8).tobytes(), starts[::STRIDE]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """Ids of each block; all runs of all blocks advance together, one table look-up an id."""
        if not hasattr(self, "table"):
            self.table = np.repeat(self.ids, 1 << (self.width - self.bits)).astype(np.uint32)
            self.steps = np.repeat(self.bits, 1 << (self.width - self.bits)).astype(np.uint8)
            if len(self.table) < 1 << self.width:  # a single id uses half the code space
                self.table, self.steps = (np.resize(x, 1 << self.width) for x in (self.table, self.steps))
        data = np.frombuffer(b"".join(p + bytes(8) for p in payloads), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(p) + 8 for p in payloads])])[:-1] * 8
        at = np.concatenate([c + b for c, b in zip(checkpoints, base, strict=True)])
        left = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n in counts])
        most, order = int(left.max(initial=0)), np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        out = np.zeros((len(at), most), np.uint32)
        words = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
        shift, active = np.uint32(32 - self.width), len(at)
        for step in range(most):
            while active and left[active - 1] <= step:
                active -= 1
            now = at[:active]
            key = (words[now >> 3] << (now & 7).astype(np.uint32)) >> shift
            out[:active, step] = self.table[key]
            at[:active] += self.steps[key]
        rows, result, k = np.argsort(order, kind="stable"), [], 0
        for n in counts:
            runs = -(-n // STRIDE)
            result.append(out[rows[k : k + runs]].reshape(-1)[:n])
            k += runs
        return result


_BLOCKS = "start long, n int, payload binary, checkpoints array<long>, docs array<struct<doc_id:long,start:long,n:int>>"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, most_bits: int = MOST_BITS) -> None:
    """Write every whole text of ``docs`` (doc_id, text) to ``folder`` in ascending order of doc_id.

    Null texts count as empty; a document always has its end id. Repeated rows and ids are written
    as often as they occur; other columns are ignored; an empty table gives empty files. The ids are
    kept for the second pass as a scratch table in the shared folder. Brought to the driver: counts
    by id (bounded by the vocabulary) and one total per range partition.
    """
    spark = docs.sparkSession
    place = scratch(spark, "ids")
    tokenized(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(place)
    rows = spark.read.schema(_TOKENIZED).parquet(place)
    lengths = code_lengths(global_counts(rows), most_bits)
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    totals = rows.filter("counts is not null").select("part", F.col("at").alias("n")).orderBy("part").collect()
    offsets = dict(zip((r.part for r in totals), np.cumsum([0, *(r.n for r in totals)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((lengths, offsets))  # bounded by vocabulary and partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = Code(shared.value[0]), shared.value[1]
        for batch in batches:
            out, held, index, total = [], [], [], 0
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "at", "ids"))
            for k, (part, doc_id, at, raw) in enumerate(zip(*columns, strict=True)):
                ids = _unpacked(raw)
                held.append(ids)
                total += len(ids)
                index.append({"doc_id": doc_id, "start": base[part] + at, "n": len(ids)})
                if total >= BLOCK_IDS or k == batch.num_rows - 1:
                    x = np.concatenate(held)
                    payload, points = code.encode(x)
                    out.append((index[0]["start"], len(x), payload, points, index))
                    held, index, total = [], [], 0
            columns = [*zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES, strict=True)], names=["start", "n", "payload", "checkpoints", "docs"])

    rows.filter("counts is null").select("part", "doc_id", "at", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    deleted(spark, place)


_BLOCK_TYPES = [
    pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()),
    pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])),
]


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) as read from the files; with ``digest`` ids_crc32 for ids."""
    book = spark.read.schema("id long, bits int").parquet(f"{folder}/codebook")
    lengths = {r.id: r.bits for r in book.collect()}
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                some = batch.slice(k, 32)
                payloads, points, counts, docs = (some.column(c).to_pylist() for c in ("payload", "checkpoints", "n", "docs"))
                out = []
                for ids, index in zip(code.decode(payloads, [np.array(p, np.int64) for p in points], counts), docs, strict=True):
                    at = 0
                    for d in index:
                        x = ids[at : at + d["n"]].astype("<u4")
                        out.append((d["doc_id"], d["start"], d["n"], zlib.crc32(x.tobytes()) if digest else x.tolist()))
                        at += d["n"]
                columns = [*zip(*out, strict=True)] or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), last[1]), strict=True)],
                    names=["doc_id", "start", "n_tokens", last[0]],
                )

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(run, schema)
