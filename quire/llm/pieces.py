"""SentencePiece BPE ids by a table of prefixes, and their texts.

Every prefix of a text has one last token: the last id of its own encoding. A piece that ends there is
it if and only if it is compatible with the last token of what stands before it, which means that
the two, side by side, are encoded as these two. So one pass over the matches of an automaton fills
a table of last tokens, and the ids are read from it backwards, in time linear in the text. A pair is
tested by going through the merges inside both pieces in the order of their scores: the pair is
incompatible if at some moment the symbols at the seam make a piece whose merge comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

END_ID = 2
SPACE = "▁"  # fixed value: what the model writes for a space
LATIN = "\u0100"  # characters before it are encoded side by side
PAIRS = 500_000  # tested pairs that are kept
_NEVER = float("-inf")
_models: dict[str, PieceEncoder] = {}
_libraries: dict = {}


class PieceEncoder(dict):
    """Ids of whole texts under a SentencePiece BPE model, as little-endian 32-bit integers.

    Merges never join what no piece holds: if no piece has a space mark behind another character, texts
    are cut before the marks, and each distinct cut is encoded once. As a dictionary it holds the ids of
    cuts, about ``most``; ``"\\n"`` before a cut says that it follows a line feed instead of a mark.
    Characters without a piece become byte pieces, or the unknown id where the model has none.
    """

    def __init__(self, path: str, most: int = 200_000):
        import ahocorasick

        self.library, self.most = library(path), most
        own, n = self.library, self.library.get_piece_size()
        bare = [i for i in range(n) if not (own.is_control(i) or own.is_byte(i) or own.is_unknown(i))]
        if any(own.is_unused(i) for i in bare):
            raise ValueError(f"{path} has unused pieces")
        self.score = {own.id_to_piece(i): own.get_score(i) for i in bare}
        self.bytes = {own.id_to_piece(i): i for i in range(n) if own.is_byte(i)}
        self.unknown, self.names = own.unk_id(), {}
        self.steps, self.known, self.size = {}, {}, n + len({c for p in self.score for c in p})
        self.automaton = ahocorasick.Automaton()
        loose = sorted({c for p in self.score for c in p} - set(self.score))  # can merge, but are no pieces
        for t, piece in [*((i, own.id_to_piece(i)) for i in bare), *enumerate(loose, n)]:
            steps = self._merges(piece)
            if steps:
                self.steps[t] = steps
                self.automaton.add_word(piece, (len(piece), t))
                if t >= n:
                    self.names[t] = piece
        self.automaton.make_automaton()
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score) and not any("\n" in p for p in self.score)
        sample = "".join(own.id_to_piece(i) for i in bare[:: max(1, len(bare) // 300)])
        if self.ids(own.normalize(sample)) != own.encode(sample):
            raise ValueError(f"{path} isn't a BPE model whose merges go by the scores of its pieces")

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make ``piece`` of its characters, and the first and last symbol before each and at the end."""
        parts, scores, firsts, lasts = list(piece), [], [piece[0]], [piece[-1]]
        while len(parts) > 1:
            found = [self.score.get(parts[k] + parts[k + 1], _NEVER) for k in range(len(parts) - 1)]
            best = max(found)
            if best == _NEVER:
                return None  # the pieces inside it merge in another way
            k = found.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return [*scores, _NEVER], firsts, lasts

    def compatible(self, a: int, b: int) -> bool:
        """Are the texts of the tokens ``a`` and ``b``, side by side, encoded as ``a, b``?

        The best score goes first, of equal ones the leftmost: merges in ``a``, at the seam, in ``b``.
        """
        (left, _, lasts), (right, firsts, _) = self.steps[a], self.steps[b]
        i = j = 0
        while True:
            seam = self.score.get(lasts[i] + firsts[j], _NEVER)
            if seam > left[i] and seam >= right[j]:
                return False
            if left[i] == right[j] == _NEVER:
                return True
            if left[i] >= right[j]:
                i += 1
            else:
                j += 1

    def ids(self, text: str) -> list[int]:
        """Ids of a text that is normalised already."""
        last: list[int | None] = [None] * (len(text) + 1)
        known, many = self.known, self.size
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            before = last[end - size]
            if before is not None:
                pair = before * many + token
                ok = known.get(pair)
                if ok is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    ok = known[pair] = self.compatible(before, token)
                if not ok:
                    continue
            last[end] = token
        out, end = [], len(text)
        while end:
            token = last[end]
            if token is None or token in self.names:
                end -= 1
                out += self._spelt(text[end])
            else:
                out.append(token)
                end -= len(self.steps[token][1][-1])
        out.reverse()
        return out

    def _spelt(self, sign: str) -> list[int]:
        """A character without a piece, last byte first."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[f"<0x{b:02X}>"] for b in reversed(sign.encode())]

    def __missing__(self, cut: str) -> bytes:
        ids = [*self.ids("\n"), *self.ids(cut[1:])] if cut[0] == "\n" else self.ids(SPACE + cut)
        raw = np.array(ids, "<i4").tobytes()
        if len(cut) <= 64:
            self[cut] = raw
        return raw

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        out: list[bytes] = []
        plain, marked = [], []
        for k, text in enumerate(self.library.normalize(texts)):
            m = text.replace("\n", SPACE + "\n")
            if self.cuts and m[:1] == SPACE and m[-1] != SPACE and SPACE + SPACE not in m:
                plain.append(k)
                marked.append(m[1:])
                out.append(b"")
            else:
                out.append(self._odd(text))
        if plain:
            parts = pc.split_pattern(pa.array(marked, pa.string()), SPACE)
            numbered = parts.flatten().dictionary_encode()
            raw = self._learned(numbered.dictionary.to_pylist())
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            flat, number = np.frombuffer(b"".join(raw), "<i4"), numbered.indices.to_numpy()
            each = size[number]
            ends = np.cumsum(each)
            ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[number] - (ends - each), each)]
            stops = ends[np.cumsum(parts.value_lengths().to_numpy()) - 1].tolist()
            for k, lo, hi in zip(plain, [0, *stops], stops, strict=False):
                out[k] = ids[lo:hi].tobytes()
        return out

    def _odd(self, text: str) -> bytes:
        """Ids of a text with runs of marks."""
        if not self.cuts:
            return np.array(self.ids(text), "<i4").tobytes()
        parts = re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", text)
        return b"".join(self[p[1:]] if p[0] == SPACE and p[1:2] not in ("", SPACE) else np.array(self.ids(p), "<i4").tobytes() for p in parts)

    def _learned(self, cuts: list[str]) -> list[bytes]:
        """Ids of each of distinct ``cuts``: Latin ones are learned side by side, others one by one."""
        if not hasattr(self, "side"):
            self.side = SideBySide(self)
        if len(self) >= self.most:
            self.clear()
        new, column = [c for c in cuts if c not in self], self.side.column
        if "".join(new).translate(column) or max(map(len, new), default=0) > 64:
            new = [c for c in new if len(c) <= 64 and not c.translate(column)]
        self.update(zip(new, self.side.encode(new), strict=True))
        return [self[c] for c in cuts]


class SideBySide:
    """The table of prefixes for many cuts of Latin characters at once: a row a cut, a column a character.

    The automaton is an array (state, character), each state's longest piece and each piece's next
    shorter one at its end are arrays too. Tested pairs stand in a direct-mapped array in front of
    ``PieceEncoder.known``.
    """

    def __init__(self, own: PieceEncoder):
        self.own, self.feed = own, own.ids("\n")[-1]
        pieces = {t: p for t, (_, _, (*_, p)) in own.steps.items() if t not in own.names and all(c == SPACE or c < LATIN for c in p)}
        signs = sorted({p for p in pieces.values() if len(p) == 1})
        self.column = dict.fromkeys(map(ord, [*signs, "\n"]))  # cuts of other characters leave something
        self.number = np.zeros(ord(SPACE) + 1, np.uint8 if len(signs) < 256 else np.uint16)
        self.number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        pieces = {t: p for t, p in pieces.items() if all(ord(c) in self.column for c in p)}
        below: list[dict[str, int]] = [{}]
        node_of = {}
        for t, piece in pieces.items():
            node = 0
            for c in piece:
                if c not in below[node]:
                    below[node][c] = len(below)
                    below.append({})
                node = below[node][c]
            node_of[t] = node
        self.goto = np.zeros((len(below), len(signs) + 1), np.int32)
        self.longest = np.full(len(below), -1, np.int32)
        self.longest[list(node_of.values())] = list(node_of)
        self.shorter, self.length = np.full(own.size, -1, np.int32), np.ones(own.size, np.int32)
        fail, queue = [0] * len(below), [0]
        for node in queue:  # it grows: breadth first
            if node:
                self.goto[node] = self.goto[fail[node]]
            for c, child in below[node].items():
                n = self.number[ord(c)]
                fail[child] = int(self.goto[node, n])
                self.goto[node, n] = child
                rest = self.longest[fail[child]]
                if self.longest[child] < 0:
                    self.longest[child] = rest
                else:
                    self.shorter[self.longest[child]] = rest
                queue.append(child)
        for t, piece in pieces.items():
            self.length[t] = len(piece)
        self.pairs = np.full(1 << 20, -1, np.int64)
        self.fits = np.zeros(1 << 20, bool)

    def _compatible(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        pair = before.astype(np.int64) * self.own.size + token
        slot = (pair * 0x9E3779B1 >> 13) & (len(self.pairs) - 1)
        new = np.unique(pair[self.pairs[slot] != pair])
        found = self.fits[slot]
        if len(new):
            known, many = self.own.known, self.own.size
            if len(known) >= PAIRS:
                known.clear()
            value = np.empty(len(new), bool)
            for k, p in enumerate(new.tolist()):
                ok = known.get(p)
                if ok is None:
                    ok = known[p] = self.own.compatible(*divmod(p, many))
                value[k] = ok
            at = np.flatnonzero(self.pairs[slot] != pair)
            found[at] = value[np.searchsorted(new, pair[at])]
            self.pairs[slot[at]], self.fits[slot[at]] = pair[at], found[at]
        return found

    def encode(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut; it has no characters but those of ``column``, and a line feed at its start only."""
        out: list[bytes] = [b""] * len(cuts)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        feeds = np.fromiter((c[0] == "\n" for c in cuts), bool, len(cuts))
        size += ~feeds
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), 32_768):
            rows = order[lo : lo + 32_768]
            signs = np.array([cuts[k] if feeds[k] else SPACE + cuts[k] for k in rows.tolist()])
            for k, raw in zip(rows.tolist(), self._some(signs, size[rows]), strict=True):
                out[k] = raw
        return out

    def _some(self, cuts: np.ndarray, size: np.ndarray) -> list[bytes]:
        """``cuts`` with their marks, the longest first."""
        signs = cuts.view(np.uint32).reshape(len(cuts), -1)
        table = np.full((len(cuts), signs.shape[1] + 1), -1, np.int32)
        state = np.zeros(len(cuts), np.int32)
        for k in range(signs.shape[1]):
            n = int(np.searchsorted(-size, -k, "left"))  # cuts of more than k characters
            state = self.goto[state[:n], self.number[signs[:n, k]]]
            token, left = self.longest[state], np.arange(n)
            if not k:
                feeds = np.flatnonzero(signs[:, 0] == 10)
                table[feeds, 1] = self.feed
                left = np.flatnonzero(signs[:, 0] != 10)
            while len(left):
                now = token[left]
                if (now < 0).any():
                    raise ValueError("a prefix has no last token")
                start = k + 1 - self.length[now]
                before = table[left, start]
                ok = (start == 0) | (before == self.feed)
                test = np.flatnonzero(~ok)
                ok[test] = self._compatible(before[test], now[test])
                table[left[ok], k + 1] = now[ok]
                left = left[~ok]
                token[left] = self.shorter[token[left]]
        ids = np.full(table.shape, -1, np.int32)
        row, at, step = np.arange(len(cuts)), size.copy(), table.shape[1]
        while len(row):  # from the end: the last id goes to the right
            step -= 1
            now = table[row, at[row]]
            ids[row, step] = now
            at[row] -= self.length[now]
            row = row[at[row] > 0]
        there = ids >= 0
        ends = np.cumsum(there.sum(1)) * 4
        raw = ids[there].astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def library(path: str):
    """The library's own processor, one a worker process and file."""
    from sentencepiece import SentencePieceProcessor

    if path not in _libraries:
        _libraries[path] = SentencePieceProcessor(model_file=path)
    return _libraries[path]


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    if path not in _models:
        _models[path] = PieceEncoder(path)
    return _models[path]


def encoded(docs: DataFrame, model: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids of the whole text, then ``end_id``.

    Null texts count as empty and have the end id only. Rows are encoded one by one, without a shuffle:
    null doc_ids and repeated rows stay as they are, an empty table gives no rows, other columns are
    ignored. A task holds one slice of texts and a bounded number of encoded words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(model).encode, np.array([end_id], "<i4").tobytes()
        for batch in (x for b in batches for x in slices(b, 1 << 21)):
            raw = [ids + end for ids in encode(batch.column("text").fill_null("").to_pylist())]
            flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the text that the library reads from the ids.

    Null ids count as none and give an empty text; null ids inside a list are left out. Repeated rows
    stay, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = library(model).decode
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("ids").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
                some = batch.slice(at, to - at)
                texts = decode(some.column("ids").to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                at = to

    ids = F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda x: x.isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")
