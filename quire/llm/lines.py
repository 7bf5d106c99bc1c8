"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity.

Lines that normalise alike are one node. A line's words are dealt into shares by a hash of the word, and
each share has a SimHash of its own, in which longer words weigh more: a block of the line's signature. A changed word touches the share
that it left and the one that it came to, so by the pigeonhole principle blocks stay equal while fewer
shares are touched than there are. Short lines meet in lists keyed by two of their blocks, long ones,
which have more shares, by one; a line near the limit between two numbers of shares is in both kinds
of lists. Pairs whose whole SimHashes are far apart are left out, and pairs whose pairs of neighbouring letters
differ more than the edits allow; edit similarity confirms the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, finish, folded, linked, run_hashes, signed, slices, word_hashes, written

_SIGNS = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_FOLD = folded(_SIGNS)
#: Most bits in which the SimHashes of two lines that are compared differ; unrelated lines differ in 32 on average.
BITS = 30
#: Up to so many words a line has so many shares and meets others by so many blocks at once; longer lines have 8 shares,
#: from 100 words on twice as many for each doubling, and meet others by one block.
SHARES = ((24, 6, 2),)
#: Edits up to which diagonals are followed.
FEW_EDITS = 12
#: Most words of a band of the table that is followed side by side with others, pairs that are, and bytes of their letters.
MOST_BAND, BAND_PAIRS, BAND_BYTES = 16, 1024, 1 << 21
#: Fewer pairs than this for each word of their bands are faster one by one.
FEW_PAIRS = 16
#: Letters beyond three a word that a key stands on at least, by the blocks that it has.
LEAST_STRENGTH = {1: 8, 2: 1}
#: More lines to verify than this are fetched by a join instead of a broadcast of their places.
BROADCAST_LINES = 500_000


#: Numbers of 64 bits that hold the parities of a line's pairs of letters, and the bit of each pair.
GRAMS = 4
_GRAM = (finish(np.arange(1, 65_537, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8)
_SIGN = np.frombuffer(_SIGNS, np.uint8)


def normal_line(line: str) -> str:
    """Words of a line: A-Z lower-cased, digits made 0, other ASCII signs dropped."""
    return b" ".join(line.encode().translate(_SIGNS).split()).decode()


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance of two strings, None if it is above ``most``.

    Few edits are found by following the farthest places on each diagonal, more by rows of bits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    start = _same(a, b, 0, 0)
    a, b = a[start:], b[start:]
    if not a:
        return len(b)
    goal, far = len(b) - len(a), {}
    for edits in range(min(most, FEW_EDITS) + 1):
        now = {}
        for d in range(-edits, edits + 1):
            i = 0 if not edits else max(far.get(d - 1, -1), far.get(d, -1) + 1, far.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                now[d] = i + _same(a, b, i, i + d)
        if now.get(goal) == len(a):
            return edits
        far = now
    return _by_rows(a, b, most) if most > FEW_EDITS else None


def _by_rows(a: str, b: str, most: int) -> int | None:
    """Edit distance by rows of the table, whose steps up and down are the bits of two numbers."""
    one, two = Counter(a), Counter(b)
    if max((one - two).total(), (two - one).total()) > most:
        return None
    full, places = (1 << len(a)) - 1, {}
    up, down, last = full, 0, 1 << (len(a) - 1)
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    distance = len(a)
    for j, c in enumerate(b, 1):
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        distance += bool(right & last) - bool(left & last)
        if distance - (len(b) - j) > most:
            return None
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(diagonal | right)) & full, right & diagonal
    return distance if distance <= most else None


def _same(a: str, b: str, i: int, j: int) -> int:
    """How far ``a`` from ``i`` on and ``b`` from ``j`` on are alike."""
    n, done, step = min(len(a) - i, len(b) - j), 0, 8
    while done < n:
        to = min(n, done + step)
        if a[i + done : i + to] != b[j + done : j + to]:
            while to - done > 1:
                mid = (done + to) // 2
                if a[i + done : i + mid] == b[j + done : j + mid]:
                    done = mid
                else:
                    to = mid
            return done
        done, step = to, step * 2
    return n


def within(one: list[str], two: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of strings have an edit distance of at most ``most``, many pairs side by side.

    The table of a pair is followed in a band about its diagonal, as wide as ``most`` allows, whose steps up
    and down are the bits of words of 64. Pairs are set so that the bottom of each band meets its string's end in the same
    step; which letters of the band are the next letter of the other string is read off the strings.
    """
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (one, two))
    good = np.zeros(len(m), bool)
    width = (2 * most + 65) // 64
    alone = (m <= most) | (width > MOST_BAND)
    for k in np.flatnonzero(alone).tolist():
        good[k] = edit_distance(one[k], two[k], int(most[k])) is not None
    order = np.flatnonzero(~alone & (np.abs(m - n) <= most))
    if not len(order):
        return good
    letters = [np.frombuffer("".join(x).encode("utf-32-le"), "<u4") for x in (one, two)]
    there = np.zeros(int(max(x.max(initial=0) for x in letters)) + 1, bool)
    for x in letters:
        there[x] = True
    number = np.cumsum(there)
    kind = np.uint8 if number[-1] < 255 else np.uint16 if number[-1] < 65535 else np.uint32
    letters = [number.astype(kind)[x] for x in letters]
    first = [np.cumsum(x) - x for x in (m, n)]
    order = order[_alike(letters, first, m, n, order) <= most[order]]
    order = order[np.lexsort((most[order] - m[order], width[order]))]  # of each width, the longest first
    at = 0
    while at < len(order):
        w, longest = int(width[order[at]]), int((m - most)[order[at]])
        most_pairs = max(1, min(BAND_PAIRS, BAND_BYTES // (longest * 2 + 256 * w)))
        some = order[at : at + most_pairs]
        some = some[width[some] == w]
        at += len(some)
        if len(some) < FEW_PAIRS * w:
            good[some] = [edit_distance(one[k], two[k], int(most[k])) is not None for k in some.tolist()]
            continue
        good[some] = _bands(w, letters, [x[some] for x in first], m[some], n[some], most[some], kind)
    return good


def _alike(letters: list[np.ndarray], first: list[np.ndarray], m: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Letters that one string of a pair has more often than the other, or the other than the one: no more than their edit distance."""
    out, bins = np.zeros(len(which), np.int64), min(int(max(x.max() for x in letters)) + 1, 256)
    for k in range(0, len(which), BAND_PAIRS):
        some, counts = which[k : k + BAND_PAIRS], []
        for flat, start, size in zip(letters, first, (m, n), strict=True):
            each = size[some]
            row = np.repeat(np.arange(len(some)), each)
            at = np.arange(len(row)) + np.repeat(start[some] - (np.cumsum(each) - each), each)
            counts.append(np.bincount(row * bins + flat[at] % bins, minlength=len(some) * bins).reshape(-1, bins))
        more = counts[0] - counts[1]
        out[k : k + BAND_PAIRS] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    return out


def _bands(width: int, letters: list[np.ndarray], first: list[np.ndarray], m: np.ndarray, n: np.ndarray, most: np.ndarray, kind: type) -> np.ndarray:
    """``within`` for pairs in order of falling ``m - most`` whose bands have ``width`` words."""
    band, down_for = 64 * width, m - most
    turn, rest = int(down_for[0]), n - down_for  # steps until the bottoms end, and from there on
    last = turn + int(rest.max())
    pattern = np.zeros((len(m), band + last), kind)
    text = np.full((len(m), last), np.iinfo(kind).max, kind)
    for table, flat, start, size, to in ((pattern, letters[0], first[0], m, band + turn - m), (text, letters[1], first[1], n, turn - down_for)):
        row = np.repeat(np.arange(len(m)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        table[row, place + to[row]] = flat[place + start[row]]
    one, full, top = np.uint64(1), np.uint64(2**64 - 1), np.uint64(63)
    up, down = [], [np.zeros(len(m), np.uint64) for _ in range(width)]
    for k in range(width):
        zeros = np.clip(band - most - 1 - 64 * k, 0, 64)
        up.append(np.where(zeros == 64, np.uint64(0), full << (zeros & 63).astype(np.uint64)))
    distance, limit = most.copy(), most + rest
    begun = np.searchsorted(-down_for, np.arange(last) - turn, "right")  # down_for >= turn - step
    out, who = np.zeros(len(m), bool), np.arange(len(m))
    for step in range(last):
        if step and step % 32 == 0:  # those that can't come back under their limit go
            stay = distance <= limit
            if not stay.all():
                if not stay.any():
                    return out
                begun[step:] = np.cumsum(stay)[begun[step:] - 1]
                who, distance, limit, rest, most, pattern, text = (x[stay] for x in (who, distance, limit, rest, most, pattern, text))
                up, down = [x[stay] for x in up], [x[stay] for x in down]
        c = int(begun[step]) if step < turn else len(who)
        if not c:
            continue
        same = np.packbits(pattern[:c, step + 1 : step + 1 + band] == text[:c, step, None], axis=1, bitorder="little").view("<u8")
        carry, zeros, right, left = None, [], [], []
        for k in range(width):
            x, p, q = same[:, k], up[k][:c], down[k][:c]
            add = x & p
            total = add + p
            over = total < add
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64) if k + 1 < width else None
            zero = (total ^ p) | x | q
            zeros.append(zero)
            right.append(q | ~(zero | p))
            left.append(zero & p)
        if step < turn:
            distance[:c] += (~zeros[-1] >> top).astype(np.int64)
        else:
            bit = band - 2 - (step - turn)
            k, bit, going = bit // 64, np.uint64(bit % 64), step - turn < rest
            distance += np.where(going, (right[k] >> bit & one).astype(np.int64) - (left[k] >> bit & one).astype(np.int64), 0)
        for k in range(width):
            moved = zeros[k] >> one
            if k + 1 < width:
                moved |= zeros[k + 1] << top
            up[k][:c] = left[k] | ~(moved | right[k])
            down[k][:c] = moved & right[k]
    out[who] = distance <= most
    return out


def shares_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of shares, and of blocks in a key, of lines of ``n`` words."""
    shares, blocks = 8 << np.maximum(0, np.log2(np.maximum(n, 1) / 50).astype(np.int64)), np.ones(len(n), np.int64)
    for most, c, together in reversed(SHARES):
        shares, blocks = np.where(n <= most, c, shares), np.where(n <= most, together, blocks)
    return shares, blocks


def _signatures(h: np.ndarray, size: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of lines of ``n`` words ``h`` of ``size`` letters: line, share, SimHash, strength; and each line's SimHash.

    Where one word outweighs all others of its share the SimHash would be that word's hash; there the block
    is the sum of the share's hashes.
    """
    line = np.repeat(np.arange(len(n)), n)
    share = ((h >> np.uint64(40)) % shares[line].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((h, line * int(shares.max(initial=1)) + share))
    line, share, h, weight = line[order], share[order], h[order], np.minimum(size[order], 255).astype(np.uint8)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])  # a word counts once
    line, share, h, weight = line[new], share[new], h[new], weight[new]
    starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (share[1:] != share[:-1])]))
    total = np.add.reduceat(weight, starts, dtype=np.int64)
    strength = np.add.reduceat(np.maximum(weight, 3) - np.uint8(3), starts, dtype=np.int64)
    one_word = np.maximum.reduceat(weight, starts) * np.int64(2) > total
    of = line[starts]
    heads = np.searchsorted(of, np.arange(len(n)))
    lines = np.add.reduceat(total, heads)
    if lines.max() < 2**16:  # sums of four bits side by side in 64
        sums = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)].reshape(-1, 16) * weight.astype(np.uint64)[:, None], starts, axis=0)
        both = [x.view(np.uint16).reshape(-1, 64) for x in (sums, np.add.reduceat(sums, heads, axis=0))]
    else:
        sums = np.add.reduceat(np.unpackbits(h.view(np.uint8)).reshape(-1, 64) * weight[:, None], starts, axis=0, dtype=np.int64)
        both = [sums, np.add.reduceat(sums, heads, axis=0)]
    block, whole = (np.packbits(x > n[:, None] // 2, axis=1).view(np.uint64).ravel() for x, n in zip(both, (total, lines), strict=True))
    block = np.where(one_word, finish(np.add.reduceat(h, starts)), block)
    return of, share[starts], block, strength, whole


def _lanes() -> np.ndarray:
    """The eight bits of each byte as eight 16-bit numbers, in two of 64 bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype("<u2")
    return np.ascontiguousarray(bits).view("<u8")


_LANES = _lanes()


def line_keys(h: np.ndarray, size: np.ndarray, n: np.ndarray, shares: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) of the lists of lines of ``n`` words ``h`` of ``size`` letters, and the SimHash of each line.

    Keys of less than LEAST_STRENGTH, which would bring together all lines that hold some common word,
    take in the next share's block, and if that is too weak as well they are the whole line's SimHash.
    """
    line, share, block, strength, whole = _signatures(h, size, n, shares)
    lines, keys = [], []
    for c in np.unique(shares).tolist():
        there = np.flatnonzero(shares == c)
        at = np.searchsorted(there, line[shares[line] == c])
        table, strong = np.zeros((len(there), c), np.uint64), np.zeros((len(there), c), np.int64)
        mine = shares[line] == c
        table[at, share[mine]], strong[at, share[mine]] = finish(block[mine] + (c * 1_000_003 + share[mine]).astype(np.uint64)), strength[mine]
        blocks = int(together[there[0]])
        for some in combinations(range(c), blocks):
            key, force = np.zeros(len(there), np.uint64), np.zeros(len(there), np.int64)
            for k in some:
                key, force = finish(key + table[:, k]), force + strong[:, k]
            if blocks == 1:
                weak = force < LEAST_STRENGTH[1]
                after = (some[0] + 1) % c
                key, force = np.where(weak, finish(key + table[:, after]), key), force + weak * strong[:, after]
            key = np.where(force < LEAST_STRENGTH[blocks], finish(whole[there] + np.uint64(1)), key)
            lines.append(there)
            keys.append(key)
    line, key = np.concatenate(lines), np.concatenate(keys)
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (key[1:] != key[:-1])])
    return line[new], key[new], whole


def letter_pairs(lines: pa.Array) -> np.ndarray:
    """256 bits a line, as GRAMS numbers: parities of how often each pair of neighbouring letters occurs, by the pair's bit.

    Lines are taken as ``normal_line`` has them with a space before, letters by their first byte. One edit takes
    away two pairs at most and adds two, so two lines differ in four bits an edit at most.
    """
    out = np.zeros((len(lines), GRAMS), np.uint64)
    for k in range(0, len(lines), 4096):
        some = lines.slice(k, 4096).cast(pa.large_string()).fill_null("")
        _, where, data = some.buffers()
        bounds = np.frombuffer(where, np.int64)[some.offset : some.offset + len(some) + 1]
        if bounds[-1] == bounds[0]:
            continue
        raw, bounds = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        sign = _SIGN[raw]
        at = np.flatnonzero((sign != 32) & (raw & 0xC0 != 0x80))
        if not len(at):
            continue
        line, letter = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(bounds))[at], sign[at].astype(np.int32)
        first = (at == bounds[line]) | (sign[at - 1] == 32)
        before = np.concatenate([[32], letter[:-1]]).astype(np.int32)
        last = first & np.concatenate([[False], line[1:] == line[:-1]])  # a word of the line ended before
        bits = np.bincount(line * 256 + _GRAM[np.where(first, 32, before) << 8 | letter], minlength=256 * len(some))
        bits += np.bincount(line[last] * 256 + _GRAM[before[last] << 8 | 32], minlength=256 * len(some))
        out[k : k + len(some)] = np.packbits((bits & 1).astype(np.uint8).reshape(-1, 256), axis=1).view(np.uint64)
    return out


def _occurrences(docs: DataFrame, least_words: int) -> DataFrame:
    """Each line with words: (doc_id, text_id, no, node, sim, chars, keys, g0 to g3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 21):
                lines = pc.split_pattern(part.column("text").fill_null(""), "\n")
                per, flat = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lines.flatten()
                sizes: list[np.ndarray] = []
                h, bounds = word_hashes(flat, _FOLD, sizes)
                size, n = np.concatenate([*sizes, np.empty(0, np.int64)]), np.diff(bounds)
                filled = np.flatnonzero(n)
                if not len(filled):
                    continue
                row = np.repeat(np.arange(len(per)), per)
                no = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                n, sim, at, keys = n[filled], np.zeros(len(filled), np.uint64), [], []
                chars = np.add.reduceat(size, bounds[filled]) + n - 1
                fuzzy = n >= least_words
                if fuzzy.any():
                    place, some, word, letters = np.flatnonzero(fuzzy), n[fuzzy], h[np.repeat(fuzzy, n)], size[np.repeat(fuzzy, n)]
                    own = shares_of(some)
                    for near in (some, np.floor(some * 0.93), np.ceil(some * 1.07)):
                        shares, together = shares_of(near)
                        other = np.ones(len(some), bool) if near is some else (shares != own[0]) & (near >= least_words)
                        if other.any():
                            there = np.repeat(other, some)
                            line, key, whole = line_keys(word[there], letters[there], some[other], shares[other], together[other])
                            at.append(place[other][line])
                            keys.append(key)
                            if near is some:
                                sim[place] = whole
                at, keys = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((at, np.int64), (keys, np.uint64)))
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(filled) + 1))
                take, grams = pa.array(row[filled]), np.zeros((len(filled), GRAMS), np.uint64)
                if fuzzy.any():
                    grams[fuzzy] = letter_pairs(flat.take(pa.array(filled[fuzzy])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(take), part.column("text_id").take(take), pa.array(no[filled], pa.int32()),
                        pa.array(signed(run_hashes(h, bounds[filled], n))), pa.array(signed(sim)), pa.array(chars.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(keys[order]))),
                        *(pa.array(signed(np.ascontiguousarray(grams[:, k]))) for k in range(GRAMS)),
                    ],
                    names=["doc_id", "text_id", "no", "node", "sim", "chars", "keys", *(f"g{k}" for k in range(GRAMS))],
                )

    grams = "".join(f", g{k} long" for k in range(GRAMS))
    return _named(docs).mapInArrow(run, f"doc_id long, text_id long, no int, node long, sim long, chars int, keys array<long>{grams}")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line) for the ``wanted`` places (node, doc_id, text_id, no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, line = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for p in places:
                    node.append(p["node"])
                    line.append(normal_line(lines[p["no"]]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(line, pa.string())], names=["node", "line"])

    small = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    places = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("node", "no")).alias("places"))
    rows = _named(docs).join(F.broadcast(places) if small else places, ["doc_id", "text_id"])
    return rows.select("text", "places").mapInArrow(run, "node long, line string")


def _near(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, la, lb) whose lines have the edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1 << 20, "lb")):
            longer = np.maximum(*(pc.utf8_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("la", "lb")))
            most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            hit = within(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), most)
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def remove_repeated_lines(docs: DataFrame, similarity: float = 0.9, least_words: int = 5) -> DataFrame:
    """``docs`` with ``lines``: struct of kept_text, n_lines, n_removed.

    Of each connected group of lines one occurrence stays, the first by doc_id and place; all others
    are removed. Lines that normalise alike are always linked; lines of ``least_words`` words or more
    also if they meet in a list and 1 - edit distance / longer length, of the normalised lines, is at
    least ``similarity``. Lines that normalise to nothing stay. Null and empty texts have no lines to
    remove. Rows with a null doc_id take no part and stay whole. Rows that share a doc_id are told
    apart by their texts; rows that share both are one document. Other columns pass through and a
    column called ``lines`` is replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(_occurrences(docs.filter("doc_id is not null"), least_words), "lines")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_id", "no")).alias("at"), F.first("sim").alias("sim"), F.first("chars").alias("chars"), *(F.first(f"g{k}").alias(f"g{k}") for k in range(GRAMS)), F.count("*").alias("often"))
    nodes = scratch.keep(nodes, "line-nodes")
    by_list = Window.partitionBy("v")
    listed = rows.select("node", F.explode("keys").alias("v"))
    listed = listed.withColumn("first", F.min("node").over(by_list)).withColumn("last", F.max("node").over(by_list))
    members = listed.filter("first <> last").select("v", "node", "first").distinct()  # of lists with two members at least
    left = nodes.select(F.col("node").alias("a"), F.col("sim").alias("x"), F.col("chars").alias("nx"), *(F.col(f"g{k}").alias(f"x{k}") for k in range(GRAMS)))
    right = nodes.select(F.col("node").alias("b"), F.col("sim").alias("y"), F.col("chars").alias("ny"), *(F.col(f"g{k}").alias(f"y{k}") for k in range(GRAMS)))
    edits = (1 - similarity) * F.greatest("nx", "ny") + 1e-9
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(1, GRAMS)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    possible = (F.abs(F.col("nx") - F.col("ny")) <= edits) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS) & (apart <= 4 * edits)

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "at"), "node")
        texts = scratch.keep(_texts(docs, scratch.keep(wanted.select("node", "at.doc_id", "at.text_id", "at.no"), "line-places")), "line-texts")
        one = texts.select(F.col("node").alias("a"), F.col("line").alias("la"))
        two = texts.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        return _near(pairs.join(two, "b").join(one, "a"), similarity)

    whole = linked(members, left, right, possible, confirmed, once=True)
    parts = whole.select(F.col("id").alias("node"), F.col("component").alias("part"))
    parts = parts.union(whole.select(F.col("component").alias("node"), F.col("component").alias("part")).distinct())
    grouped = nodes.join(parts, "node", "left").filter("often > 1 or part is not null")  # all others occur once and are alone
    grouped = grouped.select("node", "at", F.coalesce("part", "node").alias("part"))
    first = grouped.groupBy("part").agg(F.min("at").alias("first"))
    firsts = scratch.keep(grouped.join(first, "part").select("node", "first"), "line-firsts")
    gone = rows.select("doc_id", "text_id", "no", "node").join(firsts, "node").filter(F.struct("doc_id", "text_id", "no") != F.col("first"))
    gone, _ = written(gone.groupBy("doc_id", "text_id").agg(F.collect_set("no").alias("__gone")), "lines-gone")
    scratch.drop()

    kept = [c for c in docs.columns if c != "lines"]
    texts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"),
    )
    size = gone.agg(F.count("*"), F.sum(F.size("__gone"))).first()
    small = size[0] + (size[1] or 0) <= BROADCAST_LINES
    texts = texts.join(F.broadcast(gone) if small else gone, ["doc_id", "text_id"], "left")
    text = F.coalesce("row.text", F.lit(""))  # sent once, in its row
    lines = F.split(text, "\n")
    gone_or_none = F.coalesce("__gone", F.array().cast("array<int>"))
    stay = F.filter(lines, lambda _, i: ~F.array_contains(gone_or_none, i))
    lines_out = F.struct(
        F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone_or_none).cast("long").alias("n_removed"),
    )
    return texts.withColumn("__lines", lines_out).select("row.*", F.col("__lines").alias("lines"))
